"""The daily count kept up to date from a stream of the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def daily_count_stream(stream: DataFrame, ts: str, of: str, name: str, keys: Sequence[str] = (),
                       lateness: str = "1 day") -> DataFrame:
    """`daily_count` on a stream: one row per day (and key) once the watermark has passed it.

    State holds one counter per open day and key; days older than the allowed
    lateness are emitted and dropped.
    """
    marked = stream.withWatermark(ts, lateness)
    counted = marked.groupBy(F.window(ts, "1 day"), *keys).agg(F.count(of).alias(name))
    return counted.select(*keys, F.to_date("window.start").alias("day"), name)

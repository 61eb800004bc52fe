"""Writing slices and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def save_slice(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = (), read_back: bool = False
) -> DataFrame | None:
    """Write a slice as parquet; with `read_back` go on from the written table.

    Reading back cuts the lineage at a table that outlives any executor.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if read_back else None


def save_monthly_slice(df: DataFrame, path: str, ts: str = "ts", mode: str = "errorifexists") -> None:
    """Slice partitioned by calendar month, so later date filters prune folders.

    Rows are rebalanced by month before the write, so a month is a few files;
    adaptive execution splits a busy month over several tasks.
    """
    monthly = df.withColumn("month", F.date_format(F.col(ts), "yyyy-MM"))
    save_slice(monthly.hint("rebalance", "month"), path, mode, ["month"])


def save_report(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """Report table as CSV with a header. `single_file` is for tables of a few rows."""
    out = df.repartition(1) if single_file else df
    out.write.mode(mode).option("header", True).csv(path)

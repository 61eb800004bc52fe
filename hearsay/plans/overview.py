"""Search-interest overview: summary, monthly trend and distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hearsay.operators.aggregates import monthly_mean
from hearsay.operators.quality import histogram, series_summary
from hearsay.operators.reshape import melt


def series_overview(wide: DataFrame, brands: Sequence[str], date: str = "Date", bin_width: float = 1.0) -> dict[str, DataFrame]:
    """`summary` per brand, `monthly` means, and a `histogram` with fixed bins."""
    long = melt(wide, [date], brands, "brand", "normalized_count")
    return {
        "summary": series_summary(long, "brand", "normalized_count"),
        "monthly": monthly_mean(long, date, "brand", "normalized_count", "normalized_count"),
        "histogram": histogram(long, "normalized_count", bin_width, ["brand"]),
    }

"""Audits and profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def profile_schema(df: DataFrame) -> DataFrame:
    """One row per column with its type, position, and the table's row and column counts."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(t).alias("type"))
        for i, (n, t) in enumerate(df.dtypes)
    ])
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.explode(fields).alias("f"), "n_rows").select(
        "f.*", "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, one pass, one output column per input column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in (cols or df.columns)])


def null_nan_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """As `null_counts`; in floating-point columns NaN counts too."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}

    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()

    return df.agg(*[F.count_if(missing(c)).alias(c) for c in (cols or df.columns)])


def describe(df: DataFrame, col: str, keys: Sequence[str] = (), quartiles: bool = False) -> DataFrame:
    """Count, mean, sample deviation, min, max; quartiles through a bounded sketch."""
    aggs = [
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("stddev"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    ]
    if quartiles:
        q = F.percentile_approx(col, [0.25, 0.5, 0.75], 10_000)
        aggs += [q[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return df.groupBy(*keys).agg(*aggs)


def series_summary(long: DataFrame, key: str | Sequence[str], value: str) -> DataFrame:
    """Mean, min, max and exact interpolated quartiles per series.

    For daily series: a group has at most one value per day, so the exact
    percentile's buffer is bounded by the calendar.
    """
    keys = [key] if isinstance(key, str) else list(key)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return long.groupBy(*keys).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), q.alias("_q")
    ).select(*keys, "min", "max", "mean", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))


def histogram(df: DataFrame, value: str, width: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per bin of a fixed width; `bin` is the lower edge."""
    edge = F.floor(F.col(value) / F.lit(width)) * F.lit(width)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, edge.alias("bin")).agg(F.count(F.lit(1)).alias("count"))

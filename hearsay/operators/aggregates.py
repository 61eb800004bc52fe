"""Counts, sums, means, shares and ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.columns import as_col, month_label, ratio


def count_by(df: DataFrame, key: str | Sequence[str], name: str = "count") -> DataFrame:
    """Rows per key, most frequent first, ties by key."""
    keys = [key] if isinstance(key, str) else list(key)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return counted.orderBy(F.desc(name), *keys)


def daily_count(df: DataFrame, ts: str, of: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Non-null `of` values per calendar day (and key)."""
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(of).alias(name))


def daily_sum(df: DataFrame, date: str, cols: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums per day: `cols` maps source column to output name. Whole-number sums are long."""
    return df.groupBy(*keys, F.to_date(date).alias("day")).agg(*[F.sum(c).alias(n) for c, n in cols.items()])


def daily_mean(df: DataFrame, ts: str, value: str, name: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.avg(value).alias(name))


def monthly_sum(daily: DataFrame, day: str, cols: Sequence[str], require_all: bool = False) -> DataFrame:
    """Month totals of daily counts with a `2021-1` label, in date order.

    One pass over the daily rows. `require_all` leaves out months in which a
    column has no value, as an inner join of one total per column would.
    """
    out = (
        daily.where(F.col(day).isNotNull())
        .groupBy(F.trunc(day, "month").alias("month"))
        .agg(*[F.sum(c).alias(c) for c in cols])
    )
    if require_all:
        out = out.dropna(subset=list(cols))
    return out.select(month_label("month").alias("dt_month_year"), "month", *cols).orderBy("month")


def monthly_mean(df: DataFrame, date: str, key: str, value: str, name: str = "mean") -> DataFrame:
    """Mean per key and month, labelled by the month's last day."""
    return df.groupBy(key, F.last_day(date).alias("month_end")).agg(F.avg(value).alias(name))


def author_metrics(df: DataFrame, author: str, text: str, score: str, sentiment: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, author).agg(
        F.count(text).alias("number_of_comments"),
        F.avg(score).alias("average_score"),
        F.avg(sentiment).alias("average_sentiment"),
    )


PERSONA_METRICS = ["average_score", "average_sentiment", "number_of_comments"]


def persona(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every author weighs the same: averages of per-author figures."""
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in PERSONA_METRICS])


def co_mention_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("count"))


def total(df: DataFrame, col: str, how: str = "sum") -> DataFrame:
    fn = {"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[how]
    return df.agg(fn(col).alias(f"{how}_{col}"))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def group_totals(df: DataFrame, key: str | Sequence[str], value: str, name: str = "total_count") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.sum(value).alias(name))


def share_of_total(df: DataFrame, value: str, digits: int | None = 0, name: str = "pct") -> DataFrame:
    """Percent of the grand total, rounded half to even.

    The total is a scalar subquery: no row leaves its partition for it.
    """
    whole = df.agg(F.sum(value)).scalar()
    pct = F.try_divide(F.col(value) * F.lit(100.0), whole)
    return df.withColumn(name, pct if digits is None else F.bround(pct, digits))


def ratio_of(df: DataFrame, numerator: str, denominator: str, name: str = "ratio",
             digits: int | None = None, scale: float = 1.0) -> DataFrame:
    return df.withColumn(name, ratio(numerator, denominator, digits, scale))


def text_length_stats(df: DataFrame, tokens: str | Column) -> DataFrame:
    n = F.size(as_col(tokens))
    return df.agg(
        F.count(n).alias("count"),
        F.avg(n).alias("mean"),
        F.stddev_samp(n).alias("stddev"),
        F.min(n).cast("bigint").alias("min"),
        F.max(n).cast("bigint").alias("max"),
    )

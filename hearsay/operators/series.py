"""Daily series as window expressions.

Input is long: one row per series and day. A window partition is one series,
so its size is bounded by the calendar however large the log behind it is;
different series run in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.session import ship_package

Z95 = 1.959963984540054
Z99 = 2.5758293035489004


def over_days(keys: Sequence[str], day: str):
    return Window.partitionBy(*keys).orderBy(day)


def _per_row(df: DataFrame, fn, schema: str) -> DataFrame:
    """Apply `fn(row) -> list of tuples` to every aggregated row, in batches."""
    ship_package(df.sparkSession)
    names = [part.split()[0].strip("`") for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [t for row in batch.itertuples(index=False) for t in fn(row)]
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def _key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def regularize(df: DataFrame, keys: Sequence[str], day: str, value: str, fill: float | None = None) -> DataFrame:
    """Every day from a series' first to its last, absent days null or `fill`."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(day))
    out = days.join(df.select(*keys, day, value), [*keys, day], "left")
    return out if fill is None else out.fillna(fill, [value])


def rolling_stats(df: DataFrame, keys: Sequence[str], day: str, value: str, n: int = 10) -> DataFrame:
    """Mean and sample deviation of the last n rows; null until n values exist."""
    w = over_days(keys, day).rowsBetween(-(n - 1), 0)
    full = F.count(value).over(w) == n
    return df.withColumns({
        "rolling_mean": F.when(full, F.avg(value).over(w)),
        "rolling_std": F.when(full, F.stddev_samp(value).over(w)),
    })


def difference(df: DataFrame, keys: Sequence[str], day: str, value: str, order: int = 1, out: str | None = None,
               lag: int = 1) -> DataFrame:
    """The value minus the one `lag` rows before, applied `order` times."""
    out = out or f"{value}_diff"
    w = over_days(keys, day)
    df = df.withColumn(out, F.col(value))
    for _ in range(order):
        df = df.withColumn(out, F.col(out) - F.lag(out, lag).over(w))
    return df


def impute_neighbors(df: DataFrame, keys: Sequence[str], day: str, value: str, k: int = 2) -> DataFrame:
    """A null becomes the mean of the values up to k rows before and after."""
    w = over_days(keys, day).rowsBetween(-k, k)
    return df.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(w)))


def undifference(fc: DataFrame, anchors: DataFrame, keys: Sequence[str], day: str, value: str, order: int,
                 out: str | None = None) -> DataFrame:
    """Undo differencing of a forecast by cumulative sums.

    `anchors` has one row per series: `last` and, for order 2, `before_last`,
    the final observed values the forecast continues from.
    """
    out = out or f"{value}_level"
    w = over_days(keys, day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = fc.join(anchors, list(keys))
    step: Column = F.col(value)
    if order == 2:
        df = df.withColumn("_step", F.col("last") - F.col("before_last") + F.sum(value).over(w))
        step = F.col("_step")
    elif order != 1:
        raise ValueError("order must be 1 or 2")
    return df.withColumn(out, F.col("last") + F.sum(step).over(w)).drop("_step", "last", "before_last")


def last_values(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """The last value of each series and the one before it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    ranked = df.select(*keys, F.col(value).alias("_v"), F.row_number().over(w).alias("_r")).where("_r <= 2")
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col("_v"))).alias("last"),
        F.max(F.when(F.col("_r") == 2, F.col("_v"))).alias("before_last"),
    )


def tail_split(df: DataFrame, keys: Sequence[str], day: str, n: int) -> tuple[DataFrame, DataFrame]:
    """All but the last n rows of each series, and those n rows."""
    w = Window.partitionBy(*keys).orderBy(F.desc(day))
    ranked = df.withColumn("_r", F.row_number().over(w))
    return ranked.where(F.col("_r") > n).drop("_r"), ranked.where(F.col("_r") <= n).drop("_r")


def acf(df: DataFrame, keys: Sequence[str], day: str, value: str, nlags: int | None = None) -> DataFrame:
    """Autocorrelation per lag, all of them unless `nlags` says fewer, with white-noise and Bartlett bands.

    One row per series holds its days; all sums of lagged products come from one
    Fourier transform of them, its squared size and the way back. Null values
    are left out before, so lags count the days that have one.
    """
    keys = list(keys)
    held = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(day).alias("_day"), F.col(value).cast("double").alias("_v")))).alias("_s"))
    rows = held.select(*keys, F.col("_s._v").alias("days"))

    def lagged(row):
        sums = lagged_products(np.asarray(row.days, float))
        few = sums[: len(sums) if nlags is None else nlags + 1]
        return [(*row[: len(keys)], len(sums), k, float(c / sums[0]) if sums[0] else None) for k, c in enumerate(few)]

    out = _per_row(rows, lagged, f"{_key_schema(df, keys)}, _n bigint, lag int, acf double")
    before = over_days(keys, "lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    root = F.sqrt(F.col("_n").cast("double"))
    return out.select(
        *keys, "lag", "acf",
        (F.lit(Z95) / root).alias("bound95"),
        (F.lit(Z99) / root).alias("bound99"),
        F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(F.lit(Z95) * F.sqrt((1 + 2 * squares) / F.col("_n"))).alias("bartlett95"),
    )


def lagged_products(values: np.ndarray) -> np.ndarray:
    """For each lag the sum of products of the centred values that many places apart."""
    n = len(values)
    centred = values - values.mean()
    if not np.abs(centred).max() > 1e-12 * np.abs(values).max(initial=0):
        return np.zeros(n)  # a constant series has none
    size = 1 << (2 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(centred, size)) ** 2
    return np.fft.irfft(power, size)[:n]


def decompose(df: DataFrame, keys: Sequence[str], day: str, value: str, period: int = 7) -> DataFrame:
    """Additive trend, seasonal and residual parts.

    The trend is the centred moving average (half weights at the ends for an
    even period); the seasonal part is the mean detrended value of the phase,
    shifted so that the phases average to zero.
    """
    w = over_days(keys, day)
    half = period // 2
    span = w.rowsBetween(-half, half)
    full = F.count(value).over(span) == 2 * half + 1
    if period % 2:
        mean = F.avg(value).over(span)
    else:
        ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        mean = (F.sum(value).over(w.rowsBetween(-half + 1, half - 1)) + ends) / period
    df = df.withColumn("trend", F.when(full, mean)).withColumn("phase", (F.row_number().over(w) - 1) % period)
    df = df.withColumn("_detrended", F.col(value) - F.col("trend"))
    by_phase = df.groupBy(*keys, "phase").agg(F.avg("_detrended").alias("_raw"))
    centre = Window.partitionBy(*keys)
    by_phase = by_phase.select(*keys, "phase", (F.col("_raw") - F.avg("_raw").over(centre)).alias("seasonal"))
    out = df.join(by_phase, [*keys, "phase"])
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_detrended")


def residual_report(df: DataFrame, keys: Sequence[str], resid: str) -> DataFrame:
    """Count, mean, deviation, min, exact quartiles and max of a residual series."""
    q = F.percentile(resid, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return df.groupBy(*keys).agg(
        F.count(resid).alias("count"), F.avg(resid).alias("mean"), F.stddev_samp(resid).alias("std"),
        F.min(resid).alias("min"), q.alias("_q"), F.max(resid).alias("max"),
    ).select(*keys, "count", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))], "max")


def residual_density(df: DataFrame, keys: Sequence[str], resid: str, points: int = 25) -> DataFrame:
    """Gaussian kernel density at evenly spaced points, Scott's bandwidth.

    One aggregation with a sum per grid point; the grid reaches half a range
    beyond the data on both sides. A constant series has null densities.
    """
    present = df.where(F.col(resid).isNotNull())
    whole = Window.partitionBy(*keys)
    lo, hi, n = F.min(resid).over(whole), F.max(resid).over(whole), F.count(resid).over(whole)
    sized = present.select(
        *keys, F.col(resid).alias("_x"), n.alias("_n"), (lo - (hi - lo) / 2).alias("_from"),
        ((hi - lo) * 2 / (points - 1)).alias("_step"),
        (F.stddev_samp(resid).over(whole) * F.pow(n.cast("double"), F.lit(-0.2))).alias("_h"),
    )
    z = [F.try_divide(F.col("_from") + F.col("_step") * i - F.col("_x"), F.col("_h")) for i in range(points)]
    norm = F.col("_n") * F.col("_h") * F.lit((2 * 3.141592653589793) ** 0.5)
    cells = F.array(*[
        F.struct(F.lit(i).alias("point"), F.first(F.col("_from") + F.col("_step") * i).alias("x"),
                 F.sum(F.try_divide(F.exp(-z[i] * z[i] / 2), norm)).alias("density"))
        for i in range(points)
    ])
    return sized.groupBy(*keys).agg(cells.alias("_c")).select(*keys, F.explode("_c").alias("_c")).select(*keys, "_c.*")


def durbin_watson(df: DataFrame, keys: Sequence[str], day: str, resid: str) -> DataFrame:
    """Squared steps of the residuals over their squares."""
    step = F.col(resid) - F.lag(resid).over(over_days(keys, day))
    stepped = df.select(*keys, F.col(resid).alias("_e"), step.alias("_s"))
    e, s = F.col("_e"), F.col("_s")
    return stepped.groupBy(*keys).agg(F.try_divide(F.sum(s * s), F.sum(e * e)).alias("durbin_watson"))


def forecast_accuracy(df: DataFrame, forecast: str, actual: str, keys: Sequence[str] = ()) -> DataFrame:
    """MAPE, ME, MAE, MPE, RMSE, correlation and min-max error in one aggregation."""
    f, a = F.col(forecast), F.col(actual)
    err = f - a
    return df.groupBy(*keys).agg(
        F.avg(F.try_divide(F.abs(err), F.abs(a))).alias("mape"),
        F.avg(err).alias("me"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.try_divide(err, a)).alias("mpe"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.corr(f, a).alias("corr"),
        (1 - F.avg(F.try_divide(F.least(f, a), F.greatest(f, a)))).alias("minmax"),
    )

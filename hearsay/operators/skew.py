"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hearsay.session import cut_lineage


def is_small(df: DataFrame, max_rows: int) -> bool:
    """A count that stops at `max_rows + 1`: the check behind a broadcast hint."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only when the counted side is small.

    A larger side comes back without a hint and joins by shuffle, where AQE
    splits skewed partitions.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def join_hot_split(
    big: DataFrame, dim: DataFrame, keys: Sequence[str], weight: str, share: float = 1e-4, how: str = "inner", written: bool = False,
) -> DataFrame:
    """Join a skewed fact side, read once, to a table with one row per key.

    `weight` is the number of fact rows of a key. A table of at most `1 / share`
    rows is broadcast, and the fact side doesn't move. Of a larger one, the keys
    above `share` of all rows, at most `1 / share`, are cut: their row is copied
    once per `share` of the fact rows, and their fact rows are numbered round
    over the copies by position, so identical rows spread as well. One broadcast
    of the hot keys and their numbers of copies tells the fact rows apart; all
    rows then join in groups no larger than `share` of the total. Rows with a
    null key match nothing and are spread likewise. No row is dropped or capped.

    `dim` is computed once, when called, and checkpointed, unless it is `written`
    to a table already. Which copy a row
    meets makes no difference, but its place must be the same when a task runs
    again: pass a scan or what is computed row by row from one.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type {how!r}")
    keys, most = list(keys), int(1 / share)
    found = [c for c in dim.columns if c not in keys]
    dim = dim if written else cut_lineage(dim)
    columns = [*big.columns, *found]
    if is_small(dim, most):
        return big.join(F.broadcast(dim), keys, how).select(*columns)
    limit = dim.agg((F.sum(weight) * F.lit(share)).alias("limit")).scalar()
    copies = F.greatest(F.ceil(F.col(weight) / limit), F.lit(1)).cast("int")
    hot = dim.where(F.col(weight) > limit).select(*keys, copies.alias("_copies_"))
    place = F.monotonically_increasing_id()
    unkeyed = F.lit(False)
    for k in keys:
        unkeyed = unkeyed | F.col(k).isNull()
    cut = F.when(unkeyed, F.pmod(place, F.lit(most))).otherwise(F.coalesce(F.pmod(place, F.col("_copies_")), F.lit(0)))
    salted = big.join(F.broadcast(hot), keys, "left").withColumn("_copy_", cut.cast("int")).drop("_copies_")
    copied = dim.withColumn("_copy_", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.join(copied, [*keys, "_copy_"], how).select(*columns)

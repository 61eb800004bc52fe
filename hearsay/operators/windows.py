"""Shares, ranks and row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.functions.columns import ratio
from hearsay.operators.skew import is_small, join_hot_split
from hearsay.session import cut_lineage


def percent_of_total(df: DataFrame, value: str, digits: int = 2, name: str = "percent") -> DataFrame:
    """Percent of the grand total (half-up rounding), without a one-partition window."""
    whole = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.round(F.try_divide(F.col(value) * F.lit(100.0), whole), digits))


def share_within(df: DataFrame, group: Sequence[str], sub: Sequence[str], value: str | None = None,
                 digits: int | None = None, scale: float = 1.0, wide_groups: bool = False) -> DataFrame:
    """Counts per (group, sub) with the group's total and their ratio.

    Rows are pre-aggregated to (group, sub). By default the total is a window
    over those: right when `sub` has a short value list, such as labels. With
    `wide_groups` (many subs in a group) totals are aggregated and joined, so
    no group is gathered in one task.
    """
    group, sub = list(group), list(sub)
    measure = F.count(F.lit(1)) if value is None else F.sum(value)
    counts = df.groupBy(*group, *sub).agg(measure.alias("value"))
    if wide_groups:
        totals = counts.groupBy(*group).agg(F.sum("value").alias("total_count"))
        counts = _join_null_safe(counts, totals, group)
    else:
        counts = counts.withColumn("total_count", F.sum("value").over(Window.partitionBy(*group)))
    return counts.withColumn("ratio", ratio("value", "total_count", digits, scale))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on columns of the same names in which nulls match; the left side's stay."""
    named = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(named, same).drop(*[f"_right_{c}" for c in keys])


def top_k_per_group(df: DataFrame, group: Sequence[str], by: str, k: int, ties: str = "rank",
                    tie_break: Sequence[str] = (), groups: DataFrame | None = None, max_groups: int = 1000) -> DataFrame:
    """The k largest rows of each group with their rank.

    `row` breaks ties by columns and keeps exactly k; Spark limits each group
    on the map side before the shuffle. `rank` keeps every row tied with the
    k-th: ranks come from the counts of the k largest distinct values, which
    join back by value with `join_hot_split`, so a value shared by very many rows
    never meets in one task. `by` must then be reproducible, for instance a
    rounded value, and `df` a scan or computed row by row from one.
    `groups` may name a cheap frame holding the group columns: when it has at
    most `max_groups` distinct groups, the k values of each are broadcast and
    the rows do not move.
    """
    group = list(group)
    if ties == "row":
        w = Window.partitionBy(*group).orderBy(F.desc(by), *tie_break)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if ties != "rank":
        raise ValueError(f"unknown ties {ties!r}")
    values = df.groupBy(*group, by).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy(F.desc(by))
    kept = values.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= k)
    before = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("rank", F.coalesce(before, F.lit(0)) + 1).where(F.col("rank") <= k)
    kept = kept.drop("_row")
    if groups is not None and is_small(groups.select(*group).distinct(), max_groups):
        return _join_null_safe(df, F.broadcast(kept.drop("_n")), [*group, by])
    keys = [*group, by]
    sides = kept.select(F.xxhash64(*keys).alias("_hash"), "rank", "_n", *[F.col(c).alias(f"_right_{c}") for c in keys])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in keys])
    joined = join_hot_split(df.withColumn("_hash", F.xxhash64(*keys)), sides, ["_hash"], "_n")
    return joined.where(same).select(*df.columns, "rank")


def with_row_id(df: DataFrame, order: Sequence[str | Column], partition_by: Sequence[str] = (), name: str = "row_id") -> DataFrame:
    """Dense row numbers from 1 in a real order, global or within each group.

    The rows are range-partitioned and sorted once and that layout is
    checkpointed, so partition numbers and positions stay what they are. A
    row's number is its position plus the rows of the partitions before; a
    group's numbers start after its first row. No table or group is gathered
    in one task: the window below has one row per partition.
    """
    keys = list(partition_by)
    fixed = cut_lineage(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    part = F.spark_partition_id().alias("_part")
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = fixed.select("*", part, position.alias("_position"))
    sizes = fixed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_position") + 1).alias(name))
    if not keys:
        return numbered
    grouped = numbered.withColumn("_group", F.to_json(F.struct(*keys)))
    starts = grouped.groupBy("_group").agg((F.min(name) - 1).alias("_start"), F.count(F.lit(1)).alias("_rows"))
    joined = join_hot_split(grouped, starts, ["_group"], "_rows")
    return joined.select(*df.columns, (F.col(name) - F.col("_start")).alias(name))

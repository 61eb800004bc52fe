"""Melt, pivot, explode, unions, ordering, top-k with a rest row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def pivot_counts(df: DataFrame, rows: Sequence[str], col: str, value: str | None = None,
                 values: Sequence | None = None) -> DataFrame:
    """One wide table in one aggregation; an absent cell is zero.

    Naming the `values` spares the extra job that would look for them.
    """
    cell = F.count(F.lit(1)) if value is None else F.sum(value)
    grouped = df.groupBy(*rows)
    wide = (grouped.pivot(col, list(values)) if values is not None else grouped.pivot(col)).agg(cell)
    return wide.fillna(0, [c for c in wide.columns if c not in rows])


def explode(df: DataFrame, col: str | Column, name: str, position: str | None = None) -> DataFrame:
    col = F.col(col) if isinstance(col, str) else col
    if position:
        return df.select("*", F.posexplode(col).alias(position, name))
    return df.select("*", F.explode(col).alias(name))


def order(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def top_k(df: DataFrame, by: str, k: int, tie_break: Sequence[str]) -> DataFrame:
    """The k largest rows; ties are broken by columns so the result is stable."""
    return df.orderBy(F.desc(by), *tie_break).limit(k)


def union_all(*frames: DataFrame) -> DataFrame:
    """By position; names come from the first frame."""
    return reduce(DataFrame.union, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def top_k_with_other(df: DataFrame, key: str, value: str, k: int, other: str = "other") -> DataFrame:
    """The k largest keys and one row with the sum of the rest."""
    best = top_k(df.where(F.col(key).isNotNull()), value, k, [key])
    kept = best.select(F.col(key).alias("_kept"), F.lit(True).alias("_top"))
    # `kept` has at most k rows.
    labelled = df.join(F.broadcast(kept), F.col(key) == F.col("_kept"), "left")
    named = F.when(F.col("_top"), F.col(key)).otherwise(F.lit(other))
    return labelled.groupBy(named.alias(key)).agg(F.sum(value).alias(value))

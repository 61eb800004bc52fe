"""Joins of daily series, counts, lookups and cohorts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from hearsay.operators.skew import is_small, join_hot_split


def full_outer_daily(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """USING join: the key survives on days only one side has."""
    return a.join(b, key, "full")


def inner_on(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "inner")


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "inner")


def merge_counts_zero_fill(a: DataFrame, b: DataFrame, key: str, total: str = "total_activity") -> DataFrame:
    """Full outer merge of two count tables; a missing count is zero; plus their sum."""
    counts = [c for c in a.columns + b.columns if c != key]
    filled = a.join(b, key, "full").select(key, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    summed = F.col(counts[0])
    for c in counts[1:]:
        summed = summed + F.col(c)
    return filled.withColumn(total, summed)


def align_series(a: DataFrame, b: DataFrame, day: str = "day") -> DataFrame:
    return a.join(b, day, "inner")


def join_by_id(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Put columns of two results of one table side by side by the carried row id."""
    return a.join(b, row_id, "full")


def lookup_left(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join to a dimension; Catalyst broadcasts it when its size allows."""
    return df.join(dim, key, "left")


def cohort_of(comments: DataFrame, posts: DataFrame, community: str, community_col: str = "community",
              author: str = "author", exclude: Sequence[str] = ()) -> DataFrame:
    """Distinct authors seen in a community, in either feed."""
    both = comments.where(F.col(community_col) == community).select(author).unionByName(
        posts.where(F.col(community_col) == community).select(author)
    )
    both = both.where(F.col(author).isNotNull())
    if exclude:
        both = both.where(~F.col(author).isin(list(exclude)))
    return both.distinct()


def cohort_activity(log: DataFrame, cohort: DataFrame, author: str = "author", broadcast_rows: int | None = 200_000) -> DataFrame:
    """All rows of the cohort's authors, wherever posted.

    A semi join: the author list never reaches the driver. The cohort is
    counted, up to `broadcast_rows`, and broadcast if it fits; the log does not
    move then. Otherwise, or with None, all authors get their row counts, from a
    pass over the author column alone, and `join_hot_split` decides rows of busy
    authors, in the cohort or not, where they are.
    """
    if broadcast_rows and is_small(cohort, broadcast_rows):
        return log.join(F.broadcast(cohort), author, "left_semi").select(*log.columns)
    rows = log.groupBy(author).agg(F.count(F.lit(1)).alias("_rows"))
    members = cohort.select(author, F.lit(True).alias("_member")).distinct()
    weighted = rows.join(members, author, "left")
    return join_hot_split(log, weighted, [author], "_rows").where("_member").select(*log.columns)


def attach_by_text(df: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame], outputs: Sequence[str]) -> DataFrame:
    """Run a costly per-text computation once per distinct text and fan it out.

    `compute` takes a frame with the text column and adds `outputs`. Equal
    texts are reduced before the shuffle, the join back is many-to-one on a
    SHA-256 of the text, and a text with very many copies is handled by
    `join_hot_split`. Rows without a text keep null outputs.
    """
    present = df.where(F.col(text).isNotNull())
    absent = df.where(F.col(text).isNull())
    distinct = present.groupBy(text).agg(F.count(F.lit(1)).alias("_copies"))
    scored = compute(distinct).select(F.sha2(text, 256).alias("_key"), "_copies", *outputs)
    keyed = present.withColumn("_key", F.sha2(text, 256))
    joined = join_hot_split(keyed, scored, ["_key"], "_copies").drop("_key", "_copies")
    blanks = [F.lit(None).cast(scored.schema[o].dataType).alias(o) for o in outputs]
    return joined.unionByName(absent.select("*", *blanks))

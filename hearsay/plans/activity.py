"""Slices, cohorts and activity over time.

Feeds are normalised activity: (id, author, community, ts, score, body, kind).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.columns import community_or_keyword, total_of
from hearsay.operators.aggregates import monthly_sum
from hearsay.operators.joins import cohort_activity, cohort_of
from hearsay.operators.reshape import top_k
from hearsay.operators.rows import drop_sentinels
from hearsay.session import cut_lineage
from hearsay.vocab import BOT_AUTHOR, REMOVED


def slice_log(comments: DataFrame, posts: DataFrame, community: str, keyword: str, competitors: Sequence[str],
              cohort_broadcast_rows: int | None = 200_000) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Brand, competitor and cohort slices of both feeds. The cohort is found once, when called; the slices are lazy."""
    brand = community_or_keyword("community", "body", community, keyword)
    cohort = cut_lineage(cohort_of(comments, posts, community, exclude=[BOT_AUTHOR]))
    rivals = F.col("community").isin(list(competitors))
    return {
        "brand": (comments.where(brand), posts.where(brand)),
        "competitor": (comments.where(rivals), posts.where(rivals)),
        "cohort": tuple(cohort_activity(f, cohort, broadcast_rows=cohort_broadcast_rows) for f in (comments, posts)),
    }


def feed_counts(comments: DataFrame, posts: DataFrame, key: Column, name: str, of: str | None = None) -> DataFrame:
    """Rows (or non-null `of` values) of each feed per key in one aggregation; null where a feed has no row.

    The feeds are stacked as (key, is_post, counted) and counted side by side:
    one shuffle of pre-aggregated rows where two counts and an outer join would
    take three.
    """
    def narrow(df: DataFrame, post: bool) -> DataFrame:
        counted = F.lit(1).cast("bigint") if of is None else F.col(of).isNotNull().cast("bigint")
        return df.select(key.alias(name), F.lit(post).alias("_post"), counted.alias("_n"))

    both = narrow(comments, False).unionAll(narrow(posts, True))
    return both.groupBy(name).agg(
        F.sum(F.when(~F.col("_post"), F.col("_n"))).alias("comment_count"),
        F.sum(F.when(F.col("_post"), F.col("_n"))).alias("submission_count"),
    )


def community_interest(comments: DataFrame, posts: DataFrame, k: int = 100) -> DataFrame:
    """Where a cohort is active: comments, posts and total per community, the k largest."""
    counts = feed_counts(comments, posts, F.col("community"), "community")
    counts = counts.fillna(0, ["comment_count", "submission_count"])
    counts = counts.withColumn("total_activity", total_of("comment_count", "submission_count"))
    return top_k(counts, "total_activity", k, ["community"])


def daily_counts(comments: DataFrame, posts: DataFrame, community: str) -> DataFrame:
    """(day, comment_count, submission_count) of one community."""
    here = F.col("community") == community
    return feed_counts(comments.where(here), posts.where(here), F.to_date("ts"), "day", of="id")


def daily_activity(comments: DataFrame, posts: DataFrame, community: str, missing: str = "null") -> DataFrame:
    """(day, total_activity). A day only one feed has is null, or counts the other feed as zero."""
    counts = daily_counts(comments, posts, community)
    return counts.select("day", total_of("comment_count", "submission_count", missing=missing).alias("total_activity"))


def monthly_activity(daily: DataFrame) -> DataFrame:
    return monthly_sum(daily, "day", ["comment_count", "submission_count"]).drop("month")


def activity_vs_external(comments: DataFrame, posts: DataFrame, community: str, external: DataFrame) -> DataFrame:
    """Daily activity beside an outside daily series (joined on `day`).

    Moderator rows and adult posts are expected to be filtered already (see
    `quality_filter`); removed and missing bodies are dropped here.
    """
    both = comments.unionByName(posts).where(F.col("community") == community)
    kept = drop_sentinels(both, {"body": [REMOVED]})
    daily = kept.groupBy(F.to_date("ts").alias("day")).agg(F.count("body").alias("activity_count"))
    return daily.join(external, "day")


def author_activity(log: DataFrame) -> DataFrame:
    """Actions and distinct communities per author.

    Counted per (author, community) first, so a very busy author is reduced
    where the rows are before anything moves.
    """
    per = log.where(F.col("author").isNotNull()).groupBy("author", "community").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("author").agg(F.sum("_n").alias("n_actions"), F.count("community").alias("n_communities"))

"""A log kept in buckets by author, so that slices of cohorts need no exchange of it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearsay.session import scratch_path, write_table

COPY = "_copy"


@dataclass(frozen=True)
class BucketedLog:
    """`table` holds the log in `buckets` sorted buckets by (author, copy); `busy` the authors with several copies."""

    table: str
    author: str
    buckets: int
    busy: DataFrame


def write_bucketed(log: DataFrame, author: str, buckets: int, table: str | None = None, path: str | None = None, share: float = 1e-4) -> BucketedLog:
    """Write a log once, for many slices.

    Authors with more than `share` of the rows, at most `1 / share` of them, are
    dealt out over that many copies by position, so a bucket holds about its
    share whoever wrote the rows. Rows without an author are spread too; no
    cohort asks for them. Each bucket is one sorted file. Without a `path` the
    table lies in the shared folder.
    """
    spark = log.sparkSession
    table = table or f"log_{uuid.uuid4().hex}"
    counts = log.where(F.col(author).isNotNull()).groupBy(author).agg(F.count(F.lit(1)).alias("_rows"))
    counts = write_table(counts, "author-rows")
    limit = counts.agg(F.sum("_rows") * F.lit(share)).first()[0] or 0
    busy = write_table(counts.where(F.col("_rows") > limit).select(author, F.ceil(F.col("_rows") / F.lit(float(limit or 1))).cast("int").alias("_copies")), "busy-authors")
    place = F.monotonically_increasing_id()
    copy = F.when(F.col(author).isNull(), F.pmod(place, F.lit(int(1 / share)))).otherwise(F.coalesce(F.pmod(place, F.col("_copies")), F.lit(0)))
    dealt = log.join(F.broadcast(busy), author, "left").withColumn(COPY, copy.cast("int")).drop("_copies")
    writer = dealt.select(*log.columns, COPY).repartition(buckets, author, COPY).write.bucketBy(buckets, author, COPY).sortBy(author, COPY)
    writer.option("path", path or scratch_path(spark, "bucketed")).format("parquet").saveAsTable(table)
    return BucketedLog(table, author, buckets, busy)


def cohort_slice(spark: SparkSession, log: BucketedLog, cohort: DataFrame) -> DataFrame:
    """All rows of the cohort's authors: the cohort moves to the buckets, the log stays where it lies."""
    members = cohort.select(log.author).where(F.col(log.author).isNotNull()).distinct()
    asked = members.join(F.broadcast(log.busy), log.author, "left").withColumn(COPY, F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
    found = spark.table(log.table).join(asked.select(log.author, COPY).hint("merge"), [log.author, COPY], "left_semi")
    return found.select(*[c for c in spark.table(log.table).columns if c != COPY])

"""Reading the activity log: declared schemas, one shape for every feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hearsay.functions.columns import as_col, post_body

COMMENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("subreddit_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("controversiality", T.LongType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("is_submitter", T.BooleanType()),
    T.StructField("link_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("distinguished", T.StringType()),
])

POST_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_id", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("subreddit_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("over_18", T.BooleanType()),
    T.StructField("created_utc", T.LongType()),
    T.StructField("distinguished", T.StringType()),
    T.StructField("is_self", T.BooleanType()),
    T.StructField("is_video", T.BooleanType()),
    T.StructField("locked", T.BooleanType()),
])

ACTIVITY_COLUMNS = ["id", "author", "community", "ts", "score", "body", "kind"]


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_activity(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One feed of the log; `kind` is `comment` or `post`.

    The declared schema keeps Spark from opening footers to infer one, which
    matters when the log has a million files.
    """
    schemas = {"comment": COMMENT_SCHEMA, "post": POST_SCHEMA}
    return read_parquet(spark, path, schemas[kind])


def normalize_activity(df: DataFrame, kind: str, columns: Mapping[str, str | Column] | None = None) -> DataFrame:
    """Any feed as (id, author, community, ts, score, body, kind).

    `columns` overrides where a target column comes from. A comment's body is
    its own; a post's body is title and text.
    """
    source: dict[str, str | Column] = {
        "id": "id",
        "author": "author",
        "community": "subreddit",
        "ts": F.timestamp_seconds("created_utc"),
        "score": "score",
        "body": post_body() if kind == "post" else "body",
    }
    source.update(columns or {})
    cols = [as_col(source[c]).alias(c) for c in ACTIVITY_COLUMNS[:-1]]
    return df.select(*cols, F.lit(kind).alias("kind"))


def stack_chunks(*frames: DataFrame, drop: Sequence[str] = ("isPartial",)) -> DataFrame:
    """Pulls of one feed over neighbouring date ranges, appended by column name."""
    return reduce(DataFrame.unionByName, [f.drop(*drop) for f in frames])


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)

"""Typed CSV readers for outside daily series and small lookup files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EPIDEMIC_SCHEMA = "date_reported string, New_cases bigint, Cumulative_cases bigint, New_deaths bigint, Cumulative_deaths bigint"


def search_interest_schema(brands: list[str]) -> str:
    return "Date date, " + ", ".join(f"`{b}` int" for b in brands)


def read_daily_series(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and declared types: no inference pass over the file."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_lookup(spark: SparkSession, path: str, schema: T.StructType | str, lower: tuple[str, ...] = ()) -> DataFrame:
    """A small dimension file, read by Spark itself; `lower` names columns to lower-case."""
    df = read_daily_series(spark, path, schema)
    return df.withColumns({c: F.lower(c) for c in lower}) if lower else df


def cast_cols(df: DataFrame, types: Mapping[str, str], strict: bool = False) -> DataFrame:
    """Cast columns; text that does not parse becomes null unless `strict`."""
    if strict:
        return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})

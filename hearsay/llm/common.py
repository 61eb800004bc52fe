"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StructField, StructType

from hearsay.session import scratch_path, ship_package

#: ASCII white space, as the contracts of the queries name it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def materialise(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: later steps start from files that outlive executors."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text (null: none), in order."""
    found = F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), f"{SPACE}+")
    return F.when(F.coalesce(text, F.lit("")).rlike(WORD), found).otherwise(F.array().cast("array<string>"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller views of the batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def add_by_text(
    df: DataFrame, text_col: str, name: str, kind: DataType, work: Callable[[list[bytes]], pa.Array],
) -> DataFrame:
    """All columns and one more, made by `work` from the UTF-8 bytes of a batch of texts (null: empty)."""
    ship_package(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = work([x or b"" for x in batch.column(place).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)]))


def join_weighted(rows: DataFrame, dim: DataFrame, keys: list[str], weight: str, share: float = 1e-4) -> DataFrame:
    """Inner join to a table with one row per key whose `weight` is the number of its rows.

    Keys above `share` of all rows, at most `1 / share` of them, go out as a
    broadcast and leave their rows where they are; all other keys are too small
    to be skewed and join by shuffle. `rows` is read twice: pass a written table
    or a cheap scan. Null keys match nothing.
    """
    limit = dim.agg((F.sum(weight) * F.lit(share)).alias("limit")).first()["limit"] or 0
    hot, cold = dim.where(F.col(weight) > limit).drop(weight), dim.where(F.col(weight) <= limit).drop(weight)
    few = F.broadcast(hot)
    left = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(left.join(cold, keys))

"""Integer vectors in packed blocks, and a query set matched against them block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from hearsay.llm.common import materialise
from hearsay.session import ship_package

Pack = Callable[[pa.RecordBatch], dict]


def integer_vectors(vecs: DataFrame, id_col: str, vec_col: str, scale: int, **more: Column) -> DataFrame:
    """id, `more` and `ints`, the components as floor(scale * x), of rows whose vector is whole.

    Rows with a null vector or a null or non-finite component are left out.
    """
    x = F.col(vec_col)
    broken = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    ints = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    return vecs.where(x.isNotNull() & ~broken).select(F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in more.items()], ints.alias("ints"))


def written(rows: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The rows with a number of their own, `row`, in a table of the shared folder, and the longest vector's length."""
    made = materialise(rows.withColumn("row", F.monotonically_increasing_id()), label)
    return made, made.agg(F.max(F.size("ints"))).first()[0] or 0


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of `width` components; shorter ones end in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.asarray(lists.flatten(), np.int64)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def longs(packed: bytes, width: int = 0) -> np.ndarray:
    found = np.frombuffer(packed, "<i8")
    return found.reshape(-1, width) if width else found


def doubles(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<f8")


def cut_blocks(rows: DataFrame, order: Sequence[str], size: int, pack: Pack, schema: str, label: str, split: str | None = None) -> DataFrame:
    """Consecutive rows by `order` as one packed row per block of at most `size`, with a `block` number.

    Sampled splitters deal the rows out in ranges, so rows that share a key lie
    in as many blocks as they need when `order` ends in the row's number. A block
    holds one value of `split` only.
    """
    ship_package(rows.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def emit(part: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([pack(pa.Table.from_batches(part).combine_chunks().to_batches()[0])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for batch in batches:
            at = 0
            keys = np.asarray(batch.column(split)) if split else None
            while at < batch.num_rows:
                stop = min(batch.num_rows, at + size - n)
                if keys is not None:
                    if n and keys[at] != last:
                        yield emit(held)
                        held, n = [], 0
                        continue
                    stop = min(stop, int(np.searchsorted(keys, keys[at], "right")))
                    last = keys[at]
                held.append(batch.slice(at, stop - at))
                n, at = n + stop - at, stop
                if n == size:
                    yield emit(held)
                    held, n = [], 0
        if n:
            yield emit(held)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(sorted_rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), label)


def match_blocks(
    queries: DataFrame, blocks: DataFrame, meets: Column, q_cols: Sequence[str], b_cols: Sequence[str],
    kernel: Callable[[dict, dict], Iterator[pa.RecordBatch]], schema: str,
) -> DataFrame:
    """`kernel` on every pair of a query block and a block that `meets` allows.

    `meets` compares the small columns of the directories, `q.…` and `b.…`. The
    directories are joined in lanes of some 256 blocks, and only the pairs that
    remain fetch their packed rows: a block moves once, a query block once per
    block it visits. A task holds one pair at a time.
    """
    spark = blocks.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lanes = blocks.count() // 256 + 1
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes))
    small = lambda df: df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, BinaryType)])
    left = small(queries).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).alias("q")
    right = small(blocks).withColumn("lane", lane).alias("b")
    pairs = left.join(right, (F.col("q.lane") == F.col("b.lane")) & meets).select(F.col("q.block").alias("q_block"), F.col("b.block").alias("b_block"))
    held = queries.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in q_cols])
    packed = blocks.select(F.col("block").alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in b_cols])
    asked = pairs.join(held, "q_block").repartition(tasks, "b_block")
    both = asked.join(packed.repartition(tasks, "b_block").hint("merge"), "b_block")
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                yield from kernel({c: row[f"q_{c}"] for c in q_cols}, {c: row[f"b_{c}"] for c in b_cols})

    return both.mapInArrow(run, schema)


def first_of_each(query: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's first k by (score descending, id, row), in that order."""
    order = np.lexsort((row, ident, -score, query))
    q = query[order]
    start = np.searchsorted(q, q, "left") if len(q) else q
    return order[np.arange(len(q)) - start < k]

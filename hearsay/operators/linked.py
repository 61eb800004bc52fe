"""Coded texts in groups, their words at homes, and the vectors that pass between the two as packed rows.

Every word has one home. A group and a home keep the same list of the words they
share, in one order, so that a round's vectors travel without words or keys: one
row of bytes per group and home. Several groups of `code_words` make one here,
since a word they have in common then moves once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from hearsay.operators.coded import Coded, chunks, dealt, spread_keys
from hearsay.session import drop_table, write_table

#: Groups of `code_words` that make one, at most, and numbers in the vectors of their words, about: what one task holds at a time.
TOGETHER, MOST_NUMBERS = 4, 1 << 25

#: Rows on their way: to the group or home `_p`, from the group or home `_at` (or, with `doc`, of the coded group `_at`).
PASSED = StructType([
    StructField("_p", IntegerType()), StructField("_at", IntegerType()), StructField("doc", BooleanType()), StructField("values", BinaryType()),
    StructField("totals", ArrayType(DoubleType())), StructField("bound", DoubleType()),
])
_BLOCKS = StructType([
    StructField("_p", IntegerType()), StructField("_c", IntegerType()), StructField("_at", IntegerType()),
    *[StructField(c, BinaryType()) for c in ("docs", "words", "counts", "own", "tf")],
])
_PLAN = StructType([
    StructField("kind", StringType()), StructField("_p", IntegerType()), StructField("_at", IntegerType()), StructField("_c", IntegerType()),
    StructField("words", BinaryType()), StructField("places", BinaryType()), StructField("totals", ArrayType(DoubleType())),
    StructField("word", StringType()), StructField("n", LongType()), StructField("_i", IntegerType()),
])


@dataclass(frozen=True)
class Linked:
    """`cells`: the groups' counts and places of their words; `links`: the homes' places of each group's words; `words`: _p (home), _i, word, n.
    `level`: the words' first vectors, rows of `PASSED`. `group_of`: the group of each coded group."""

    cells: DataFrame
    links: DataFrame
    words: DataFrame
    level: DataFrame
    group_of: dict[int, int]
    plan: DataFrame

    def free(self) -> None:
        self.cells.unpersist()
        self.links.unpersist()
        drop_table(self.plan)


def read(cell: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def packed(values: np.ndarray) -> bytes:
    """Numbers by place of their bytes, which makes signs, exponents and all that is near one value small, and how many they are; nothing is lost."""
    planes = np.ascontiguousarray(values, "f8").reshape(-1).view("u1").reshape(-1, 8).T.tobytes()
    return np.int64(values.size).tobytes() + (pa.compress(planes, codec="zstd", asbytes=True) if values.size else b"")


def unpacked(cell: pa.Scalar, k: int) -> np.ndarray:
    """The vectors of `k` numbers that `packed` wrote."""
    data = cell.as_buffer()
    n = int(np.frombuffer(data[:8], "i8")[0])
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd"), "u1") if n else np.empty(0, "u1")
    return np.ascontiguousarray(planes.reshape(8, n).T).view("f8").reshape(-1, k)


def read_counts(cell: pa.Scalar, n: int) -> np.ndarray:
    """Numbers as `_small` wrote them."""
    return read(cell, f"u{len(cell.as_buffer()) // max(n, 1) or 1}")


def _small(values: np.ndarray) -> bytes:
    """In as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _pack(group_of: dict[int, int]):
    """A coded group's documents in blocks of cells in order of words: each word once, its number of cells, and the cells' documents and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for c in np.unique(table["_p"].to_numpy()).tolist():
                for part, own, word, tf in chunks(table.filter(pc.equal(table["_p"], c)).combine_chunks()):
                    order = np.argsort(word, kind="stable")
                    word, counts = np.unique(word[order], return_counts=True)
                    row = [group_of[c], c, -1, part.column("_i").to_numpy().astype(np.int32).tobytes(), word.astype(np.int32).tobytes(),
                           _small(counts), _small(own[order]), _small(tf[order].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(row, _BLOCK_TYPES)], names=_BLOCKS.names)

    return run


_BLOCK_TYPES = [*[pa.int32()] * 3, *[pa.binary()] * 5]
_PASSED_TYPES = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
_PLAN_TYPES = [pa.string(), *[pa.int32()] * 3, *[pa.binary()] * 2, pa.list_(pa.float64()), pa.string(), pa.int64(), pa.int32()]


def first_weights(words: list[str], k: int, seed: int) -> np.ndarray:
    """Between a half and one and a half, by a digest of word and topic: the same in every run and partitioning."""
    return np.array([[0.5 + int(md5(f"{seed}-{t}-{w}".encode()).hexdigest()[:8], 16) / (1 << 32) for t in range(k)] for w in words]).reshape(-1, k)


def _settle(group_of: dict[int, int], k: int, seed: int, min_df: int, given: bool):
    """Work of a home: its words numbered, with their first vectors, and for each group the list of those they share."""
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = table["word"].combine_chunks().dictionary_encode()
        code, n = found.indices.to_numpy(), table["n"].to_numpy()
        total = np.bincount(code, n, len(found.dictionary)).astype(np.int64)
        used = total >= min_df
        index = np.where(used, np.cumsum(used) - 1, -1).astype(np.int32)
        words, size, home = found.dictionary.filter(pa.array(used)), int(used.sum()), key[0].as_py()
        if given:
            first = np.unique(code, return_index=True)[1]
            level = np.column_stack([table[f"g{t}"].to_numpy()[first] for t in range(k)])[used]
        else:
            level = first_weights(words.to_pylist(), k, seed)
        rows = [("level", home, -1, None, None, packed(level), level.sum(0).tolist())]
        c, i, at = table["_p"].to_numpy(), table["_i"].to_numpy().astype(np.int32), index[code]
        c, i, at = c[at >= 0], i[at >= 0], at[at >= 0]
        coded = np.array(sorted(group_of))
        group = np.array([group_of[x] for x in coded.tolist()])[np.searchsorted(coded, c)]
        for g in np.unique(group).tolist():
            own = group == g
            shared, place = np.unique(at[own], return_inverse=True)
            rows.append(("link", home, g, None, None, shared.astype(np.int32).tobytes(), None))
            for one in np.unique(c[own]).tolist():
                its = c[own] == one
                rows.append(("map", g, home, one, i[own][its].tobytes(), place[its].astype(np.int32).tobytes(), None))
        columns = [pa.array([*v, *[None] * size], t) for v, t in zip(zip(*rows), _PLAN_TYPES)]
        columns[0] = pa.array([*[r[0] for r in rows], *["word"] * size], pa.string())
        columns[1] = pa.array([*[r[1] for r in rows], *[home] * size], pa.int32())
        none = pa.nulls(len(rows), pa.string())
        columns += [pa.concat_arrays([none, words.cast(pa.string())]), pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(total[used])]),
                    pa.concat_arrays([pa.nulls(len(rows), pa.int32()), pa.array(np.arange(size, dtype=np.int32))])]
        return pa.table(columns, names=_PLAN.names)

    return work


def _kept(rows: DataFrame, n: int) -> DataFrame:
    """By `_p` on the executors' disks and in order there, until unpersisted."""
    rows = rows.repartition(n, "_p").sortWithinPartitions("_p").persist(StorageLevel.DISK_ONLY)
    rows.count()  # only a finished table tells the planner how it is partitioned
    return rows


def link_words(coded: Coded, words: DataFrame, k: int, seed: int = 0, min_df: int = 1) -> Linked:
    """Give the words of coded documents, in at least `min_df` of them, homes. `words`: _p, _i, word, n and, unless first vectors are drawn, g0 …."""
    spark = words.sparkSession
    n = min(coded.groups, max(-(-coded.groups // TOGETHER), -(-words.count() * k // MOST_NUMBERS), spark.sparkContext.defaultParallelism))
    keys, given = spread_keys(spark, n), "g0" in words.columns
    group_of = {c: keys[j % n] for j, c in enumerate(spread_keys(spark, coded.groups))}
    homes = dealt(words, "word", keys, "_h").groupBy("_h")
    plan = write_table(homes.applyInArrow(_settle(group_of, k, seed, min_df, given), _PLAN), "topic-plan")
    maps = plan.where("kind = 'map'").select("_p", "_c", "_at", F.lit(None).cast("binary").alias("docs"), "words", F.lit(None).cast("binary").alias("counts"), F.col("places").alias("own"), F.lit(None).cast("binary").alias("tf"))
    cells = _kept(coded.rows.select("_p", "_i", "_w", "_tf").mapInArrow(_pack(group_of), _BLOCKS).unionByName(maps), n)
    links = _kept(plan.where("kind = 'link'").select("_p", "_at", "places"), n)
    level = plan.where("kind = 'level'").select("_p", F.lit(-1).alias("_at"), F.lit(False).alias("doc"), F.col("places").alias("values"), "totals", F.lit(0.0).alias("bound"))
    return Linked(cells, links, plan.where("kind = 'word'").select("_p", "_i", "word", "n"), level, group_of, plan)


def passed(rows: list[tuple]) -> pa.Table:
    """Rows of `PASSED`; their values are bytes, copied once."""
    if not rows:
        return pa.table([pa.array([], t) for t in _PASSED_TYPES], names=PASSED.names)
    columns = [*zip(*rows)]
    parts = [np.empty(0, "u1") if v is None else np.frombuffer(v, "u1") for v in columns[3]]
    ends = np.cumsum([0, *[len(x) for x in parts]])
    columns[3] = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(parts))])
    return pa.table([v if t == pa.binary() else pa.array(v, t) for v, t in zip(columns, _PASSED_TYPES)], names=PASSED.names)


def rows_of(table: pa.Table, *columns: str) -> Iterator[tuple[pa.Scalar, ...]]:
    """Row by row, without copies of their bytes."""
    for batch in table.select(columns).to_batches():
        for j in range(batch.num_rows):
            yield tuple(batch.column(c)[j] for c in columns)


def levels_at(level: dict[int, np.ndarray], k: int) -> tuple[np.ndarray, dict[int, int]]:
    """The homes' vectors in one array, in order of the homes, and where each begins."""
    homes = sorted(level)
    starts = dict(zip(homes, np.cumsum([0, *[len(level[h]) for h in homes]]).tolist()))
    return np.concatenate([level[h] for h in homes]) if homes else np.empty((0, k)), starts

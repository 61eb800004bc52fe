"""Texts as numbers, in groups of documents that keep a list of their own words.

A value per word reaches a document's group once, not once per occurrence: the
group's words are joined to it, and the documents, coded by their place in the
group's list, stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from hearsay.session import drop_table, ship_package, write_table

#: Tokens of a group, about (here a row's distinct words): what one task holds at a time.
GROUP_TOKENS, LEAST_TOKENS = 1 << 23, 1 << 17
#: (document, word) counts that are worked on at a time.
_CHUNK = 1 << 19


@dataclass(frozen=True)
class Coded:
    """`rows`: _p, _i, the id, sums, `_w` and `_tf`, its words' places and counts; `words`: _p, _i, word and n, its documents in the group."""

    rows: DataFrame
    words: DataFrame
    groups: int


def group_number(tokens: DataFrame, col: str) -> int:
    """Groups for a written column of tokens: by its size, and enough of them for all cores."""
    total = tokens.agg(F.sum(F.size(col).cast("long"))).first()[0] or 0
    return max(1, -(-total // GROUP_TOKENS), min(tokens.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_TOKENS)))


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """One number for each of `n` hash partitions, so that groups named by them lie one to a partition."""
    tried = spark.range(n * (int(log(n)) + 9)).select(F.col("id").cast("int").alias("key"))
    found = tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("at")).agg(F.min("key").alias("key")).collect()
    return sorted(r["key"] for r in found) if len(found) == n else list(range(n))


def dealt(df: DataFrame, col: str, keys: Sequence[int], name: str) -> DataFrame:
    """Rows by a hash of `col` to the groups of `keys`, whose number is put in `name`."""
    return df.withColumn(name, F.lit(list(keys))[F.pmod(F.xxhash64(col), F.lit(len(keys))).cast("int")]).repartition(len(keys), name)


def _counted(schema: StructType):
    """Each row's distinct words and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                lists = some.column("_tokens")
                found = lists.flatten().dictionary_encode()
                n = max(len(found.dictionary), 1)
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                word = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
                pairs, times = np.unique((owner * n + word)[word >= 0], return_counts=True)
                own, word = np.divmod(pairs, n)
                ends = pa.array(np.searchsorted(own, np.arange(len(lists) + 1)).astype(np.int32))
                listed = [pa.ListArray.from_arrays(ends, v) for v in (found.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(times.astype(np.int32)))]
                rest = [some.column(f.name) for f in schema.fields if f.name not in ("_words", "_tf")]
                yield pa.RecordBatch.from_arrays([*rest, *listed], names=schema.names)

    return run


def code_words(df: DataFrame, row_id: str, tokens: str | Column, sums: Sequence[str] = ()) -> Coded:
    """Count the words of every document with an id; rows of one id are one document, whose `sums`, double columns, add up. Null tokens don't count."""
    spark, sums = df.sparkSession, list(sums)
    ship_package(spark)
    words = F.col(tokens) if isinstance(tokens, str) else tokens
    rows = df.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), *sums, words.alias("_tokens"))
    counts = StructType([*rows.schema.fields[:-1], StructField("_words", ArrayType(StringType())), StructField("_tf", ArrayType(IntegerType()))])
    texts = write_table(rows.mapInArrow(_counted(counts), counts), "tokens")
    groups = group_number(texts, "_words")
    kind = texts.schema["_id"].dataType
    schema = StructType([
        StructField("_p", IntegerType()), StructField("_i", IntegerType()), StructField("_id", kind), *[StructField(c, DoubleType()) for c in sums],
        StructField("_w", ArrayType(IntegerType())), StructField("_tf", ArrayType(IntegerType())), StructField("word", StringType()), StructField("n", LongType()),
    ])

    def code(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["_id"].combine_chunks().dictionary_encode()
        lists = table["_words"].combine_chunks()
        found = lists.flatten().dictionary_encode()
        owner, n_docs, n_words = ids.indices.to_numpy(), len(ids.dictionary), len(found.dictionary)
        doc, word, tf = np.repeat(owner, lists.value_lengths().to_numpy()), found.indices.to_numpy(), table["_tf"].combine_chunks().flatten().to_numpy()
        if n_docs < len(owner):
            pairs, place = np.unique(doc.astype(np.int64) * max(n_words, 1) + word, return_inverse=True)
            (doc, word), tf = np.divmod(pairs, max(n_words, 1)), np.bincount(place, tf, len(pairs))
        ends = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
        p, none = key[0].as_py(), lambda n, kind: pa.nulls(n, kind)
        added = [pa.array(np.bincount(owner, table[c].to_numpy(), n_docs), pa.float64()) for c in sums]
        listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (word, tf)]
        names = [f.name for f in schema.fields]
        rows = pa.table([pa.array(np.full(n_docs, p, np.int32)), pa.array(np.arange(n_docs, dtype=np.int32)), ids.dictionary, *added, *listed, none(n_docs, pa.string()), none(n_docs, pa.int64())], names=names)
        held = pa.array(np.bincount(word, minlength=n_words).astype(np.int64))
        terms = pa.table([pa.array(np.full(n_words, p, np.int32)), pa.array(np.arange(n_words, dtype=np.int32)), none(n_words, ids.dictionary.type), *[none(n_words, pa.float64())] * len(sums),
                          *[none(n_words, pa.list_(pa.int32()))] * 2, found.dictionary.cast(pa.string()), held], names=names)
        return pa.concat_tables([rows.cast(terms.schema), terms])

    grouped = dealt(texts, "_id", spread_keys(spark, groups), "_p").groupBy("_p")
    coded = write_table(grouped.applyInArrow(code, schema), "coded")
    drop_table(texts)
    rows = coded.where("word IS NULL").drop("word", "n").withColumnRenamed("_id", row_id)
    return Coded(rows, coded.where("word IS NOT NULL").select("_p", "_i", "word", "n"), groups)


def kept(coded: Coded, *columns: str) -> DataFrame:
    """Columns of the coded documents by group on the executors' disks, until unpersisted; rounds of `per_group` move none of them."""
    rows = coded.rows.select("_p", *columns).repartition(coded.groups, "_p").persist(StorageLevel.DISK_ONLY)
    rows.count()  # only a finished table tells the planner how it is partitioned
    return rows


def per_group(rows: DataFrame, state: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
    """`work` on each group's rows and the state sent to it. There `_p` of the state is `_to`. Rows of `kept` stay where they are."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    return rows.groupBy("_p").cogroup(state.withColumnRenamed("_p", "_to").groupBy("_to")).applyInArrow(run, schema)


def chunks(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a group's rows, and the documents (from 0 in the slice), words and counts of their cells."""
    for batch in table.to_batches():
        lens = batch.column("_w").value_lengths().to_numpy()
        cuts = np.searchsorted(np.cumsum(lens), np.arange(_CHUNK, int(lens.sum()) + _CHUNK, _CHUNK)) if len(lens) else []
        start = 0
        for end in [*[int(c) + 1 for c in cuts], len(lens)]:
            end = min(end, len(lens))
            if end > start:
                part = batch.slice(start, end - start)
                own = np.repeat(np.arange(end - start), lens[start:end])
                yield part, own, part.column("_w").flatten().to_numpy(), part.column("_tf").flatten().to_numpy().astype(float)
                start = end

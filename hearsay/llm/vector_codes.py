"""Product codes of vectors, with nearest entries found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import join_weighted, materialise
from hearsay.llm.vectors import integer_vectors, matrix, written
from hearsay.session import ship_package

OUT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, the lower index among equally near ones.

    Entries are sorted by component sum. Search starts where a part's own sum
    falls and goes outward on both sides; a side ends where the squared gap of
    sums, divided by the dimension, strictly exceeds the best distance, since a
    squared distance is never below that quotient.
    """
    n, dim = parts.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    ranked, entries = sums[order], book[order]
    own = parts.sum(1)
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book))
    middle = np.searchsorted(ranked, own, "left")
    for side in (1, -1):
        who, at = np.arange(n), middle if side == 1 else middle - 1
        while True:
            inside = (at >= 0) & (at < len(book))
            who, at = who[inside], at[inside]
            gap = own[who] - ranked[at]
            bound = best[who]
            go = (gap * gap + dim - 1) // dim <= bound  # gap² > dim * best, without overflow of the product
            who, at = who[go], at[go]
            if not len(who):
                break
            apart = parts[who] - entries[at]
            far = np.einsum("ij,ij->i", apart, apart)
            found = order[at]
            better = (far < best[who]) | ((far == best[who]) & (found < index[who]))
            best[who[better]], index[who[better]] = far[better], found[better]
            at = at + side
    return index, best


def split_parts(ints: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, component), vectors filled with zeros to a multiple of `parts`."""
    fill = -ints.shape[1] % parts
    whole = np.pad(ints, ((0, 0), (0, fill)))
    return whole.reshape(len(ints), parts, -1).transpose(1, 0, 2)


def entry_sums(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """part, entry, n, sums: one row per entry and task, then added up."""
    parts, entries, dim = books.shape
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for p, part in enumerate(split_parts(matrix(batch.column("ints"), width), parts)):
                index, _ = nearest_entries(part, books[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, part)
        p, e = np.nonzero(counts)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), dim).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists], names=["part", "entry", "n", "sums"])

    made = rows.select("ints").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each)


def train_codebooks(rows: DataFrame, width: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """(part, entry, component): starts at the vectors with the smallest ids, moved by floored means.

    Only the books, `parts * entries` short vectors, and their sums pass the driver.
    """
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints", "row").select("ints").limit(entries).toArrow()
    books = np.ascontiguousarray(split_parts(matrix(first.column("ints"), width), parts))
    for _ in range(rounds):
        for r in entry_sums(rows, books, width).toLocalIterator():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
    return books


def encode(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """The rows with `code` and `error` in place of the vector."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = split_parts(matrix(batch.column("ints"), width), len(books))
            found = [nearest_entries(part, book) for part, book in zip(split, books)]
            codes = np.column_stack([index for index, _ in found]).astype(np.uint8)
            error = np.sum([far for _, far in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return rows.select("id", "label", "ints").mapInArrow(run, "id long, label string, code string, error long")


def compress_vectors(
    vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 256,
    parts: int = 16, entries: int = 64, rounds: int = 2,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row per whole vector.

    Components become floor(scale * x). Each of `parts` positions has a codebook
    of at most `entries` (256 at most) vectors, moved in `rounds` rounds. `error`
    is the sum of squared distances, `label_error` its sum over rows of the same
    label, null labels together.

    Vectors that are null or hold a null or non-finite component are dropped. A
    null id is the largest; equal ids start the books in the order of their
    components; repeated rows each have a row. Shorter vectors are filled with
    zeros, as are lengths that are no multiple of `parts`. With fewer vectors
    than `entries` the books are as short; an empty table gives an empty result.
    """
    label = F.when(F.col(label_col).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(label_col).cast("string")))
    rows, width = written(integer_vectors(vecs, id_col, vec_col, scale, label=label), "vectors")
    if rows.isEmpty():
        return vecs.sparkSession.createDataFrame([], OUT)
    books = train_codebooks(rows, width, parts, entries, rounds)
    coded = materialise(encode(rows, books, width), "codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return join_weighted(coded, totals, ["label"], "n").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The contract's query in plain SQL; each round is an assignment of all parts and new entries."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT vec_id, part, any_value(v) AS v, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT x.vec_id, x.part, x.v, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM p x JOIN b{r} b ON x.part = b.part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, entry, list(c ORDER BY i) AS v FROM (
    SELECT part, entry, i, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c FROM (
        SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry),
b{r + 1} AS (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, j AS part, c[j * len(c) // {parts} + 1:(j + 1) * len(c) // {parts}] AS v FROM k, range({parts}) t(j)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries}),
b0 AS (SELECT part, entry, v FROM p JOIN f USING (vec_id)),
{','.join(steps)},
e AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), h
"""


SQL = _sql()

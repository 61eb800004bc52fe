"""Exact top-k search by inner product with a pivot-distance index.

Every vector gets one more component, the root of (longest norm squared minus
its own), so that all have one length and the highest inner products are the
smallest distances. Vectors are keyed by nearest pivot and distance to it and
kept in sorted annuli. A query first visits the annuli it lies in, which gives
it a k-th best distance t; by the triangle inequality a vector at distance r
from a pivot at distance d from the query is no nearer than |d - r|, so only
annuli that reach into [d - t, d + t] are visited, from the nearest outward, and
t shrinks on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from hearsay.llm.common import materialise
from hearsay.llm.vectors import cut_blocks, doubles, first_of_each, integer_vectors, longs, match_blocks, matrix, written
from hearsay.session import ship_package

OUT = "query_id long, rank int, vec_id long, score long"
FOUND = "q_row long, q_id long, id long, row long, score long"
BLOCK = "pivot int, lo double, hi double, row binary, id binary, ints binary, r binary"
QUERY = (
    "reach double, near array<double>, far array<double>, here array<int>, r_lo double, r_hi double, "
    "row binary, id binary, ints binary, best binary, gaps binary"
)
#: Squared distances from floating point are trusted to this share of the largest.
SLACK = 1e-9
NONE = -(1 << 62)


def lengthened(ints: np.ndarray, top: float) -> np.ndarray:
    """With the component that gives all vectors the squared length `top`; a query has zero there."""
    x = ints.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points * points).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Farthest-first starts, moved by a few rounds of means."""
    chosen = [0]
    gap = distances(sample, sample[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(sample, sample[chosen[-1:]])[:, 0])
    pivots = sample[chosen].copy()
    for _ in range(rounds):
        own = distances(sample, pivots).argmin(1)
        for p in range(len(pivots)):
            if (own == p).any():
                pivots[p] = sample[own == p].mean(0)
    return pivots


def key_by_pivot(rows: DataFrame, pivots: np.ndarray, top: float, width: int) -> DataFrame:
    """With `pivot`, the nearest pivot's number, and `r`, the distance to it."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = distances(lengthened(matrix(batch.column("ints"), width), top), pivots)
            own = gaps.argmin(1)
            made = [pa.array(own, pa.int32()), pa.array(gaps[np.arange(len(own)), own], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "pivot", "r"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("pivot", IntegerType()), StructField("r", DoubleType())]))


def search_block(query: dict, block: dict, width: int, top: float, k: int, chunk: int = 1024) -> Iterator[pa.RecordBatch]:
    """The k best of one block for each query of a query block, annulus by annulus from the nearest on."""
    asked, own, best = longs(query["ints"], width), longs(query["row"]), longs(query["best"]).copy()
    gap = doubles(query["gaps"]).reshape(len(own), -1)[:, block["pivot"]]
    rows, ids, ints, r = longs(block["row"]), longs(block["id"]), longs(block["ints"], width), doubles(block["r"])
    fits = float(np.abs(asked).max(initial=0)) * float(np.abs(ints).max(initial=0)) * width < 2**52
    left, right = (asked.astype(np.float64), ints.astype(np.float64)) if fits else (asked, ints)
    squared = (asked.astype(np.float64) ** 2).sum(1) + top
    starts = np.arange(0, len(rows), chunk)
    ends = np.minimum(starts + chunk, len(rows))
    bound = np.maximum(0, np.maximum(gap[:, None] - r[ends - 1], r[starts] - gap[:, None]))
    kept = [np.empty(0, np.int64)] * 3  # query, place in the block, score
    for c in np.argsort(bound.min(0), kind="stable"):
        reach = np.where(best > NONE, squared - 2.0 * best, np.inf) + SLACK * squared
        open_ = np.flatnonzero(bound[:, c] ** 2 <= reach)
        if not len(open_):
            continue
        part = slice(starts[c], ends[c])
        scores = (left[open_] @ right[part].T).astype(np.int64)
        same = own[open_][:, None] == rows[part]
        scores[same] = NONE
        floor = best[open_]
        if scores.shape[1] >= k:
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        q, x = np.nonzero((scores >= floor[:, None]) & ~same)
        kept = [np.concatenate(z) for z in zip(kept, (open_[q], x + starts[c], scores[q, x]))]
        kept = [z[first_of_each(kept[0], kept[2], ids[kept[1]], rows[kept[1]], k)] for z in kept]
        full = np.flatnonzero(np.bincount(kept[0], minlength=len(asked)) == k)
        best[full] = np.maximum(best[full], kept[2][np.searchsorted(kept[0], full, "right") - 1])
    q, x, score = kept
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(z) for z in (own[q], longs(query["id"])[q], ids[x], rows[x], score)], names=["q_row", "q_id", "id", "row", "score"])


def top_k(
    vecs: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024,
    pivots: int = 32, sample: int = 4096, block: int = 16384, query_block: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row that `asks` chooses.

    Components become floor(scale * x). Candidates are all rows but the query's
    own; equal scores go by id, then by row, so repeated ids and repeated vectors
    are rows of their own. Vectors with null or non-finite components and rows
    with a null id take no part; vectors shorter than the longest are filled with
    zeros; a query with fewer than k candidates has them all; an empty table
    gives an empty result. Scores must fit a long.

    Pivots are fitted on the `sample` rows with the smallest id hashes; all rows
    are indexed and the result is exact whatever the pivots. `block` and
    `query_block` bound what a task holds. Where distances to pivots tell little
    (many dimensions without clusters), bounds exclude little, and the work is
    the whole product of query and vector blocks.
    """
    spark = vecs.sparkSession
    rows, width = written(integer_vectors(vecs.where(F.col(id_col).isNotNull()), id_col, vec_col, scale, asks=F.coalesce(asks, F.lit(False))), "vectors")
    square = F.aggregate("ints", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    top = rows.agg(F.max(square)).first()[0]
    if top is None:
        return spark.createDataFrame([], OUT)
    some = rows.select("ints", F.xxhash64("id").alias("h"), "row").orderBy("h", "row").limit(sample).toArrow()
    points = choose_pivots(lengthened(matrix(some.column("ints"), width), top), pivots)
    keyed = materialise(key_by_pivot(rows, points, top, width), "keyed")

    def pack(batch: pa.RecordBatch) -> dict:
        r = np.asarray(batch.column("r"))
        return {"pivot": batch.column("pivot")[0].as_py(), "lo": float(r[0]), "hi": float(r[-1]), "row": np.asarray(batch.column("row")).tobytes(),
                "id": np.asarray(batch.column("id")).tobytes(), "ints": matrix(batch.column("ints"), width).tobytes(), "r": r.tobytes()}

    blocks = cut_blocks(keyed.select("pivot", "r", "row", "id", "ints"), ["pivot", "r", "row"], block, pack, BLOCK, "annuli", split="pivot")

    def pack_queries(batch: pa.RecordBatch) -> dict:
        ints, best = matrix(batch.column("ints"), width), np.asarray(batch.column("best"))
        gaps = distances(np.pad(ints.astype(np.float64), ((0, 0), (0, 1))), points)
        squared = (ints.astype(np.float64) ** 2).sum(1) + top
        reach = np.sqrt(np.maximum(0, np.where(best > NONE, squared - 2.0 * best, 4 * squared) + SLACK * squared))
        return {"reach": float(reach.max()), "near": gaps.min(0).tolist(), "far": gaps.max(0).tolist(), "ints": ints.tobytes(),
                "best": best.tobytes(), "gaps": gaps.tobytes(), "here": sorted(set(batch.column("pivot").to_pylist())),
                "r_lo": float(np.min(batch.column("r"))), "r_hi": float(np.max(batch.column("r"))),
                "row": np.asarray(batch.column("row")).tobytes(), "id": np.asarray(batch.column("id")).tobytes()}

    inside = F.array_contains("q.here", F.col("b.pivot")) & (F.col("b.lo") <= F.col("q.r_hi")) & (F.col("b.hi") >= F.col("q.r_lo"))
    at = F.col("b.pivot") + 1
    reached = (F.col("b.lo") <= F.element_at("q.far", at) + F.col("q.reach")) & (F.col("b.hi") >= F.element_at("q.near", at) - F.col("q.reach"))
    wanted = keyed.where("asks").select("pivot", "r", "row", "id", "ints")

    def visit(asking: DataFrame, meets: Column, label: str) -> DataFrame:
        cut = cut_blocks(asking, ["pivot", "r", "row"], query_block, pack_queries, QUERY, f"{label}-queries")
        search = partial(search_block, width=width, top=top, k=k)
        return materialise(match_blocks(cut, blocks, meets, ["row", "id", "ints", "best", "gaps"], ["pivot", "row", "id", "ints", "r"], search, FOUND), label)

    ranked = Window.partitionBy("q_row").orderBy(F.desc("score"), "id", "row")
    seeds = visit(wanted.withColumn("best", F.lit(NONE)), inside, "seeds")
    kth = seeds.withColumn("place", F.row_number().over(ranked)).where(F.col("place") == k).select(F.col("q_row").alias("row"), F.col("score").alias("best"))
    rest = visit(wanted.join(kth, "row", "left").withColumn("best", F.coalesce("best", F.lit(NONE))), reached, "found")
    final = rest.unionByName(seeds).distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return final.select(F.col("q_id").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


#: The contract's query in plain SQL.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""

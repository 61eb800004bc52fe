"""Hard negatives by threshold joins over an index that leaves out what norms already bound.

A vector's leading dimensions stay out of the index of a block while the norms
of both sides over them can't reach the threshold: a pair that reaches it must
then share an indexed dimension. Partial scores are accumulated from the
strongest dimensions on; a pair goes as soon as its partial score and the norms
that remain stay under the threshold, and those left are scored in full.
Thresholds start close to the positives' scores and are lowered for the anchors
whose windows are not full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.llm.common import materialise
from hearsay.llm.vectors import cut_blocks, first_of_each, integer_vectors, longs, match_blocks, matrix, written

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
BLOCK = "l_lo string, l_hi string, norm double, labels array<string>, row binary, id binary, ints binary, label_no binary"
QUERY = f"{BLOCK}, floor double, goals binary"
FOUND = "q_row long, q_id long, place int, id long, row long, score long"
NONE = -(1 << 62)
#: Norms from floating point are trusted to this share.
SLACK = 1e-9
DIMENSIONS = 16


def exact_scores(q: np.ndarray, x: np.ndarray, pairs: int = 1 << 16) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[np.einsum("ij,ij->i", q[at: at + pairs], x[at: at + pairs]) for at in range(0, len(q), pairs)]])


def threshold_pairs(queries: np.ndarray, rows: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose inner product is at least the query's floor."""
    strength = np.argsort((rows.astype(np.float64) ** 2).sum(0), kind="stable")
    q, x = queries[:, strength].astype(np.float64), rows[:, strength].astype(np.float64)
    edges = [*range(0, q.shape[1], DIMENSIONS), q.shape[1]]
    norms = lambda v: np.sqrt(np.column_stack([np.zeros(len(v)), np.cumsum(v * v, axis=1)])[:, edges]) * (1 + SLACK)
    q_norm, x_norm = norms(q), norms(x)
    least = floors.min()
    start = np.maximum(0, (x_norm * q_norm.max(0) < least).sum(1) - 1)
    order = np.argsort(start, kind="stable")
    alive = order[: np.searchsorted(start[order], len(edges) - 1, "left")]
    acc = np.zeros((len(q), len(alive)))
    slack = SLACK * (1 + np.abs(floors).max()) + 1e-6
    for g in range(len(edges) - 2, -1, -1):
        posted = int(np.searchsorted(start[alive], g, "right"))
        if not posted:
            continue
        dims = slice(edges[g], edges[g + 1])
        acc[:, :posted] += q[:, dims] @ x[alive[:posted], dims].T
        if g:
            hope = acc[:, :posted] + q_norm[:, g, None] * x_norm[None, alive[:posted], g] + slack >= floors[:, None]
            stay = np.concatenate([hope.any(0), np.ones(len(alive) - posted, bool)])
            if stay.mean() < 0.8:
                alive, acc = alive[stay], acc[:, stay]
    left = q_norm[:, start[alive]] * x_norm[alive, start[alive]]
    i, j = np.nonzero(acc + left + slack >= floors[:, None])
    j = alive[j]
    scores = exact_scores(queries[i], rows[j])
    reach = scores >= floors[i]
    return i[reach], j[reach], scores[reach]


def labels_in(query: dict, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Label numbers of both sides, by the block's numbering; -1 where the block lacks the query's label."""
    at = {name: i for i, name in enumerate(block["labels"])}
    own = np.array([at.get(name, -1) for name in query["labels"]], np.int64)
    return own[longs(query["label_no"])], longs(block["label_no"])


def nearest_alike(query: dict, block: dict, width: int, k: int, chunk: int = 4096) -> Iterator[pa.RecordBatch]:
    """The k best rows of the same label for each query; the k-th best so far is the threshold of what follows."""
    asked, rows, ids = longs(query["ints"], width), longs(block["row"]), longs(block["id"])
    ints, own = longs(block["ints"], width), longs(query["row"])
    q_label, x_label = labels_in(query, block)
    out = []
    for label in np.intersect1d(q_label, x_label):
        who, where = np.flatnonzero(q_label == label), np.flatnonzero(x_label == label)
        floors = np.full(len(who), NONE, np.int64)
        kept = [np.empty(0, np.int64)] * 3
        lead = max(64, 2 * k)
        for a, b in [(0, lead), *[(at, at + chunk) for at in range(lead, len(where), chunk)]]:
            part = where[a:b]
            if a == 0:
                i, j = (z.ravel() for z in np.indices((len(who), len(part))))
                score = exact_scores(asked[who[i]], ints[part[j]])
            else:
                i, j, score = threshold_pairs(asked[who], ints[part], floors)
            other = own[who[i]] != rows[part[j]]
            kept = [np.concatenate(z) for z in zip(kept, (i[other], part[j[other]], score[other]))]
            first = first_of_each(kept[0], kept[2], ids[kept[1]], rows[kept[1]], k)
            kept = [z[first] for z in kept]
            full = np.flatnonzero(np.bincount(kept[0], minlength=len(who)) == k)
            floors[full] = kept[2][np.searchsorted(kept[0], full, "right") - 1]
        out.append((who[kept[0]], kept[1], kept[2]))
    if out:
        q, x, score = (np.concatenate(z) for z in zip(*out))
        yield _found(own[q], longs(query["id"])[q], np.zeros(len(q), np.int64), ids[x], rows[x], score)


def nearest_unlike(
    query: dict, block: dict, width: int, k: int, step: int, low: int, high: int, chunk: int = 4096,
) -> Iterator[pa.RecordBatch]:
    """For each query and goal the k best rows of other labels within low and high percent of the goal, down to `step` percent."""
    asked, rows, ids = longs(query["ints"], width), longs(block["row"]), longs(block["id"])
    ints, own, goals = longs(block["ints"], width), longs(query["row"]), longs(query["goals"]).reshape(len(longs(query["row"])), -1)
    q_label, x_label = labels_in(query, block)
    wanted = goals > NONE
    reached = np.where(wanted, np.ceil(goals * (step / 100) * (1 - SLACK)), np.inf)
    kept = [np.empty(0, np.int64)] * 4  # query, place of the goal, place in the block, score
    for at in range(0, len(rows), chunk):
        i, j, score = threshold_pairs(asked, ints[at: at + chunk], reached.min(1))
        j = j + at
        unlike = q_label[i] != x_label[j]
        i, j, score = i[unlike], j[unlike], score[unlike]
        for p in range(goals.shape[1]):
            goal = goals[i, p]
            fits = (goal > NONE) & (low * goal <= 100 * score) & (100 * score <= high * goal) & (score >= reached[i, p])
            kept = [np.concatenate(z) for z in zip(kept, (i[fits], np.full(fits.sum(), p), j[fits], score[fits]))]
        window = kept[0] * goals.shape[1] + kept[1]
        first = first_of_each(window, kept[3], ids[kept[2]], rows[kept[2]], k)
        kept, window = [z[first] for z in kept], window[first]
        full = np.flatnonzero(np.bincount(window, minlength=goals.size) == k)
        reached.ravel()[full] = np.maximum(reached.ravel()[full], kept[3][np.searchsorted(window, full, "right") - 1])
    q, p, x, score = kept
    if len(q):
        yield _found(own[q], longs(query["id"])[q], p, ids[x], rows[x], score)


def _found(q_row: np.ndarray, q_id: np.ndarray, place: np.ndarray, ident: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(q_row), pa.array(q_id), pa.array(place, pa.int32()), pa.array(ident), pa.array(row), pa.array(score)]
    return pa.RecordBatch.from_arrays(arrays, names=["q_row", "q_id", "place", "id", "row", "score"])


def mine_negatives(
    vecs: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, steps: Sequence[int] = (95, 88),
    block: int = 16384, query_block: int = 512,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), scores are integer inner products, equal
    ones go by id, then by row. An anchor's positives are its best `positives`
    other rows of the same label; each gets the best `negatives` rows of other
    labels that score at least `low` and at most `high` percent of it. Fewer are
    all there are; a positive below zero has an empty window. The join runs at
    each of `steps` percent, then at `low`, for the anchors whose windows aren't full.

    Rows with a null label, a null id, a null vector or a null or non-finite
    component take no part; shorter vectors are filled with zeros; repeated ids
    and vectors are rows of their own; an empty table gives an empty result. A
    label with a third of all rows lies in many blocks like any other.
    """
    label = F.col(label) if isinstance(label, str) else label
    whole = vecs.where(F.col(id_col).isNotNull() & label.isNotNull())
    rows, width = written(integer_vectors(whole, id_col, vec_col, scale, label=label.cast("string"), asks=F.coalesce(anchors, F.lit(False))), "labelled")
    order = ["label", "row"]

    def pack(batch: pa.RecordBatch) -> dict:
        ints, names = matrix(batch.column("ints"), width), batch.column("label").dictionary_encode()
        return {"l_lo": names[0].as_py(), "l_hi": names[-1].as_py(), "norm": float(np.sqrt((ints.astype(np.float64) ** 2).sum(1)).max()),
                "labels": names.dictionary.to_pylist(), "row": np.asarray(batch.column("row")).tobytes(), "id": np.asarray(batch.column("id")).tobytes(),
                "ints": ints.tobytes(), "label_no": np.asarray(names.indices).astype(np.int64).tobytes()}

    def pack_query(batch: pa.RecordBatch, step: int) -> dict:
        goals = np.array([[NONE if g is None else g for g in row] for row in batch.column("goals").to_pylist()], np.int64)
        floor = float((goals[goals > NONE] * (step / 100)).min(initial=np.inf))
        return {**pack(batch), "floor": floor, "goals": goals.tobytes()}

    blocks = cut_blocks(rows.select("label", "row", "id", "ints"), order, block, pack, BLOCK, "label-blocks")
    asked = rows.where("asks").select("label", "row", "id", "ints")
    held = ["row", "id", "ints", "labels", "label_no"]
    ranked = Window.partitionBy("q_row", "place").orderBy(F.desc("score"), "id", "row")

    start = cut_blocks(asked, order, query_block, pack, BLOCK, "anchors")
    share = (F.col("q.l_lo") <= F.col("b.l_hi")) & (F.col("b.l_lo") <= F.col("q.l_hi"))
    alike = match_blocks(start, blocks, share, held, held, partial(nearest_alike, width=width, k=positives), FOUND)
    alike = alike.withColumn("n", F.row_number().over(ranked)).where((F.col("n") <= positives) & (F.col("score") >= 0))
    alike = materialise(alike.select("q_row", (F.col("n") - 1).alias("place"), F.col("q_id").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    mixed = ~((F.col("q.l_lo") == F.col("q.l_hi")) & (F.col("b.l_lo") == F.col("b.l_hi")) & (F.col("q.l_lo") == F.col("b.l_lo")))
    near = mixed & (F.col("q.floor") <= F.col("q.norm") * F.col("b.norm") * (1 + SLACK) + 1)
    goal = F.array(*[F.max(F.when(F.col("place") == p, F.col("positive_score"))) for p in range(positives)])
    open_, done = alike.select("q_row", "place", "positive_score"), []
    for step in [*[s for s in steps if s > low], low]:
        goals = open_.groupBy("q_row").agg(goal.alias("goals")).withColumnRenamed("q_row", "row")
        queries = cut_blocks(asked.join(goals, "row"), order, query_block, partial(pack_query, step=step), QUERY, "goals")
        mine = partial(nearest_unlike, width=width, k=negatives, step=step, low=low, high=high)
        found = match_blocks(queries, blocks, near, [*held, "goals"], held, mine, FOUND)
        found = materialise(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives), "negatives")
        if step == low:
            done.append(found)
            break
        full = found.where(F.col("rank") == negatives).select("q_row", "place")
        done.append(found.join(full, ["q_row", "place"], "left_semi"))
        open_ = materialise(open_.join(full, ["q_row", "place"], "left_anti"), "open")
        if open_.isEmpty():
            break
    both = done[0]
    for more in done[1:]:
        both = both.unionByName(more)
    return both.join(alike, ["q_row", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The contract's query in plain SQL.
SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, list_inner_product(a.c, v.c)::BIGINT AS score
    FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""

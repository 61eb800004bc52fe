"""Top-k search, hard negatives and vector codes against plain Python, on vectors with awkward cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import hard_negatives as H, top_search as S, vector_codes as V
from hearsay.llm.vectors import first_of_each

SCHEMA = "vec_id long, embedding array<float>, label int, score double, row string, pivot int, n long"


def rows_of(seed, n=700, dim=12, copies=200):
    """Clusters, a third of the rows the same vector, near copies, ties, repeated ids, null and non-finite vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    x = centres[rng.integers(0, 8, n)] * 0.2 + rng.normal(size=(n, dim)) * 0.05
    x[:copies] = x[0]
    x[copies: copies + 30] = x[0] + rng.normal(size=(30, dim)) * 0.002
    x[-5] *= 40
    out = [(i, [float(v) for v in row], int(rng.integers(0, 4)) if i % 3 else 1, 0.5, "own", 3, 7) for i, row in enumerate(x.astype(np.float32))]
    out += [out[50], (100, out[3][1], 2, None, None, None, None), (n + 1, None, 1, 0.0, "r", 1, 1), (200, [float("nan")] * dim, 1, 0.0, "r", 1, 1)]
    out += [(n + 2, [0.1, None] + [0.0] * (dim - 2), 1, 0.0, "r", 1, 1), (n + 3, [float("inf")] * dim, 2, 0.0, "r", 1, 1), (None, out[4][1], 2, 0.0, "r", 1, 1)]
    out += [(400, [0.3] * (dim - 4), 2, 0.0, "r", 1, 1), (n + 4, [], 3, 0.0, "r", 1, 1), (n + 5, out[7][1], None, 0.0, "r", 1, 1)]
    return out


def plain(rows, scale, labelled=False):
    """(id, label, integers) of the rows that take part."""
    ok = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    width = max(map(lambda r: len(r[1]), ok), default=0)
    ints = [[math.floor(scale * v) for v in r[1]] + [0] * (width - len(r[1])) for r in ok]
    return [(r[0], r[2], np.array(x, np.int64)) for r, x in zip(ok, ints) if not labelled or r[2] is not None]


def plain_top(rows, k, every):
    kept = [r for r in plain(rows, 1024) if r[0] is not None]
    out = []
    for i, (q, _, x) in enumerate(kept):
        if q % every == 0:
            best = sorted((-int(x @ y), v, j) for j, (v, _, y) in enumerate(kept) if j != i)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v, _) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module", params=[1, 2])
def vecs(spark, request):
    rows = rows_of(request.param)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("block, query_block, pivots", [(64, 8, 5), (16384, 512, 32), (16, 3, 1)])
def test_top_k_is_exact(vecs, block, query_block, pivots):
    rows, df = vecs
    got = S.top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=query_block, pivots=pivots)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 10, 50)


def test_top_k_with_few_or_no_candidates(spark):
    few = [(i, [float(i), 1.0], 0, 0.0, "r", 1, 1) for i in range(4)]
    df = spark.createDataFrame(few, SCHEMA)
    got = S.top_k(df, F.col("vec_id") % 2 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(few, 10, 2)
    assert S.top_k(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []
    assert S.top_k(df.limit(1), F.lit(True)).collect() == []
    assert S.top_k(df, F.lit(False)).collect() == []


def test_bounds_skip_annuli_of_far_clusters(spark, monkeypatch):
    """Distant clusters are not visited, and the result is the whole one."""
    rng = np.random.default_rng(3)
    unit = np.eye(16)[rng.integers(0, 16, 3000)] + rng.normal(size=(3000, 16)) * 0.01
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    rows = [(i, [float(v) for v in x], 0, 0.0, "r", 1, 1) for i, x in enumerate(unit)]
    seen = []
    real = S.match_blocks

    def counted(queries, blocks, meets, q_cols, b_cols, kernel, schema):
        left, right = queries.select("block", "reach", "near", "far", "here", "r_lo", "r_hi"), blocks.select("block", "pivot", "lo", "hi")
        seen.append((left.alias("q").join(right.alias("b"), meets).count(), left.count() * right.count()))
        return real(queries, blocks, meets, q_cols, b_cols, kernel, schema)

    monkeypatch.setattr(S, "match_blocks", counted)
    got = S.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, query_block=4, block=64)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 10, 100)
    assert seen[1][0] < seen[1][1] / 4


def test_first_of_each():
    q, s, i, r = (np.array(z) for z in ([1, 0, 1, 1, 0], [5, 7, 5, 9, 7], [2, 4, 1, 8, 3], [0, 1, 2, 3, 4]))
    assert first_of_each(q, s, i, r, 2).tolist() == [4, 1, 3, 2]
    assert first_of_each(*(np.empty(0, np.int64),) * 4, 2).tolist() == []


# 12 ------------------------------------------------------------------------------------------------------------------

def plain_negatives(rows, every=10, positives=5, negatives=5):
    kept = [(v, lab if v is None or v % 7 else (lab + 1) % 10, x) for v, lab, x in plain(rows, 256, True) if v is not None]
    out = []
    for i, (a, lab, x) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-int(x @ y), v, j) for j, (v, _, y) in enumerate(kept) if j != i)
        alike = [(v, -s) for s, v, j in scored if kept[j][1] == lab][:positives]
        for p, ps in alike:
            window = [(v, -s) for s, v, j in scored if kept[j][1] != lab and 80 * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(a, p, r + 1, v, ps, s) for r, (v, s) in enumerate(window)]
    return sorted(out)


def moved_label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("block, query_block, steps", [(64, 8, (95, 88)), (16384, 512, ()), (50, 3, (99, 97, 90))])
def test_hard_negatives_are_exact(vecs, block, query_block, steps):
    rows, df = vecs
    got = H.mine_negatives(df, F.col("vec_id") % 10 == 0, label=moved_label(), block=block, query_block=query_block, steps=steps)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_hard_negatives_of_few_rows_and_texts_as_labels(spark):
    few = [(i, [1.0, float(i % 3)], i % 2, 0.0, "ab"[i % 2], 1, 1) for i in range(8)]
    df = spark.createDataFrame(few, SCHEMA)
    want = sorted(tuple(r) for r in H.mine_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert want and want == sorted(tuple(r) for r in H.mine_negatives(df, F.col("vec_id") % 10 == 0, label="row").collect())
    assert H.mine_negatives(df.limit(0), F.lit(True)).collect() == []
    assert H.mine_negatives(df.where("label = 1"), F.lit(True)).collect() == []
    assert H.mine_negatives(df.limit(1), F.lit(True)).collect() == []


def test_threshold_pairs_miss_nothing():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-90, 90, (40, 37)), rng.integers(-90, 90, (300, 37))
    x[:, :20] //= 30
    scores = q @ x.T
    for floors in (np.quantile(scores, 0.99, axis=1), np.full(40, 0.0), np.full(40, 1e9), np.full(40, -1e9), scores.max(1).astype(float)):
        i, j, s = H.threshold_pairs(q, x, floors)
        assert sorted(zip(i, j, s)) == [(a, b, scores[a, b]) for a in range(40) for b in range(300) if scores[a, b] >= floors[a]]


# 13 ------------------------------------------------------------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = plain(rows, 256)
    width = len(kept[0][2]) + -len(kept[0][2]) % parts
    x = np.array([np.pad(v, (0, width - len(v))) for _, _, v in kept]).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, list(kept[i][2])))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    assign = lambda: np.array([((x[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(parts)]).T
    for _ in range(rounds):
        code = assign()
        for p in range(parts):
            for e in np.unique(code[:, p]):
                own = x[code[:, p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    code = assign()
    error = [sum(int(((x[i, p] - books[p, code[i, p]]) ** 2).sum()) for p in range(parts)) for i in range(len(kept))]
    by = {}
    for (_, label, _), e in zip(kept, error):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return sorted(((v, "".join(f"{c:02x}" for c in code[i]), error[i], by[label], digest) for i, (v, label, _) in enumerate(kept)), key=str)


@pytest.mark.parametrize("parts, entries", [(16, 64), (4, 16), (3, 1)])
def test_codes_equal_plain_codes(vecs, parts, entries):
    rows, df = vecs
    got = V.compress_vectors(df, parts=parts, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, parts, entries)


def test_codes_of_few_vectors(spark):
    df = spark.createDataFrame(rows_of(3)[300:310], SCHEMA)
    assert sorted((tuple(r) for r in V.compress_vectors(df).collect()), key=str) == plain_codes(rows_of(3)[300:310])
    assert V.compress_vectors(df.limit(0)).collect() == []


def test_equal_average_search_takes_the_lowest_of_equal_entries():
    rng = np.random.default_rng(6)
    for dim in (1, 3, 4):
        book, x = rng.integers(-4, 5, (40, dim)), rng.integers(-6, 7, (500, dim))
        far = ((x[:, None] - book) ** 2).sum(2)
        index, best = V.nearest_entries(x, book)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()

"""SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from hearsay.llm.common import add_by_text, join_weighted, materialise

SHINGLE, SEED, BITS = 4, 42, 64
_CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """64 bits, each 1 where more than half of the shingles' hashes have it; no words give zero."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    digest = xxhash.xxh64_intdigest
    if n < SHINGLE:
        return digest(joined, SEED)
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - SHINGLE + 1]
    spans = zip(starts.tolist(), ends[SHINGLE - 1:].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        rows = hashes[at: at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def add_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    def work(texts: list[bytes]) -> pa.Array:
        made = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        return pa.array(made.view(np.int64), pa.int64())

    return add_by_text(docs, text_col, name, LongType(), work)


def segments_of(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment.

    Two fingerprints within `distance` are within radius `distance // segments`
    in one of the first `distance % segments + 1` segments, or one closer in one
    of the rest.
    """
    base, more = divmod(distance, segments)
    widths = [BITS // segments + (k < BITS % segments) for k in range(segments)]
    shifts = [sum(widths[:k]) for k in range(segments)]
    radii = [base if k <= more else base - 1 for k in range(segments)]
    return [x for x in zip(shifts, widths, radii) if x[2] >= 0]


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def close_pairs(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints `f` that differ in at most `distance` bits.

    Each fingerprint enters one table per segment and asks each table for the
    small ball around its segment; matches are verified over all bits. Every pair
    is found, some more than once. Three segments suit up to some 10^8 distinct
    fingerprints; two make tables of 32 bits and balls of 529 for more.
    """
    tables, probes = [], []
    for k, (shift, width, radius) in enumerate(segments_of(distance, segments)):
        value = F.shiftrightunsigned("f", shift).bitwiseAND(F.lit((1 << width) - 1))
        tables.append(prints.select(F.lit(k).alias("k"), value.alias("v"), F.col("f").alias("b")))
        near = F.explode(F.array(*[F.lit(m).cast("long") for m in ball(width, radius)]))
        probes.append(prints.select(F.lit(k).alias("k"), value.alias("own"), F.col("f").alias("a"), near.alias("m"))
                      .select("k", F.col("own").bitwiseXOR(F.col("m")).alias("v"), "a"))
    left, right = probes[0], tables[0]
    for p, t in zip(probes[1:], tables[1:]):
        left, right = left.unionAll(p), right.unionAll(t)
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right.hint("merge"), (left.k == right.k) & (left.v == right.v) & (F.col("a") < F.col("b")) & within).select("a", "b")


def roots(pairs: DataFrame) -> DataFrame:
    """(f, root) for every fingerprint in a pair: the smallest one reachable.

    Large-star and small-star steps in turn, each a grouped minimum and a join
    written to the shared folder, until a round changes nothing.
    """
    edges = materialise(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("w")), "least")
        large = join_weighted(both.where("v > u"), least, ["u"], "w").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialise(large.distinct(), "stars")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w")), "least")
        small = join_weighted(large, least, ["u"], "w").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            return edges.groupBy(F.col("u").alias("f")).agg(F.min("v").alias("root"))
        seen = now


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, segments: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, n_links, text_hash.

    Equal fingerprints are one node, so copies never meet in pairs. A document's
    component_id is the smallest id reachable; n_links counts the other distinct
    fingerprints within `distance`. Null and empty texts have fingerprint zero
    and link like any other; null ids are ignored by the minimum, so a group of
    them only has a null component_id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    rows = add_fingerprint(rows, "_text", "f").select("doc_id", "f", F.xxhash64("_text").alias("text_hash"))
    rows = materialise(rows, "prints")
    prints = materialise(rows.groupBy("f").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    pairs = materialise(close_pairs(prints, distance, segments).distinct(), "pairs")
    links = pairs.select(F.col("a").alias("f")).unionAll(pairs.select(F.col("b").alias("f"))).groupBy("f").agg(F.count(F.lit(1)).alias("n_links"))
    named = prints.join(roots(pairs), "f", "left").join(links, "f", "left")
    named = named.withColumn("root", F.coalesce("root", "f"))
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialise(named.join(groups, "root").select("f", "n", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    out = join_weighted(rows, classes, ["f"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", "n_links", "text_hash")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, the one whose id names it, with the columns of `docs`.

    Where rows share that id, the one with the smallest text hash stays, and
    where text and id are the same in several rows, all of these stay: copies
    are left to exact dedup. A group of null ids keeps its smallest text hash.
    """
    first = near_groups(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = F.struct("text_hash")
    first = first.groupBy(F.col("component_id"), F.when(F.col("doc_id").isNull(), F.col("fingerprint")).alias("g")).agg(F.min(one).alias("m"))
    keep = first.select(F.col("component_id").alias("_id"), F.col("m.text_hash").alias("_hash"))
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_id"]) & (F.xxhash64(docs[text_col]) == keep["_hash"]), "left_semi")

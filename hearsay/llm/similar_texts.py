"""Near copies by wide SimHash fingerprints, multi-index hashing and an exact check of their shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from hearsay.llm.common import join_weighted, materialise, slices
from hearsay.llm.simhash import ball, roots, segments_of
from hearsay.operators.bloom import bloom_filter
from hearsay.session import ship_package

SHINGLE, SIMILARITY, BITS = 5, 0.8, 128
#: Segments of each 64-bit word; two fingerprints meet where a segment differs in at most two bits.
SEGMENTS = 3
#: Complete distance up to which a pair is checked; at a similarity of 0.8 about 19 bits differ, of unrelated texts 64.
DISTANCE = 28
#: Words of 64 bits in a sketch of a set of shingles.
WORDS = 16
_CHUNK = 1 << 14


def shingle_hashes(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes, as bytes in rows, of all word shingles of a lower-cased text, and 64 bits of the distinct ones, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty((0, 16), np.uint8), np.empty(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - size + 1)
    spans = zip(starts[:last].tolist(), ends[min(size, len(words)) - 1:].tolist())
    digest = xxhash.xxh3_128_digest
    rows = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in spans]), np.uint8).reshape(-1, 16)
    return rows, np.unique(np.ascontiguousarray(rows[:, :8]).view(np.int64).ravel())


def wide_print(rows: np.ndarray) -> tuple[int, int]:
    """Two words of 64 bits, a bit 1 where more than half of the hashes have it."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(rows), _CHUNK):
        counts += np.unpackbits(rows[at: at + _CHUNK], axis=1).sum(0, dtype=np.int64)
    first, second = np.packbits(2 * counts > len(rows)).view(">i8") if len(rows) else (0, 0)
    return int(first), int(second)


def add_prints(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """All columns but the text, with the fingerprint `f0`, `f1`, and of the set of shingles its hash `sig` and its size `n`."""
    ship_package(rows.sparkSession)
    place = rows.columns.index(text_col)
    names = ["f0", "f1", "sig", "n"]
    kept = [f for f in rows.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = []
            for text in batch.column(place).cast(pa.binary()).to_pylist():
                hashes, distinct = shingle_hashes(text or b"", size)
                made.append((*wide_print(hashes), xxhash.xxh3_64_intdigest(distinct.tobytes()) - (1 << 63), len(distinct)))
            columns = [pa.array(c, pa.int64()) for c in zip(*made)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns], names=[*[f.name for f in kept], *names])

    return rows.mapInArrow(run, StructType([*kept, *[StructField(n, LongType()) for n in names]]))


def add_shingles(rows: DataFrame, text_col: str, size: int) -> DataFrame:
    """All columns but the text, with `shingles`, the hashes of its distinct shingles."""
    ship_package(rows.sparkSession)
    place = rows.columns.index(text_col)
    kept = [f for f in rows.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            sets = [shingle_hashes(t or b"", size)[1] for t in batch.column(place).cast(pa.binary()).to_pylist()]
            lists = pa.array(sets, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], lists], names=[*[f.name for f in kept], "shingles"])

    return rows.mapInArrow(run, StructType([*kept, StructField("shingles", ArrayType(LongType()))]))


def _segments(word: str, first: int) -> list[tuple[int, Column, int]]:
    """(number, value, width) of each segment of a 64-bit word."""
    return [(first + k, F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << width) - 1)), width) for k, (shift, width, _) in enumerate(segments_of(SEGMENTS, SEGMENTS))]


def _entries(nodes: DataFrame, flips: bool) -> DataFrame:
    """A row per segment, and per neighbour of its value at one bit: `at`, the segment and the value, the flipped bit (-1: none) and the node's columns."""
    cells = []
    for k, value, width in [*_segments("f0", 0), *_segments("f1", SEGMENTS)]:
        masks = [(-1, 0), *[(b, 1 << b) for b in range(width if flips else 0)]]
        cells += [F.struct(value.bitwiseXOR(F.lit(mask | k << 32)).alias("at"), F.lit(bit).cast("byte").alias("bit")) for bit, mask in masks]
    return nodes.select("*", F.explode(F.array(*cells)).alias("_e")).select(*nodes.columns, "_e.*")


def _near(a: str, b: str, similarity: float) -> Column:
    """Complete distance, and sizes that allow the similarity at all."""
    apart = F.bit_count(F.col(f"{a}.f0").bitwiseXOR(F.col(f"{b}.f0"))) + F.bit_count(F.col(f"{a}.f1").bitwiseXOR(F.col(f"{b}.f1")))
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (apart <= DISTANCE) & (small >= large * similarity)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("same") >= similarity * (F.size("x") + F.size("y") - F.col("same"))).select("a", "b")


def _differ(a: str, b: str) -> Column:
    """One meeting of two entries counts: equal flips of equal values have met without."""
    return (F.col(f"{a}.bit") != F.col(f"{b}.bit")) | (F.col(f"{a}.bit") < 0)


def _meet(a: str, b: str) -> Column:
    """A segment of the two differs in at most two bits."""
    cells = [zip(_segments(f"{a}.{w}", 0), _segments(f"{b}.{w}", 0)) for w in ("f0", "f1")]
    return F.array_min(F.array(*[F.bit_count(x.bitwiseXOR(y)) for pairs in cells for (_, x, _), (_, y, _) in pairs])) <= 2


def _crowded(whole: DataFrame, shared: DataFrame, crowd: int) -> DataFrame:
    """The nodes of which a segment is within two bits of a value that more than `crowd` nodes have, beyond four times what chance gives.

    Any other node meets at most that many by each value it can meet by.
    """
    chance = whole.count() // (2 * SEGMENTS << 64 // SEGMENTS)
    full = shared.where(F.col("w") > crowd + 4 * chance)
    width = max(width for _, width, _ in segments_of(SEGMENTS, SEGMENTS))
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, 2)])
    around = full.select("at", F.explode(masks).alias("m")).select(F.col("at").bitwiseXOR(F.col("m")).alias("at"))
    return whole.join(around.distinct(), "at", "left_semi").select("node")


def _rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """node, pos, s, sketch: of the shingles of each node, rarest in the table first, those one of which a similar set must have.

    The sketch has a bit for each of 64 * WORDS buckets of shingles: whether their number is odd.
    """
    cells = sets.select("node", F.explode("shingles").alias("s"))
    often = cells.groupBy("s").agg(F.count(F.lit(1)).alias("w")).withColumn("often", F.col("w"))
    cells = join_weighted(cells, materialise(often, "crowd-shingles"), ["s"], "w")
    bit = [F.when(F.pmod("s", F.lit(WORDS)) == k, F.expr(f"shiftleft(1L, cast(pmod(s div {WORDS}, 64) as int))")).otherwise(0) for k in range(WORDS)]
    ranked = cells.groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("often", "s"))).alias("l"), *[F.bit_xor(b).alias(f"_b{k}") for k, b in enumerate(bit)])
    ranked = ranked.select("node", "l", F.array(*[f"_b{k}" for k in range(WORDS)]).alias("sketch"))
    first = F.slice("l", F.lit(1), (F.floor(F.size("l") * (1 - similarity) + 1e-6) + 1).cast("int"))
    return ranked.select("node", "sketch", F.posexplode(first).alias("pos", "_c")).select("node", "sketch", "pos", "_c.s")


def _crowd_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of different parts that meet, and can have the similarity by the places of a shingle they share.

    Two sets that have m shingles in common share one that is in none of the last m - 1 places of either. A shingle that
    only one of them has changes one bit of their sketches, so these differ in no more bits than the sets in shingles.
    Nodes of the part that has a shingle most often are asked only by those of other parts, never by each other.
    """
    cells = materialise(_rarest(sets, similarity).join(nodes, "node"), "crowd-rarest")
    held = cells.groupBy("s", "part").agg(F.count(F.lit(1)).alias("c"))
    most = materialise(held.groupBy("s").agg(F.max_by("part", F.struct("c", "part")).alias("most"), F.sum("c").alias("w")), "crowd-most")
    x, y = join_weighted(cells, most, ["s"], "w").where("part <> most").alias("x"), cells.alias("y")
    least = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6
    placed = (F.col("x.pos") + least <= F.col("x.n")) & (F.col("y.pos") + least <= F.col("y.n"))
    differ = reduce(add, [F.bit_count(F.col("x.sketch")[k].bitwiseXOR(F.col("y.sketch")[k])) for k in range(WORDS)])
    alike = differ <= F.col("x.n") + F.col("y.n") - 2 * least
    apart = (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("x.most")) | (F.col("x.node") < F.col("y.node")))
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & apart & placed & alike & _near("x", "y", similarity) & _meet("x", "y"))
    ends = F.least("x.node", "y.node"), F.greatest("x.node", "y.node")
    return met.select(*[F.struct(end.alias("node")).alias(name) for end, name in zip(ends, "xy")])


def similar_groups(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, similarity: float = SIMILARITY, hub: int = 1000, crowd: int = 20) -> DataFrame:
    """doc_id, text_hash, group: documents linked by shingle sets of at least `similarity` (Jaccard) share a group.

    Texts with the same set of shingles are one node. Of the nodes that share a
    whole segment, the best connected one, likely what the others are copies of,
    is linked to each. These links are checked in full, and nodes linked to one
    centre are a part. Then all nodes
    enter a table per segment under their value and its neighbours at one bit, so
    two whose segments differ in at most two bits meet; pairs of different parts
    are verified over all 128 bits, by the sizes of their sets and by the sets.
    The nodes of parts above `hub` nodes, and all near a segment that more than
    `crowd` nodes share, and more than by chance, whatever their parts, are a crowd.
    Before, parts above `crowd` nodes take in what their centre is linked to by
    entries, and in a crowd the part that has a shingle most often is met by others only.
    Two texts of which one isn't linked to the centre can be linked only by
    shingles that they have or lack against it, so in a crowd those meet that
    share one of their rarest and whose sketches allow the similarity; the same
    pairs are linked. So each other node makes a bounded number of pairs.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), key.alias("key"), F.col(text_col).alias("_text"))
    prints = materialise(add_prints(rows, "_text", size), "wide-prints")
    nodes = prints.groupBy("sig", "f0", "f1", "n").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    slim = nodes.where("n > 0").select("node", "f0", "f1", F.col("n").cast("int").alias("n"))

    def sets_of(asked: DataFrame, label: str) -> DataFrame:
        """The shingles of the nodes asked for; only their texts are read again, and moved."""
        named = materialise(nodes.join(asked, "node").select("node", "key"), f"{label}-nodes")
        texts = docs.select(key.alias("key"), F.col(text_col).alias("_text")).where(bloom_filter(named, "key").might_hold("key"))
        sets = add_shingles(texts.join(named, "key").select("node", "_text").dropDuplicates(["node"]), "_text", size)
        return materialise(sets, f"{label}-sets")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs (a, b) whose sets have the similarity."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return materialise(_verified(pairs, sets_of(asked, label), similarity), f"{label}-links")

    whole = materialise(_entries(slim, flips=False).drop("bit"), "whole-segments")
    shared = materialise(whole.groupBy("at").agg(F.count(F.lit(1)).alias("w")).where("w > 1"), "shared-segments")
    crowded = materialise(join_weighted(whole, shared.withColumn("size", F.col("w")), ["at"], "w"), "crowded")
    degree = crowded.groupBy("node").agg(F.sum("size").alias("degree"), F.count(F.lit(1)).alias("k"))
    ranked = materialise(join_weighted(crowded, degree, ["node"], "k"), "degrees")
    best = F.max_by(F.struct("node", "f0", "f1", "n"), F.struct("degree", -F.col("node"))).alias("c")
    centres = materialise(ranked.groupBy("at").agg(best, F.count(F.lit(1)).alias("w")), "centres")
    stars = join_weighted(crowded.select("at", "node", "f0", "f1", "n"), centres, ["at"], "w").select(F.struct("node", "f0", "f1", "n").alias("x"), F.col("c").alias("y"))
    near = stars.where(_near("x", "y", similarity)).where("x.node <> y.node")
    near = materialise(near.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct(), "star-pairs")
    linked = verified(near, "star")
    # Each node goes with the best connected centre it is linked to, and that with its own; what isn't one part by then is compared below.
    owned = linked.unionByName(linked.select(F.col("b").alias("a"), "b")).distinct()
    owned = owned.join(degree.select(F.col("node").alias("a"), "degree"), "a", "left").fillna(0, ["degree"])
    part = owned.groupBy(F.col("b").alias("node")).agg(F.max_by("a", F.struct("degree", -F.col("a"))).alias("part"))
    part = materialise(part, "parts-1")
    for k in (2, 3):
        above = part.select(F.col("node").alias("_up"), F.col("part").alias("_top"))
        part = materialise(part.join(above, F.col("part") == F.col("_up"), "left").select("node", F.coalesce("_top", "part").alias("part")), f"parts-{k}")
    parted = materialise(slim.join(part, "node", "left").withColumn("part", F.coalesce("part", "node")), "parted")

    # Large parts take in what their centre is linked to without sharing a whole segment.
    many = parted.groupBy("part").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd)
    heads = materialise(_entries(parted.join(many.select(F.col("part").alias("node")), "node", "left_semi"), flips=True), "head-entries")
    if not heads.isEmpty():
        x, y = heads.alias("x"), _entries(parted, flips=True).alias("y")
        met = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.part") != F.col("y.part")) & _differ("x", "y") & _near("x", "y", similarity))
        found = verified(materialise(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "head-pairs"), "head")
        linked = linked.unionByName(found)
        above = found.join(heads.select(F.col("node").alias("a"), F.col("part").alias("_top")).distinct(), "a").groupBy(F.col("b").alias("node")).agg(F.min("_top").alias("_top"))
        parted = materialise(parted.join(above, "node", "left").withColumn("part", F.coalesce("_top", "part")).drop("_top"), "parted-again")

    entries = _entries(parted, flips=True)
    big = parted.groupBy("part").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hub).select("part")
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    crowded = materialise(_crowded(whole, shared, crowd).unionByName(parted.join(big, "part", "left_semi").select("node")).distinct(), "crowd")
    left, pairs = entries, []
    if not crowded.isEmpty():
        left = _entries(parted.join(crowded, "node", "left_anti"), flips=True)
        close = _crowd_pairs(parted.join(crowded, "node"), sets_of(crowded, "crowd"), similarity)
        pairs = [close.select(*ends)]
    x, y = left.alias("x"), entries.alias("y")
    met = x.join(y.hint("merge"), (F.col("x.at") == F.col("y.at")) & (F.col("x.part") != F.col("y.part")) & _differ("x", "y") & _near("x", "y", similarity))
    pairs = reduce(DataFrame.unionByName, [met.select(*ends), *pairs])
    links = linked.unionByName(verified(materialise(pairs.distinct(), "met-pairs"), "met"))
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    group = roots(ends).withColumnsRenamed({"f": "node", "root": "group"})
    named = nodes.join(group, "node", "left").withColumn("group", F.when(F.col("n") == 0, F.lit(-1)).otherwise(F.coalesce("group", "node")))
    classes = materialise(named.select("sig", "f0", "f1", "n", "group", "copies"), "groups")
    return join_weighted(prints, classes, ["sig", "f0", "f1", "n"], "copies").select("doc_id", "text_hash", "group")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of `similar_groups` stays, the one with the smallest id, with the columns of `docs`.

    Null ids come last, equal ids go by text hash; where text and id are the same
    in several rows, all of these stay: copies are left to exact dedup. Texts
    without a word, null ones included, are one group. An empty table stays empty.
    """
    rows = similar_groups(docs, id_col, text_col, size, similarity)
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("m"))
    keep = first.select(F.col("m.doc_id").alias("_id"), F.col("m.text_hash").alias("_hash"))
    return docs.join(keep, docs[id_col].eqNullSafe(keep["_id"]) & (F.xxhash64(docs[text_col]) == keep["_hash"]), "left_semi")

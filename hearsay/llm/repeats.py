"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import materialise
from hearsay.session import ship_package

LENGTH, GRAM = 100, 32
#: Bytes of text that are hashed at once, and strings that are merged by one task.
BLOCK, BUCKET = 1 << 20, 500
#: Bytes of a letter in the merge of transforms; LENGTH is a multiple of it.
WIDE = 4
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A rolling hash of the GRAM bytes from each place, by doubling its length."""
    h, size, power = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & (1 << 64) - 1, size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchored_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, hash): runs of the windows of LENGTH bytes whose smallest gram is the same.

    The smallest gram of a window, the leftmost of equals, is a matter of the
    window's bytes alone, so equal windows have equal anchors at equal places.
    """
    if len(data) < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    h = _gram_hashes(data)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    least, size, span = key, 1, LENGTH - GRAM + 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    anchor = (least & _PLACE).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    return anchor[first], first, last, h[anchor[first]]


def text_runs(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of a whole text; a long one is cut into blocks that share all but one byte of a window."""
    for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
        anchor, first, last, h = anchored_runs(np.frombuffer(text[at: at + BLOCK + LENGTH - 1], np.uint8))
        yield anchor + at, first + at, last + at, h


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rid, doc = batch.column(0).to_numpy(), batch.column(1)
        owner, firsts, lasts, hashes, sids = [], [], [], [], []
        for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
            for anchor, first, last, h in text_runs(text or b""):
                owner.append(np.full(len(first), i)), firsts.append(first), lasts.append(last), hashes.append(h)
                seeds = (anchor - first).tolist()
                sids.append(np.fromiter((digest(text[a: b + LENGTH], s) for a, b, s in zip(first.tolist(), last.tolist(), seeds)), np.uint64, len(first)))
        if owner:
            own = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(sids).view(np.int64)), doc.take(pa.array(own)), pa.array(rid[own]),
                pa.array(np.concatenate(firsts).astype(np.int64)), pa.array((np.concatenate(lasts) - np.concatenate(firsts) + 1).astype(np.int32)),
            ], names=["h", "sid", "doc_id", "rid", "start", "n"])


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array of a shard, in order of LENGTH bytes or more, by doubling; a zero ends each string and sorts by its place."""
    place = np.arange(len(text))
    key, ended = np.zeros(len(text), np.int64), np.zeros(len(text), bool)
    step = 7
    for k in range(step):
        key = key << 8 | np.where(ended, 0, text[(place + k) % len(text)])
        ended |= text[(place + k) % len(text)] == 0
    rank = np.empty(len(text), np.int64)
    order = np.argsort(key, kind="stable")
    # Equal starts that hold an end are told apart by its place, in which order the stable sort left them.
    rank[order] = np.cumsum(np.concatenate(([False], (key[order][1:] != key[order][:-1]) | ended[order][1:])))
    while step < LENGTH and rank[order[-1]] < len(text) - 1:
        ahead = np.zeros(len(text), np.int64)
        ahead[:-step or None] = rank[step:] + 1
        pair = rank * (len(text) + 2) + ahead
        order = np.argsort(pair, kind="stable")
        rank[order] = np.concatenate(([0], np.cumsum(pair[order][1:] != pair[order][:-1])))
        step *= 2
    return order


def wide_transform(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Transform of a shard in letters of WIDE bytes: those before each suffix, the nearest in the lowest place."""
    letters = np.zeros(len(text), np.uint32)
    for k in range(WIDE):
        # Bytes 0 to 255 and the end need 257 values; 0xFF never occurs in UTF-8, so 255 suffices.
        letters |= text[suffixes - k - 1].astype(np.uint32) << np.uint32(8 * k)
    return letters


def merge_transforms(shards: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the wide transforms of shards, and the block of each place, for suffixes in order of `depth` bytes.

    It starts with the shards one after the other. Each round deals the places
    out by the WIDE bytes before them, keeping their order: suffixes sorted by p
    bytes become sorted by p + WIDE. Two neighbours stay in one block while they
    had the same letter and came from one block; the round that parts them is
    their common prefix in steps of WIDE, so the blocks left after `depth` bytes
    are the repeated intervals. No suffix is sorted anew. Letters that hold the
    end of a string keep their order and stand alone.
    """
    which = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(b) for b in shards])
    found, joined = np.unique(np.concatenate(shards), return_inverse=True)
    ended = np.zeros(len(found), bool)
    for k in range(WIDE):
        ended |= (found >> np.uint32(8 * k)) & np.uint32(255) == 0
    # Numbers of 16 bits are dealt out by counting; a bucket with more letters is sorted.
    joined = joined.astype(np.uint16 if len(found) <= 1 << 16 else np.int64)
    block = np.zeros(len(which), np.int32)
    # The letters dealt out are the same in every round, and so are the borders between them.
    order = np.argsort(joined, kind="stable")
    dealt = joined[order]
    alone = np.flatnonzero(ended[dealt])
    alone_shard = which[order][alone]
    border = np.ones(len(which), bool)
    border[1:] = dealt[1:] != dealt[:-1]
    border[alone] = True
    letters = np.empty_like(joined)
    for _ in range(-(-depth // WIDE)):
        # The k-th place of a shard in the interleave reads the k-th letter of its transform.
        letters[np.argsort(which, kind="stable")] = joined
        order = np.argsort(letters, kind="stable")
        which, block = which[order], block[order]
        which[alone] = alone_shard
        parted = border.copy()
        parted[1:] |= block[1:] != block[:-1]
        block = np.cumsum(parted, dtype=np.int32)
    return which, block


def covered_windows(strings: list[bytes], order: np.ndarray, shard_size: int = 250) -> list[tuple[int, int, int]]:
    """(string, first, last) runs of windows that a string earlier in `order` has too.

    `order` ranks the windows' places: the rank of (document, start) of the first
    window of each string. Windows of one document are told apart by their starts.
    """
    step = max(shard_size, -(-len(strings) // 250))
    transforms, places, owners = [], [], []
    for low in range(0, len(strings), step):
        part = strings[low: low + step]
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + 1, 0) for s in part])
        suffixes = sorted_suffixes(text)
        transforms.append(wide_transform(text, suffixes))
        sizes = np.array([len(s) + 1 for s in part])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        own = np.repeat(np.arange(len(part)), sizes)
        owners.append((own + low)[suffixes])
        places.append(suffixes - begin[own[suffixes]])
    which, block = merge_transforms(transforms)
    by_shard = np.argsort(which, kind="stable")
    owner, place = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    owner[by_shard], place[by_shard] = np.concatenate(owners), np.concatenate(places)
    room = np.array([len(s) for s in strings])[owner] - place >= LENGTH
    owner, place, block = owner[room], place[room], block[room]
    sort = np.lexsort((place, order[owner], block))
    owner, place, block = owner[sort], place[sort], block[sort]
    later = np.concatenate(([False], block[1:] == block[:-1]))
    owner, place = owner[later], place[later]
    sort = np.lexsort((place, owner))
    owner, place = owner[sort], place[sort]
    if not len(owner):
        return []
    cut = np.flatnonzero((owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(owner)])) - 1
    return list(zip(owner[first].tolist(), place[first].tolist(), place[last].tolist()))


def _merge_bucket(table: pa.Table) -> pa.Table:
    strings = table.column("bytes").to_pylist()
    starts, rids = table.column("start").to_numpy(), table.column("rid").to_numpy()
    docs = table.column("_rank").to_numpy()
    order = np.empty(len(strings), np.int64)
    order[np.lexsort((starts, rids, docs))] = np.arange(len(strings))
    # Anchors agree in equal windows, so the order of strings is that of their equal windows.
    found = covered_windows(strings, order)
    at = np.array([f[0] for f in found], np.int64)
    low, high = (np.array([f[k] for f in found], np.int64) for k in (1, 2))
    return pa.table({"rid": pa.array(rids[at] if len(at) else at), "first": pa.array((starts[at] if len(at) else at) + low),
                     "last": pa.array((starts[at] if len(at) else at) + high + LENGTH)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            text, kept, at, runs = text or b"", hashlib.sha256(), 0, 0
            removed, high = 0, -1
            for span in sorted((s["first"], s["last"]) for s in spans or []):
                if span[0] > high:
                    kept.update(text[max(at, 0): span[0]])
                    runs += 1
                    removed += span[1] - span[0]
                    high = at = span[1]
                elif span[1] > high:
                    removed += span[1] - high
                    high = at = span[1]
            kept.update(text[at:])
            out.append((len(text), removed, runs, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Windows of 100 bytes fall into runs around an anchor that equal windows
    share. Runs whose anchor occurs once can't repeat anything. Of equal runs
    all but the first go whole. Of each anchor with different runs, the first
    occurrences are merged: their shards' transforms, bucket by bucket, show
    which windows they share.

    `docs` has to be a repeatable read of files, which its row numbers rely on.
    Null texts count as empty; texts under 100 bytes lose nothing; a null id
    comes after all others, and rows that share an id come in file order.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    every = rows.mapInArrow(_occurrences, f"h long, sid long, doc_id {kind}, rid long, start long, n int")
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    runs = materialise(every.join(shared.hint("merge"), "h", "left_semi"), "runs", "zstd")

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "start", "n")
    strings = materialise(runs.groupBy("h", "sid").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("times")).select("h", "sid", "p.*", "times"), "strings", "zstd")
    again = strings.where("times > 1").select("h", "sid", F.col("rid").alias("_r"), F.col("start").alias("_s"))
    copies = runs.join(again.hint("merge"), ["h", "sid"]).where("rid <> _r OR start <> _s").select("rid", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("last"))

    several = strings.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    contested = materialise(strings.join(several.hint("merge"), "h", "left_semi"), "contested", "zstd")
    wanted = contested.groupBy("rid").agg(F.collect_list(F.struct("h", "start", "n")).alias("wanted"))
    held = rows.select("rid", F.col("doc_id"), F.encode("_text", "UTF-8").alias("_bytes")).join(wanted.hint("merge"), "rid").select("rid", "doc_id", "_bytes", F.explode("wanted").alias("x"))
    held = held.select("rid", "doc_id", "x.h", "x.start", F.substring("_bytes", F.col("x.start").cast("int") + 1, F.col("x.n") + LENGTH - 1).alias("bytes"))
    buckets = max(1, -(-contested.count() // BUCKET))
    held = held.select(F.pmod("h", F.lit(buckets)).alias("_bucket"), "rid", "start", "bytes",
                       F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_rank"))
    windows = held.groupBy("_bucket").applyInArrow(_merge_bucket, "rid long, first long, last long")

    spans = copies.unionByName(windows).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return rows.join(materialise(spans, "spans", "zstd").hint("merge"), "rid", "left").select("doc_id", "_text", "spans").mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

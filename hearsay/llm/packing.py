"""Best-fit packing by residuals: local best fit, then a tree of merges of underfull bins."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import materialise, slices
from hearsay.session import ship_package

CAPACITY = 2048
#: Words whose ids a Python worker remembers.
REMEMBERED = 350_000
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, as little-endian 32-bit bytes, for a tokenizer that never joins text across white space.

    The texts of a call are cut into words by the classes of their bytes: at white
    space, and between an ASCII letter and a mark, which the tokenizer never joins
    either. Arrow numbers the distinct words and puts their ids in the words'
    places; each distinct word is encoded once and remembered in Arrow tables.
    Marks that stay behind a word are cut off where its normal form ends in a
    letter (the tokenizer joins them to a combining mark). ASCII capitals make no
    difference to it, unless a combining mark may follow or an added token is
    spelt. New stems of letters are encoded as one text, in which every stem ends
    with the only token that ends a word; should these not add up, and for all
    other stems, each is encoded by itself. A memory that is half full becomes the
    past one, from which words in use come back; what the past one before it held
    is forgotten. This changes no result.
    """

    MARKS = b".,!*#$%&;:?"
    SPACE = b" \t\n\x0b\x0c\r"
    #: Lead bytes of U+0300 to U+037F, where all marks that ASCII letters are composed with are.
    COMBINING = b"\xcc", b"\xcd"
    SMALL = bytes(range(256)).lower()
    MEMORY = pa.schema([("word", pa.binary()), ("ids", pa.large_binary())])

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.room = Tokenizer.from_file(path), remembered
        self.words = self.past_words = self.stems = self.past_stems = self.MEMORY.empty_table()
        self.learned: dict[bytes, bytes] = {}
        # Classes of bytes: white space, ASCII letters, marks, others; only letters and marks differ by 3.
        self.classes = bytes(0 if c in self.SPACE else 1 if bytes([c]).isalpha() else 2 if c in self.MARKS else 4 for c in range(256))
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.turned = self._turned()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _turned(self) -> re.Pattern:
        """Letters whose normal form ends in something else, a combining mark."""
        if self.tokenizer.normalizer is None:
            return re.compile("(?!)")
        found = []
        for low in range(0, sys.maxunicode, 4096):  # few letters at a time: workers keep what they once took
            letters = [c for c in map(chr, range(low, low + 4096)) if c.isalpha()]
            normal = self.tokenizer.normalizer.normalize_str(" ".join(letters)).split(" ") if letters else []
            found += [c for c, n in zip(letters, normal) if not n.isalpha()]
        return re.compile(f"[{''.join(found)}]" if found else "(?!)")

    def _split(self, word: bytes) -> tuple[bytes, bytes]:
        if not word.isascii():
            stem = word.rstrip(self.MARKS)
            last = stem.decode(errors="replace")[-1:] if len(stem) < len(word) else ""
            if last.isalpha() and not self.turned.match(last):
                return stem, word[len(stem):]
        return word, b""

    def _plain(self, stem: bytes) -> bool:
        if stem.isascii():
            return stem.isalpha()
        text = stem.decode()
        return text.isalpha() and not self.turned.search(text)

    def _learn(self, stems: list[bytes]) -> None:
        letters = [s for s in stems if self._plain(s)]
        for at in range(0, len(letters), 512):
            some = letters[at: at + 512]
            ids = self._ids(" ".join(s.decode() for s in some))
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                raw, cuts = ids.tobytes(), [0, *(4 * last).tolist()]
                self.learned.update((s, raw[i:j]) for s, i, j in zip(some, cuts, cuts[1:]))
        for s in stems:
            if s not in self.learned:
                self.learned[s] = self._ids(s.decode()).tobytes()

    def _learn_words(self, words: list[bytes]) -> None:
        pairs = [p for p in map(self._split, words) if p[1]]
        wanted = list({x for p in pairs for x in p})
        known = dict(zip(wanted, self._remember("stems", pa.array(wanted, pa.binary()), self._learn).to_pylist()))
        joined = {a + b: known[a] + known[b] for a, b in pairs}
        self._learn([w for w in words if w not in joined])
        self.learned.update(joined)

    def _remember(self, memory: str, wanted: pa.Array, learn: Callable[[list[bytes]], None]) -> pa.Array:
        """Ids of distinct words; those that the memory doesn't have are learned."""
        now, past = getattr(self, memory), getattr(self, f"past_{memory}")
        if len(now) > self.room // 2:
            now, past = self.MEMORY.empty_table(), now
        rest = wanted.filter(pc.invert(pc.is_in(wanted, value_set=now["word"])))
        at = pc.index_in(rest, value_set=past["word"])
        new = rest.filter(at.is_null())
        words = new.to_pylist()
        learn(words)
        made = pa.table([new, pa.array(map(self.learned.__getitem__, words), pa.large_binary())], schema=self.MEMORY)
        self.learned.clear()
        now = pa.concat_tables([now, past.take(at.drop_null()), made]).combine_chunks()
        setattr(self, memory, now), setattr(self, f"past_{memory}", past)
        return now["ids"].take(pc.index_in(wanted, value_set=now["word"])).combine_chunks()

    def _cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many come before each text and after the last."""
        joined = b" " + b" ".join(texts)
        small = joined.translate(self.SMALL)
        data = joined if any(x in joined for x in self.COMBINING) or any(t in small for t in self.added) else small
        kind = np.frombuffer(joined.translate(self.classes), np.uint8)
        inside = kind != 0
        starts = np.zeros(len(kind), bool)
        starts[1:] = inside[1:] & (~inside[:-1] | (kind[1:] ^ kind[:-1] == 3))
        first = np.searchsorted(np.flatnonzero(starts), np.cumsum([0] + [1 + len(t) for t in texts]))
        data, cuts = data.translate(None, self.SPACE), np.flatnonzero(starts[inside])
        cuts = np.append(cuts, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]), first

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words, first = self._cut(texts)
        coded = words.dictionary_encode()
        ids = self._remember("words", coded.dictionary, self._learn_words).take(coded.indices)
        places = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset: ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[i:j]) for i, j in zip(places[first], places[first[1:]])]


_encoders: dict[str, WordEncoder] = {}


def worker_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, which serves many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def give_back() -> None:
    """Free what the allocators keep after a task: workers that wait for the next one count in an executor's memory too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def groups_of(texts: list[bytes], most: int = 1 << 22) -> Iterator[list[bytes]]:
    """Consecutive texts of about `most` bytes together, so that the words of one group fit in memory."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and a final 0, cut where longer than the capacity."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches)
        give_back()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = worker_encoder(tokenizer), bytes(4), 4 * capacity
        for batch in slices(batches):
            owner, piece, length, crc = [], [], [], []
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, ids in enumerate(ids for group in groups_of(texts) for ids in encode(group)):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at: at + width]
                    owner.append(i), piece.append(k), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            place = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner, pa.int64())), pa.array(place, pa.int32()), pa.array(place * capacity, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: largest first, each into the fullest bin with room.

    Open bins hang on their room; one big integer has a bit for each room that
    occurs, so the smallest room that fits is its lowest set bit.
    """
    where, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            at, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = at, fill[at]
        fill[at] += size
        if room > size:
            if not open_bins[room - size]:
                rooms |= 1 << (room - size)
            open_bins[room - size].append(at)
    return where, offset, np.array(fill, np.int64)


def _pack_rows(rows: pd.DataFrame, part: int, level: int, capacity: int) -> pd.DataFrame:
    """Pack the bins of one partition; a bin that isn't nearly full goes on as one item."""
    rows = rows.sort_values(["sequence_id", "offset"], kind="stable", ignore_index=True)
    ids = rows["sequence_id"].to_numpy()
    item = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))[: len(ids)]
    sizes = np.bincount(item, rows["length"].to_numpy()).astype(np.int64)
    where, offset, fill = best_fit(sizes, capacity)
    return rows.assign(
        sequence_id=(np.int64(level) << 56) + (np.int64(part) << 32) + where[item], offset=rows["offset"].to_numpy() + offset[item], fill=fill[where[item]])


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = 8, fan_in: int = 8, merge_rows: int = 100_000) -> DataFrame:
    """All columns of `pieces` with sequence_id and offset; needs a `length` of at most `capacity` on every row.

    Every partition packs what it holds by best fit and emits the bins with at
    most `slack` tokens of room. The others go, as items that stay together, to
    a fan-in of fewer partitions, round by round. The last round has one
    partition for `merge_rows` underfull bins, so no task grows with the input;
    a round's own best fit leaves at most one bin half empty or worse each.
    """
    ship_package(pieces.sparkSession)
    columns = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, fill long"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = list(batches)
        if not got:
            return
        whole = pa.Table.from_batches(got)
        where, offset, fill = best_fit(whole.column("length").to_numpy(), capacity)
        made = whole
        for name, values in (("sequence_id", (np.int64(part) << 32) + where), ("offset", offset), ("fill", fill[where])):
            made = made.append_column(name, pa.array(values, pa.int64()))
        yield from made.combine_chunks().to_batches()

    def merge(level: int):
        def run(table: pa.Table) -> pa.Table:
            part = table.column("_part")[0].as_py()
            own = pd.DataFrame({n: table.column(n).to_numpy() for n in ("sequence_id", "offset", "length")})
            own["_at"] = np.arange(len(own))
            packed = _pack_rows(own, part, level, capacity)
            made = table.select(columns).take(pa.array(packed["_at"].to_numpy()))
            for name in ("sequence_id", "offset", "fill"):
                made = made.append_column(name, pa.array(packed[name].to_numpy(), pa.int64()))
            return made
        return run

    # The plan numbers its partitions itself, so a lost task redoes the same bins.
    done = []
    now = materialise(pieces.mapInArrow(local, schema), "packed")
    bins, parts, level = None, None, 0
    while True:
        full, rest = now.where(F.col("fill") >= capacity - slack), now.where(F.col("fill") < capacity - slack)
        left = rest.where("offset = 0").count()
        end = max(1, -(-left // merge_rows))
        if parts is None:
            parts = max(end, rest.select(F.shiftright("sequence_id", 32)).distinct().count())
        if left <= 1 or parts <= end and level or bins is not None and left == bins:
            return _union([*done, now]).select(*columns, "sequence_id", "offset")
        done.append(full)
        parts, level, bins = max(end, -(-parts // fan_in)), level + 1, left
        keyed = rest.drop("fill").withColumn("_part", F.pmod(F.xxhash64("sequence_id"), F.lit(parts)).cast("int"))
        now = materialise(keyed.groupBy("_part").applyInArrow(merge(level), schema), "packed")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
) -> DataFrame:
    """Token sequences of all documents: one row per piece with its place.

    Null and empty texts are a single 0. Rows that share an id are documents of
    their own with equal piece numbers. An empty table gives an empty result.
    """
    return pack(cut_pieces(docs, id_col, text_col, tokenizer or default_tokenizer(), capacity), capacity)

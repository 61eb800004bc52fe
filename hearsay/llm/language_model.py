"""LM scoring: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import materialise
from hearsay.llm.quality import fold
from hearsay.session import ship_package

END = b"\n"
#: Words with symbols of their own, and classes that all other words share by their last two bytes.
SYMBOLS, CLASSES = 1024, 256
#: Words above this share of all tokens, at most 500,000, are looked up in memory; all others by a join.
FREQUENT = 2e-6
_FLUSH = 200_000


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the one text column of `texts`; END stands for the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in _texts(batch, 0):
                tally.update(text.lower().split())
                tally[END] += 1
                if len(tally) > _FLUSH:
                    yield emit()
                    tally.clear()
        yield emit()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """What a worker needs to turn words into symbols and counts; at most 1 / FREQUENT words."""

    place: dict[bytes, int]
    symbol: np.ndarray
    log_count: np.ndarray
    symbols: int

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Symbols of all words, places of the frequent ones (else -1), and the words without a place."""
        get = self.place.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        rare = [words[i] for i in np.flatnonzero(at < 0).tolist()]
        out = self.symbol[at]
        out[at < 0] = [self.symbols + 1 + crc32(w[-2:]) % CLASSES for w in rare]
        return out, at, rare


def build_lexicon(counts: DataFrame, total: int, symbols: int = SYMBOLS) -> Lexicon:
    least = max(1, math.ceil(total * FREQUENT))
    found = counts.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).collect()
    found = sorted(((r["c"], bytes(r["word"])) for r in found), key=lambda x: (-x[0], x[1]))
    place = {w: i for i, (_, w) in enumerate(found)}
    symbol = np.array([i + 1 if i < symbols else symbols + 1 + crc32(w[-2:]) % CLASSES for i, (_, w) in enumerate(found)] or [0], np.int64)
    return Lexicon(place, symbol, np.log10(np.array([c for c, _ in found] or [0], float) + 1), symbols)


def pair_counts(texts: DataFrame, lexicon) -> DataFrame:
    """(code, n): how often a symbol follows another, over all texts; symbol 0 stands before and after a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        width = known.symbols + 1 + CLASSES
        seen = np.zeros(width * width, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                ids = known.read(text.lower().split())[0]
                both = np.concatenate(([0], ids)) * width + np.concatenate((ids, [0]))
                np.add.at(seen, both, 1) if len(both) < 1000 else np.add(seen, np.bincount(both, minlength=len(seen)), out=seen)
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(seen[code])], names=["code", "n"])

    return texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def train_log_bilinear(counts: np.ndarray, size: int = 40, noise: float = 20.0, epochs: int = 12, rate: float = 0.1, block: int = 256) -> np.ndarray:
    """Normalised log10 probabilities, one row per context symbol.

    The score of a word after a context is the product of the context's vector,
    mapped by a matrix, with the word's vector, plus the word's bias. Noise-
    contrastive estimation tells the counted pairs from `noise` times as many
    drawn from the unigram distribution; as all pairs are counted, each step
    takes the exact expectation for a block of contexts. Adagrad sets the steps.
    A softmax by matrix products then normalises the scores.
    """
    width = len(counts)
    rng = np.random.default_rng(7)
    counts = counts.astype(np.float32)
    unigram = (counts.sum(0) + 1) / (counts.sum() + width)
    context, word = (rng.normal(0, 0.1, (width, size)).astype(np.float32) for _ in range(2))
    turn, bias = np.eye(size, dtype=np.float32), np.log(unigram).astype(np.float32)
    speed = [np.full(x.shape, 1e-6, np.float32) for x in (context, word, turn, bias)]
    threshold = np.log(noise * unigram).astype(np.float32)
    mass = counts.sum(1, keepdims=True)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(width), max(1, width // block)):
            n = counts[at]
            scale = 1 / (np.sqrt(mass[at]) + 1)  # frequent contexts count more, but don't drown the others
            own = context[at] @ turn
            real = 1 / (1 + np.exp(-np.clip(own @ word.T + bias - threshold, -30, 30)))
            slope = (n * (1 - real) - noise * mass[at] * unigram * real) * scale
            steps = ((slope @ word) @ turn.T, slope.T @ own, context[at].T @ (slope @ word), slope.sum(0))
            for values, total, step, rows in zip((context, word, turn, bias), speed, steps, (at, slice(None), slice(None), slice(None))):
                total[rows] += step ** 2
                values[rows] += rate * step / np.sqrt(total[rows])
    out = np.empty((width, width), np.float32)
    for low in range(0, width, block):
        z = (context[low: low + block] @ turn) @ word.T + bias
        z -= z.max(1, keepdims=True)
        out[low: low + block] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / math.log(10)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The model is normalised over all texts of words: a symbol after a symbol by
    the log-bilinear model; then, where the symbol is a class of words, the word
    in its class by (count + 1) / (tokens + words + 1 of the class), the last
    one for unseen words. Counts and pairs come from all training texts. Words
    above FREQUENT of the tokens are looked up in memory; the rest, each too
    rare to be a hot key, find their counts by a join.

    Null texts count as empty and have one token, the end. Rows that share an id
    are scored each. Without training rows all counts are zero.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), (fold(F.col(id_col), folds) == held_fold).alias("held_out"))
    train = rows.where("NOT held_out").select("_text")
    counts = materialise(token_counts(train), "word-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("c"))).alias("ends")).first()
    total, distinct, ends = sums["n"] or 0, sums["v"], sums["ends"] or 0
    known = build_lexicon(counts, total)
    shared = spark.sparkContext.broadcast(known)
    width = known.symbols + 1 + CLASSES

    pairs = pair_counts(train, shared).toPandas()
    table = np.zeros(width * width, np.int64)
    table[pairs["code"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    log_p = train_log_bilinear(table.reshape(width, width))

    class_of = F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(CLASSES))
    sizes = counts.where(F.col("word") != F.lit(END)).groupBy(class_of.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    in_class = np.ones(CLASSES)
    for r in sizes:
        in_class[r["k"]] += r["n"] + r["v"]
    for w, i in known.place.items():
        if i < known.symbols:
            in_class[crc32(w[-2:]) % CLASSES] -= round(10 ** known.log_count[i])
    model = spark.sparkContext.broadcast((log_p, np.log10(in_class), math.log10(ends + 1), int(ends > 0)))
    share = math.log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lexicon, (log_p, log_class, log_end, end_known) = shared.value, model.value
        next_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            n_tokens, n_known, base, score, tails = [], [], [], [], []
            for text in _texts(batch, 1):
                words = text.lower().split()
                ids, at, rare = lexicon.read(words)
                seen = at[at >= 0]
                logs = lexicon.log_count[seen]
                grouped = ids[ids > lexicon.symbols] - lexicon.symbols - 1
                path = float(log_p[np.concatenate(([0], ids)), np.concatenate((ids, [0]))].sum(dtype=np.float64))
                n_tokens.append(len(words) + 1)
                n_known.append(len(seen) + end_known)
                base.append(float(logs.sum()) + log_end - (len(words) + 1) * share)
                score.append(path - float(log_class[grouped].sum()) + float(logs[seen >= lexicon.symbols].sum()))
                tails.append(rare)
            ids = np.arange(next_id, next_id + len(tails))
            next_id += len(tails)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids), batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(tails, pa.list_(pa.binary())),
            ], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "part", "rare"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = materialise(rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, part double, rare array<binary>"), "scored")
    least = max(1, math.ceil(total * FREQUENT))
    tail = scored.select("rid", F.explode("rare").alias("word")).join(counts.where(F.col("c") < least), "word")
    tail = tail.groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.count(F.lit(1)).alias("found"))
    out = scored.drop("rare").join(tail, "rid", "left").fillna(0, ["logs", "found"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("found")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs")).alias("base_score"), (F.col("part") + F.col("logs")).alias("score"))

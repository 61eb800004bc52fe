"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from hearsay.llm.common import add_by_text, fresh

FEATURES = (
    "log_words", "word_length", "upper", "digit", "stop_marks", "shout_marks", "symbols", "bars", "non_ascii",
    "lines_per_word", "longest_line", "copied_lines", "distinct_words", "copied_triples", "letterless_words", "short_words",
)
_CLASS = np.zeros((256, 8))
_CLASS[65:91, 0] = 1                                   # upper case
_CLASS[97:123, 1] = 1                                  # lower case
_CLASS[48:58, 2] = 1                                   # digits
_CLASS[[ord(c) for c in ".,;:"], 3] = 1
_CLASS[[ord(c) for c in "!?"], 4] = 1
_CLASS[[ord(c) for c in "#*$%&<>@~^=_{}[]\\"], 5] = 1
_CLASS[ord("|"), 6] = 1
_CLASS[128:, 7] = 1


def text_features(text: bytes) -> np.ndarray:
    """The sixteen numbers the model sees, from the whole text; an empty text gives zeros."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    if not n:
        return np.zeros(len(FEATURES))
    upper, lower, digit, stop, shout, symbol, bar, wide = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
    lines = [x for x in text.split(b"\n") if x]
    sizes = np.fromiter(map(len, words), np.int64, n)
    triples = set(zip(words, words[1:], words[2:]))
    return np.array([
        np.log1p(n), sizes.mean(), upper / max(1.0, upper + lower), digit / size, stop / n, shout / n, symbol / n, bar / n,
        wide / size, len(lines) / n, np.log1p(max(map(len, lines))), 1 - len(set(lines)) / len(lines), len(set(words)) / n,
        1 - len(triples) / max(1, n - 2) if n > 2 else 0.0, 1 - sum(map(bytes.isalnum, words)) / n,
        (sizes <= 3).mean(),
    ])


@dataclass
class AdditiveModel:
    """An intercept, a table of bins for each feature and a grid of bins for each chosen pair."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: additions of looked-up bins, for all rows at once."""
        total = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], side="right")]
        for a, b, cuts_a, cuts_b, grid in self.pairs:
            total += grid[np.searchsorted(cuts_a, x[:, a], side="right"), np.searchsorted(cuts_b, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaf(grad: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return grad / (weight + 1.0)


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, splits: int = 2) -> np.ndarray:
    """Step function of at most `splits` cuts over ordered bins, chosen greedily by gain."""
    parts = [(0, len(grad))]
    for _ in range(splits):
        best = (1e-9, None)
        for at, (low, high) in enumerate(parts):
            if high - low < 2:
                continue
            g, h = np.cumsum(grad[low:high]), np.cumsum(hess[low:high])
            gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - g[-1] ** 2 / (h[-1] + 1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (at, low + k + 1))
        if best[1] is None:
            break
        at, cut = best[1]
        low, high = parts.pop(at)
        parts += [(low, cut), (cut, high)]
    out = np.zeros(len(grad))
    for low, high in parts:
        out[low:high] = _leaf(grad[low:high].sum(), hess[low:high].sum())
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each axis of a grid, as a table of four values, and its gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    def block(s):
        top_left = s[1:-1, 1:-1]
        left, top, whole = s[-1:, 1:-1], s[1:-1, -1:], s[-1, -1]
        return top_left, top - top_left, left - top_left, whole - top - left + top_left
    if min(grad.shape) < 2:
        return 0.0, np.zeros(grad.shape)
    values = list(zip(block(g), block(h)))
    gain = sum(a ** 2 / (b + 1) for a, b in values)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(grad.shape)
    tl, tr, bl, br = (_leaf(a[i, j], b[i, j]) for a, b in values)
    out[: i + 1, : j + 1], out[: i + 1, j + 1:], out[i + 1:, : j + 1], out[i + 1:, j + 1:] = tl, tr, bl, br
    return float(gain[i, j]), out


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 32, pairs: int = 6, pair_bins: int = 8,
) -> AdditiveModel:
    """Boost one shallow tree per feature in turn, round after round; then do the same for the strongest pairs.

    No rows give an undecided model; one class gives a nearly constant one.
    """
    if not len(x):
        return AdditiveModel(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    width, rate_of = x.shape[1], (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate_of / (1 - rate_of))), [_edges(x[:, k], bins) for k in range(width)], [], [])
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(x), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow_tree(*(np.bincount(at[k], v, len(table)) for v in (g, h)))
            table += step
            total += step[at[k]]
    coarse = [_edges(x[:, k], pair_bins) for k in range(width)]
    placed = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]

    def grids(a, b):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = placed[a] * shape[1] + placed[b]
        return cell, [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in slopes()]

    gains = sorted(((_quadrants(*grids(a, b)[1])[0], a, b) for a in range(width) for b in range(a)), reverse=True)
    model.pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains[:pairs]]
    for _ in range(rounds // 3):
        for a, b, _, _, table in model.pairs:
            cell, sums = grids(a, b)
            step = rate * _quadrants(*sums)[1]
            table += step
            total += step.ravel()[cell]
    return model


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> AdditiveModel:
    """Fit on labelled rows outside fold 2 of 4; at most `max_rows` of them, in the order of a hash of the id.

    The bound is the one the model needs: more rows don't change tables of 32
    bins. Rows without id, text or label are not learned from.
    """
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    chosen = chosen.where(fold(F.col("_id"), 4) != 2).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    rows = add_features(rows.join(F.broadcast(chosen), "_id"), "_text", "_x").select("_y", "_x").toPandas()
    x = np.array(rows["_x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_additive(x, rows["_y"].to_numpy(dtype=float))


def add_features(df: DataFrame, text_col: str, name: str) -> DataFrame:
    def work(texts: list[bytes]) -> pa.Array:
        return pa.array([text_features(t).tolist() for t in texts], pa.list_(pa.float64()))

    return add_by_text(df, text_col, name, ArrayType(DoubleType()), work)


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with the probability of label 1; null texts score as empty ones."""

    def work(texts: list[bytes]) -> pa.Array:
        x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))
        return pa.array(model.score(x), pa.float64())

    return add_by_text(docs, text_col, name, DoubleType(), work)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, with the columns of `docs`."""
    name = fresh(docs, "score")
    return score_quality(docs, train_quality(docs, labels), name=name).where(F.col(name) >= threshold).drop(name)

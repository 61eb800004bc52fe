"""Logistic regression over exact words, its weights a table.

Every round is a sum over the words of all texts: the losses are bounded by
squares whose curvature follows each text's present margin, and since a text's
features add up to two (its words to one, the constant to one), the bound splits
into one square per word. All words move at once, and the loss never rises. The texts
are coded by group and stay where they are; a round sends each group the weights
of its words, and adds up what comes back by word.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from hearsay.operators.coded import chunks, code_words, kept, per_group
from hearsay.session import write_table

#: The constant's name among the words; no token is empty.
CONSTANT = ""


@dataclass(frozen=True)
class WordModel:
    """`weights`: word, n (its texts), idf and weight; `losses`: mean loss and penalty before each round."""

    weights: DataFrame
    losses: list[float]


def _by_place(state: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of a group's words as arrays over their places; zero for words that aren't there."""
    place = state["_i"].to_numpy()
    out = []
    for name in names:
        out.append(np.zeros(int(place.max()) + 1 if len(place) else 0))
        out[-1][place] = state[name].to_numpy()
    return out


def _margins(cells: pa.Table, state: pa.Table):
    """Slices of a group's texts, their cells (text, word and x, the TF-IDF share of the text's known words) and the sums of x and weight."""
    idf, weight = _by_place(state, "idf", "weight")
    for part, own, word, tf in chunks(cells):
        told = word < len(idf)
        own, word = own[told], word[told]
        value = tf[told] * idf[word]
        whole = np.bincount(own, value, len(part))
        told = value > 0
        own, word = own[told], word[told]
        x = value[told] / whole[own]
        yield part, own, word, x, np.bincount(own, x * weight[word], len(part))


def _slopes(constant: float, schema: StructType):
    """Work of a group: slope and curvature summed by word, and for the constant, whose row also has the loss and the sum of squared weights."""
    def work(cells: pa.Table, state: pa.Table) -> pa.Table:
        place = state["_i"].to_numpy()
        size = int(place.max()) + 1 if len(place) else 0
        slopes, bends, own_sums = np.zeros(size), np.zeros(size), np.zeros(3)
        for part, own, word, x, sums in _margins(cells, state):
            rows, ones = part.column("_rows").to_numpy(), part.column("_y").to_numpy()
            # A text that comes in several rows counts as often, as its join to its labels has it.
            margin = rows * sums + rows * rows * constant
            p = 1 / (1 + np.exp(-margin))
            with np.errstate(divide="ignore", invalid="ignore"):
                bend = rows * np.where(np.abs(margin) < 1e-6, 0.25, (p - 0.5) / margin)
            slope = rows * p - ones
            loss = rows * (np.maximum(margin, 0) + np.log1p(np.exp(-np.abs(margin)))) - margin * ones
            slopes += np.bincount(word, slope[own] * x, size)
            bends += np.bincount(word, 2 * bend[own] * x, size)
            own_sums += (rows * slope).sum(), (2 * rows * bend).sum(), (rows * loss).sum()
        home, weight = state["home"].to_numpy(), state["weight"].to_numpy()
        last = [cells["_p"][0].as_py() if len(cells) else 0, -1, CONSTANT, 0, False, 0.0, constant, *own_sums, (weight[home] ** 2).sum()]
        zeros = np.zeros(len(state))
        made = [*[state[c] for c in ("_to", "_i", "word", "n", "home", "idf", "weight")], slopes[place], bends[place], zeros, zeros]
        columns = [pa.array([*v.to_pylist(), x], t) if isinstance(v, pa.ChunkedArray) else pa.array(np.append(v, x)) for v, x, t in zip(made, last, _TYPES)]
        return pa.table(columns, names=schema.names)

    return work


_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), *[pa.float64()] * 6]
_SUMS = StructType([
    StructField("_p", IntegerType()), StructField("_i", IntegerType()), StructField("word", StringType()), StructField("n", LongType()), StructField("home", BooleanType()),
    *[StructField(c, DoubleType()) for c in ("idf", "weight", "_g", "_h", "_l", "_squares")],
])


def fit_words(df: DataFrame, row_id: str, tokens: str, label: str, rounds: int = 20, penalty: float = 1e-4, min_df: int = 1) -> WordModel:
    """Weights of all words found in at least `min_df` labelled texts, for a label of 0 and 1.

    The loss is the mean log loss plus half of `penalty` times the squared
    weights, the constant's left out. Each round reads the features once. Rows
    without an id or a label, and repeated ids, must be settled before; rows with
    a null in either are left out. A word found in all texts has no weight.
    """
    y = F.col(label).cast("double")
    rows = df.where(F.col(row_id).isNotNull() & y.isNotNull()).select(row_id, tokens, F.lit(1.0).alias("_rows"), y.alias("_y"))
    coded = code_words(rows, row_id, tokens, ["_rows", "_y"])
    total = int(coded.rows.agg(F.sum("_rows")).first()[0] or 0)
    of_word = Window.partitionBy("word")
    known = coded.words.where(F.col("word") != CONSTANT).withColumns({"n": F.sum("n").over(of_word), "home": F.row_number().over(of_word.orderBy("_p")) == 1})
    known = known.where(F.col("n") >= min_df).withColumns({"idf": F.log((total + 1) / (F.col("n") + 1)), "weight": F.lit(0.0)})
    known = known.select("_p", "_i", "word", "n", "home", "idf", "weight")
    state = write_table(known.where("idf > 0") if rounds and total else known, "word-weights")
    cells = kept(coded, "_w", "_tf", "_rows", "_y")
    constant, losses = 0.0, []
    for _ in range(rounds if total else 0):
        sums = write_table(per_group(cells, state, _slopes(constant, _SUMS), _SUMS), "word-weights")
        g, h, loss, squares = sums.where(F.col("word") == CONSTANT).agg(*[F.sum(c) for c in ("_g", "_h", "_l", "_squares")]).first()
        losses.append(loss / total + penalty * squares / 2)
        step = (F.sum("_g").over(of_word) / total + penalty * F.col("weight")) / (F.sum("_h").over(of_word) / total + penalty)
        state = sums.where(F.col("word") != CONSTANT).select("_p", "_i", "word", "n", "home", "idf", (F.col("weight") - step).alias("weight"))
        constant -= g / h
    own = df.sparkSession.createDataFrame([(CONSTANT, total, 1.0, constant)], "word string, n bigint, idf double, weight double")
    weights = write_table(state.where("home").select("word", "n", "idf", "weight").unionByName(own), "word-weights")
    cells.unpersist()
    return WordModel(weights, losses)


def score_words(model: WordModel, df: DataFrame, row_id: str, tokens: str, labels: Sequence[str] = ("negative", "positive")) -> DataFrame:
    """row id, probability of the label 1, and `sentiment`, the likelier of the two names; words without a weight count for nothing."""
    coded = code_words(df, row_id, tokens)
    constant = model.weights.where(F.col("word") == CONSTANT).first()["weight"]
    state = coded.words.select("_p", "_i", "word").join(model.weights.where(F.col("word") != CONSTANT).select("word", "idf", "weight"), "word").select("_p", "_i", "idf", "weight")

    def work(cells: pa.Table, state: pa.Table) -> pa.Table:
        found = [(part.column(row_id), 1 / (1 + np.exp(-(sums + constant)))) for part, _, _, _, sums in _margins(cells, state)]
        ids = pa.chunked_array([f[0] for f in found], cells[row_id].type)
        return pa.table([ids, pa.array(np.concatenate([f[1] for f in found]) if found else np.empty(0))], names=[row_id, "probability"])

    kinds = StructType([coded.rows.schema[row_id], StructField("probability", DoubleType())])
    out = per_group(coded.rows.select("_p", "_w", "_tf", row_id), state, work, kinds)
    return out.withColumn("sentiment", F.when(F.col("probability") >= 0.5, labels[1]).otherwise(labels[0]))

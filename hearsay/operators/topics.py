"""Topics by variational inference on sums that Spark makes; words and documents stay in tables.

A topic model's state is a vector per word, kept at the word's home, one per
document, and k totals. A round sends each group of coded documents the vectors
of its words and documents, shares every (document, word) count out over the
topics there, and adds the shares up by document inside the group and by word at
the homes. The counts themselves stay where they are, a round's files go when the
next has ended, and neither a vocabulary nor a document passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from hearsay.operators.coded import Coded, code_words, per_group
from hearsay.operators.linked import PASSED, Linked, levels_at, link_words, packed, passed, read, read_counts, rows_of, unpacked
from hearsay.session import drop_table, shuffles_freed, write_table


@dataclass(frozen=True)
class Topics:
    """`words`: word, n, g0 … (weights of each topic). `docs`: row id, g0 …. `bounds`: the likelihood bound before each round but the first, on request."""

    words: DataFrame
    docs: DataFrame
    row_id: str
    k: int
    alpha: float
    eta: float
    totals: tuple[float, ...]
    bounds: list[float] = field(default_factory=list)


def digamma(x: str) -> Column:
    """The slope of log gamma for a positive column: six steps up, then the asymptotic series."""
    y = f"({x} + 6)"
    square = f"(1 / ({y} * {y}))"
    series = f"ln({y}) - 0.5D / {y} - {square} * (1D / 12 - {square} * (1D / 120 - {square} * (1D / 252 - {square} / 240)))"
    return F.expr(f"{series} - ({' + '.join(f'1 / ({x} + {i})' for i in range(6))})")


def log_gamma(x: str) -> Column:
    """Log gamma for a positive column: eight steps up, then Stirling's series."""
    y = f"({x} + 8)"
    square = f"(1 / ({y} * {y}))"
    series = f"({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + (1D / 12 - {square} * (1D / 360 - {square} / 1260)) / {y}"
    return F.expr(f"{series} - ({' + '.join(f'ln({x} + {i})' for i in range(8))})")


def digamma_of(x):
    """The same of a number or an array."""
    y = x + 6
    square = 1 / (y * y)
    return np.log(y) - 0.5 / y - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square / 240))) - sum(1 / (x + i) for i in range(6))


def log_gamma_of(x):
    y = x + 8
    square = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - square * (1 / 360 - square / 1260)) / y
    return series - sum(np.log(x + i) for i in range(8))


def _add(columns: Sequence[Column]) -> Column:
    return reduce(Column.__add__, columns)


#: Cells that are worked on at a time: their shares stay in a core's cache.
_STEP = 1 << 15


def _share(k: int, alpha: float, bounds: bool, homes: bool):
    """Work of a group: its counts shared out over the topics and added up by document and, for the words' `homes`, by word."""
    def work(cells: pa.Table, state: pa.Table) -> pa.Table:
        sent = [(at.as_py(), doc.as_py(), unpacked(values, k)) for at, doc, values in rows_of(state, "_at", "doc", "values")]
        level, starts = levels_at({at: values for at, doc, values in sent if not doc}, k)
        mixed = {at: values for at, doc, values in sent if doc}
        maps, blocks = cells.filter(pc.is_null(cells["docs"])), cells.filter(pc.is_valid(cells["docs"]))
        place, size = {}, {}
        for c, words, docs in rows_of(blocks, "_c", "words", "docs"):
            n_words, n_docs = size.get(c.as_py(), (0, 0))
            size[c.as_py()] = max(n_words, read(words, "i4").max(initial=-1) + 1), max(n_docs, read(docs, "i4").max(initial=-1) + 1)
        for c, at, words, own in rows_of(maps, "_c", "_at", "words", "own"):
            c, at, words = c.as_py(), at.as_py(), read(words, "i4")
            if at in starts:
                place.setdefault(c, np.full(size[c][0], -1, np.int32))[words] = read(own, "i4") + starts[at]
        even = np.full(k, alpha)
        levels = {c: mixed.get(c) if c in mixed else np.broadcast_to(even, (n, k)) for c, (_, n) in size.items()}
        levels = {c: np.exp(digamma_of(g) - digamma_of(g.sum(1))[:, None]) for c, g in levels.items()}
        sums, shared, bound = np.zeros_like(level), {c: np.full((n, k), alpha) for c, (_, n) in size.items()}, 0.0
        for c, docs, words, counts, own, tf in rows_of(blocks, "_c", "docs", "words", "counts", "own", "tf"):
            c, docs, words = c.as_py(), read(docs, "i4"), read(words, "i4")
            if c not in place or not len(words):
                continue
            counts, at = read_counts(counts, len(words)), place[c][words]
            n = int(counts.sum(dtype=np.int64))
            own, tf, known = read_counts(own, n), read_counts(tf, n).astype(float), at >= 0
            if not known.all():
                told = np.repeat(known, counts)
                own, tf, at, counts = own[told], tf[told], at[known], counts[known]
            word = np.repeat(np.arange(len(at)), counts)
            by_word, by_doc = np.zeros((k, len(at))), np.zeros((k, len(docs)))
            of_word, of_doc = np.ascontiguousarray(level[at].T), np.ascontiguousarray(levels[c][docs].T)
            for first in range(0, len(word), _STEP):
                d, w, times = own[first:first + _STEP].astype(np.intp), word[first:first + _STEP], tf[first:first + _STEP]
                here = slice(w[0], w[-1] + 1)
                w = w - w[0]
                shares = [x.take(d) * y[here].take(w) for x, y in zip(of_doc, of_word)]
                whole = np.sum(shares, axis=0)
                times = times / whole
                for t, x in enumerate(shares):
                    x *= times
                    by_word[t, here] += np.bincount(w, x)
                    by_doc[t] += np.bincount(d, x, len(docs))
                if bounds:
                    bound += float((times * whole * np.log(whole)).sum())
            if homes:
                sums[at] += by_word.T
            shared[c][docs] += by_doc.T
        if not len(cells) or not starts:
            return passed([])
        ends = dict(zip(starts, [*list(starts.values())[1:], len(level)]))
        group, to = cells["_p"][0].as_py(), [*starts]
        rows = [(h, group, False, packed(sums[start:ends[h]]), None, 0.0) for h, start in starts.items()] if homes else []
        rows += [(to[j % len(to)] if homes else group, c, True, packed(g), None, _doc_bound(g, k, alpha) if bounds else 0.0) for j, (c, g) in enumerate(shared.items())]
        return passed([*rows, (to[0], -1, True, None, None, bound)] if bounds else rows)

    return work


def _gather(group_of: dict[int, int], k: int, eta: float, bounds: bool):
    """Work of a home: what its words' groups send added up, with the sums over its words; documents are sent back to their group."""
    def work(links: pa.Table, sums: pa.Table) -> pa.Table:
        place = {at.as_py(): read(places, "i4") for at, places in rows_of(links, "_at", "places")}
        level = np.full((max((int(x.max(initial=-1)) for x in place.values()), default=-1) + 1, k), eta)
        rows, found = [], {}
        for at, doc, values, bound in rows_of(sums, "_at", "doc", "values", "bound"):
            if doc.as_py():
                rows.append((group_of.get(at.as_py(), -1), at.as_py(), True, values.as_buffer(), None, bound.as_py()))
            else:
                found[at.as_py()] = unpacked(values, k)
        for at in sorted(found):
            level[place[at]] += found[at]
        if len(links):
            own = float(((eta - level) * digamma_of(level) + log_gamma_of(level)).sum()) if bounds else 0.0
            rows.append((links["_p"][0].as_py(), -1, False, packed(level), level.sum(0).tolist(), own))
        return passed(rows)

    return work


def _send(k: int, totals: Sequence[float]):
    """Work of a home: each group's list of words with exp(E[log weight])."""
    def work(links: pa.Table, state: pa.Table) -> pa.Table:
        slope, rows = digamma_of(np.array(totals)), []
        for home, _, values in rows_of(state, "_to", "_at", "values"):
            level = np.exp(digamma_of(unpacked(values, k)) - slope)
            rows += [(at.as_py(), home.as_py(), False, packed(level[read(places, "i4")]), None, 0.0) for at, places in rows_of(links, "_at", "places")]
        return passed(rows)

    return work


def _round(linked: Linked, words: DataFrame, docs: DataFrame | None, totals: Sequence[float], alpha: float, eta: float | None = None, bounds: bool = False) -> DataFrame:
    """The documents' and, with `eta`, the words' vectors after a round. Without `docs`, all mixtures are even."""
    k = len(totals)
    sent = per_group(linked.links, words, _send(k, totals), PASSED)
    sums = per_group(linked.cells, sent if docs is None else sent.unionByName(docs), _share(k, alpha, bounds, eta is not None), PASSED)
    with shuffles_freed(words.sparkSession):
        return write_table(sums if eta is None else per_group(linked.links, sums, _gather(linked.group_of, k, eta, bounds), PASSED), "topic-sums")


def fit_topics(
    df: DataFrame, row_id: str, tokens: str | Column, k: int = 10, rounds: int = 10, min_df: int = 1,
    alpha: float | None = None, eta: float | None = None, seed: int = 17, bounds: bool = False,
) -> Topics:
    """Latent Dirichlet allocation over all words found in at least `min_df` documents.

    Each of `rounds` reads all counts once, and never lowers the likelihood
    bound; `bounds` computes it. `alpha` and `eta` are the concentrations of
    mixtures and topics (1 / k by default). Documents without a counted word have
    an even mixture; documents without an id are left out.
    """
    alpha, eta = alpha or 1 / k, eta or 1 / k
    with shuffles_freed(df.sparkSession):
        coded = code_words(df, row_id, tokens)
        linked = link_words(coded, coded.words, k, seed, min_df)
    size, words, docs, state, history, bound = linked.words.count(), linked.level, None, None, [], (0.0, 0.0)
    totals = _totals(words, k)
    for _ in range(rounds):
        last, state = state, _round(linked, words, docs, totals, alpha, eta, bounds)
        words, docs = state.where(~F.col("doc")), state.where(F.col("doc") & (F.col("_at") >= 0))
        if bounds:
            told = _sum_bound(state.where(F.col("doc") & (F.col("_at") < 0)))
            if last is not None:
                history.append(told + bound[0] + _word_bound(bound[1], k, eta, size, totals))
            bound = _sum_bound(docs), _sum_bound(words)
        totals = _totals(words, k)
        if last is not None:
            drop_table(last)
    with shuffles_freed(df.sparkSession):
        found = write_table(per_group(linked.words, words, *_unpack_words(k)), "topic-words")
        mixed = write_table(_of_ids(coded, docs, row_id, k, alpha), "topic-docs")
    for table in (coded.rows, *([] if state is None else [state])):
        drop_table(table)
    linked.free()
    return Topics(found, mixed, row_id, k, alpha, eta, totals, history)


def _unpack_words(k: int):
    """Work of a home, and its columns: word, n, g0 …."""
    schema = StructType([StructField("word", StringType()), StructField("n", LongType()), *[StructField(f"g{t}", DoubleType()) for t in range(k)]])

    def work(words: pa.Table, state: pa.Table) -> pa.Table:
        level = np.concatenate([np.empty((0, k)), *[unpacked(values, k) for values, in rows_of(state, "values")]])[words["_i"].to_numpy()]
        return pa.table([words["word"], words["n"], *[pa.array(level[:, t]) for t in range(k)]], names=schema.names)

    return work, schema


def _unpack_docs(k: int):
    """_p, _i, g0 … of documents' vectors."""
    schema = StructType([StructField("_p", IntegerType()), StructField("_i", IntegerType()), *[StructField(f"g{t}", DoubleType()) for t in range(k)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, values in rows_of(pa.Table.from_batches([batch]), "_at", "values"):
                g = unpacked(values, k)
                columns = [np.full(len(g), c.as_py(), np.int32), np.arange(len(g), dtype=np.int32), *g.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in columns], names=schema.names)

    return run, schema


def _of_ids(coded: Coded, docs: DataFrame | None, row_id: str, k: int, alpha: float) -> DataFrame:
    """row id, g0 … of every coded document; those without a counted word have an even mixture."""
    if docs is None:
        return coded.rows.select(row_id, *[F.lit(alpha).alias(f"g{t}") for t in range(k)])
    found = docs.select("_at", "values").mapInArrow(*_unpack_docs(k))
    return coded.rows.select(row_id, "_p", "_i").join(found, ["_p", "_i"], "left").select(row_id, *[F.coalesce(F.col(f"g{t}"), F.lit(alpha)).alias(f"g{t}") for t in range(k)])


def _totals(words: DataFrame, k: int) -> tuple[float, ...]:
    return tuple(x or 1.0 for x in words.agg(*[F.sum(F.col("totals")[t]) for t in range(k)]).first())


def _sum_bound(rows: DataFrame) -> float:
    return rows.agg(F.sum("bound")).first()[0] or 0.0


def _doc_bound(g: np.ndarray, k: int, alpha: float) -> float:
    whole = g.sum(1)
    each = ((alpha - g) * (digamma_of(g) - digamma_of(whole)[:, None]) + log_gamma_of(g)).sum(1) - log_gamma_of(whole)
    return float((each + (lgamma(k * alpha) - k * lgamma(alpha))).sum())


def _word_bound(own: float, k: int, eta: float, size: int, totals: Sequence[float]) -> float:
    """The words' part of the bound, from what the homes tell of it and the totals."""
    slopes = sum((eta * size - total) * float(digamma_of(total)) for total in totals)
    return own - slopes + k * (lgamma(size * eta) - size * lgamma(eta)) - sum(lgamma(total) for total in totals)


def topic_words(topics: Topics, n_words: int = 10) -> DataFrame:
    """(topic, rank, word, weight): the top words of each topic and their shares of it; equal shares by word."""
    each = F.array(*[F.struct(F.lit(t).alias("topic"), (F.col(f"g{t}") / total).alias("weight")) for t, total in enumerate(topics.totals)])
    flat = topics.words.select("word", F.explode(each).alias("_t")).select("word", "_t.topic", "_t.weight")
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "word"))
    return flat.withColumn("rank", place).where(F.col("rank") <= n_words).select("topic", "rank", "word", "weight")


def topic_mixtures(topics: Topics) -> DataFrame:
    """(row id, topic, weight): how much of each topic a document of the fit holds."""
    return _mixtures(topics.docs, topics.row_id, topics.k)


def _mixtures(docs: DataFrame, row_id: str, k: int) -> DataFrame:
    whole = _add([F.col(f"g{t}") for t in range(k)])
    return docs.select(row_id, F.posexplode(F.array(*[F.col(f"g{t}") / whole for t in range(k)])).alias("topic", "weight"))


def infer_mixtures(topics: Topics, df: DataFrame, row_id: str, tokens: str | Column, rounds: int = 10) -> DataFrame:
    """(row id, topic, weight) of other documents, the topics held fixed; words the fit hasn't seen count for nothing."""
    k, docs = topics.k, None
    with shuffles_freed(df.sparkSession):
        coded = code_words(df, row_id, tokens)
        linked = link_words(coded, coded.words.join(topics.words.drop("n"), "word"), k)
    for _ in range(rounds):
        last, docs = docs, _round(linked, linked.level, docs, topics.totals, topics.alpha)
        if last is not None:
            drop_table(last)
    out = write_table(_of_ids(coded, docs, row_id, k, topics.alpha), "topic-docs")
    for table in (coded.rows, *([] if docs is None else [docs])):
        drop_table(table)
    linked.free()
    return _mixtures(out, row_id, k)

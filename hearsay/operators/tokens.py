"""Cleaning, word counts, TF-IDF, bag of words and topics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from hearsay.functions import columns as C
from hearsay.functions.snowball import snowball_word
from hearsay.operators.bloom import bloom_filter
from hearsay.operators.coded import group_number, per_group
from hearsay.operators.reshape import top_k
from hearsay.operators.skew import join_hot_split
from hearsay.operators.topics import fit_topics, topic_mixtures, topic_words
from hearsay.operators.windows import top_k_per_group, with_row_id
from hearsay.session import ship_package, write_table
from hearsay.vocab import STOPWORDS, TOPIC_NOISE


def tokenize(df: DataFrame, col: str, out: str = "words", keep_empty: bool = False) -> DataFrame:
    return df.withColumn(out, C.word_tokens(col, keep_empty))


def remove_stopwords(df: DataFrame, col: str, out: str = "words", extra: Sequence[str] = (),
                     base: Sequence[str] = tuple(STOPWORDS)) -> DataFrame:
    return df.withColumn(out, C.without_stopwords(col, [*base, *extra]))


STEMMERS = {"light": C.stem_word, "snowball": snowball_word}


def stem(df: DataFrame, col: str, out: str = "stems", method: str = "light") -> DataFrame:
    """Stems in place of words, in order, word by word inside the row: `light` suffix rules or `snowball` English."""
    stems = C.stem_tokens(col) if method == "light" else F.transform(col, lambda w: STEMMERS[method](w))
    return df.withColumn(out, stems)


def stem_counts(counts: DataFrame, word: str = "word", count: str = "count", method: str = "light") -> DataFrame:
    """Counts per stem from counts per word: each distinct word is stemmed once."""
    return counts.groupBy(STEMMERS[method](F.col(word)).alias("stem")).agg(F.sum(count).alias(count))


def stem_distinct(df: DataFrame, col: str, row_id: str, out: str = "stems", method: str = "snowball") -> DataFrame:
    """As `stem`, for long token columns: each distinct word is stemmed once, and the words that change are put in by `lemmatize`."""
    words = word_count(df, col).select(F.col("word").alias("form"), STEMMERS[method](F.col("word")).alias("lemma"))
    return lemmatize(df, col, write_table(words, "stems"), row_id, out)


def lemmatize(df: DataFrame, col: str, lemmas: Mapping[str, str] | DataFrame, row_id: str, out: str = "lemmas") -> DataFrame:
    """Replace word forms by lemmas, keeping token order.

    A mapping is applied inside the row. For a (form, lemma) table, the rows go to
    groups, and each group is sent the lemmas of its own words, once each; there
    they are put in by position. Of several lemmas of a form the smallest counts.
    Null tokens go, and a row without an id keeps its forms.
    """
    if isinstance(lemmas, Mapping):
        return df.withColumn(out, C.lemmatize_tokens(col, lemmas))
    changed = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma")).where("form <> lemma")
    texts = write_table(df, "tokens")
    groups = group_number(texts, col)
    named = texts.where(F.col(row_id).isNotNull()).withColumn("_p", F.pmod(F.xxhash64(row_id, col), F.lit(groups)).cast("int"))
    named = write_table(named.repartition(groups, "_p"), "grouped-tokens")
    used = named.select("_p", F.explode(col).alias("form")).distinct()
    sent = used.join(changed, "form").select("_p", "form", "lemma")
    kept = [c for c in df.columns if c != out]
    schema = StructType([*[named.schema[c] for c in kept], StructField(out, ArrayType(StringType()))])

    def put_in(rows: pa.Table, state: pa.Table) -> pa.Table:
        lists = rows[col].combine_chunks()
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=state["form"].combine_chunks())
        words = pc.coalesce(state["lemma"].combine_chunks().take(at), flat)
        held = np.concatenate([[0], np.cumsum(pc.is_valid(flat).to_numpy(zero_copy_only=False))])
        ends = held[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])]
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.drop_null())
        return rows.select(kept).append_column(out, made)

    ship_package(df.sparkSession)
    mapped = per_group(named, sent, put_in, schema)
    plain = texts.where(F.col(row_id).isNull()).withColumn(out, F.coalesce(F.array_compact(col), F.array().cast("array<string>")))
    return mapped.unionByName(plain.select(*schema.names)).select(*[c for c in df.columns if c != out], out)


def clean_text(df: DataFrame, col: str, lemmas: Mapping[str, str] | None = None,
               stopwords: Sequence[str] = tuple(STOPWORDS), tokens: str = "tokens", out: str = "body_clean") -> DataFrame:
    """Tokenise, normalise, lemmatise, drop stop words, join again."""
    words = C.normalize_tokens(C.word_tokens(col))
    if lemmas:
        words = C.lemmatize_tokens(words, lemmas)
    return df.withColumn(tokens, C.without_stopwords(words, stopwords)).withColumn(out, F.concat_ws(" ", tokens))


def simple_words(df: DataFrame, col: str, out: str = "words", extra: Sequence[str] = ()) -> DataFrame:
    """Tokens for topic modelling: accent-free, 2 to 15 letters, no stop words."""
    return df.withColumn(out, C.without_stopwords(C.simple_tokens(col), [*STOPWORDS, *TOPIC_NOISE, *extra]))


def word_count(df: DataFrame, tokens: str | Column, k: int | None = None) -> DataFrame:
    """Occurrences per word; counts combine on the map side, so a hot word moves few rows."""
    words = C.explode_rows(df, tokens, "word")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return counted if k is None else top_k(counted, "count", k, ["word"])


def term_frequencies(df: DataFrame, tokens: str | Column) -> DataFrame:
    """Word table behind a word cloud, with the frequency relative to the top word."""
    counted = word_count(df, tokens)
    top = counted.agg(F.max("count")).scalar()
    return counted.withColumn("relative", F.col("count") / top)


def tf(df: DataFrame, row_id: str, tokens: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact occurrences per (document, word).

    A document whose id no other row has is counted where it is, so its words
    aren't shuffled. The ids are counted when called; rows without an id, and rows
    whose id a Bloom filter takes for a repeated one, are counted by a shuffle.
    """
    ids = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(row_id).isNull()).select(row_id)
    repeated = write_table(ids, "repeated-ids")
    if repeated.isEmpty():
        return _row_counts(df, row_id, tokens, keys)
    shared = F.coalesce(bloom_filter(repeated, row_id).might_hold(row_id), F.lit(True))
    words = C.explode_rows(df.where(shared), tokens, "word", row_id, *keys)
    counted = words.groupBy(row_id, *keys, "word").agg(F.count(F.lit(1)).alias("tf"))
    return _row_counts(df.where(~shared), row_id, tokens, keys).unionByName(counted)


def _row_counts(df: DataFrame, row_id: str, tokens: str | Column, keys: Sequence[str]) -> DataFrame:
    """(row, word) with the occurrences in that row; a batch's rows are counted side by side."""
    ship_package(df.sparkSession)
    rows = df.select(row_id, *keys, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("_tokens"))
    schema = StructType([*rows.schema.fields[:-1], StructField("word", StringType()), StructField("tf", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                lists = some.column(some.num_columns - 1)
                found = lists.flatten().dictionary_encode()
                n = max(len(found.dictionary), 1)
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                word = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
                pairs, times = np.unique((owner * n + word)[word >= 0], return_counts=True)
                own, word = np.divmod(pairs, n)
                kept = [c.take(pa.array(own)) for c in some.columns[:-1]]
                columns = [*kept, found.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(times, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def idf(df: DataFrame, tokens: str) -> DataFrame:
    """Document frequency and smoothed inverse ln((N + 1) / (df + 1)) per word.

    A document is one row, so its words are made distinct inside the row; only
    counts per word are shuffled.
    """
    words = C.explode_rows(df, F.array_distinct(tokens), "word")
    return _with_idf(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")), df)


def _with_idf(counted: DataFrame, docs: DataFrame) -> DataFrame:
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    return counted.withColumn("idf", F.log((n_docs + 1) / (F.col("df") + 1)))


def tf_idf(df: DataFrame, row_id: str, tokens: str, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """TF-IDF per (document, word), keeping the word itself.

    The texts are tokenised and counted once, when called, into a written
    table; document frequencies come from that table. A word found in nearly
    every document is a hot join key; its document frequency is known, so
    `join_hot_split` takes the few hottest words out. `row_id` tells documents apart.
    """
    frequencies = write_table(tf(df, row_id, tokens, keys), "tf")
    counted = frequencies.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    joined = join_hot_split(frequencies, _with_idf(counted, df), ["word"], "df")
    value = F.col("tf") * F.col("idf")
    return joined.withColumn("tf_idf", value if digits is None else F.round(value, digits))


def top_tfidf_words(df: DataFrame, row_id: str, tokens: str, label: str, k: int = 10, digits: int = 6) -> DataFrame:
    """The k largest single TF-IDF values per label with their words; ties kept. The scores are written, since they are read twice."""
    scored = write_table(tf_idf(df, row_id, tokens, [label], digits), "tf-idf")
    return top_k_per_group(scored, [label], "tf_idf", k, groups=df).select(label, row_id, "word", "tf_idf", "rank")


def vocabulary(frequencies: DataFrame, size: int | None = None, min_df: int = 1) -> DataFrame:
    """(word, df, total, term_id): words numbered from 0 by falling use, ties by word; all of them unless `size` is given."""
    counted = frequencies.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    used = counted.where(F.col("df") >= min_df)
    best = used if size is None else top_k(used, "total", size, ["word"])
    numbered = with_row_id(best, [F.desc("total"), "word"], name="term_id")
    return numbered.withColumn("term_id", F.col("term_id") - 1)


def bag_of_words(df: DataFrame, row_id: str, tokens: str, vocab_size: int | None = None, min_df: int = 1) -> DataFrame:
    """Sparse bags in long form: (row id, term_id, word, tf) over a fitted vocabulary."""
    frequencies = write_table(tf(df, row_id, tokens), "tf")
    terms = vocabulary(frequencies, vocab_size, min_df).drop("total")
    return join_hot_split(frequencies, terms, ["word"], "df").select(row_id, "term_id", "word", "tf")


def topic_model(df: DataFrame, row_id: str, tokens: str, k: int = 10, n_words: int = 10, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Topics with their words, and every document's mixture."""
    topics = fit_topics(df, row_id, tokens, k, rounds)
    return topic_words(topics, n_words), topic_mixtures(topics)

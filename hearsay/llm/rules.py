"""Quality rules with cross-document line frequency, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.llm.common import SPACE, WORD, join_weighted, materialise, words_of


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, each word counted once.

    Windows are sorted with their places, so equal ones are neighbours; the
    places that have an equal neighbour then cover three words each.
    """
    def marked(s: Column) -> Column:
        places = F.transform(s, lambda x, k: F.when(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))
        return F.sort_array(F.filter(places, lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(
            i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 3, 0).otherwise(covered(let(F.sort_array(windows), marked)))


def text_rules(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The base measures of every row, and its lines as hashes of their normalised words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"), words_of(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumns({"lines": lines})
    plain = lambda x: F.regexp_replace(F.trim(F.lower(x), F.lit(" \t\x0b\x0c\r")), f"{SPACE}+", " ")
    return rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: let(plain(x), lambda p: F.struct(
            F.xxhash64(p).alias("h"), (F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1).alias("n")))).alias("lines"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    least_documents: int = 10, share: float = 0.01, least_words: int = 50, depleted: float = 0.5,
) -> DataFrame:
    """One row per document: the base measures, n_removed_lines, n_removed_words, base_failed and kept.

    A line is removed where it occurs in more than `least_documents` distinct
    documents of a host and in more than `share` of them; a document that loses
    more than `depleted` of its words is rejected. Documents count as distinct
    by content: those with the same set of normalised lines count once, so that
    a document with many copies isn't taken for boilerplate; near copies, which
    differ in a line, count each. Dropping copies is another operator's task.

    Null texts have no words and fail the base rules; a null host is a host of
    its own; rows that share an id are documents of their own.
    """
    rows = materialise(text_rules(docs, id_col, text_col, host_col), "rules")
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    distinct = F.sort_array(F.array_distinct(F.transform("lines", lambda x: x["h"])))
    sets = rows.select("rid", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "lines")
    seen = sets.select("host", "no_host", let(distinct, lambda d: let(F.xxhash64(d), lambda sig: F.transform(d, lambda h: F.struct(
        h.alias("h"), sig.alias("sig"))))).alias("d"))
    seen = seen.select("host", "no_host", F.explode("d").alias("x")).select("host", "no_host", "x.h", "x.sig")
    counted = seen.groupBy("host", "no_host", "h", "sig").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy("host", "no_host", "h").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).where(F.col("docs") > least_documents)
    limit = hosts.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), (F.col("n_docs") * share).alias("most"))
    common = counted.join(limit, ["host", "no_host"]).where("docs > most").select("host", "no_host", "h", "n")
    common = materialise(common, "common-lines")
    lines = sets.select("rid", "host", "no_host", F.explode("lines").alias("x")).select("rid", "host", "no_host", "x.h", F.col("x.n").alias("words"))
    removed = join_weighted(lines, common, ["host", "no_host", "h"], "n").groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_removed_lines"), F.sum("words").cast("long").alias("n_removed_words"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.drop("lines", "host").join(removed, "rid", "left").fillna(0, ["n_removed_lines", "n_removed_words"]).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_removed_words") <= F.col("n_words") * depleted)).alias("kept"), "n_removed_lines", "n_removed_words")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
base AS (SELECT d.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS wc,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (rid)),
ln AS (SELECT rid, host, regexp_replace(trim(lower(x), E' \t\x0b\x0c\r'), '[\x20\x09-\x0D]+', ' ', 'g') AS p FROM (SELECT rid, host, unnest(lines) AS x FROM d)),
own AS (SELECT DISTINCT rid, host, p FROM ln),
sig AS (SELECT rid, md5(string_agg(p, chr(10) ORDER BY p)) AS s FROM own GROUP BY rid),
cnt AS (SELECT host, p, count(DISTINCT s) AS docs FROM own JOIN sig USING (rid) GROUP BY host, p),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
common AS (SELECT cnt.host, p FROM cnt JOIN hosts ON cnt.host IS NOT DISTINCT FROM hosts.host WHERE docs > 10 AND docs > n * 0.01),
gone AS (SELECT rid, count(*) AS nl, sum(len(string_split(ln.p, ' '))) AS nw FROM ln JOIN common c ON ln.host IS NOT DISTINCT FROM c.host AND ln.p = c.p GROUP BY rid)
SELECT doc_id, n_words, coalesce(wc, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(nw, 0) <= n_words * 0.5 AS kept,
  CAST(coalesce(nl, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(nw, 0) AS BIGINT) AS n_removed_words
FROM base LEFT JOIN gone USING (rid)
"""

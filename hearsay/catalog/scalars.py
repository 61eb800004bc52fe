"""X rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay import vocab
from hearsay.catalog import inputs as I
from hearsay.catalog.registry import query
from hearsay.functions import columns as C


def docs(spark, sf):
    return I.table(spark, sf, "documents")


def texts(spark, sf):
    return I.documents(spark, sf)


@query("x1_lower", "SELECT doc_id, md5(lower(text)) AS v FROM documents")
def x1(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(F.lower("text")).alias("v"))


@query("x2_contains", "SELECT doc_id, contains(text, 'license') AS v FROM documents")
def x2(spark, sf):
    return docs(spark, sf).select("doc_id", F.col("text").contains("license").alias("v"))


@query("x3_strip_punct_delete", f"SELECT doc_id, md5(translate(text, {I.MARKS}, ' ')) AS v FROM documents")
def x3(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.strip_punct("text")).alias("v"))


@query("x3_strip_punct_space", f"SELECT doc_id, md5(translate(text, {I.MARKS}, {I.SPACES})) AS v FROM documents")
def x3b(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.strip_punct("text", "space")).alias("v"))


@query("x4_letters_only", "SELECT doc_id, md5(lower(regexp_replace(text, '[^a-zA-Z\\s]', '', 'g'))) AS v FROM documents")
def x4(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.letters_only("text")).alias("v"))


def _chain(expr: str, rules) -> str:
    for pattern, target in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{target}', 'g')"
    return expr


def _single_pass(expr: str, rules) -> str:
    pairs = sorted(dict(rules).items(), key=lambda p: (-len(p[0]), p[0]))
    for i, (pattern, _) in enumerate(pairs):
        expr = f"regexp_replace({expr}, '\\b{pattern}\\b', chr({0xE000 + i}), 'g')"
    for i, (_, target) in enumerate(pairs):
        expr = f"replace({expr}, chr({0xE000 + i}), '{target}')"
    return expr


@query("x5_normalize_terms", f"SELECT doc_id, md5({_single_pass('lower(text)', I.RULES)}) AS v FROM documents")
def x5(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.normalize_terms(F.lower("text"), I.RULES)).alias("v"))


def _all_rules(expr: str, rules) -> str:
    """As _single_pass, with accented letters as letters; twice, since neighbours share the mark between them."""
    pairs = sorted(dict(rules).items(), key=lambda p: (-len(p[0]), p[0]))
    for i, (pattern, _) in enumerate(pairs):
        for _ in range(2):
            expr = f"regexp_replace({expr}, '(^|[^\\p{{L}}\\p{{N}}_]){pattern.replace('.', '[.]')}([^\\p{{L}}\\p{{N}}_]|$)', '\\1' || chr({0xE000 + i}) || '\\2', 'g')"
    for i, (_, target) in enumerate(pairs):
        expr = f"replace({expr}, chr({0xE000 + i}), '{target}')"
    return expr


@query("x5_normalize_terms_all_rules", f"SELECT doc_id, md5({_all_rules('lower(text)', vocab.WHOLE_WORD_RULES)}) AS v FROM documents")
def x5c(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.normalize_terms(F.lower("text"), vocab.WHOLE_WORD_RULES)).alias("v"))


@query("x5_normalize_terms_chain", f"SELECT doc_id, md5({_chain('lower(text)', I.RULES)}) AS v FROM documents")
def x5b(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.normalize_terms(F.lower("text"), I.RULES, compat=True)).alias("v"))


@query("x6_strip_sentence_marks", "SELECT doc_id, md5(lower(regexp_replace(text, '[,\\.!?]', '', 'g'))) AS v FROM documents")
def x6(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(C.strip_sentence_marks("text")).alias("v"))


@query("x7_pattern_tests", """SELECT doc_id, regexp_matches(text, 'License|license') AS r, lower(text) LIKE '%public%' AS l, starts_with(lower(text), 'the') AS p FROM documents""")
def x7(spark, sf):
    t = F.lower("text")
    return docs(spark, sf).select("doc_id", F.col("text").rlike("License|license").alias("r"), t.like("%public%").alias("l"), t.startswith("the").alias("p"))


@query("x9_concat", "SELECT n_nationkey, n_name || '-' || n_regionkey AS a, concat_ws(' ', n_name, CASE WHEN n_regionkey > 2 THEN 'far' END) AS b FROM nation")
def x9(spark, sf):
    far = F.when(F.col("n_regionkey") > 2, "far")
    return I.table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit("-"), "n_regionkey").alias("a"), F.concat_ws(" ", "n_name", far).alias("b"))


@query("x10_dates", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m,
year(o_orderdate) || '-' || month(o_orderdate) AS label, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS parsed,
strftime(o_orderdate, '%Y-%m-%d') AS formatted FROM orders""")
def x10(spark, sf):
    d = "o_orderdate"
    label = C.month_label(d)
    return I.table(spark, sf, "orders").select(
        "o_orderkey", C.day_of(d).cast("string").alias("day"), F.year(d).alias("y"), F.month(d).alias("m"), label.alias("label"),
        C.month_label_to_date(label).cast("string").alias("parsed"), F.date_format(d, "yyyy-MM-dd").alias("formatted"))


@query("x11_parse_dates", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def x11(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return I.table(spark, sf, "orders").select("o_orderkey", F.to_date(F.to_timestamp(text, "yyyy-MM-dd")).cast("string").alias("day"))


@query("x12_round", "SELECT event_id, round(value, 1) AS r1, round(value)::INT AS ri FROM events")
def x12(spark, sf):
    return I.table(spark, sf, "events").select("event_id", F.round("value", 1).alias("r1"), F.round("value").cast("int").alias("ri"))


@query("x13_array_filter", "SELECT vec_id, (SELECT count(*) FROM (SELECT unnest(embedding) AS x) WHERE x > 0)::INT AS n FROM embeddings")
def x13(spark, sf):
    return I.table(spark, sf, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n"))


@query("x14_arrays_structs", "SELECT c_custkey, c_mktsegment AS k, 'segment' AS name FROM customer UNION ALL SELECT c_custkey, c_name, 'name' FROM customer")
def x14(spark, sf):
    pairs = F.array(F.struct(F.col("c_mktsegment").alias("k"), F.lit("segment").alias("name")), F.struct(F.col("c_name").alias("k"), F.lit("name").alias("name")))
    return I.table(spark, sf, "customer").select("c_custkey", F.explode(pairs).alias("p")).select("c_custkey", "p.*")


@query("x15_size", "SELECT doc_id, len(regexp_split_to_array(lower(text), '\\s'))::INT AS n FROM documents")
def x15(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(C.word_tokens("text", keep_empty=True)).alias("n"))


@query("x16_map_access", "SELECT doc_id, quality + 10 AS a, toxic AS b FROM labels")
def x16(spark, sf):
    m = F.create_map(F.lit("quality"), F.col("quality") + 10, F.lit("toxic"), F.col("toxic"))
    return I.table(spark, sf, "labels").select("doc_id", F.element_at(m, "quality").alias("a"), F.element_at(m, "toxic").alias("b"))


@query("x17_missing_values", """SELECT d.doc_id, l.quality IS NULL AS missing, coalesce(l.quality, 0) AS filled, CASE WHEN d.lang = 'en' THEN 'english' ELSE d.lang END AS lang
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def x17(spark, sf):
    df = docs(spark, sf).join(I.table(spark, sf, "labels"), "doc_id", "left").withColumn("missing", F.col("quality").isNull())
    return df.fillna(0, ["quality"]).na.replace("en", "english", ["lang"]).select("doc_id", "missing", F.col("quality").alias("filled"), "lang")


@query("x18_null_arithmetic", """SELECT d.doc_id, d.n_chars + l.quality AS void, d.n_chars + coalesce(l.quality, 0) AS filled FROM documents d LEFT JOIN labels l USING (doc_id)""")
def x18(spark, sf):
    df = docs(spark, sf).join(I.table(spark, sf, "labels"), "doc_id", "left")
    return df.select("doc_id", C.total_of("n_chars", "quality").alias("void"), C.total_of("n_chars", "quality", missing="zero").alias("filled"))


@query("x19_flag_to_label", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' END AS brand FROM documents")
def x19(spark, sf):
    return docs(spark, sf).select("doc_id", F.when(C.mentions("text", "license", "substring"), F.lit("license")).alias("brand"))

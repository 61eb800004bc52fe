"""F and J rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.registry import query
from hearsay.functions import columns as C
from hearsay.operators import aggregates as A, joins as J, reshape as R, rows, tokens as T, windows as W
from hearsay.sources.bucketed import cohort_slice, write_bucketed
from hearsay.vocab import BOT_AUTHOR

QUALITY_SQL = """q AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL ELSE d.source END AS author,
  CASE l.toxic WHEN 1 THEN true WHEN 0 THEN false END AS over_18, CASE WHEN d.lang = 'de' THEN 'moderator' END AS distinguished
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def flagged(spark, sf):
    df = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return df.select(
        "doc_id", F.when(F.col("quality").isNotNull(), F.col("source")).alias("author"),
        (F.col("toxic") == 1).alias("over_18"), F.when(F.col("lang") == "de", "moderator").alias("distinguished"),
    )


@query("f1_brand_slice", f"WITH {I.TEXTS_SQL} SELECT doc_id, community FROM texts WHERE community = 'src3' OR contains(lower(body), 'license')")
def f1(spark, sf):
    return rows.brand_slice(I.texts(spark, sf), "src3", "License", "community", "body").select("doc_id", "community")


@query("f2_in_list", "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def f2(spark, sf):
    return rows.in_list(I.table(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", ["click", "view"])


@query("f3_filter_eq", "SELECT event_id, value FROM events WHERE event_type = 'view'")
def f3(spark, sf):
    return rows.filter_eq(I.table(spark, sf, "events"), "event_type", "view").select("event_id", "value")


@query("f3_filter_ne", "SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def f3b(spark, sf):
    return rows.filter_eq(I.table(spark, sf, "events"), "event_type", "view", negate=True).select("event_id", "event_type")


@query("f4_known_author", f"WITH {QUALITY_SQL} SELECT doc_id FROM q WHERE author IS NOT NULL")
def f4(spark, sf):
    return rows.quality_filter(flagged(spark, sf), author="author").select("doc_id")


@query("f5_not_adult", f"WITH {QUALITY_SQL} SELECT doc_id FROM q WHERE over_18 = false")
def f5(spark, sf):
    return rows.quality_filter(flagged(spark, sf), adult="over_18").select("doc_id")


@query("f6_not_moderator", f"WITH {QUALITY_SQL} SELECT doc_id FROM q WHERE distinguished IS NULL")
def f6(spark, sf):
    return rows.quality_filter(flagged(spark, sf), distinguished="distinguished").select("doc_id")


@query("f4_f5_f6_quality_filter", f"WITH {QUALITY_SQL} SELECT doc_id, author FROM q WHERE author IS NOT NULL AND over_18 = false AND distinguished IS NULL")
def f456(spark, sf):
    return rows.quality_filter(flagged(spark, sf), "author", "over_18", "distinguished").select("doc_id", "author")


@query("f7_drop_sentinels", f"WITH {QUALITY_SQL} SELECT doc_id, author FROM q WHERE author <> 'src1' AND author <> 'src2'")
def f7(spark, sf):
    return rows.drop_sentinels(flagged(spark, sf), {"author": ["src1", "src2"]}).select("doc_id", "author")


@query("f8_sql_predicate", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 1000")
def f8(spark, sf):
    return rows.where_any(I.table(spark, sf, "documents"), "lang == 'en' AND n_chars > 1000").select("doc_id")


@query("f9_mentions_two_case", "SELECT doc_id FROM documents WHERE regexp_matches(text, 'License|license')")
def f9(spark, sf):
    return I.table(spark, sf, "documents").where(C.mentions("text", "license", "two_case")).select("doc_id")


@query("f9_mentions_word", f"SELECT doc_id FROM documents WHERE {I.word_match_sql('text', 'license')}")
def f9b(spark, sf):
    return I.table(spark, sf, "documents").where(C.mentions("text", "license")).select("doc_id")


@query("f10_like_any", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%public%'")
def f10(spark, sf):
    return I.table(spark, sf, "documents").where(C.like_any("text", ["%license%", "%public%"])).select("doc_id")


@query("f11_exact_vocab_match", "SELECT p_partkey, p_name FROM part WHERE p_name IN ('small ring', 'blue bolt', 'red widget')")
def f11(spark, sf):
    return rows.exact_vocab_match(I.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["small ring", "blue bolt", "red widget"])


@query("f11_exact_vocab_table", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def f11b(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    copies = docs.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("text")
    return rows.exact_vocab_match(docs, "text", copies).select("doc_id")


@query("f12_restrict_words", f"WITH {I.words_sql('documents', 'doc_id', 'text')} SELECT word, count(*)::BIGINT AS count FROM words "
       "WHERE word IN ('license', 'apache', 'version', 'trash') GROUP BY 1")
def f12(spark, sf):
    counts = T.word_count(I.documents(spark, sf), C.clean_tokens("text"))
    return rows.restrict_words(counts, ["license", "apache", "version", "trash"])


@query("f13_drop_outlier_groups", """WITH g AS (SELECT source, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1)
SELECT source, size FROM g WHERE abs(size - (SELECT avg(size) FROM g)) <= 1.0 * (SELECT stddev_samp(size) FROM g)""")
def f13(spark, sf):
    groups = I.table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return rows.drop_outlier_groups(groups, "size", "zscore", 1.0)


@query("f14_set_flags", "SELECT doc_id, variable, value FROM (UNPIVOT labels ON quality, toxic INTO NAME variable VALUE value) WHERE value = 1")
def f14(spark, sf):
    return rows.set_flags(R.melt(I.table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"]))


DAILY_TWO = """a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::BIGINT AS orders FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*)::BIGINT AS shipped FROM lineitem GROUP BY 1)"""


def two_daily(spark, sf):
    a = A.daily_count(I.table(spark, sf, "orders"), "o_orderdate", "o_orderkey", "orders")
    b = A.daily_count(I.table(spark, sf, "lineitem"), "l_shipdate", "l_orderkey", "shipped")
    return a, b


def day_text(df, col="day"):
    return df.withColumn(col, F.col(col).cast("string"))


@query("j1_full_outer_daily", f"WITH {DAILY_TWO} SELECT CAST(day AS VARCHAR) AS day, orders, shipped FROM a FULL JOIN b USING (day)")
def j1(spark, sf):
    return day_text(J.full_outer_daily(*two_daily(spark, sf), "day"))


@query("j2_inner_on", f"""WITH {DAILY_TWO}, ma AS (SELECT date_trunc('month', day) AS m, sum(orders)::BIGINT AS orders FROM a GROUP BY 1),
mb AS (SELECT date_trunc('month', day) AS m, sum(shipped)::BIGINT AS shipped FROM b GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS m, orders, shipped FROM ma JOIN mb USING (m)""")
def j2(spark, sf):
    a, b = two_daily(spark, sf)
    ma = a.groupBy(F.date_format("day", "yyyy-MM").alias("m")).agg(F.sum("orders").alias("orders"))
    mb = b.groupBy(F.date_format("day", "yyyy-MM").alias("m")).agg(F.sum("shipped").alias("shipped"))
    return J.inner_on(ma, mb, "m")


@query("j3_score_join", f"""WITH {I.scored_sql('documents', 'doc_id', 'text')} SELECT doc_id, pw AS positive_weight, nw AS negative_weight, sentiment FROM scored""")
def j3(spark, sf):
    from hearsay.operators.sentiment import score_distinct

    scored = score_distinct(I.documents(spark, sf).select("doc_id", "text"), "text", I.LEXICON)
    return scored.select("doc_id", "positive_weight", "negative_weight", "sentiment")


@query("j4_join_on_two", f"""WITH {I.EVENT_DAYS_SQL}, m AS (SELECT CAST(ts AS DATE) AS day, event_type AS series, max(value) AS top FROM events GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, series, n, top FROM days JOIN m USING (day, series)""")
def j4(spark, sf):
    tops = I.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("series")).agg(F.max("value").alias("top"))
    return day_text(J.join_on(I.event_days(spark, sf), tops, ["day", "series"]).select("day", "series", "n", "top"))


@query("j5_merge_counts_zero_fill", """WITH a AS (SELECT s_nationkey AS k, count(*)::BIGINT AS suppliers FROM supplier GROUP BY 1),
b AS (SELECT c_nationkey AS k, count(*)::BIGINT AS customers FROM customer GROUP BY 1)
SELECT k, coalesce(suppliers, 0)::BIGINT AS suppliers, coalesce(customers, 0)::BIGINT AS customers,
 (coalesce(suppliers, 0) + coalesce(customers, 0))::BIGINT AS total_activity FROM a FULL JOIN b USING (k)""")
def j5(spark, sf):
    a = I.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = I.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return J.merge_counts_zero_fill(a, b, "k")


@query("j6_align_series", f"WITH {DAILY_TWO} SELECT CAST(day AS VARCHAR) AS day, orders, shipped FROM a JOIN b USING (day)")
def j6(spark, sf):
    return day_text(J.align_series(*two_daily(spark, sf)))


@query("j8_lookup_left", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def j8(spark, sf):
    dim = I.table(spark, sf, "nation").where("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup_left(I.table(spark, sf, "customer").select("c_custkey", "c_nationkey"), dim, "c_nationkey").drop("c_nationkey")


COHORT_SQL = """cohort AS (SELECT author FROM comments WHERE community = 'c7' UNION SELECT author FROM posts WHERE community = 'c7')"""


@query("j9_cohort_semi_join", f"WITH {I.LOG_SQL}, {COHORT_SQL} SELECT id, author, community FROM comments WHERE author IN (SELECT author FROM cohort)")
def j9(spark, sf):
    c, p = I.comments(spark, sf), I.posts(spark, sf)
    cohort = J.cohort_of(c, p, "c7", exclude=[BOT_AUTHOR])
    return J.cohort_activity(c, cohort).select("id", "author", "community")


@query("j9_cohort_of_bucketed_log", f"WITH {I.LOG_SQL}, {COHORT_SQL} SELECT id, author, community FROM comments WHERE author IN (SELECT author FROM cohort)")
def j9b(spark, sf):
    """The log written in buckets by author, then sliced without an exchange of it."""
    c, p = I.comments(spark, sf), I.posts(spark, sf)
    log = write_bucketed(c.select("id", "author", "community"), "author", 16)
    return cohort_slice(spark, log, J.cohort_of(c, p, "c7", exclude=[BOT_AUTHOR]))


@query("j10_pivot_counts", "SELECT event_type, " + ", ".join(
    f"(count(*) FILTER (l.lang = '{x}'))::BIGINT AS {x}" for x in ("de", "en", "es", "fr")) +
    " FROM events e JOIN documents l ON e.event_id = l.doc_id GROUP BY 1")
def j10(spark, sf):
    return R.pivot_counts(I.authored(spark, sf), ["event_type"], "lang", values=["de", "en", "es", "fr"])


@query("j11_zip_by_key", """SELECT o_orderpriority AS k, a.mean, b.q1 FROM (SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1) a
JOIN (SELECT o_orderpriority, round(min(o_totalprice), 4) AS q1 FROM orders GROUP BY 1) b USING (o_orderpriority)""")
def j11(spark, sf):
    o = I.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "k")
    a = o.groupBy("k").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    b = o.groupBy("k").agg(F.round(F.min("o_totalprice"), 4).alias("q1"))
    return J.inner_on(a, b, "k")


SHARE_SQL = """SELECT p_brand, p_type, count(*)::BIGINT AS value, (sum(count(*)) OVER (PARTITION BY p_brand))::BIGINT AS total_count,
round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY p_brand), 6) AS ratio FROM part GROUP BY p_brand, p_type"""


@query("j12_share_within", SHARE_SQL)
def j12(spark, sf):
    return W.share_within(I.table(spark, sf, "part"), ["p_brand"], ["p_type"], digits=6)


@query("j12_share_within_wide", SHARE_SQL)
def j12b(spark, sf):
    return W.share_within(I.table(spark, sf, "part"), ["p_brand"], ["p_type"], digits=6, wide_groups=True)


@query("j12_share_nullable_group", """WITH c AS (SELECT quality, lang, count(*)::BIGINT AS value FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT quality, lang, value, sum(value) OVER (PARTITION BY quality)::BIGINT AS total_count, round(value / sum(value) OVER (PARTITION BY quality), 6) AS ratio FROM c""")
def j12c(spark, sf):
    df = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return W.share_within(df, ["quality"], ["lang"], digits=6, wide_groups=True)


@query("j13_forecast_with_interval")
def j13(spark, sf):
    from hearsay.catalog.series import seasonal_forecast

    return seasonal_forecast(spark, sf)

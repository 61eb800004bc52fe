"""B rows of the inventory: the user-level questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.aggregates import FLAGS_SQL, AUTHOR_SQL, rounded
from hearsay.catalog.filters import COHORT_SQL, day_text
from hearsay.catalog.registry import query
from hearsay.functions import columns as C
from hearsay.operators import mentions as M, rows, sentiment as N, tokens as T
from hearsay.operators.windows import share_within
from hearsay.plans import activity as PA, brands as PB, overview as PO
from hearsay.vocab import PLACES as ALL_PLACES, PRODUCT_SPELLINGS, STOPWORDS, TOP_WORD_NOISE


@query("b1_slice_log", f"""WITH {I.LOG_SQL}, {COHORT_SQL}
SELECT 'competitor' AS slice, 'comment' AS kind, count(*)::BIGINT AS n FROM comments WHERE community IN ('c1', 'c2', 'c3')
UNION ALL SELECT 'competitor', 'post', count(*)::BIGINT FROM posts WHERE community IN ('c1', 'c2', 'c3')
UNION ALL SELECT 'brand', 'comment', count(*)::BIGINT FROM comments WHERE community = 'c7' OR contains(lower(event_type), 'view')
UNION ALL SELECT 'brand', 'post', count(*)::BIGINT FROM posts WHERE community = 'c7' OR contains(lower(event_type), 'view')
UNION ALL SELECT 'cohort', 'comment', count(*)::BIGINT FROM comments WHERE author IN (SELECT author FROM cohort)
UNION ALL SELECT 'cohort', 'post', count(*)::BIGINT FROM posts WHERE author IN (SELECT author FROM cohort)""")
def b1(spark, sf):
    c, p = [f.withColumnRenamed("event_type", "body") for f in (I.comments(spark, sf), I.posts(spark, sf))]
    out = None
    for name, feeds in PA.slice_log(c, p, "c7", "view", ["c1", "c2", "c3"]).items():
        for kind, feed in zip(("comment", "post"), feeds):
            row = feed.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("slice"), F.lit(kind).alias("kind"), "n")
            out = row if out is None else out.unionByName(row)
    return out


INTEREST = """SELECT community, coalesce(a.n, 0)::BIGINT AS comment_count, coalesce(b.n, 0)::BIGINT AS submission_count,
(coalesce(a.n, 0) + coalesce(b.n, 0))::BIGINT AS total_activity
FROM (SELECT community, count(*) AS n FROM comments GROUP BY 1) a FULL JOIN (SELECT community, count(*) AS n FROM posts GROUP BY 1) b USING (community)
ORDER BY total_activity DESC, community LIMIT 100"""


@query("b2_community_interest", f"WITH {I.LOG_SQL} {INTEREST}")
def b2(spark, sf):
    return PA.community_interest(I.comments(spark, sf), I.posts(spark, sf))


DAILY = """daily AS (SELECT day, a.n AS comment_count, b.n AS submission_count
FROM (SELECT CAST(ts AS DATE) AS day, count(id)::BIGINT AS n FROM comments WHERE community = 'c7' GROUP BY 1) a
FULL JOIN (SELECT CAST(ts AS DATE) AS day, count(id)::BIGINT AS n FROM posts WHERE community = 'c7' GROUP BY 1) b USING (day))"""


@query("b3_daily_activity", f"WITH {I.LOG_SQL}, {DAILY} SELECT CAST(day AS VARCHAR) AS day, comment_count + submission_count AS total_activity FROM daily")
def b3(spark, sf):
    return day_text(PA.daily_activity(I.comments(spark, sf), I.posts(spark, sf), "c7"))


@query("b3_daily_activity_zero_fill", f"WITH {I.LOG_SQL}, {DAILY} SELECT CAST(day AS VARCHAR) AS day, coalesce(comment_count, 0) + coalesce(submission_count, 0) AS total_activity FROM daily")
def b3b(spark, sf):
    return day_text(PA.daily_activity(I.comments(spark, sf), I.posts(spark, sf), "c7", "zero"))


@query("b4_monthly_activity", f"WITH {I.LOG_SQL}, {DAILY} SELECT year(day) || '-' || month(day) AS dt_month_year, sum(comment_count)::BIGINT AS comment_count, "
       "sum(submission_count)::BIGINT AS submission_count FROM daily GROUP BY 1")
def b4(spark, sf):
    return PA.monthly_activity(PA.daily_counts(I.comments(spark, sf), I.posts(spark, sf), "c7"))


@query("b5_top_words", f"""WITH {I.TEXTS_SQL}, feed AS (SELECT body FROM texts UNION ALL SELECT text FROM conversations), {I.words_sql('feed', 'body', 'body', 'delete')}
SELECT word, count(*)::BIGINT AS count FROM words WHERE word NOT IN ({I.sql_list([*STOPWORDS, *TOP_WORD_NOISE, 'que'])}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def b5(spark, sf):
    feed = I.texts(spark, sf).select("body").unionAll(I.titles(spark, sf).select("title"))
    return PB.top_words(feed, "body", ["que"], 20)


@query("b6_mention_flags", "SELECT doc_id, " + ", ".join(f"{I.word_match_sql('text', b)} AS {b}" for b in I.BRANDS) + " FROM documents")
def b6(spark, sf):
    return M.mention_flags(I.documents(spark, sf).select("doc_id", "text"), "text", I.BRANDS).drop("text")


@query("b7_co_mentions", f"WITH {FLAGS_SQL} SELECT {', '.join(I.BRANDS)}, count(*)::BIGINT AS count FROM flags GROUP BY ALL")
def b7(spark, sf):
    return PB.co_mentions(I.texts(spark, sf), "body", I.BRANDS)


@query("b8_share_of_voice", "WITH feed AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations), n AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS brand, (count(*) FILTER ({I.word_match_sql('text', b)}))::BIGINT AS total_count FROM feed" for b in I.BRANDS)
    + ") SELECT brand, total_count, round_even(total_count * 100.0 / sum(total_count) OVER (), 0) AS pct FROM n")
def b8(spark, sf):
    return PB.share_of_voice(I.texts(spark, sf), I.titles(spark, sf), I.BRANDS)


NAMES = ["small ring", "blue bolt", "red widget", "large ring", "green bolt", "red ring", "small bolt", "blue widget", "large gear", "red gear"]
NAME_RULES = [("small ring", "ring"), ("large ring", "ring"), ("red ring", "ring"), ("ring", "band"), ("blue bolt", "bolt"), ("small bolt", "bolt")]


def _rule_case(expr):
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NAME_RULES if a != "ring")
    return f"CASE {expr} {cases} ELSE {expr} END"


@query("b9_product_mentions", f"""WITH n AS (SELECT lower(p_name) AS t FROM part WHERE lower(p_name) IN ({I.sql_list(NAMES)})),
c AS (SELECT {_rule_case('t')} AS product, count(*)::BIGINT AS count FROM n GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, product) AS k FROM c)
SELECT CASE WHEN k <= 3 THEN product ELSE 'other' END AS product, sum(count)::BIGINT AS count FROM r GROUP BY 1""")
def b9(spark, sf):
    return PB.product_mentions(I.table(spark, sf, "part"), "p_name", NAMES, NAME_RULES, 3)


VOCAB = ["license", "licensed", "version", "released", "apache", "trash", "only"]
WORD_CASE = "CASE word WHEN 'licensed' THEN 'license' WHEN 'license' THEN 'licence' WHEN 'version' THEN 'release' WHEN 'released' THEN 'version' ELSE word END"


@query("b10_product_words", f"""WITH {I.words_sql('documents', 'doc_id', 'text')} SELECT {WORD_CASE} AS product, count(*)::BIGINT AS count FROM words
WHERE word IN ({I.sql_list(VOCAB)}) GROUP BY 1""")
def b10(spark, sf):
    counts = T.word_count(I.texts(spark, sf), C.clean_tokens("body"))
    return PB.product_words(counts, VOCAB, I.RULES)


SCORED = I.scored_sql("documents", "doc_id", "text")
CLEAN_DOCS = f"clean AS (SELECT d.doc_id, d.source, s.sentiment, {I.clean_sql('d.text')} AS t FROM documents d JOIN scored s USING (doc_id))"
HITS = "hits AS (" + " UNION ALL ".join(f"SELECT doc_id, source, sentiment, '{p}' AS product FROM clean WHERE contains(t, ' {p} ')" for p in I.PRODUCTS) + ")"
SHARES = """shares AS (SELECT product, sentiment, count(*)::BIGINT AS sentiment_count, (sum(count(*)) OVER (PARTITION BY product))::BIGINT AS total_mention,
round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY product), 6) AS ratio FROM hits GROUP BY product, sentiment)"""


def scored_texts(spark, sf):
    return N.score_sentiment(I.texts(spark, sf), "body", I.LEXICON)


@query("b11_product_sentiment_counts", f"WITH {SCORED}, {CLEAN_DOCS}, {HITS}, {SHARES} SELECT * FROM shares")
def b11(spark, sf):
    return rounded(PB.product_sentiment_counts(scored_texts(spark, sf), "body", I.PRODUCTS))


@query("b11_product_sentiment_top", f"WITH {SCORED}, {CLEAN_DOCS}, {HITS}, {SHARES} SELECT * FROM shares WHERE sentiment = 'positive' ORDER BY ratio DESC, product LIMIT 5")
def b11b(spark, sf):
    return rounded(PB.product_sentiment(scored_texts(spark, sf), "body", I.PRODUCTS, 5))


@query("b11_product_sentiment_top_labels", f"""WITH {SCORED}, {CLEAN_DOCS}, {HITS}, {SHARES}
SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY ratio DESC, product) <= 10""")
def b11d(spark, sf):
    return rounded(PB.product_sentiment_by_label(scored_texts(spark, sf), "body", I.PRODUCTS, 10))


def spelled(name: str) -> list[str]:
    return sorted({" ".join(s.replace(".", " ").replace("-", " ").split()) for s in PRODUCT_SPELLINGS[name]})


@query("b11_product_mentions_all_spellings", f"WITH c AS (SELECT {I.clean_sql('text')} AS t FROM documents) " + " UNION ALL ".join(
    f"SELECT '{p}' AS product, count(*)::BIGINT AS count FROM c WHERE {' OR '.join(f'contains(t, {chr(39)} {x} {chr(39)})' for x in spelled(p))} HAVING count(*) > 0" for p in PRODUCT_SPELLINGS))
def b11e(spark, sf):
    """Texts that name each product, under all spellings of the full list."""
    hits = M.explode_mentions(I.texts(spark, sf).select("body"), "body", PRODUCT_SPELLINGS, "product")
    return hits.groupBy("product").agg(F.count(F.lit(1)).alias("count"))


@query("b11_explode_term_table", f"""WITH g AS (SELECT l.doc_id, {I.clean_sql('d.text')} AS t FROM documents d JOIN documents l USING (doc_id)),
t AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT unnest(['{"', '".join(I.PRODUCTS)}']))
SELECT DISTINCT doc_id, term FROM g JOIN t ON contains(g.t, ' ' || term || ' ')""")
def b11c(spark, sf):
    names = I.table(spark, sf, "part").select(F.col("p_name").alias("spelling"), F.explode(F.array("p_name", *map(F.lit, I.PRODUCTS))).alias("name"))
    terms = names.select(F.col("name").alias("spelling"), "name").distinct()
    return M.explode_term_table(I.texts(spark, sf), "doc_id", "body", terms, 2)


RULES = {"apache": "src1", "license": "src2", "version": "src3"}
BRAND_CASE = "CASE " + " ".join(f"WHEN source = '{c}' OR {I.word_match_sql('text', b)} THEN '{b}'" for b, c in RULES.items()) + " ELSE 'general' END"


def branded(df):
    return PB.with_brand(df, M.community_or_mention_rules(RULES, "community", "body"))


@query("b12_attribute_brand", f"SELECT doc_id, {BRAND_CASE} AS brand FROM documents")
def b12(spark, sf):
    return branded(I.texts(spark, sf)).select("doc_id", "brand")


BRANDED = f"branded AS (SELECT d.doc_id, {BRAND_CASE} AS brand, lower(d.text) AS t, s.sentiment FROM documents d JOIN scored s USING (doc_id))"


@query("b13_sentiment_by_brand", f"""WITH {SCORED}, {BRANDED} SELECT brand, sentiment, count(*)::BIGINT AS value, (sum(count(*)) OVER (PARTITION BY brand))::BIGINT AS total_count,
round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY brand), 3) AS ratio FROM branded WHERE brand <> 'general' GROUP BY brand, sentiment""")
def b13(spark, sf):
    return PB.sentiment_by_brand(branded(scored_texts(spark, sf)))


PAIRS = "pairs AS (" + " UNION ALL ".join(f"SELECT brand, sentiment, '{p}' AS variable FROM branded WHERE brand <> 'general' AND contains(t, '{p}')" for p in I.PRODUCTS) + ")"


@query("b14_brand_product_sentiment", f"""WITH {SCORED}, {BRANDED}, {PAIRS} SELECT brand, variable, sentiment, count(*)::BIGINT AS value,
(sum(count(*)) OVER (PARTITION BY brand, variable))::BIGINT AS total_count, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY brand, variable), 6) AS ratio
FROM pairs GROUP BY brand, variable, sentiment""")
def b14(spark, sf):
    return rounded(PB.brand_product_sentiment(branded(scored_texts(spark, sf)), "body", list(RULES), I.PRODUCTS))


PLACES = ["the", "thor", "is", "ou", "der", "la", "st. ou"]


def _place_union(test):
    return " UNION ALL ".join(f"SELECT '{p}' AS city FROM documents WHERE {test(p.replace('.', ''))}" for p in PLACES)


@query("b15_place_mentions", f"""WITH h AS ({_place_union(lambda p: f"starts_with(lower(translate(text, {I.MARKS}, ' ')), '{p}')")}),
c AS (SELECT city, count(*)::BIGINT AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM h GROUP BY 1)
SELECT c.*, n_nationkey AS code FROM c LEFT JOIN nation ON length(city) = n_nationkey""")
def b15(spark, sf):
    nation = I.table(spark, sf, "nation")
    lengths = F.array(*[F.struct(F.lit(p).alias("city"), F.lit(len(p)).alias("n")) for p in PLACES])
    dim = nation.select(F.explode(lengths).alias("p"), F.col("n_nationkey").alias("code")).where("p.n = code").select("p.city", "code")
    return PB.place_mentions(I.texts(spark, sf), "body", PLACES, dim)


@query("b15_place_mentions_word", f"""WITH h AS ({_place_union(lambda p: f"contains({I.clean_sql('text')}, ' {p} ')")})
SELECT city, count(*)::BIGINT AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM h GROUP BY 1""")
def b15b(spark, sf):
    return PB.place_mentions(I.texts(spark, sf), "body", PLACES, match="word")


BRANCHES_SQL = f"branches AS (SELECT ([{I.sql_list(ALL_PLACES)}])[1 + c_custkey % {len(ALL_PLACES)}] AS city, lower(c_mktsegment) AS rest FROM customer)"


@query("b15_place_mentions_all_places", f"""WITH {BRANCHES_SQL}, p AS (SELECT unnest([{I.sql_list(ALL_PLACES)}]) AS place),
h AS (SELECT place AS city FROM branches, p WHERE starts_with(replace(city, '.', '') || ' ' || rest, replace(place, '.', '')))
SELECT city, count(*)::BIGINT AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM h GROUP BY 1""")
def b15c(spark, sf):
    """The full list of places, in texts made of a place and a customer's market segment."""
    place = F.get(C.string_array(ALL_PLACES), (F.col("c_custkey") % len(ALL_PLACES)).cast("int"))
    texts = I.table(spark, sf, "customer").select(F.concat_ws(" ", F.initcap(place), "c_mktsegment").alias("body"))
    return PB.place_mentions(texts, "body", ALL_PLACES)


STACKED = "stacked AS (" + " UNION ALL ".join(f"SELECT '{b}' AS brand, j.* FROM j WHERE {I.word_match_sql('body', b)}" for b in I.BRANDS) + ")"


@query("b16_persona_by_brand", f"""WITH {AUTHOR_SQL}, {STACKED}, a AS (SELECT brand, author, avg(score) AS average_score, avg(code) AS average_sentiment, count(body) AS number_of_comments
FROM stacked GROUP BY ALL), m AS (SELECT brand, avg(average_score) AS average_score, avg(average_sentiment) AS average_sentiment, avg(number_of_comments) AS number_of_comments FROM a GROUP BY 1)
SELECT brand, metric, round(score, 6) AS score FROM (UNPIVOT m ON average_score, average_sentiment, number_of_comments INTO NAME metric VALUE score)""")
def b16(spark, sf):
    return rounded(PB.persona_by_brand(I.authored(spark, sf), I.BRANDS, I.LEXICON))


@query("b17_explode_brands", " UNION ALL ".join(f"SELECT doc_id, '{b}' AS brand FROM documents WHERE {I.word_match_sql('text', b)}" for b in I.BRANDS))
def b17(spark, sf):
    return M.explode_brands(I.texts(spark, sf), "body", I.BRANDS).select("doc_id", "brand")


DAILY_SENTIMENT = f"""{AUTHOR_SQL}, {STACKED}, {I.WIDE_SQL},
joined AS (SELECT Date, brand, round(avg(code), 6) AS average_sentiment, any_value(click) AS click, any_value("view") AS "view", any_value(error) AS error,
 any_value(signup) AS signup, any_value(purchase) AS purchase FROM stacked JOIN wide ON Date = CAST(ts AS DATE) GROUP BY ALL)"""


def daily_sentiment(spark, sf):
    return rounded(PB.daily_sentiment_vs_series(I.authored(spark, sf), I.wide_interest(spark, sf), "body", I.BRANDS, I.LEXICON))


@query("b18_daily_sentiment_vs_series", f"WITH {DAILY_SENTIMENT} SELECT CAST(Date AS VARCHAR) AS Date, brand, average_sentiment, click, \"view\", error, signup, purchase FROM joined")
def b18(spark, sf):
    return day_text(daily_sentiment(spark, sf), "Date")


OWN = {"apache": "click", "license": "view", "version": "error", "public": "signup"}


@query("b19_align_own_series", f"""WITH {DAILY_SENTIMENT} SELECT DISTINCT CAST(Date AS VARCHAR) AS Date, brand, average_sentiment,
(CASE brand WHEN 'apache' THEN click WHEN 'license' THEN "view" WHEN 'version' THEN error WHEN 'public' THEN signup END)::DOUBLE AS google_value
FROM joined WHERE google_value IS NOT NULL""")
def b19(spark, sf):
    joined = daily_sentiment(spark, sf).withColumnsRenamed({v: k for k, v in OWN.items()})
    return day_text(PB.align_own_series(joined, I.BRANDS), "Date")


@query("b20_activity_vs_external", f"""WITH {I.LOG_SQL}, a AS (SELECT CAST(ts AS DATE) AS day, count(*)::BIGINT AS activity_count FROM log WHERE community = 'c7' AND event_type <> 'error' GROUP BY 1),
x AS (SELECT CAST(ts AS DATE) AS day, count(*)::BIGINT AS daily_new, round(sum(value), 4) AS cumulative FROM events GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, activity_count, daily_new, cumulative FROM a JOIN x USING (day)""")
def b20(spark, sf):
    c, p = [f.withColumn("body", F.when(F.col("event_type") != "error", F.col("event_type"))) for f in (I.comments(spark, sf), I.posts(spark, sf))]
    ext = I.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("daily_new"), F.round(F.sum("value"), 4).alias("cumulative"))
    return day_text(PA.activity_vs_external(c, p, "c7", ext))


LONG = f"{I.WIDE_SQL}, long AS (SELECT Date, variable AS brand, value AS v FROM (UNPIVOT wide ON click, view, error, signup, purchase INTO NAME variable VALUE value))"


@query("b21_series_summary", f"WITH {LONG} SELECT brand, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3 FROM long GROUP BY 1")
def b21(spark, sf):
    return rounded(PO.series_overview(I.wide_interest(spark, sf), I.EVENT_TYPES)["summary"])


@query("b21_series_monthly", f"WITH {LONG} SELECT brand, CAST(last_day(Date) AS VARCHAR) AS month_end, round(avg(v), 6) AS normalized_count FROM long GROUP BY ALL")
def b21b(spark, sf):
    return day_text(rounded(PO.series_overview(I.wide_interest(spark, sf), I.EVENT_TYPES)["monthly"]), "month_end")


@query("b21_series_histogram", f"WITH {LONG} SELECT brand, floor(v / 1.0) AS bin, count(*)::BIGINT AS count FROM long GROUP BY ALL")
def b21c(spark, sf):
    return PO.series_overview(I.wide_interest(spark, sf), I.EVENT_TYPES)["histogram"]


@query("b22_author_activity", f"WITH {I.LOG_SQL} SELECT author, count(*)::BIGINT AS n_actions, count(DISTINCT community)::BIGINT AS n_communities FROM log GROUP BY 1")
def b22(spark, sf):
    return PA.author_activity(I.log(spark, sf))

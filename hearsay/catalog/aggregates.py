"""A, W, O, U and R rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.filters import DAILY_TWO, day_text, two_daily
from hearsay.catalog.registry import query
from hearsay.functions import columns as C
from hearsay.operators import aggregates as A, mentions as M, quality as Q, reshape as R, series as S, windows as W


def rounded(df, digits=6):
    """Round the double columns, so that summation order does not show."""
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema.fields if f.dataType.simpleString() == "double"})


@query("a1_count_by", "SELECT source, count(*)::BIGINT AS count FROM documents GROUP BY 1")
def a1(spark, sf):
    return A.count_by(I.table(spark, sf, "documents"), "source")


@query("a2_daily_count", "SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(event_id)::BIGINT AS n FROM events GROUP BY ALL")
def a2(spark, sf):
    return day_text(A.daily_count(I.table(spark, sf, "events"), "ts", "event_id", "n", ["event_type"]))


@query("a3_monthly_sum", f"""WITH {DAILY_TWO} SELECT year(day) || '-' || month(day) AS dt_month_year, strftime(date_trunc('month', day), '%Y-%m-%d') AS month,
sum(orders)::BIGINT AS orders, sum(shipped)::BIGINT AS shipped FROM a FULL JOIN b USING (day) GROUP BY ALL""")
def a3(spark, sf):
    a, b = two_daily(spark, sf)
    return day_text(A.monthly_sum(a.join(b, "day", "full"), "day", ["orders", "shipped"]), "month")


@query("a4_daily_sum", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, sum(l_linenumber)::BIGINT AS lines, round(sum(l_quantity), 4) AS quantity
FROM lineitem GROUP BY 1""")
def a4(spark, sf):
    return day_text(rounded(A.daily_sum(I.table(spark, sf, "lineitem"), "l_shipdate", {"l_linenumber": "lines", "l_quantity": "quantity"}), 4))


AUTHOR_SQL = f"""{I.AUTHORED_SQL}, {I.scored_sql('authored', 'doc_id', 'body')},
j AS (SELECT a.*, s.sentiment, CASE s.sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS code FROM authored a JOIN scored s USING (doc_id)),
per AS (SELECT event_type, author, count(body)::BIGINT AS number_of_comments, avg(score) AS average_score, avg(code) AS average_sentiment FROM j GROUP BY ALL)"""


def author_scored(spark, sf):
    from hearsay.operators.sentiment import score_sentiment, sentiment_code

    return score_sentiment(I.authored(spark, sf), "body", I.LEXICON).withColumn("code", sentiment_code())


@query("a5_author_metrics", f"""WITH {AUTHOR_SQL} SELECT event_type, author, number_of_comments, round(average_score, 6) AS average_score,
round(average_sentiment, 6) AS average_sentiment FROM per""")
def a5(spark, sf):
    return rounded(A.author_metrics(author_scored(spark, sf), "author", "body", "score", "code", ["event_type"]))


@query("a6_persona", f"""WITH {AUTHOR_SQL} SELECT event_type, round(avg(average_score), 6) AS average_score,
round(avg(average_sentiment), 6) AS average_sentiment, round(avg(number_of_comments), 6) AS number_of_comments FROM per GROUP BY 1""")
def a6(spark, sf):
    per = A.author_metrics(author_scored(spark, sf), "author", "body", "score", "code", ["event_type"])
    return rounded(A.persona(per, ["event_type"]))


@query("a7_daily_mean", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a7(spark, sf):
    return day_text(rounded(A.daily_mean(I.table(spark, sf, "events"), "ts", "value", "mean")))


FLAGS_SQL = "flags AS (SELECT " + ", ".join(f"{I.word_match_sql('text', b)} AS {b}" for b in I.BRANDS) + " FROM documents)"


@query("a8_co_mention_counts", f"WITH {FLAGS_SQL} SELECT {', '.join(I.BRANDS)}, count(*)::BIGINT AS count FROM flags GROUP BY ALL")
def a8(spark, sf):
    return A.co_mention_counts(M.mention_flags(I.documents(spark, sf).select("text"), "text", I.BRANDS), I.BRANDS)


@query("a9_total", "SELECT sum(n_chars)::BIGINT AS sum_n_chars FROM documents")
def a9(spark, sf):
    return A.total(I.table(spark, sf, "documents"), "n_chars")


@query("a9_max", "SELECT max(c) AS max_count FROM (SELECT count(*)::BIGINT AS c FROM events GROUP BY user_id)")
def a9b(spark, sf):
    return A.total(A.count_by(I.table(spark, sf, "events"), "user_id"), "count", "max")


NULLS = ["doc_id", "lang", "quality", "toxic"]


@query("a10_null_counts", "SELECT " + ", ".join(f"(count(*) FILTER ({c} IS NULL))::BIGINT AS {c}" for c in NULLS)
       + " FROM documents LEFT JOIN labels USING (doc_id)")
def a10(spark, sf):
    return Q.null_counts(I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left"), NULLS)


@query("a11_null_nan_counts", """SELECT (count(*) FILTER (event_id IS NULL))::BIGINT AS event_id,
(count(*) FILTER (value < 5 OR value > 200))::BIGINT AS odd FROM events""")
def a11(spark, sf):
    odd = F.when(F.col("value") < 5, F.lit(float("nan"))).when(F.col("value") <= 200, F.col("value"))
    return Q.null_nan_counts(I.table(spark, sf, "events").select("event_id", odd.alias("odd")))


@query("a12_describe", """SELECT event_type, count(value)::BIGINT AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev,
min(value) AS min, max(value) AS max FROM events GROUP BY 1""")
def a12(spark, sf):
    return rounded(Q.describe(I.table(spark, sf, "events"), "value", ["event_type"]))


@query("a13_series_summary", f"""WITH {I.EVENT_DAYS_SQL} SELECT series, min(n)::BIGINT AS min, max(n)::BIGINT AS max, round(avg(n), 6) AS mean,
round(quantile_cont(n, 0.25), 6) AS q1, round(quantile_cont(n, 0.75), 6) AS q3 FROM days GROUP BY 1""")
def a13(spark, sf):
    return rounded(Q.series_summary(I.event_days(spark, sf), "series", "n"))


@query("a14_monthly_mean", f"""WITH {I.ORDER_DAYS_SQL} SELECT series, CAST(last_day(day) AS VARCHAR) AS month_end, round(avg(n), 6) AS mean FROM days GROUP BY ALL""")
def a14(spark, sf):
    return day_text(rounded(A.monthly_mean(I.order_days(spark, sf), "day", "series", "n")), "month_end")


@query("a15_distinct", "SELECT DISTINCT event_type, user_id FROM events")
def a15(spark, sf):
    return A.distinct_rows(I.table(spark, sf, "events"), ["event_type", "user_id"])


@query("a16_group_totals", f"WITH {I.EVENT_DAYS_SQL} SELECT series, sum(n)::BIGINT AS total_count FROM days GROUP BY 1")
def a16(spark, sf):
    return A.group_totals(I.event_days(spark, sf), "series", "n")


@query("a17_share_of_total", """SELECT event_type, count(*)::BIGINT AS n, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 0) AS pct FROM events GROUP BY 1""")
def a17(spark, sf):
    counts = I.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return A.share_of_total(counts, "n", 0)


@query("a18_ratio", """SELECT source, (count(*) FILTER (toxic = 1))::BIGINT AS bad, count(toxic)::BIGINT AS seen,
round((count(*) FILTER (toxic = 1)) * 100.0 / nullif(count(toxic), 0), 3) AS ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def a18(spark, sf):
    df = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    counts = df.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count("toxic").alias("seen"))
    return A.ratio_of(counts, "bad", "seen", digits=3, scale=100.0)


@query("w1_percent_of_total", """SELECT source, count(*)::BIGINT AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY 1""")
def w1(spark, sf):
    return W.percent_of_total(A.count_by(I.table(spark, sf, "documents"), "source"), "count")


TIES_SQL = """SELECT event_type, event_id, score, rank FROM (SELECT event_type, event_id, round(value) AS score,
rank() OVER (PARTITION BY event_type ORDER BY round(value) DESC)::BIGINT AS rank FROM events) WHERE rank <= 10"""


@query("w2_top_k_per_group_ties", TIES_SQL)
def w2(spark, sf):
    df = I.table(spark, sf, "events").select("event_type", "event_id", F.round("value").alias("score"))
    return W.top_k_per_group(df, ["event_type"], "score", 10, groups=df)


@query("w2_top_k_nullable_group", """SELECT quality, doc_id, n_chars, rank FROM (SELECT quality, doc_id, n_chars,
rank() OVER (PARTITION BY quality ORDER BY n_chars DESC) AS rank FROM documents LEFT JOIN labels USING (doc_id)) WHERE rank <= 5""")
def w2c(spark, sf):
    df = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left").select("quality", "doc_id", "n_chars")
    return W.top_k_per_group(df, ["quality"], "n_chars", 5)


@query("w2_top_k_per_group_rows", """SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value,
row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INT AS rank FROM events) WHERE rank <= 10""")
def w2b(spark, sf):
    df = I.table(spark, sf, "events").select("event_type", "event_id", "value")
    return W.top_k_per_group(df, ["event_type"], "value", 10, "row", ["event_id"])


@query("w3_rolling_stats", f"""WITH {I.ORDER_DAYS_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n,
round(CASE WHEN count(n) OVER w = 10 THEN avg(n) OVER w END, 6) AS rolling_mean, round(CASE WHEN count(n) OVER w = 10 THEN stddev_samp(n) OVER w END, 6) AS rolling_std
FROM days WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w3(spark, sf):
    return day_text(rounded(S.rolling_stats(I.order_days(spark, sf).drop("amount"), ["series"], "day", "n")))


@query("w4_difference", f"""WITH {I.ORDER_DAYS_SQL}, d1 AS (SELECT series, day, n - lag(n) OVER (PARTITION BY series ORDER BY day) AS d FROM days)
SELECT series, CAST(day AS VARCHAR) AS day, (d - lag(d) OVER (PARTITION BY series ORDER BY day))::BIGINT AS n_diff FROM d1""")
def w4(spark, sf):
    return day_text(S.difference(I.order_days(spark, sf), ["series"], "day", "n", 2).select("series", "day", "n_diff"))


GAPS_SQL = f"""{I.ORDER_DAYS_SQL}, span AS (SELECT series, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM days GROUP BY 1),
full_days AS (SELECT s.series, s.day, d.n::DOUBLE AS n FROM span s LEFT JOIN days d USING (series, day))"""


def full_order_days(spark, sf):
    days = I.order_days(spark, sf).withColumn("n", F.col("n").cast("double"))
    return S.regularize(days, ["series"], "day", "n")


@query("w5_impute_neighbors", f"""WITH {GAPS_SQL} SELECT series, CAST(day AS VARCHAR) AS day,
round(coalesce(n, avg(n) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS n FROM full_days""")
def w5(spark, sf):
    return day_text(rounded(S.impute_neighbors(full_order_days(spark, sf), ["series"], "day", "n")))


@query("w6_undifference", f"WITH {I.EVENT_DAYS_SQL} SELECT series, CAST(day AS VARCHAR) AS day, n::DOUBLE AS level FROM days QUALIFY row_number() OVER (PARTITION BY series ORDER BY day) > 2")
def w6(spark, sf):
    days = I.event_days(spark, sf).select("series", "day", F.col("n").cast("double").alias("n"))
    first = S.tail_split(days.withColumn("day", -F.datediff("day", F.lit("2000-01-01"))), ["series"], "day", 2)[1]
    anchors = S.last_values(first.withColumn("day", -F.col("day")), ["series"], "day", "n")
    twice = S.difference(days, ["series"], "day", "n", 2).where(F.col("n_diff").isNotNull())
    return day_text(S.undifference(twice, anchors, ["series"], "day", "n_diff", 2, "level").select("series", "day", "level"))


@query("w7_row_id_in_group", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS row_id FROM events")
def w7(spark, sf):
    return W.with_row_id(I.table(spark, sf, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], ["user_id"]).drop("ts")


@query("w7_row_id_global", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey)::BIGINT AS row_id FROM orders")
def w7b(spark, sf):
    return W.with_row_id(I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("o1_order", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def o1(spark, sf):
    return R.order(I.table(spark, sf, "nation").select("n_name", "n_regionkey"), F.desc("n_regionkey"), "n_name")


@query("o2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o2(spark, sf):
    return R.top_k(I.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@query("u1_union_all", "SELECT text AS body FROM documents UNION ALL SELECT text FROM conversations")
def u1(spark, sf):
    return R.union_all(I.table(spark, sf, "documents").select(F.col("text").alias("body")), I.table(spark, sf, "conversations").select("text"))


@query("u2_union_distinct", "SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'signup'")
def u2(spark, sf):
    e = I.table(spark, sf, "events")
    return R.union_distinct(e.where("event_type = 'view'").select("user_id"), e.where("event_type = 'signup'").select("user_id"))


@query("u3_top_k_with_other", """WITH c AS (SELECT p_name AS product, count(*)::BIGINT AS count FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, product) AS k FROM c)
SELECT CASE WHEN k <= 5 THEN product ELSE 'other' END AS product, sum(count)::BIGINT AS count FROM r GROUP BY 1""")
def u3(spark, sf):
    counts = I.table(spark, sf, "part").groupBy(F.col("p_name").alias("product")).agg(F.count(F.lit(1)).alias("count"))
    return R.top_k_with_other(counts, "product", "count", 5)


WIDE_UNPIVOT = f"WITH {I.WIDE_SQL} SELECT CAST(Date AS VARCHAR) AS Date, variable, value FROM (UNPIVOT wide ON click, view, error, signup, purchase INTO NAME variable VALUE value)"


@query("r1_melt", WIDE_UNPIVOT)
def r1(spark, sf):
    return day_text(R.melt(I.wide_interest(spark, sf), ["Date"], I.EVENT_TYPES), "Date")


@query("r2_stack", WIDE_UNPIVOT)
def r2(spark, sf):
    stacked = ", ".join(f"'{t}', {t}" for t in I.EVENT_TYPES)
    return I.wide_interest(spark, sf).selectExpr("CAST(Date AS string) AS Date", f"stack({len(I.EVENT_TYPES)}, {stacked}) AS (variable, value)").where("value IS NOT NULL")


@query("r3_melt_labels", "SELECT doc_id, metric, score FROM (UNPIVOT labels ON quality, toxic INTO NAME metric VALUE score)")
def r3(spark, sf):
    return R.melt(I.table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"], "metric", "score")


@query("r4_pivot_sum", "SELECT l_returnflag, " + ", ".join(f"coalesce(round(sum(l_quantity) FILTER (l_linestatus = '{s}'), 4), 0) AS {s}" for s in "OF")
       + " FROM lineitem GROUP BY 1")
def r4(spark, sf):
    return rounded(R.pivot_counts(I.table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["O", "F"]), 4)


@query("r5_explode", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding)::DOUBLE, 6) AS v FROM embeddings")
def r5(spark, sf):
    out = R.explode(I.table(spark, sf, "embeddings"), "embedding", "v", "pos").select("vec_id", F.col("pos").cast("bigint").alias("pos"), "v")
    return out.withColumn("v", F.round(F.col("v").cast("double"), 6))

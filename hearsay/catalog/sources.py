"""S and P rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.registry import query
from hearsay.functions import columns as C
from hearsay.operators import joins, quality, rows
from hearsay.session import scratch_path
from hearsay.sources import activity, series, sinks


@query("s1_read_activity", "SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def s1(spark, sf):
    df = activity.read_parquet(spark, f"{sf}/documents.parquet", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("s1_normalize_activity", f"""WITH {I.AUTHORED_SQL}
SELECT doc_id::VARCHAR AS id, author, community, CAST(ts AS VARCHAR)[1:19] AS ts, score, md5(body) AS body, 'comment' AS kind FROM authored""")
def s1b(spark, sf):
    df = activity.normalize_activity(I.authored(spark, sf), "comment", {
        "id": F.col("doc_id").cast("string"), "community": "community", "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})
    return df.withColumn("body", F.md5("body"))


@query("s1_read_activity_feeds", f"""WITH {I.AUTHORED_SQL}, k AS (SELECT 'comment' AS kind UNION ALL SELECT 'post')
SELECT doc_id::VARCHAR AS id, author, community, CAST(ts AS VARCHAR)[1:19] AS ts, floor(score)::BIGINT AS score,
md5(CASE kind WHEN 'post' THEN concat_ws(' ', community, body) ELSE body END) AS body, kind FROM authored, k""")
def s1c(spark, sf):
    """Both feeds written with the columns at hand, read back under their declared schemas and brought to one shape."""
    rows = I.authored(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"), "author", F.col("community").alias("subreddit"), "body",
        F.floor("score").cast("bigint").alias("score"), F.unix_timestamp("ts").alias("created_utc"))
    feeds = []
    for kind, feed in (("comment", rows), ("post", rows.withColumnsRenamed({"body": "selftext"}).withColumn("title", F.col("subreddit")))):
        path = scratch_path(spark, f"{kind}s")
        feed.write.parquet(path)
        feeds.append(activity.normalize_activity(activity.read_activity(spark, path, kind), kind))
    return activity.stack_chunks(*feeds).withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "body": F.md5("body")})


@query("s2_read_daily_series", f"WITH {I.WIDE_SQL} SELECT CAST(Date AS VARCHAR) AS Date, click, view, error, signup, purchase FROM wide")
def s2(spark, sf):
    path = scratch_path(spark, "series")
    sinks.save_report(I.wide_interest(spark, sf), path)
    out = series.read_daily_series(spark, path, series.search_interest_schema(I.EVENT_TYPES))
    return out.select(F.col("Date").cast("string").alias("Date"), *[F.col(c).cast("bigint").alias(c) for c in I.EVENT_TYPES])


@query("s3_read_lookup", "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation")
def s3(spark, sf):
    path = scratch_path(spark, "lookup")
    sinks.save_report(I.table(spark, sf, "nation"), path, single_file=True)
    return series.read_lookup(spark, path, "n_nationkey int, n_name string, n_regionkey int", lower=("n_name",))


@query("s4_literal_rows", """SELECT p_type AS product, count(*)::BIGINT AS "count" FROM part GROUP BY 1
UNION ALL SELECT 'other', 39::BIGINT""")
def s4(spark, sf):
    counts = I.table(spark, sf, "part").groupBy(F.col("p_type").alias("product")).agg(F.count(F.lit(1)).alias("count"))
    return counts.unionByName(activity.literal_rows(spark, [("other", 39)], "product string, count bigint"))


@query("s5_save_slice", f"WITH {I.LOG_SQL} SELECT community, count(*)::BIGINT AS n, round(sum(score), 4) AS score FROM comments GROUP BY 1")
def s5(spark, sf):
    kept = sinks.save_slice(I.comments(spark, sf), scratch_path(spark, "slice"), "overwrite", read_back=True)
    return kept.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query("s5_save_monthly_slice", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def s5b(spark, sf):
    path = scratch_path(spark, "monthly")
    sinks.save_monthly_slice(I.table(spark, sf, "orders"), path, "o_orderdate")
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("s6_save_report", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def s6(spark, sf):
    path = scratch_path(spark, "report")
    counts = I.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    sinks.save_report(counts, path, single_file=True)
    return series.read_daily_series(spark, path, "event_type string, n bigint")


@query("s7_sql_text", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events WHERE value > 10 GROUP BY 1")
def s7(spark, sf):
    return spark.sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {log} WHERE value > 10 GROUP BY 1",
                     log=I.table(spark, sf, "events"))


@query("s8_profile_schema", "SELECT x.*, (SELECT count(*)::BIGINT FROM supplier) AS n_rows, 4 AS n_columns FROM (VALUES "
       "(0, 's_suppkey', 'bigint'), (1, 's_name', 'string'), (2, 's_nationkey', 'int'), (3, 's_acctbal', 'double')) x(position, \"column\", type)")
def s8(spark, sf):
    return quality.profile_schema(I.table(spark, sf, "supplier"))


@query("s9_stack_chunks", f"""WITH {I.WIDE_SQL} SELECT CAST(Date AS VARCHAR) AS Date, click, view FROM wide""")
def s9(spark, sf):
    wide = I.wide_interest(spark, sf).select("Date", "click", "view").withColumn("isPartial", F.lit(False))
    early, middle = F.lit("2024-01-11").cast("date"), F.lit("2024-01-21").cast("date")
    chunks = [wide.where(F.col("Date") < early), wide.where((F.col("Date") >= early) & (F.col("Date") < middle)),
              wide.where(F.col("Date") >= middle)]
    return activity.stack_chunks(*chunks).withColumn("Date", F.col("Date").cast("string"))


@query("p1_keep", "SELECT event_id, user_id, event_type, value FROM events")
def p1(spark, sf):
    return rows.keep(I.table(spark, sf, "events"), ["event_id", "user_id", "event_type", "value"])


@query("p2_drop_cols", "SELECT doc_id, lang, source, n_chars FROM documents")
def p2(spark, sf):
    return rows.drop_cols(I.table(spark, sf, "documents"), ["text", "not_a_column", "edited"])


@query("p3_epoch_to_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def p3(spark, sf):
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return I.table(spark, sf, "events").select("event_id", F.date_format(C.epoch_to_ts(epoch), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("p4_cast_cols", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k, TRY_CAST(event_type AS INT) AS bad FROM events")
def p4(spark, sf):
    df = I.table(spark, sf, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"), F.col("event_type").alias("bad"))
    return series.cast_cols(df, {"k": "int", "bad": "int"})


@query("p5_rename", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_nationkey FROM supplier")
def p5(spark, sf):
    return rows.rename(I.table(spark, sf, "supplier"), {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"})


@query("p6_alias_expression", "SELECT o_orderkey, floor(o_totalprice / 1000)::BIGINT AS thousands FROM orders")
def p6(spark, sf):
    return I.table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("thousands"))


@query("p7_post_body", """SELECT d.doc_id, md5(concat_ws(' ', CASE WHEN l.toxic = 0 THEN d.source END, d.text)) AS body
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p7(spark, sf):
    df = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    df = df.withColumn("title", F.when(F.col("toxic") == 0, F.col("source")))
    return df.select("doc_id", F.md5(C.post_body("title", "text")).alias("body"))


@query("p8_with_label", "SELECT n_nationkey, n_name, 'country' AS kind FROM nation")
def p8(spark, sf):
    return rows.with_label(I.table(spark, sf, "nation").select("n_nationkey", "n_name"), "kind", "country")


@query("p9_flatten_struct", "SELECT event_id, user_id, value FROM events")
def p9(spark, sf):
    return I.table(spark, sf, "events").select("event_id", F.struct("user_id", "value").alias("s")).select("event_id", "s.*")


@query("p10_encode_ordinal", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code, o_orderpriority FROM orders""")
def p10(spark, sf):
    return I.table(spark, sf, "orders").select("o_orderkey", C.ordinal("o_orderstatus", {"F": 0, "O": 1, "P": 2}).alias("code"), "o_orderpriority")


@query("x8_case_when", f"""SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'long' WHEN lang = 'en' THEN 'english' ELSE 'rest' END AS bucket FROM documents""")
def x8(spark, sf):
    rules = F.when(F.col("n_chars") > 5000, "long").when(F.col("lang") == "en", "english").otherwise("rest")
    return I.table(spark, sf, "documents").select("doc_id", rules.alias("bucket"))


@query("j7_join_by_id", f"""WITH {I.scored_sql('documents', 'doc_id', 'text')}
SELECT d.doc_id, d.source, s.sentiment FROM documents d FULL JOIN scored s USING (doc_id)""")
def j7(spark, sf):
    from hearsay.operators.sentiment import score_sentiment

    docs = I.table(spark, sf, "documents")
    scored = score_sentiment(docs.select("doc_id", "text"), "text", I.LEXICON).select("doc_id", "sentiment")
    return joins.join_by_id(docs.select("doc_id", "source"), scored, "doc_id")

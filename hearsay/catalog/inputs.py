"""Stand-ins for the activity log, built from the test tables, and their SQL twins.

events -> log rows without text (author, community, time, score); documents
-> texts; conversations -> post titles; documents joined with events on the
id -> texts with author and time; labels and roles -> quality flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hearsay.vocab import PUNCTUATION

POST_TYPES = ["signup", "purchase"]
BRANDS = ["apache", "license", "version", "public"]
PRODUCTS = ["under", "license", "licensed", "version", "general public", "released", "thing", "trash", "nicht", "only"]
RULES = [
    ("licensed", "license"), ("general public license", "gpl"), ("apache license", "asl"), ("license", "licence"),
    ("version", "release"), ("released", "version"),
]
LEXICON = {
    "worthless": -2.0, "clown": -1.0, "trash": -1.0, "scum": -2.0, "moron": -2.0, "loser": -1.0, "idiot": -2.0,
    "pathetic": -1.0, "disgusting": -2.0, "stupid": -1.0, "only": 1.0, "thing": 1.0, "best": 2.0, "great": 2.0,
    "license": 1.0, "licensed": 1.0, "released": 1.0, "public": 1.0, "general": 1.0, "heed": -1.0, "hest": 1.0,
}
LEMMAS = {"is": "be", "are": "be", "was": "be", "were": "be", "has": "have", "had": "have", "licensed": "license",
          "words": "word", "things": "thing", "better": "good", "best": "good"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The text table."""
    return table(spark, sf, "documents").select("doc_id", "text", "source", "lang")


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("author"),
        F.concat(F.lit("c"), F.regexp_extract("props", "([0-9]+)", 1)).alias("community"),
        "ts", F.col("value").alias("score"), "event_type",
    )


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).where(~F.col("event_type").isin(POST_TYPES))


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).where(F.col("event_type").isin(POST_TYPES))


LOG_SQL = """
log AS (SELECT event_id AS id, 'u' || user_id AS author,
               'c' || regexp_extract(props, '([0-9]+)', 1) AS community, ts, value AS score, event_type FROM events),
comments AS (SELECT * FROM log WHERE event_type NOT IN ('signup', 'purchase')),
posts AS (SELECT * FROM log WHERE event_type IN ('signup', 'purchase'))"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.col("text").alias("body"), F.col("source").alias("community"), "lang")


TEXTS_SQL = "texts AS (SELECT doc_id, text AS body, source AS community, lang FROM documents)"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("text").alias("title"), F.col("role").alias("community"))


def authored(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the author, time and score of the event of the same id."""
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.concat(F.lit("u"), "user_id").alias("author"), "ts", F.col("value").alias("score"),
        "event_type",
    )
    return texts(spark, sf).join(events, "doc_id")


AUTHORED_SQL = """authored AS (SELECT d.doc_id, d.text AS body, d.source AS community, d.lang, 'u' || e.user_id AS author,
                    e.ts, e.value AS score, e.event_type FROM documents d JOIN events e ON e.event_id = d.doc_id)"""


def order_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order counts and sums per priority: (series, day, n, amount)."""
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("amount"))


ORDER_DAYS_SQL = """days AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, count(*)::BIGINT AS n,
               sum(o_totalprice) AS amount FROM orders GROUP BY ALL)"""


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts and mean values per event type: (series, day, n, v)."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("v")
    )


EVENT_DAYS_SQL = """days AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*)::BIGINT AS n,
               round(avg(value), 6) AS v FROM events GROUP BY ALL)"""

EVENT_TYPES = ["click", "view", "error", "signup", "purchase"]


def wide_interest(spark: SparkSession, sf: str) -> DataFrame:
    """Wide daily series: one column per event type."""
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("Date"))
    return days.pivot("event_type", EVENT_TYPES).agg(F.count(F.lit(1)))


WIDE_SQL = "wide AS (SELECT CAST(ts AS DATE) AS Date, " + ", ".join(
    f"nullif(count(*) FILTER (event_type = '{t}'), 0)::BIGINT AS \"{t}\"" for t in EVENT_TYPES
) + " FROM events GROUP BY 1)"


# --- SQL fragments --------------------------------------------------------------

MARKS = "'" + PUNCTUATION.replace("'", "''") + "'"
SPACES = "'" + " " * len(PUNCTUATION) + "'"


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))


def words_sql(source: str, cols: str, text: str, mode: str = "space", name: str = "words") -> str:
    """CTE (cols, word): one row per non-empty token."""
    target = SPACES if mode == "space" else "' '"
    return (f"{name} AS (SELECT * FROM (SELECT {cols}, unnest(regexp_split_to_array(lower(translate({text}, {MARKS}, "
            f"{target})), '\\s+')) AS word FROM {source}) WHERE word <> '')")


def clean_sql(text: str) -> str:
    """Text as single-spaced cleaned tokens with a space on both ends."""
    return f"(' ' || trim(regexp_replace(lower(translate({text}, {MARKS}, {SPACES})), '\\s+', ' ', 'g')) || ' ')"


def weight_sql(word: str, sign: int) -> str:
    cases = " ".join(f"WHEN '{w}' THEN {abs(v)}::DOUBLE" for w, v in LEXICON.items() if v * sign > 0)
    return f"CASE {word} {cases} ELSE 0.0::DOUBLE END"


def scored_sql(source: str, key: str, text: str, name: str = "scored") -> str:
    """CTEs ending in (key, pw, nw, sentiment) per row of the source."""
    return f"""{words_sql(source, key, text, name='w_' + name)},
{name} AS (SELECT s.{key}, coalesce(sum({weight_sql('w.word', 1)}), 0.0)::DOUBLE AS pw, coalesce(sum({weight_sql('w.word', -1)}), 0.0)::DOUBLE AS nw,
  CASE WHEN coalesce(sum({weight_sql('w.word', 1)}), 0.0) > coalesce(sum({weight_sql('w.word', -1)}), 0.0) THEN 'positive'
       WHEN coalesce(sum({weight_sql('w.word', 1)}), 0.0) < coalesce(sum({weight_sql('w.word', -1)}), 0.0) THEN 'negative'
       ELSE 'neutral' END AS sentiment
  FROM {source} s LEFT JOIN w_{name} w ON w.{key} = s.{key} GROUP BY s.{key})"""


def word_match_sql(text: str, term: str) -> str:
    """Whole-word, any-case test."""
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){term}([^\\p{{L}}\\p{{N}}_]|$)')"

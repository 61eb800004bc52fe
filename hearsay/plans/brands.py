"""Brand, product and place tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions import columns as C
from hearsay.operators import mentions as M
from hearsay.operators.aggregates import PERSONA_METRICS, author_metrics, co_mention_counts, persona
from hearsay.operators.reshape import melt, top_k, top_k_with_other
from hearsay.operators.rows import drop_sentinels
from hearsay.operators.sentiment import score_sentiment, sentiment_code
from hearsay.operators.tokens import remove_stopwords, word_count
from hearsay.operators.windows import percent_of_total, share_within, top_k_per_group
from hearsay.vocab import DELETED, TOP_WORD_NOISE


def top_words(texts: DataFrame, text: str, extra_stop: Sequence[str] = (), k: int = 20) -> DataFrame:
    """Most used words after punctuation and stop words are gone."""
    tokens = texts.select(C.clean_tokens(text, "delete").alias("words"))
    return word_count(remove_stopwords(tokens, "words", extra=[*TOP_WORD_NOISE, *extra_stop]), "words", k)


def co_mentions(df: DataFrame, text: str, terms: Sequence[str], match: str = "word") -> DataFrame:
    return co_mention_counts(M.mention_flags(df.select(text), text, terms, match), terms)


def share_of_voice(comments: DataFrame, posts: DataFrame, terms: Sequence[str], comment_text: str = "body",
                   post_text: str = "title", match: str = "word") -> DataFrame:
    """Mentions of each brand over comments and post titles, with whole percents.

    All brands are counted in one pass over both feeds; the total is taken
    from that one row of counts.
    """
    texts = comments.select(F.col(comment_text).alias("text")).unionAll(posts.select(F.col(post_text).alias("text")))
    counted = texts.agg(*[F.count_if(C.mentions("text", t, match)).alias(t) for t in terms])
    counted = counted.withColumn("_all", sum((F.col(t) for t in terms[1:]), F.col(terms[0])))
    long = melt(counted, ["_all"], terms, "brand", "total_count")
    pct = F.bround(F.try_divide(F.col("total_count") * F.lit(100.0), F.col("_all")), 0)
    return long.select("brand", "total_count", pct.alias("pct"))


def product_mentions(df: DataFrame, text: str, vocab: Sequence[str], rules, k: int = 5, compat: bool = False) -> DataFrame:
    """Texts that are a product name, names unified, the k largest and the rest."""
    cleaned = df.select(F.lower(C.strip_punct(text)).alias("text"))
    terms = sorted({t.translate({ord(m): None for m in C.PUNCTUATION}).lower() for t in vocab})
    named = cleaned.where(F.col("text").isin(terms)).groupBy("text").agg(F.count(F.lit(1)).alias("count"))
    counted = named.groupBy(C.normalize_terms("text", rules, compat).alias("product")).agg(F.sum("count").alias("count"))
    return top_k_with_other(counted, "product", "count", k)


def product_words(counts: DataFrame, vocab: Sequence[str], rules, compat: bool = False) -> DataFrame:
    """Occurrences per product from a word-count table."""
    named = counts.where(F.col("word").isin(list(vocab)))
    return named.groupBy(C.normalize_terms("word", rules, compat).alias("product")).agg(F.sum("count").alias("count"))


def product_sentiment_counts(df: DataFrame, text: str, terms: Mapping[str, Sequence[str]] | Sequence[str],
                             match: str = "word") -> DataFrame:
    """(product, sentiment, sentiment_count, total_mention, ratio in percent); only hits are expanded."""
    hits = M.explode_mentions(df.select(text, "sentiment"), text, terms, "product", match)
    shared = share_within(hits.select("product", "sentiment"), ["product"], ["sentiment"], scale=100.0)
    return shared.withColumnsRenamed({"value": "sentiment_count", "total_count": "total_mention"})


def product_sentiment(df: DataFrame, text: str, terms, k: int = 10, label: str = "positive", match: str = "word") -> DataFrame:
    """Products with the largest share of one sentiment."""
    counts = product_sentiment_counts(df, text, terms, match).where(F.col("sentiment") == label)
    return top_k(counts, "ratio", k, ["product"])


def product_sentiment_by_label(df: DataFrame, text: str, terms, k: int = 10, match: str = "word") -> DataFrame:
    """For every sentiment the k products with the largest share of it, from one count."""
    counts = product_sentiment_counts(df, text, terms, match)
    return top_k_per_group(counts, ["sentiment"], "ratio", k, "row", ["product"]).drop("rank")


def with_brand(df: DataFrame, rules: Sequence[tuple[str, Column]], default: str = "general") -> DataFrame:
    return df.withColumn("brand", M.attribute_brand(rules, default))


def sentiment_by_brand(df: DataFrame, default: str = "general", digits: int = 3) -> DataFrame:
    """(brand, sentiment, value, total_count, ratio) without the default brand."""
    return share_within(df.where(F.col("brand") != default), ["brand"], ["sentiment"], digits=digits)


def brand_product_sentiment(df: DataFrame, text: str, brands: Sequence[str], products: Sequence[str],
                            match: str = "substring") -> DataFrame:
    """(sentiment, variable, value, total_count, ratio, brand): all brands and products in one job.

    Totals are per brand and product.
    """
    rows = df.where(F.col("brand").isin(list(brands))).select(text, "sentiment", "brand")
    hits = M.explode_mentions(rows, text, products, "variable", match)
    return share_within(hits, ["brand", "variable"], ["sentiment"])


def place_mentions(texts: DataFrame, text: str, places: Sequence[str], coordinates: DataFrame | None = None,
                   match: str = "prefix") -> DataFrame:
    """(city, count, percent and, given a table, coordinates)."""
    hits = C.explode_rows(texts, M.place_hits(text, places, match), "city")
    counted = percent_of_total(hits.groupBy("city").agg(F.count(F.lit(1)).alias("count")), "count")
    return counted if coordinates is None else counted.join(coordinates, "city", "left")


def persona_by_brand(df: DataFrame, brands: Sequence[str], lexicon: Mapping[str, float], match: str = "word") -> DataFrame:
    """(brand, metric, score): average author score, sentiment and comment count per brand.

    Needs author, body and score. Every author weighs the same.
    """
    known = drop_sentinels(df.select("author", "body", "score"), {"author": [DELETED]})
    branded = M.explode_brands(known, "body", brands, match)
    scored = score_sentiment(branded, "body", lexicon).withColumn("code", sentiment_code("sentiment"))
    per_author = author_metrics(scored.select("brand", "author", "body", F.col("score"), "code"),
                                "author", "body", "score", "code", ["brand"])
    return melt(persona(per_author, ["brand"]), ["brand"], PERSONA_METRICS, "metric", "score")


def daily_sentiment_vs_series(df: DataFrame, external: DataFrame, text: str, brands: Sequence[str],
                              lexicon: Mapping[str, float], match: str = "word") -> DataFrame:
    """Mean daily sentiment per brand beside an outside wide daily series (key `Date`)."""
    scored = score_sentiment(M.explode_brands(df.select("ts", text), text, brands, match), text, lexicon)
    daily = scored.groupBy(F.to_date("ts").alias("Date"), "brand").agg(
        F.avg(sentiment_code("sentiment")).alias("average_sentiment")
    )
    return daily.join(external, "Date")


def align_own_series(joined: DataFrame, brands: Sequence[str], day: str = "Date", brand: str = "brand",
                     measure: str = "average_sentiment", value: str = "google_value") -> DataFrame:
    """Keep each brand's own column of a wide series: (Date, brand, measure, value).

    The brand picks its column inside the row, so nothing is unpivoted and
    joined back; a brand without a value on the day is left out.
    """
    own = F.coalesce(*[F.when(F.col(brand) == b, F.col(b)) for b in brands]).try_cast("double")
    out = joined.select(day, brand, F.col(measure).try_cast("double").alias(measure), own.alias(value))
    return out.where(F.col(value).isNotNull()).distinct()

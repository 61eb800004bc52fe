"""Sentiment labels: a lexicon scorer inside the row, and a learned one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions import columns as C
from hearsay.operators.bloom import bloom_filter
from hearsay.operators.joins import attach_by_text
from hearsay.operators.skew import join_hot_split
from hearsay.session import write_table
from hearsay.vocab import SENTIMENT_CODES

MAX_INLINE_LEXICON = 20_000


def lexicon_weight(tokens: Column, lexicon: Mapping[str, float], sign: int) -> Column:
    """Summed size of the positive or the negative weights found among the tokens.

    Words are grouped by weight, so each group is one hash-set lookup per token.
    """
    by_weight: dict[float, list[str]] = {}
    for word, weight in lexicon.items():
        if weight * sign > 0:
            by_weight.setdefault(abs(float(weight)), []).append(word)
    total = F.lit(0.0)
    for weight in sorted(by_weight):
        total = total + F.size(_among(tokens, sorted(by_weight[weight]))) * F.lit(weight)
    return total


def _among(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: t.isin(list(words)))


def label_of(positive: str | Column, negative: str | Column) -> Column:
    p, n = C.as_col(positive), C.as_col(negative)
    return F.when(p > n, "positive").when(p < n, "negative").when(p == n, "neutral")


def score_tokens(df: DataFrame, tokens: str, lexicon: Mapping[str, float], prefix: str = "") -> DataFrame:
    """Add `positive_weight`, `negative_weight`, `sentiment_score` and `sentiment`; no shuffle, no UDF."""
    if len(lexicon) > MAX_INLINE_LEXICON:
        raise ValueError("lexicon too large to inline; pass it as a (word, weight) table to score_sentiment")
    p, n = f"{prefix}positive_weight", f"{prefix}negative_weight"
    return (
        df.withColumn(p, lexicon_weight(F.col(tokens), lexicon, 1))
        .withColumn(n, lexicon_weight(F.col(tokens), lexicon, -1))
        .withColumn(f"{prefix}sentiment_score", F.col(p) - F.col(n))
        .withColumn(f"{prefix}sentiment", label_of(p, n))
    )


SCORE_COLUMNS = ["positive_weight", "negative_weight", "sentiment_score", "sentiment"]


def score_sentiment(df: DataFrame, text: str, lexicon: Mapping[str, float] | DataFrame) -> DataFrame:
    """Label every text negative, neutral or positive.

    A mapping is looked up inside the row, with no shuffle. A (word, weight)
    table of any size joins to the tokens of the distinct texts that a Bloom
    filter of its words lets through, counted once into a written table; a
    mapping too large to inline becomes such a table.
    """
    if isinstance(lexicon, Mapping) and len(lexicon) > MAX_INLINE_LEXICON:
        rows = [(w, float(v)) for w, v in lexicon.items()]
        lexicon = df.sparkSession.createDataFrame(rows, "word string, weight double")
    if isinstance(lexicon, Mapping):
        return score_tokens(df.withColumn("_tokens", C.clean_tokens(text)), "_tokens", lexicon).drop("_tokens")
    return attach_by_text(df, text, lambda texts: _score_by_join(texts, text, lexicon), SCORE_COLUMNS)


def _score_by_join(texts: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    keyed = texts.withColumn("_text_key", F.sha2(text, 256))
    held = bloom_filter(lexicon, "word")
    words = C.explode_rows(keyed, C.clean_tokens(text), "word", "_text_key").where(held.might_hold("word"))
    counts = write_table(words.groupBy("_text_key", "word").agg(F.count(F.lit(1)).alias("_n")), "lexicon-counts")
    weight = F.col("weight") * F.col("_n")
    # Lexicon words in use with the number of texts holding them: the weights of the skew-proof join.
    used = counts.groupBy("word").agg(F.count(F.lit(1)).alias("_texts")).join(lexicon.select("word", "weight"), "word")
    summed = join_hot_split(counts, used, ["word"], "_texts").groupBy("_text_key").agg(
        F.sum(F.greatest(weight, F.lit(0.0))).alias("positive_weight"),
        F.sum(F.greatest(-weight, F.lit(0.0))).alias("negative_weight"),
    )
    joined = keyed.join(summed, "_text_key", "left").fillna(0.0, ["positive_weight", "negative_weight"])
    return (
        joined.withColumn("sentiment_score", F.col("positive_weight") - F.col("negative_weight"))
        .withColumn("sentiment", label_of("positive_weight", "negative_weight"))
        .drop("_text_key")
    )


def sentiment_scores(df: DataFrame, positive: str = "positive_weight", negative: str = "negative_weight",
                     out: str = "sentiment_scores") -> DataFrame:
    """Map of label to score; the three scores sum to one. Read it by key."""
    mass = F.col(positive) + F.col(negative) + F.lit(1.0)
    return df.withColumn(out, F.create_map(
        F.lit("negative"), F.col(negative) / mass,
        F.lit("neutral"), F.lit(1.0) / mass,
        F.lit("positive"), F.col(positive) / mass,
    ))


def label_score(scores: str, label: str) -> Column:
    return F.element_at(F.col(scores), label)


def score_distinct(df: DataFrame, text: str, lexicon: Mapping[str, float]) -> DataFrame:
    """Score each distinct text once and fan the result out to its copies."""
    return attach_by_text(df, text, lambda texts: score_sentiment(texts, text, lexicon), SCORE_COLUMNS)


def sentiment_code(c: str | Column = "sentiment") -> Column:
    """0 negative, 1 neutral, 2 positive."""
    return C.ordinal(c, SENTIMENT_CODES)


def train_sentiment(df: DataFrame, tokens: str, label: str, n_features: int = 1 << 16, max_iter: int = 20,
                    reg: float = 0.01) -> PipelineModel:
    """Hashed TF-IDF and logistic regression on a numeric label column."""
    return Pipeline(stages=[
        HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=n_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=max_iter, regParam=reg,
                           probabilityCol="_probability", rawPredictionCol="_raw"),
    ]).fit(df)


def apply_sentiment(model: PipelineModel, df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add the predicted label and a map of label to probability."""
    scored = model.transform(df)
    p = vector_to_array("_probability")
    names = C.string_array(labels)
    return (
        scored.withColumn("sentiment", F.get(names, F.col("prediction").cast("int")))
        .withColumn("sentiment_scores", F.map_from_arrays(names, p))
        .drop("_tf", "_features", "_raw", "_probability", "prediction")
    )

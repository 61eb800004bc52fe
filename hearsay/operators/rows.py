"""Projection, renaming and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.functions.columns import as_col, community_or_keyword
from hearsay.operators.bloom import bloom_filter
from hearsay.operators.skew import is_small
from hearsay.vocab import BOT_AUTHOR, DELETED, REMOVED


def keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Names that do not exist are ignored."""
    return df.drop(*cols)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def with_label(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.lit(value))


def brand_slice(df: DataFrame, community: str, keyword: str, community_col: str, text_col: str) -> DataFrame:
    return df.where(community_or_keyword(community_col, text_col, community, keyword))


def in_list(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_eq(df: DataFrame, col: str, value, negate: bool = False) -> DataFrame:
    test = F.col(col) == F.lit(value)
    return df.where(~test if negate else test)


def where_any(df: DataFrame, condition: str | Column) -> DataFrame:
    """Filter by a Column or by SQL text."""
    return df.where(condition)


def quality_filter(
    df: DataFrame, author: str | None = None, adult: str | None = None, distinguished: str | None = None
) -> DataFrame:
    """Known author, not adult, not a moderator; each test applies when its column is named.

    An unknown adult flag drops the row, as a test for false does.
    """
    if author:
        df = df.where(F.col(author).isNotNull())
    if adult:
        df = df.where(~F.col(adult))
    if distinguished:
        df = df.where(F.col(distinguished).isNull())
    return df


SENTINELS = {"author": [DELETED, BOT_AUTHOR], "body": [REMOVED]}


def drop_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[str]] = SENTINELS) -> DataFrame:
    """Drop rows holding a placeholder in a column; nulls in that column go too."""
    for col, values in sentinels.items():
        df = df.where(~F.col(col).isin(list(values)))
    return df


def exact_vocab_match(df: DataFrame, col: str, vocab: Sequence[str] | DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows whose whole text is a vocabulary term.

    A table of terms is broadcast when a bounded count shows that it is small;
    of a larger one a Bloom filter decides which rows move to the join at all.
    """
    if isinstance(vocab, DataFrame):
        terms = vocab.select(F.col(vocab.columns[0]).alias(col)).distinct()
        if is_small(terms, broadcast_rows):
            return df.join(F.broadcast(terms), col, "left_semi")
        return df.where(bloom_filter(terms, col).might_hold(col)).join(terms, col, "left_semi")
    return df.where(F.col(col).isin(list(vocab)))


def restrict_words(counts: DataFrame, vocab: Sequence[str] | DataFrame, word: str = "word") -> DataFrame:
    return exact_vocab_match(counts, word, vocab)


def drop_outlier_groups(
    groups: DataFrame, metric: str, method: str = "zscore", cut: float = 3.0, accuracy: int = 10_000
) -> DataFrame:
    """Drop groups whose metric is extreme, instead of naming one value by hand.

    `zscore` keeps rows at most `cut` sample deviations from the mean;
    `percentile` keeps rows up to the `cut` quantile (0..1). The limits are
    one-row scalar subqueries, so no group is moved.
    """
    if method == "zscore":
        mean = groups.agg(F.avg(metric)).scalar()
        std = groups.agg(F.stddev_samp(metric)).scalar()
        # One group has no deviation, and nothing to be extreme against.
        return groups.where((F.abs(F.col(metric) - mean) <= F.lit(cut) * std) | (std.isNull() & F.col(metric).isNotNull()))
    if method == "percentile":
        limit = groups.agg(F.percentile_approx(metric, cut, accuracy)).scalar()
        return groups.where(F.col(metric) <= limit)
    raise ValueError(f"unknown method {method!r}")


def set_flags(df: DataFrame, col: str = "value") -> DataFrame:
    """Rows of a long flag table that are set (1 or true)."""
    return df.where(F.col(col).cast("int") == 1)


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(as_col(col).isNotNull())

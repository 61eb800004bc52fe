"""Stems of token columns, rule by rule."""

from pyspark.sql import functions as F

from hearsay.functions import columns as C
from hearsay.operators import tokens as T


def test_stems_by_ending_are_those_of_all_rules(spark):
    words = ["classes", "ties", "tied", "cats", "agreedly", "lovingly", "hopping", "creating", "sized", "enabled", "kindly", "rarely", "kindness", "hopeful",
             "happy", "make", "", "s", "12", "caf\u00e9s", "cats\u2028", "hoping\u0085", "caresses\n", "Cats", None]
    df = spark.createDataFrame([(words,), ([w for w in words if w and w.isascii() and w.isalnum()],), (None,), ([],)], "words array<string>")
    got = T.stem(df.repartition(2), "words").select("stems", F.transform("words", C.stem_word).alias("want")).collect()
    assert all(r.stems == r.want for r in got) and any(r.stems and "cat" in r.stems for r in got)


def test_stems_ask_only_rules_of_their_ending(spark):
    """A word without any of the endings reaches no pattern."""
    plan = spark.range(1).select(C.stem_tokens(F.array(F.lit("a"))).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("endswith") >= sum(map(len, C.STEM_ENDINGS))

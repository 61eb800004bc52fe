"""Counts per document without a shuffle."""

from collections import Counter

import pytest

from hearsay.operators import tokens as T


@pytest.mark.parametrize("twice", [False, True])
def test_counts_per_document(spark, twice):
    """Ids of several rows are one document, and so are rows without an id; null tokens and lists don't count."""
    rows = [(1, "x", ["a", "b", "a", None]), (2, "x", []), (3, "y", None), (4, "y", ["b"])]
    rows += [(1, "x", ["a", "c"]), (4, "z", ["b"]), (None, "x", ["d"]), (None, "x", ["d", "a"])] if twice else []
    df = spark.createDataFrame(rows, "id int, k string, words array<string>").repartition(3)
    counted = T.tf(df, "id", "words", ["k"])
    want = Counter((i, k, w) for i, k, words in rows for w in words or [] if w is not None)
    got = [(r.id, r.k, r.word, r.tf) for r in counted.collect()]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    assert counted.columns == ["id", "k", "word", "tf"] and dict(counted.dtypes)["tf"] == "bigint"
    assert twice or "Exchange" not in counted.where("word <> ''")._jdf.queryExecution().executedPlan().toString().replace("RoundRobin", "").split("MapInArrow")[0]

"""Coded texts: counts by group, and rounds that leave them where they are."""

import re

from pyspark.sql import functions as F

from hearsay.operators import coded as K


def rows(spark):
    texts = [(i, [f"w{i % 7}", "the", "the", None, ""]) for i in range(40)] + [(3, ["w3", "more"]), (None, ["lost"]), (90, []), (91, None)]
    return spark.createDataFrame(texts, "id int, words array<string>").withColumn("one", F.lit(1.0))


def test_counts_by_group(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_TOKENS", 30)
    coded = K.code_words(rows(spark), "id", "words", ["one"])
    assert coded.groups > 4
    words = {(r["_p"], r["_i"]): r for r in coded.words.collect()}
    got = {r.id: ({words[r["_p"], w].word: tf for w, tf in zip(r["_w"], r["_tf"])}, r.one) for r in coded.rows.collect()}
    assert got[3] == ({"w3": 2, "the": 2, "": 1, "more": 1}, 2.0) and got[8] == ({"w1": 1, "the": 2, "": 1}, 1.0)
    assert set(got) == {*range(40), 90, 91} and got[90] == got[91] == ({}, 1.0)
    assert sum(r.n for r in words.values() if r.word == "the") == 40 and not any(r.word == "lost" for r in words.values())


def test_chunks_hold_all_cells(spark, monkeypatch):
    monkeypatch.setattr(K, "_CHUNK", 5)
    table = K.code_words(rows(spark), "id", "words").rows.select("_i", "_w", "_tf").toArrow()
    parts = list(K.chunks(table))
    assert len(parts) > 5 and sum(len(p[0]) for p in parts) == 42
    whole = {r["_i"]: (r["_w"], r["_tf"]) for r in table.to_pylist()}
    for part, own, word, tf in parts:
        for at, i in enumerate(part.column("_i").to_pylist()):
            assert (word[own == at].tolist(), tf[own == at].tolist()) == whole[i]


def test_kept_rows_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_TOKENS", 30)
    coded = K.code_words(rows(spark), "id", "words")
    cells = K.kept(coded, "_i")
    plan = K.per_group(cells, coded.words.select("_p", "_i"), lambda a, b: a, cells.schema)._jdf.queryExecution().executedPlan().toString()
    cells.unpersist()
    assert len(re.findall(r"Exchange hashpartitioning\(_to", plan)) == 1
    assert "ENSURE_REQUIREMENTS" not in plan.split("InMemoryTableScan")[0]


def test_lemmas_of_repeated_ids_and_long_rows(spark, monkeypatch):
    from hearsay.operators.tokens import lemmatize

    monkeypatch.setattr(K, "GROUP_TOKENS", 30)
    texts = [(1, ["a", None, "b"]), (1, ["b", "c", "a"]), (2, ["b"] * 200), (3, None), (4, []), (None, ["a", None])]
    df = spark.createDataFrame(texts, "id int, words array<string>")
    lemmas = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z"), ("c", "c"), (None, "n")], "form string, lemma string")
    got = sorted(((r.id, r.lemmas) for r in lemmatize(df, "words", lemmas, "id").collect()), key=str)
    assert got == sorted([(1, ["x", "y"]), (1, ["y", "c", "x"]), (2, ["y"] * 200), (3, []), (4, []), (None, ["a"])], key=str)


def test_lemmas_of_tokens_that_are_never_null(spark):
    """The planner knows that split texts hold no null token; the rows come back from the groups all the same."""
    from hearsay.operators.tokens import lemmatize

    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, t string").select("id", F.array_remove(F.split("t", " "), "").alias("words"))
    got = {r.id: r.lemmas for r in lemmatize(texts, "words", spark.createDataFrame([("a", "x")], "form string, lemma string"), "id").collect()}
    assert got == {1: ["x", "b"], 2: [], 3: []}

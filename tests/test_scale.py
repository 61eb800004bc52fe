"""Skewed data against brute force, and the shape of the plans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from hearsay.functions import columns as C
from hearsay.operators import joins as J, mentions as M, rows as R, sentiment as S, tokens as T
from hearsay.operators.bloom import bloom_filter
from hearsay.operators.skew import broadcast_if_small, join_hot_split
from hearsay.operators.windows import top_k_per_group, with_row_id
from hearsay.sources.bucketed import cohort_slice, write_bucketed

SF = "/root/testdata/sf0.001"
N = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 400)
    return spark.range(N).select("id", key.alias("k"), (F.col("id") % 7).alias("v"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1e-5, 0.01, 0.05, 1.0])
def test_hot_split_equals_plain_join(skewed, how, share):
    dim = skewed.where("k < 300").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    out = join_hot_split(skewed, dim, ["k"], "n", share, how)
    expected = skewed.join(dim, "k", how).select(out.columns)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, expected.collect()))


def test_rank_with_a_value_shared_by_a_third(skewed):
    out = top_k_per_group(skewed.withColumn("g", F.col("id") % 2), ["g"], "k", 5).collect()
    by_group = {}
    for r in skewed.withColumn("g", F.col("id") % 2).collect():
        by_group.setdefault(r.g, []).append((r.k, r.id))
    expected = set()
    for g, rows in by_group.items():
        for k, i in rows:
            rank = 1 + sum(1 for other, _ in rows if other > k)
            if rank <= 5:
                expected.add((g, i, rank))
    assert {(r.g, r.id, r["rank"]) for r in out} == expected


@pytest.mark.parametrize("groups", [[], ["k"]])
def test_row_ids_are_dense_and_ordered(skewed, groups):
    out = with_row_id(skewed, ["v", "id"], groups).collect()
    expected = {}
    for r in sorted(skewed.collect(), key=lambda r: (r.v, r.id)):
        expected.setdefault(r.k if groups else None, []).append(r.id)
    null_key = skewed.select("id", F.when(F.col("k") != 0, F.col("k")).alias("k"), "v")
    assert with_row_id(null_key, ["v", "id"], groups).count() == N
    for r in out:
        assert expected[r.k if groups else None][r.row_id - 1] == r.id
    assert len(out) == N


def test_cohort_with_a_hot_author(skewed):
    cohort = skewed.where("k in (0, 7)").select("k").distinct()
    out = J.cohort_activity(skewed, cohort, "k")
    assert out.count() == skewed.where("k in (0, 7)").count()


@pytest.mark.parametrize("broadcast_rows", [None, 1, 10])
def test_cohort_with_busy_authors_in_and_out(spark, broadcast_rows):
    """The log holds null authors; authors 0 and 2 are busy, and 2 isn't in the cohort."""
    author = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 2).when(F.col("id") % 50 != 0, F.col("id") % 400)
    log = spark.range(N).select("id", author.alias("k"), F.create_map(F.lit("a"), "id").alias("m"))
    cohort = spark.createDataFrame([(0,), (5,), (7,), (9999,)], "k long")
    got = Counter(r.id for r in J.cohort_activity(log, cohort, "k", broadcast_rows).collect())
    assert got == Counter(r.id for r in log.select("id", "k").collect() if r.k in (0, 5, 7))


def test_equal_rows_of_a_hot_key_stay_spread(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = J.attach_by_text(rows, "text", lambda d: d.withColumn("n", F.length("text")), ["n"])
    sizes = [r["count"] for r in out.where("text = 'same'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 18_000 and max(sizes) <= 2 * 18_000 / 8


def test_large_cohort_reads_only_the_columns_in_use(spark):
    log = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", "ts", "value", "props")
    cohort = log.where("event_type = 'purchase'").select("user_id").distinct()
    text = plan(J.cohort_activity(log, cohort, "user_id", None).select("event_id", "user_id"))
    assert "Scan parquet" in text
    for schema in text.split("ReadSchema: ")[1:]:
        assert not {"props", "ts", "value"} & {f.split(":")[0] for f in schema.split(">")[0].removeprefix("struct<").split(",")}


def test_broadcast_only_below_the_checked_size(spark):
    small = spark.range(10)
    assert "broadcast" in broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(small, 9)._jdf.queryExecution().logical().toString().lower()


def test_tf_idf_with_a_word_in_every_text(spark):
    import math

    texts = {i: ["the"] * 3 + [f"w{i % 5}", f"u{i}"] for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "id int, words array<string>")
    df_count = Counter(w for words in texts.values() for w in set(words))
    out = {(r.id, r.word): r.tf_idf for r in T.tf_idf(df, "id", "words").collect()}
    expected = {(i, w): c * math.log(61 / (df_count[w] + 1)) for i, words in texts.items() for w, c in Counter(words).items()}
    assert out.keys() == expected.keys()
    assert all(out[k] == pytest.approx(expected[k]) for k in out)


def test_filters_reach_the_scan(spark):
    text = plan(queries()["f2_in_list"](spark, SF))
    assert "PushedFilters: [In(event_type" in text or "PushedFilters: [Or(" in text or "In(event_type" in text.split("PushedFilters")[1][:80]
    assert "props" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["b3_daily_activity", "b5_top_words", "b8_share_of_voice", "b14_brand_product_sentiment", "b15_place_mentions",
                                  "b16_persona_by_brand", "n1_score_sentiment", "n4_score_distinct", "t6_clean_text", "t10_tf_idf", "j9_cohort_semi_join"])
def test_no_python_and_no_cross_join_in_sql_work(spark, name):
    text = plan(queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_daily_activity_has_one_shuffle(spark):
    text = plan(queries()["b3_daily_activity"](spark, SF))
    assert text.count("Exchange ") == 1
    assert "Join" not in text


def test_cohort_is_a_semi_join(spark):
    assert "LeftSemi" in plan(queries()["j9_cohort_semi_join"](spark, SF))


def test_small_cohort_leaves_the_log_in_place(spark, skewed):
    cohort = skewed.select("k").where("k = 7").distinct()
    text = plan(J.cohort_activity(skewed, cohort, "k", broadcast_rows=10))
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


@pytest.fixture
def shuffled(spark):
    """Spark's own broadcasts off, so that a plan shows what the operator does."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_split_reads_the_fact_side_once_and_spreads_identical_rows(shuffled, tmp_path):
    spark = shuffled
    path = str(tmp_path / "facts")
    key = F.when(F.col("id") % 10 > 0, F.lit(-1)).when(F.col("id") % 100 > 0, F.col("id"))
    spark.range(0, 40_000, 1, 8).select(key.alias("k"), F.lit("same").alias("v")).write.parquet(path)
    facts = spark.read.parquet(path)
    dim = facts.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for how in ("inner", "left"):
            out = join_hot_split(facts, dim, ["k"], "n", 1e-3, how)
            assert plan(out).count("FileScan parquet") == 1
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == (39_600 if how == "inner" else 40_000) and max(sizes) < 1.5 * sum(sizes) / 8
            assert out.where("k = -1 AND top = 'same' AND n = 36000").count() == 36_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_split_beyond_the_broadcast_equals_plain_join(shuffled, skewed, how):
    rows = skewed.withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    dim = skewed.where("k < 300").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    out = join_hot_split(rows, dim, ["k"], "n", 0.01, how)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, rows.join(dim, "k", how).select(out.columns).collect()))


@pytest.mark.parametrize("values", [0, 1, 5000])
def test_bloom_filter_holds_its_keys_and_few_others(spark, values):
    keys = spark.range(values).select(F.concat(F.lit("w"), "id").alias("w")).unionAll(spark.createDataFrame([(None,)], "w string"))
    held = bloom_filter(keys, "w")
    asked = spark.range(20_000).select("id", F.concat(F.lit("w"), "id").alias("w")).withColumn("hit", held.might_hold("w"))
    assert asked.where(f"id < {values} AND NOT hit").count() == 0
    assert asked.where(f"id >= {values} AND hit").count() < 0.03 * 20_000
    assert spark.createDataFrame([(None,)], "w string").where(held.might_hold("w")).count() == 0


def test_bloom_filter_beyond_its_size_lets_more_through_but_misses_nothing(spark):
    keys = spark.range(3000)
    held = bloom_filter(keys, "id", most_bits=256)
    assert held.bits == 256 and keys.where(held.might_hold("id")).count() == 3000


def test_term_table_moves_little_more_than_its_hits(shuffled):
    """With broadcasts off, n-grams are asked before the first exchange."""
    spark = shuffled
    texts = spark.range(400).select("id", F.concat_ws(" ", F.expr("transform(sequence(1, 60), x -> concat('w', id * 60 + x))"), F.lit("lip gloss")).alias("t"))
    terms = spark.createDataFrame([("lip gloss", "gloss"), ("w77", "seventy-seven"), ("w99999999", "never")], "spelling string, name string")
    out = M.explode_term_table(texts, "id", "t", terms, 2, broadcast_rows=0)
    assert Counter((r.id, r.term) for r in out.collect()) == Counter([*((i, "gloss") for i in range(400)), (1, "seventy-seven")])
    grams = C.explode_rows(texts, F.array_distinct(C.ngrams_of_lengths(C.clean_tokens("t", "space"), [1, 2])), "g", "id")
    assert grams.count() > 40_000 and grams.where(bloom_filter(terms, "spelling").might_hold("g")).count() < 2000
    assert "getbit" in plan(out)


def test_long_vocabularies_lexicons_and_lemma_tables_equal_the_short_ones(shuffled):
    spark = shuffled
    df = spark.createDataFrame([(1, "good bad fine", ["running", None, "mice"]), (2, None, None), (3, "bad", []), (None, "fine", ["mice"]), (4, "good", ["cat"])], "id int, t string, w array<string>")
    vocab = spark.createDataFrame([("bad",), ("good",), (None,)], "v string")
    assert sorted(r.id for r in R.exact_vocab_match(df, "t", vocab, broadcast_rows=0).collect()) == [3, 4]
    lemmas = spark.createDataFrame([("mice", "mouse"), ("running", "run"), ("cat", "cat"), ("dog", None)], "form string, lemma string")
    got = {(r.id, tuple(r.lemmas)) for r in T.lemmatize(df, "w", lemmas, "id").collect()}
    assert got == {(1, ("run", "mouse")), (2, ()), (3, ()), (None, ("mice",)), (4, ("cat",))}
    lexicon = {"good": 2.0, "bad": -1.0, "worse": -3.0}
    table = spark.createDataFrame(list(lexicon.items()), "word string, weight double")
    short, long = (sorted(map(str, S.score_sentiment(df.drop("w"), "t", x).where("t IS NOT NULL").collect())) for x in (lexicon, table))
    assert short == long


def test_rank_by_shuffle_keeps_nulls_and_ties(shuffled, skewed):
    df = skewed.select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("g"), F.when(F.col("id") % 4 > 0, F.col("k").cast("double")).alias("x"))
    want = Counter(map(tuple, top_k_per_group(df, ["g"], "x", 3, groups=df).collect()))
    assert Counter(map(tuple, top_k_per_group(df, ["g"], "x", 3).collect())) == want


def test_cohort_of_a_bucketed_log_moves_no_log(shuffled, skewed):
    """A third of the rows are one author's; the buckets are balanced and the slice has no exchange above the log's scan."""
    spark = shuffled
    log = skewed.withColumn("author", F.when(F.col("id") % 11 > 0, F.col("k"))).select("id", "author", "v")
    kept = write_bucketed(log, "author", 4, share=0.01)
    cohort = spark.createDataFrame([(0,), (7,), (None,), (9999,)], "author long")
    out = cohort_slice(spark, kept, cohort)
    assert out.columns == log.columns
    assert Counter(map(tuple, out.collect())) == Counter(tuple(r) for r in log.collect() if r.author in (0, 7))
    text = out._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index(kept.table)] if kept.table in text else text[:text.index("FileScan parquet")]
    assert "Exchange" not in above and "Bucketed: true" in text
    sizes = [r["count"] for r in spark.table(kept.table).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * N / 4


@pytest.mark.parametrize("places", [[], ["st. louis", "saint", "s", "St louis"]])
def test_places_of_equal_forms_and_nested_beginnings(spark, places):
    df = spark.createDataFrame([("St. Louis, MO",), ("saintly",), ("",), (None,)], "t string")
    got = [sorted(r.h) if r.h is not None else None for r in df.select(M.place_hits("t", places).alias("h")).collect()]
    want = [["s", "st. louis"], ["s", "saint"], [], []] if places else [[], [], [], []]
    assert got == want

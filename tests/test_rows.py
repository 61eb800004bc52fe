"""Edge-case rows on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearsay import vocab
from hearsay.functions import columns as C
from hearsay.operators import aggregates as A, joins as J, mentions as M, quality as Q, reshape as R, rows, sentiment as N, tokens as T
from hearsay.operators.windows import share_within, top_k_per_group
from hearsay.plans import activity as PA, brands as PB
from hearsay.sources import activity, series, sinks

LOG = "id string, author string, community string, ts timestamp, score double, body string, kind string"


def at(day, hour=1):
    return dt.datetime(2021, 1, day, hour)


@pytest.fixture(scope="module")
def feeds(spark):
    comments = [
        ("c1", "ann", "x", at(1), 1.0, "Acme is great", "comment"),
        ("c2", "bob", "x", at(1), 2.0, "acme and zenco", "comment"),
        ("c3", None, "x", at(2), 3.0, "nothing", "comment"),
        ("c4", "[deleted]", "y", at(2), 4.0, "[removed]", "comment"),
        ("c5", "ann", "y", at(3), 5.0, None, "comment"),
        ("c6", "AutoModerator", "x", at(3), 6.0, "acmes zenco", "comment"),
    ]
    posts = [
        ("p1", "cat", "x", at(1), 1.0, "Zenco sale", "post"),
        ("p2", "ann", "z", at(4), 1.0, "hello", "post"),
        ("p3", "dan", "x", at(5), 1.0, "hello", "post"),
    ]
    return spark.createDataFrame(comments, LOG), spark.createDataFrame(posts, LOG)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("v")).first()["v"]


def test_strip_punct_modes(spark):
    text = "it's a balm,dot!com no.1"
    assert one(spark, text, C.strip_punct("t")) == "its a balmdot com no1"
    assert one(spark, text, C.strip_punct("t", "space")) == "it s a balm dot com no 1"
    assert len(vocab.PUNCTUATION) == 31


def test_word_lists_have_expected_sizes():
    assert len(vocab.STOPWORDS) == 181
    assert len(vocab.PRODUCT_CATEGORIES) == 29
    assert len(vocab.PRODUCT_SPELLINGS) == 54
    assert len(vocab.RENAME_RULES) == 60


def test_rename_takes_the_leftmost_then_the_longest(spark):
    rules = [("a b", "X"), ("b c d", "Y"), ("b c", "Z"), ("X", "no"), ("c++", "cpp")]
    for text, want in [("a b c d", "X c d"), ("q b c d b c", "q Y Z"), ("b cd b", "b cd b"), ("a b", "X"), ("a c++", "a cpp"), ("", ""), (None, None)]:
        assert one(spark, text, C.normalize_terms("t", rules)) == want
    assert one(spark, "as is", C.normalize_terms("t", [])) == "as is"


def test_rename_chain_and_single_pass(spark):
    rules = vocab.RENAME_RULES
    assert one(spark, "flick", C.normalize_terms("t", rules, compat=True)) == "brow eyeliner"
    assert one(spark, "flick", C.normalize_terms("t", rules)) == "brow pencil"
    assert one(spark, "after balm", C.normalize_terms("t", rules, compat=True)) == "after tinted chapstick"
    assert one(spark, "after balm", C.normalize_terms("t", rules)) == "sunscreen"
    assert one(spark, "priming moisturizer", C.normalize_terms("t", rules, compat=True)) == "skincarer"
    assert one(spark, "no.1 pencil", C.normalize_terms("t", rules)) == "eyeliner"
    assert one(spark, "le style", C.normalize_terms("t", vocab.WHOLE_WORD_RULES)) == "limited edition products style"


@pytest.mark.parametrize("text,match,expected", [
    ("Acme!", "word", True), ("acmes", "word", False), ("éacme", "word", False), ("aCME", "word", True),
    ("acmes", "two_case", True), ("ACME", "two_case", False), ("xACMEx", "substring", True),
])
def test_mentions(spark, text, match, expected):
    assert one(spark, text, C.mentions("t", "acme", match)) is expected


def test_tokens_drop_or_keep_empties(spark):
    assert one(spark, "a  B", C.word_tokens("t")) == ["a", "b"]
    assert one(spark, "a  B", C.word_tokens("t", keep_empty=True)) == ["a", "", "b"]


def test_simple_tokens_fold_accents_and_bound_length(spark):
    assert one(spark, "Élan d été _x abcdefghijklmnopq café2go", C.simple_tokens("t")) == ["elan", "ete", "cafe", "go"]


@pytest.mark.parametrize("word", ["likes", "liked", "liking", "likely", "like"])
def test_stem_unites_forms(spark, word):
    assert one(spark, word, C.stem_word(F.col("t"))) == "lik"


def test_ngrams(spark):
    assert one(spark, "a b c", C.ngrams(C.word_tokens("t"), 2)) == ["a b", "b c"]
    assert one(spark, "a b c", C.ngrams(C.word_tokens("t"), 3)) == ["a b c"]
    assert one(spark, "a", C.ngrams(C.word_tokens("t"), 3)) == []
    assert one(spark, "a b", C.ngrams_of_lengths(C.word_tokens("t"), [1, 2])) == ["a", "b", "a b"]


def test_term_hits_normalise_spellings_like_the_text(spark):
    terms = {"pencil": ["no.1 pencil", "no. 1 pencil"], "paint": ["cloud paint", "cloudpaint"], "tin": ["tin"]}
    hits = one(spark, "My NO. 1 pencil, Cloud Paint and cloudpaint; nothing else", M.term_hits("t", terms))
    assert sorted(hits) == ["paint", "pencil"]
    assert "tin" not in hits
    assert sorted(one(spark, "nothing distinct", M.term_hits("t", ["thin", "tin"], "substring"))) == ["thin", "tin"]


def test_place_prefix_and_word(spark):
    places = ["st. louis", "paris", "kent"]
    assert one(spark, "St. Louis, MO", M.place_hits("t", places)) == ["st. louis"]
    assert one(spark, "near paris", M.place_hits("t", places)) == []
    assert one(spark, "near Paris!", M.place_hits("t", places, "word")) == ["paris"]


def test_quality_filter_drops_unknown_adult_flag(spark):
    df = spark.createDataFrame([("a", False, None), ("b", None, None), ("c", True, None), (None, False, None), ("d", False, "moderator")],
                               "author string, over_18 boolean, distinguished string")
    kept = rows.quality_filter(df, "author", "over_18", "distinguished")
    assert [r.author for r in kept.collect()] == ["a"]


def test_sentinels_drop_nulls_too(feeds):
    kept = rows.drop_sentinels(feeds[0])
    assert sorted(r.id for r in kept.collect()) == ["c1", "c2"]


def test_drop_cols_ignores_unknown(feeds):
    assert rows.drop_cols(feeds[0], ["body", "nope"]).columns == ["id", "author", "community", "ts", "score", "kind"]


def test_daily_activity_missing_option(feeds):
    comments, posts = feeds
    null = {str(r.day): r.total_activity for r in PA.daily_activity(comments, posts, "x").collect()}
    assert null == {"2021-01-01": 3, "2021-01-02": None, "2021-01-03": None, "2021-01-05": None}
    zero = {str(r.day): r.total_activity for r in PA.daily_activity(comments, posts, "x", "zero").collect()}
    assert zero == {"2021-01-01": 3, "2021-01-02": 1, "2021-01-03": 1, "2021-01-05": 1}


def test_monthly_activity_label(feeds):
    out = PA.monthly_activity(PA.daily_counts(*feeds, "x")).collect()
    assert [tuple(r) for r in out] == [("2021-1", 4, 2)]


def test_community_interest(feeds):
    out = [tuple(r) for r in PA.community_interest(*feeds, k=2).collect()]
    assert out == [("x", 4, 2, 6), ("y", 2, 0, 2)]


def test_cohort_by_hot_split_and_broadcast_join(feeds):
    comments, posts = feeds
    cohort = J.cohort_of(comments, posts, "x", exclude=[vocab.BOT_AUTHOR])
    assert sorted(r.author for r in cohort.collect()) == ["ann", "bob", "cat", "dan"]
    for limit in (None, 100, 1):
        kept = J.cohort_activity(comments, cohort, broadcast_rows=limit)
        assert sorted(r.id for r in kept.collect()) == ["c1", "c2", "c5"]
        assert kept.columns == comments.columns


def test_author_activity(feeds):
    out = {r.author: (r.n_actions, r.n_communities) for r in PA.author_activity(feeds[0].unionByName(feeds[1])).collect()}
    assert out["ann"] == (3, 3)
    assert None not in out


def test_activity_vs_external(spark, feeds):
    ext = spark.createDataFrame([(dt.date(2021, 1, 1), 10), (dt.date(2021, 1, 9), 11)], "day date, cases long")
    out = PA.activity_vs_external(*feeds, "x", ext).collect()
    assert [(str(r.day), r.activity_count, r.cases) for r in out] == [("2021-01-01", 3, 10)]


def test_share_of_voice_counts_and_percents(spark, feeds):
    posts = feeds[1].withColumnRenamed("body", "title")
    out = {r.brand: (r.total_count, r.pct) for r in PB.share_of_voice(feeds[0], posts, ["acme", "zenco"]).collect()}
    assert out == {"acme": (2, 40.0), "zenco": (3, 60.0)}


def test_share_of_total_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", 8538), ("b", 6352), ("c", 6957), ("d", 3374)], "brand string, n long")
    assert [r.pct for r in A.share_of_total(df, "n").orderBy("brand").collect()] == [34.0, 25.0, 28.0, 13.0]
    halves = spark.createDataFrame([(1,), (1,), (198,)], "n long")
    assert sorted(r.pct for r in A.share_of_total(halves, "n").collect()) == [0.0, 0.0, 99.0]


def test_co_mentions_sum_to_rows(feeds):
    out = PB.co_mentions(feeds[0].where("body is not null"), "body", ["acme", "zenco"]).collect()
    assert sum(r["count"] for r in out) == 5
    assert {(r.acme, r.zenco): r["count"] for r in out}[(True, True)] == 1


def test_explode_brands_one_row_per_brand(feeds):
    out = M.explode_brands(feeds[0], "body", ["acme", "zenco"]).select("id", "brand").collect()
    assert sorted(map(tuple, out)) == [("c1", "acme"), ("c2", "acme"), ("c2", "zenco"), ("c6", "zenco")]


def test_attribute_brand_first_match_wins(feeds):
    rules = M.community_or_mention_rules({"acme": "y", "zenco": "x"}, "community", "body")
    out = {r.id: r.brand for r in PB.with_brand(feeds[0], rules).collect()}
    assert out["c1"] == "acme" and out["c2"] == "acme" and out["c3"] == "zenco" and out["c4"] == "acme"


LEX = {"great": 1.0, "love": 2.0, "bad": -1.0, "awful": -2.0}


@pytest.mark.parametrize("text,label", [("great LOVE!", "positive"), ("bad, awful", "negative"), ("great bad", "neutral"), ("", "neutral")])
def test_sentiment_label(spark, text, label):
    df = spark.createDataFrame([(text,)], "t string")
    assert N.score_sentiment(df, "t", LEX).first().sentiment == label


def test_sentiment_scores_sum_to_one(spark):
    df = spark.createDataFrame([("great great bad",)], "t string")
    scores = N.sentiment_scores(N.score_sentiment(df, "t", LEX)).first().sentiment_scores
    assert scores == {"positive": 0.5, "neutral": 0.25, "negative": 0.25}


def test_scoring_copies_keeps_the_row_count(spark):
    texts = ["great"] * 40 + ["bad", "fine", None, None] + [f"t{i} love" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lexicon = spark.createDataFrame(list(LEX.items()), "word string, weight double")
    inline = {r.id: r.sentiment for r in N.score_sentiment(df, "t", LEX).collect()}
    for scored in (N.score_distinct(df, "t", LEX), N.score_sentiment(df, "t", lexicon)):
        out = {r.id: r.sentiment for r in scored.collect()}
        assert len(out) == scored.count() == len(texts)
        assert out == {**inline, 42: None, 43: None}


def test_sentiment_code(spark):
    df = spark.createDataFrame([("negative",), ("neutral",), ("positive",), ("other",)], "s string")
    assert [r.c for r in df.select(N.sentiment_code("s").alias("c")).collect()] == [0, 1, 2, None]


def test_product_mentions_with_rest_row(spark):
    texts = ["BDC."] * 4 + ["cloud paint", "Blush."] * 2 + ["pisces"] * 2 + ["candle", "scarf", "not a product"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = PB.product_mentions(df, "t", vocab.PRODUCT_VOCABULARY, vocab.RENAME_RULES, 2).collect()
    assert {r["product"]: r["count"] for r in out} == {"tinted chapstick": 4, "blush": 4, "other": 4}


def test_product_words_sum_occurrences(spark):
    df = spark.createDataFrame([("zit", 3), ("retinol", 4), ("other", 9)], "word string, count long")
    out = PB.product_words(df, ["zit", "retinol"], vocab.RENAME_RULES).collect()
    assert [tuple(r) for r in out] == [("skincare", 7)]


def test_brand_product_ratios_sum_to_one_per_product(spark):
    data = [("a", "lipstick and gloss", "positive"), ("a", "gloss", "negative"), ("b", "gloss", "positive"), ("b", "hair gloss", "neutral")]
    df = spark.createDataFrame(data, "brand string, t string, sentiment string")
    out = PB.brand_product_sentiment(df, "t", ["a", "b"], vocab.PRODUCT_CATEGORIES[:25]).collect()
    sums = {}
    for r in out:
        sums[r.brand, r.variable] = sums.get((r.brand, r.variable), 0) + r.ratio
    assert sums and all(abs(v - 1) < 1e-12 for v in sums.values())
    assert {(r.brand, r.variable, r.sentiment): r.total_count for r in out}["b", "gloss", "neutral"] == 2


def test_persona_weighs_authors_equally(spark):
    data = [("ann", "acme great", 1.0), ("ann", "acme bad", 3.0), ("bob", "Acme great", 10.0), ("[deleted]", "acme", 99.0), (None, "acme", 99.0)]
    df = spark.createDataFrame(data, "author string, body string, score double")
    out = {(r.brand, r.metric): r.score for r in PB.persona_by_brand(df, ["acme", "zenco"], LEX).collect()}
    assert out == {("acme", "average_score"): 6.0, ("acme", "average_sentiment"): 1.5, ("acme", "number_of_comments"): 1.5}


def test_align_own_series_keeps_own_value(spark):
    df = spark.createDataFrame([("2021-01-01", "a", "0.5", "7", "8"), ("2021-01-01", "b", "0.1", "7", None)],
                               "Date string, brand string, average_sentiment string, a string, b string")
    assert [tuple(r) for r in PB.align_own_series(df, ["a", "b"]).collect()] == [("2021-01-01", "a", 0.5, 7.0)]


def test_place_mentions_left_lookup(spark):
    df = spark.createDataFrame([("Paris, France",), ("paris!",), ("Kent",), ("she/her",)], "body string")
    cities = spark.createDataFrame([("paris", 48.9, 2.3)], "city string, lat double, lng double")
    out = {r.city: (r["count"], r.percent, r.lat) for r in PB.place_mentions(df, "body", ["paris", "kent"], cities).collect()}
    assert out == {"paris": (2, 66.67, 48.9), "kent": (1, 33.33, None)}


def test_lemmatize_table_keeps_order_and_empty_rows(spark):
    df = spark.createDataFrame([(1, ["cats", "are", "cats", "the"]), (2, []), (3, None)], "id int, w array<string>")
    lemmas = spark.createDataFrame([("cats", "cat"), ("are", "be")], "form string, lemma string")
    out = {r.id: r.lemmas for r in T.lemmatize(df, "w", lemmas, "id").collect()}
    assert out == {1: ["cat", "be", "cat", "the"], 2: [], 3: []}


def test_clean_text(spark):
    df = spark.createDataFrame([("The CATS, they're running 2 fast!",)], "t string")
    row = T.clean_text(df, "t", {"cats": "cat"}).first()
    assert row.tokens == ["cat", "theyre", "running", "fast"]
    assert row.body_clean == "cat theyre running fast"


def test_unpivot_and_pivot_are_inverse(spark):
    df = spark.createDataFrame([("d1", 1, 2), ("d2", 3, 4)], "day string, a long, b long")
    back = R.pivot_counts(R.melt(df, ["day"], ["a", "b"]), ["day"], "variable", "value", ["a", "b"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_rank_ties_are_kept_at_k(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([9, 8, 8, 8, 7])], "g string, i int, v int")
    out = top_k_per_group(df, ["g"], "v", 2).collect()
    assert sorted((r.i, r["rank"]) for r in out) == [(0, 1), (1, 2), (2, 2), (3, 2)]


def test_share_within_zero_and_wide(spark):
    df = spark.createDataFrame([("a", "p", 0), ("b", "p", 1), ("b", "n", 3)], "g string, s string, n long")
    for wide in (False, True):
        out = {(r.g, r.s): r.ratio for r in share_within(df, ["g"], ["s"], "n", wide_groups=wide).collect()}
        assert out == {("a", "p"): None, ("b", "p"): 0.25, ("b", "n"): 0.75}


def test_null_and_nan_audit(spark):
    df = spark.createDataFrame([("a", 1.0), (None, float("nan")), ("c", None)], "s string, d double")
    assert tuple(Q.null_counts(df).first()) == (1, 1)
    assert tuple(Q.null_nan_counts(df).first()) == (1, 2)


def test_merge_counts_zero_fill(spark):
    a = spark.createDataFrame([("x", 1)], "k string, c long")
    b = spark.createDataFrame([("y", 2)], "k string, p long")
    assert sorted(map(tuple, J.merge_counts_zero_fill(a, b, "k").collect())) == [("x", 1, 0, 1), ("y", 0, 2, 2)]


def test_normalize_activity_for_posts(spark):
    df = spark.createDataFrame([("p", "ann", "x", "Title", None, 3, 0)],
                               "id string, author string, subreddit string, title string, selftext string, score long, created_utc long")
    row = activity.normalize_activity(df, "post").first()
    assert (row.body, row.community, row.kind, row.ts) == ("Title", "x", "post", dt.datetime(1970, 1, 1))


def test_csv_round_trip_types(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), 88, None)], "Date date, a int, b int")
    sinks.save_report(df, str(tmp_path / "r"), single_file=True)
    back = series.read_daily_series(spark, str(tmp_path / "r"), series.search_interest_schema(["a", "b"]))
    assert back.collect() == df.collect()
    assert back.schema == df.schema


def test_save_slice_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.save_slice(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_slice(df, str(tmp_path / "s"))
    assert sinks.save_slice(df, str(tmp_path / "s"), "overwrite", read_back=True).count() == 3


def test_stack_chunks_drops_partial_flag(spark):
    a = spark.createDataFrame([("d1", 1, False)], "Date string, x int, isPartial boolean")
    b = spark.createDataFrame([(2, "d2", True)], "x int, Date string, isPartial boolean")
    assert [tuple(r) for r in activity.stack_chunks(a, b).orderBy("Date").collect()] == [("d1", 1), ("d2", 2)]


def test_outlier_groups(spark):
    df = spark.createDataFrame([(f"a{i}", 10) for i in range(20)] + [("bot", 53255514)], "author string, n long")
    assert rows.drop_outlier_groups(df, "n").count() == 20
    assert rows.drop_outlier_groups(df, "n", "percentile", 0.9).count() == 20


def test_top_words_drop_noise(spark):
    df = spark.createDataFrame([("The skin! thing, skin also 20",), ("glow skin",)], "t string")
    out = [tuple(r) for r in PB.top_words(df, "t", ["glow"], 5).collect()]
    assert out == [("skin", 3)]


@pytest.mark.parametrize("limit", [100, 1])
def test_term_table_by_broadcast_and_by_shuffle(spark, limit):
    df = spark.createDataFrame([(1, "Cloud Paint and a tin"), (2, "cloudpaint"), (3, "thin paint"), (4, None)], "id int, t string")
    terms = spark.createDataFrame([("cloud paint", "paint"), ("cloudpaint", "paint"), ("tin", "tin")], "spelling string, name string")
    out = M.explode_term_table(df, "id", "t", terms, 2, broadcast_rows=limit)
    assert sorted(map(tuple, out.collect())) == [(1, "paint"), (1, "tin"), (2, "paint")]


def test_unknown_community_is_kept(spark, feeds):
    comments, posts = feeds
    blank = comments.limit(1).withColumn("community", F.lit(None).cast("string"))
    out = {r.community: r.total_activity for r in PA.community_interest(comments.unionByName(blank), posts).collect()}
    assert out == {"x": 6, "y": 2, "z": 1, None: 1}


def test_null_groups_are_kept(spark):
    from hearsay.operators import windows as W

    df = spark.createDataFrame([(None, "a", 3), (None, "b", 3), ("g", "a", None), ("g", "b", 1)], "g string, s string, v int")
    ranked = {(r.g, r.s, r.v, r["rank"]) for r in W.top_k_per_group(df, ["g"], "v", 2).collect()}
    assert ranked == {(None, "a", 3, 1), (None, "b", 3, 1), ("g", "b", 1, 1), ("g", "a", None, 2)}
    shares = {(r.g, r.s, r.total_count) for r in W.share_within(df, ["g"], ["s"], wide_groups=True).collect()}
    assert shares == {(None, "a", 2), (None, "b", 2), ("g", "a", 2), ("g", "b", 2)}


def test_a_single_group_is_no_outlier(spark):
    from hearsay.operators.rows import drop_outlier_groups

    assert drop_outlier_groups(spark.createDataFrame([("a", 5.0)], "g string, v double"), "v").count() == 1


def test_repeated_forms_have_one_lemma_at_any_partitioning(spark):
    from hearsay.operators.tokens import lemmatize

    df = spark.createDataFrame([(1, ["forms"])], "id int, w array<string>")
    lemmas = spark.createDataFrame([("forms", f"l{i}") for i in range(6)], "form string, lemma string")
    for n in (1, 3, 5):
        assert lemmatize(df, "w", lemmas.repartition(n), "id").first()["lemmas"] == ["l0"]


def test_a_large_lexicon_joins(spark, monkeypatch):
    from hearsay.operators import sentiment as N

    monkeypatch.setattr(N, "MAX_INLINE_LEXICON", 1)
    df = spark.createDataFrame([("good day",), ("bad bad day",)], "t string")
    got = {r.t: r.sentiment for r in N.score_sentiment(df, "t", {"good": 1.0, "bad": -1.0}).collect()}
    assert got == {"good day": "positive", "bad bad day": "negative"}

"""T and N rows of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.catalog import inputs as I
from hearsay.catalog.aggregates import rounded
from hearsay.catalog.registry import query
from hearsay.functions import columns as C, snowball as B
from hearsay.operators import logistic as LR, sentiment as N, tokens as T, topics as P
from hearsay.vocab import STOPWORDS, TOPIC_NOISE


def docs(spark, sf):
    return I.documents(spark, sf).select("doc_id", "text", "lang")


WORDS = I.words_sql("documents", "doc_id, lang", "text")
RAW = """raw AS (SELECT * FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '')"""


@query("t1_tokenize", f"WITH {RAW} SELECT word, count(*)::BIGINT AS count FROM raw GROUP BY 1")
def t1(spark, sf):
    return T.word_count(T.tokenize(docs(spark, sf), "text"), "words")


@query("t2_remove_stopwords", f"WITH {RAW} SELECT word, count(*)::BIGINT AS count FROM raw WHERE word NOT IN ({I.sql_list([*STOPWORDS, 'que', 'der'])}) GROUP BY 1")
def t2(spark, sf):
    return T.word_count(T.remove_stopwords(T.tokenize(docs(spark, sf), "text"), "words", extra=["que", "der"]), "words")


def _stem_sql(expr: str) -> str:
    for pattern, target in C.STEM_RULES:
        expr = f"regexp_replace({expr}, '{pattern}', '{target.replace('$', chr(92))}')"
    return expr


NORMAL = """normal AS (SELECT * FROM (SELECT doc_id, lang, lower(regexp_replace(word, '[^a-zA-Z]', '', 'g')) AS word FROM raw) WHERE word <> '')"""


@query("t3_stem", f"WITH {RAW}, {NORMAL} SELECT {_stem_sql('word')} AS stem, count(*)::BIGINT AS count FROM normal GROUP BY 1")
def t3(spark, sf):
    words = C.normalize_tokens(C.word_tokens("text"))
    return T.stem_counts(T.word_count(docs(spark, sf), words))


@query("t3_stem_tokens", f"WITH {RAW}, {NORMAL} SELECT doc_id, md5(string_agg({_stem_sql('word')}, ' ' ORDER BY {_stem_sql('word')})) AS v FROM normal GROUP BY 1")
def t3b(spark, sf):
    df = docs(spark, sf).select("doc_id", C.normalize_tokens(C.word_tokens("text")).alias("words"))
    stems = T.stem(df.where(F.size("words") > 0), "words")
    return stems.select("doc_id", F.md5(F.concat_ws(" ", F.sort_array("stems"))).alias("v"))


def snowball_sql() -> str:
    """From `normal`, `stems`: each distinct word and its Snowball stem, one step of the algorithm after the other."""
    def longest(rules: dict[str, str], region) -> str:
        cases = []
        for suffix in sorted(rules, key=lambda x: (-len(x), x)):
            stem, need = f"left(w, length(w) - {len(suffix)})", B.BEFORE.get(suffix)
            holds = f"length({stem}) >= {region(suffix)}" + (f" AND regexp_matches({stem}, '{need}$')" if need else "")
            cases.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {holds} THEN {stem} || '{rules[suffix]}' ELSE w END")
        return f"CASE {' '.join(cases)} ELSE w END"

    def step(n: int, text: str) -> str:
        return f"z{n} AS MATERIALIZED (SELECT word, r1, r2, done, CASE WHEN done THEN w ELSE {text} END AS w FROM z{n - 1})"

    past = "NOT regexp_matches(w, 'eed(ly)?$') AND regexp_matches(w, '[aeiouy].*(ed|edly|ing|ingly)$')"
    final = f"""w LIKE '%e' AND (length(w) - 1 >= r2 OR length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{B.SHORT}'))"""
    named = " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in B.EXCEPTIONS.items())
    return ",\n".join([
        "v AS (SELECT DISTINCT word FROM normal)",
        r"m AS (SELECT word, regexp_replace(regexp_replace(word, '([aeiouy])y', '\1Y', 'g'), '^y', 'Y') AS w FROM v)",
        f"ra AS (SELECT word, w, CASE WHEN regexp_matches(w, '{B.FIRST_REGION}') THEN length(regexp_extract(w, '{B.FIRST_REGION}', 0)) ELSE length(w) END AS r1 FROM m)",
        f"rb AS (SELECT word, w, r1, CASE WHEN regexp_matches(substr(w, r1 + 1), '{B.NEXT_REGION}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{B.NEXT_REGION}', 0)) ELSE length(w) END AS r2 FROM ra)",
        """z0 AS MATERIALIZED (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[sd]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM rb)""",
        f"z1 AS MATERIALIZED (SELECT word, r1, r2, w, w IN ({I.sql_list(B.KEPT_AFTER_PLURALS)}) AS done FROM z0)",
        f"""y AS MATERIALIZED (SELECT *, CASE WHEN NOT done AND regexp_matches(w, 'eed(ly)?$') AND length(regexp_replace(w, 'eed(ly)?$', '')) >= r1 THEN regexp_replace(w, 'eed(ly)?$', 'ee')
WHEN NOT done AND {past} THEN regexp_replace(w, '(edly|ingly|ed|ing)$', '') ELSE w END AS x, NOT done AND {past} AS cut FROM z1)""",
        f"""z2 AS MATERIALIZED (SELECT word, r1, r2, done, CASE WHEN NOT cut THEN x WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '{B.DOUBLE}') THEN left(x, length(x) - 1)
WHEN length(x) <= r1 AND regexp_matches(x, '{B.SHORT}') THEN x || 'e' ELSE x END AS w FROM y)""",
        step(3, r"regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\1i')"),
        step(4, longest(B.STEP_2, lambda x: "r1")),
        step(5, longest(B.STEP_3, lambda x: "r2" if x == "ative" else "r1")),
        step(6, longest(dict.fromkeys(B.STEP_4, ""), lambda x: "r2")),
        step(7, f"CASE WHEN ({final}) OR (w LIKE '%ll' AND length(w) - 1 >= r2) THEN left(w, length(w) - 1) ELSE w END"),
        f"stems AS (SELECT word, CASE {named} WHEN length(word) <= 2 THEN word ELSE replace(w, 'Y', 'y') END AS stem FROM z7)",
    ])


@query("t3_snowball_counts", f"WITH {RAW}, {NORMAL}, {snowball_sql()} SELECT stem, count(*)::BIGINT AS count FROM normal JOIN stems USING (word) GROUP BY 1")
def t3c(spark, sf):
    """Every distinct word is stemmed once."""
    words = C.normalize_tokens(C.word_tokens("text"))
    return T.stem_counts(T.word_count(docs(spark, sf), words), method="snowball")


@query("t3_snowball_tokens", f"WITH {RAW}, {NORMAL}, {snowball_sql()} SELECT doc_id, md5(string_agg(stem, ' ' ORDER BY stem)) AS v FROM normal JOIN stems USING (word) GROUP BY 1")
def t3d(spark, sf):
    df = docs(spark, sf).select("doc_id", C.normalize_tokens(C.word_tokens("text")).alias("words"))
    stems = T.stem_distinct(df, "words", "doc_id")
    return stems.where(F.size("stems") > 0).select("doc_id", F.md5(F.concat_ws(" ", F.sort_array("stems"))).alias("v"))


@query("t4_normalize_tokens", f"WITH {RAW}, {NORMAL} SELECT word, count(*)::BIGINT AS count FROM normal GROUP BY 1")
def t4(spark, sf):
    return T.word_count(docs(spark, sf), C.normalize_tokens(C.word_tokens("text")))


LEMMA_CASE = "CASE word " + " ".join(f"WHEN '{f}' THEN '{m}'" for f, m in I.LEMMAS.items()) + " ELSE word END"


@query("t5_lemmatize", f"WITH {RAW}, {NORMAL} SELECT {LEMMA_CASE} AS word, count(*)::BIGINT AS count FROM normal GROUP BY 1")
def t5(spark, sf):
    df = docs(spark, sf).select("doc_id", C.normalize_tokens(C.word_tokens("text")).alias("words"))
    return T.word_count(T.lemmatize(df, "words", I.LEMMAS, "doc_id"), "lemmas")


@query("t5_lemmatize_by_table", f"""WITH {RAW}, {NORMAL}, f AS (SELECT word AS form, min(word) OVER (PARTITION BY substr(word, 1, 5)) AS lemma FROM (SELECT DISTINCT word FROM normal WHERE length(word) > 5))
SELECT coalesce(lemma, word) AS word, count(*)::BIGINT AS count FROM normal LEFT JOIN f ON form = word GROUP BY 1""")
def t5b(spark, sf):
    df = docs(spark, sf).select("doc_id", C.normalize_tokens(C.word_tokens("text")).alias("words"))
    forms = T.word_count(df, "words").where(F.length("word") > 5).select(F.col("word").alias("form"), F.substring("word", 1, 5).alias("head"))
    lemmas = forms.join(forms.groupBy("head").agg(F.min("form").alias("lemma")), "head").select("form", "lemma")
    return T.word_count(T.lemmatize(df, "words", lemmas, "doc_id"), "lemmas")


@query("t6_clean_text", f"""WITH {RAW}, {NORMAL}, l AS (SELECT doc_id, {LEMMA_CASE} AS word FROM normal)
SELECT doc_id, count(word)::INT AS n, md5(coalesce(string_agg(word, ' ' ORDER BY word), '')) AS v
FROM documents LEFT JOIN (SELECT * FROM l WHERE word NOT IN ({I.sql_list(STOPWORDS)})) USING (doc_id) GROUP BY 1""")
def t6(spark, sf):
    cleaned = T.clean_text(docs(spark, sf), "text", I.LEMMAS)
    ordered = F.concat_ws(" ", F.sort_array(F.split("body_clean", " ")))
    return cleaned.select("doc_id", F.size("tokens").alias("n"), F.md5(ordered).alias("v"))


@query("t7_text_length_stats", f"""WITH {RAW}, {NORMAL}, c AS (SELECT d.doc_id, count(n.word) AS k FROM documents d LEFT JOIN normal n USING (doc_id) GROUP BY 1)
SELECT count(*)::BIGINT AS count, round(avg(k), 6) AS mean, round(stddev_samp(k), 6) AS stddev, min(k)::BIGINT AS min, max(k)::BIGINT AS max FROM c""")
def t7(spark, sf):
    from hearsay.operators.aggregates import text_length_stats

    return rounded(text_length_stats(docs(spark, sf), C.normalize_tokens(C.word_tokens("text"))))


@query("t8_word_count", f"WITH {WORDS} SELECT word, count(*)::BIGINT AS count FROM words GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def t8(spark, sf):
    return T.word_count(docs(spark, sf), C.clean_tokens("text"), 20)


TF = f"""{WORDS}, tf AS (SELECT doc_id, lang, word, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
idf AS (SELECT word, count(*)::BIGINT AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY 1)"""


def tokenised(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", C.clean_tokens("text").alias("words"))


@query("t9_tf", f"WITH {TF} SELECT doc_id, word, tf FROM tf")
def t9(spark, sf):
    return T.tf(tokenised(spark, sf), "doc_id", "words")


@query("t10_tf_idf", f"WITH {TF} SELECT doc_id, word, tf, df, round(idf, 6) AS idf, round(tf * idf, 5) AS tf_idf FROM tf JOIN idf USING (word)")
def t10(spark, sf):
    return T.tf_idf(tokenised(spark, sf), "doc_id", "words", digits=5).withColumn("idf", F.round("idf", 6))


@query("t11_top_tfidf_words", f"""WITH {TF}, s AS (SELECT lang, doc_id, word, round(tf * idf, 5) AS tf_idf FROM tf JOIN idf USING (word))
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY tf_idf DESC)::BIGINT AS rank FROM s) WHERE rank <= 10""")
def t11(spark, sf):
    return T.top_tfidf_words(tokenised(spark, sf), "doc_id", "words", "lang", 10, digits=5)


@query("t12_bag_of_words", f"""WITH {TF}, v AS (SELECT word, row_number() OVER (ORDER BY sum(tf) DESC, word)::BIGINT - 1 AS term_id FROM tf
GROUP BY word HAVING count(*) >= 2)
SELECT doc_id, term_id, word, tf FROM tf JOIN v USING (word)""")
def t12(spark, sf):
    return T.bag_of_words(tokenised(spark, sf), "doc_id", "words", min_df=2)


@query("t13_topic_words")
def t13(spark, sf):
    return P.topic_words(P.fit_topics(T.simple_words(docs(spark, sf), "text"), "doc_id", "words", 10), 10)


@query("t13_topic_mixtures")
def t13b(spark, sf):
    return P.topic_mixtures(P.fit_topics(T.simple_words(docs(spark, sf), "text"), "doc_id", "words", 10))


FOLD = f"translate(lower(text), '{C.ACCENTED}', '{C.UNACCENTED}')"


TOPICS = 3


def digamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    square = f"(1 / ({y} * {y}))"
    return (f"(ln({y}) - 0.5 / {y} - {square} * (1.0::DOUBLE / 12 - {square} * (1.0::DOUBLE / 120 - {square} * (1.0::DOUBLE / 252 - {square} / 240)))"
            f" - ({' + '.join(f'1 / ({x} + {i})' for i in range(6))}))")


def topics_sql(rounds: int, a: float = 1 / TOPICS) -> str:
    """Rounds of the variational updates in plain SQL, ending in `w`, the words' weights, and `d`, the documents'."""
    ks = range(TOPICS)
    each = lambda text: ", ".join(text.replace("#", str(t)) for t in ks)
    start = ", ".join(f"0.5 + ('0x' || substr(md5('17-{t}-' || word), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS g{t}" for t in ks)
    parts = [f"""r AS (SELECT doc_id, unnest(regexp_extract_all({FOLD}, '[\\p{{L}}_]+')) AS word FROM documents),
c AS MATERIALIZED (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM r WHERE length(word) BETWEEN 2 AND 15 AND word NOT LIKE '\\_%' ESCAPE '\\'
AND word NOT IN ({I.sql_list([*STOPWORDS, *TOPIC_NOISE])}) GROUP BY ALL),
w0 AS MATERIALIZED (SELECT word, {start} FROM (SELECT DISTINCT word FROM c)),
d0 AS (SELECT DISTINCT doc_id, {each(f'{a}::DOUBLE AS g#')} FROM c)"""]
    for r in range(rounds):
        b = each(f"exp({digamma_sql('g#')} - (SELECT {digamma_sql('s')} FROM (SELECT sum(g#) AS s FROM w{r}))) AS b#")
        whole = "(" + " + ".join(f"g{t}" for t in ks) + ")"
        e = each(f"exp({digamma_sql('g#')} - {digamma_sql(whole)}) AS e#")
        both = " + ".join(f"e{t} * b{t}" for t in ks)
        parts.append(f"""p{r} AS MATERIALIZED (SELECT doc_id, word, {each(f'tf * e# * b# / ({both}) AS p#')} FROM c JOIN (SELECT word, {b} FROM w{r}) USING (word) JOIN (SELECT doc_id, {e} FROM d{r}) USING (doc_id)),
w{r + 1} AS MATERIALIZED (SELECT word, {each(f'{a}::DOUBLE + sum(p#) AS g#')} FROM p{r} GROUP BY word),
d{r + 1} AS (SELECT doc_id, {each(f'{a}::DOUBLE + sum(p#) AS g#')} FROM p{r} GROUP BY doc_id)""")
    return ",\n".join([*parts, f"w AS (SELECT * FROM w{rounds}), d AS (SELECT * FROM d{rounds})"])


def few_topics(spark, sf):
    return P.fit_topics(T.simple_words(docs(spark, sf), "text"), "doc_id", "words", TOPICS, rounds=3)


@query("t13_topic_words_three_rounds", f"WITH {topics_sql(3)}, f AS (" + " UNION ALL ".join(f"SELECT {t} AS topic, word, g{t} / (SELECT sum(g{t}) FROM w) AS weight FROM w" for t in range(TOPICS))
       + ") SELECT topic, (row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word))::INT AS rank, word, round(weight, 9) AS weight FROM f QUALIFY rank <= 10")
def t13c(spark, sf):
    """A small form of the same fit: three topics, three rounds."""
    return P.topic_words(few_topics(spark, sf), 10).withColumn("weight", F.round("weight", 9))


@query("t13_topic_mixtures_three_rounds", f"WITH {topics_sql(3)} " + " UNION ALL ".join(
    f"SELECT doc_id, {t} AS topic, round(coalesce(g{t} / ({' + '.join(f'g{i}' for i in range(TOPICS))}), {1 / TOPICS}), 8) AS weight FROM documents LEFT JOIN d USING (doc_id)" for t in range(TOPICS)))
def t13d(spark, sf):
    return P.topic_mixtures(few_topics(spark, sf)).withColumn("weight", F.round("weight", 8))


@query("t14_simple_tokens", f"""WITH r AS (SELECT unnest(regexp_extract_all({FOLD}, '[\\p{{L}}_]+')) AS word FROM documents)
SELECT word, count(*)::BIGINT AS count FROM r WHERE length(word) BETWEEN 2 AND 15 AND word NOT LIKE '\\_%' ESCAPE '\\'
AND word NOT IN ({I.sql_list([*STOPWORDS, *TOPIC_NOISE])}) GROUP BY 1""")
def t14(spark, sf):
    return T.word_count(T.simple_words(docs(spark, sf), "text"), "words")


@query("t15_term_frequencies", f"WITH {WORDS}, c AS (SELECT word, count(*)::BIGINT AS count FROM words GROUP BY 1) SELECT word, count, round(count / (SELECT max(count) FROM c), 6) AS relative FROM c")
def t15(spark, sf):
    return rounded(T.term_frequencies(docs(spark, sf), C.clean_tokens("text")))


SCORED = I.scored_sql("documents", "doc_id", "text")
N_SQL = f"WITH {SCORED} SELECT doc_id, pw AS positive_weight, nw AS negative_weight, pw - nw AS sentiment_score, sentiment FROM scored"


@query("n1_score_sentiment", N_SQL)
def n1(spark, sf):
    return N.score_sentiment(docs(spark, sf), "text", I.LEXICON).select("doc_id", *N.SCORE_COLUMNS)


@query("n1_score_sentiment_by_table", N_SQL)
def n1b(spark, sf):
    words = T.word_count(docs(spark, sf), C.clean_tokens("text")).where(F.col("word").isin(list(I.LEXICON)))
    lexicon = words.select("word", F.element_at(C.literal_map(I.LEXICON), F.col("word")).alias("weight"))
    return N.score_sentiment(docs(spark, sf), "text", lexicon).select("doc_id", *N.SCORE_COLUMNS)


@query("n2_learned_sentiment")
def n2(spark, sf):
    df = tokenised(spark, sf)
    labelled = df.join(I.table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("double").alias("y")), "doc_id")
    model = N.train_sentiment(labelled, "words", "y")
    return N.apply_sentiment(model, df, ["positive", "negative"]).select(
        "doc_id", "sentiment", F.round(N.label_score("sentiment_scores", "negative"), 6).alias("p_negative"))


def word_model_sql(rounds: int, penalty: float = 1e-4) -> str:
    """From `words`, `x` (text, word and feature), and `w`: the weights after some rounds of the bounded updates."""
    parts = ["""lab AS (SELECT doc_id, toxic::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), total AS (SELECT count(*) AS total FROM lab),
tf AS MATERIALIZED (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
known AS MATERIALIZED (SELECT word, count(*) AS n, ln((any_value(total) + 1) / (count(*) + 1)) AS idf FROM tf JOIN lab USING (doc_id), total GROUP BY word),
x AS MATERIALIZED (SELECT doc_id, word, x FROM (SELECT doc_id, word, tf * idf / nullif(sum(tf * idf) OVER (PARTITION BY doc_id), 0) AS x FROM tf JOIN known USING (word)) WHERE x > 0
 UNION ALL SELECT doc_id, '', 1.0 FROM documents), w0 AS (SELECT word, 0.0::DOUBLE AS weight FROM known UNION ALL SELECT '', 0.0)"""]
    for r in range(rounds):
        own = f"(CASE WHEN word = '' THEN 0 ELSE {penalty} END)"
        parts.append(f"""m{r} AS MATERIALIZED (SELECT doc_id, any_value(y) AS y, sum(x * weight) AS m FROM x JOIN w{r} USING (word) JOIN lab USING (doc_id) GROUP BY doc_id),
s{r} AS (SELECT word, sum((1 / (1 + exp(-m)) - y) * x) / any_value(total) AS g, sum(2 * x * CASE WHEN abs(m) < 1e-6 THEN 0.25 ELSE (1 / (1 + exp(-m)) - 0.5) / m END) / any_value(total) AS h
 FROM x JOIN m{r} USING (doc_id), total GROUP BY word),
w{r + 1} AS MATERIALIZED (SELECT word, weight - (g + {own} * weight) / (h + {own}) AS weight FROM w{r} JOIN s{r} USING (word))""")
    return ",\n".join([*parts, f"w AS (SELECT * FROM w{rounds})"])


def toxic_texts(spark, sf):
    return tokenised(spark, sf), tokenised(spark, sf).join(I.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


@query("n2_word_sentiment")
def n2b(spark, sf):
    """Sentiment learned over exact words, 20 rounds."""
    df, labelled = toxic_texts(spark, sf)
    out = LR.score_words(LR.fit_words(labelled, "doc_id", "words", "y"), df, "doc_id", "words", ["clean", "toxic"])
    return out.select("doc_id", "sentiment", F.round("probability", 6).alias("p_toxic"))


@query("n2_word_sentiment_three_rounds", f"""WITH {WORDS}, {word_model_sql(3)}, p AS (SELECT doc_id, 1 / (1 + exp(-sum(x * weight))) AS p FROM x JOIN w USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN p >= 0.5 THEN 'toxic' ELSE 'clean' END AS sentiment, round(p, 8) AS p_toxic FROM p""")
def n2c(spark, sf):
    df, labelled = toxic_texts(spark, sf)
    out = LR.score_words(LR.fit_words(labelled, "doc_id", "words", "y", rounds=3), df, "doc_id", "words", ["clean", "toxic"])
    return out.select("doc_id", "sentiment", F.round("probability", 8).alias("p_toxic"))


@query("n3_sentiment_scores", f"""WITH {SCORED} SELECT doc_id, round(pw / (pw + nw + 1), 6) AS positive, round(nw / (pw + nw + 1), 6) AS negative,
round(1 / (pw + nw + 1), 6) AS neutral FROM scored""")
def n3(spark, sf):
    scored = N.sentiment_scores(N.score_sentiment(docs(spark, sf), "text", I.LEXICON))
    return scored.select("doc_id", *[F.round(N.label_score("sentiment_scores", x), 6).alias(x) for x in ("positive", "negative", "neutral")])


@query("n4_score_distinct", N_SQL)
def n4(spark, sf):
    return N.score_distinct(docs(spark, sf), "text", I.LEXICON).select("doc_id", *N.SCORE_COLUMNS)

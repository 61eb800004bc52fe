"""Mixing sources to target weights: temperature mixing with block permutations, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.llm.common import materialise, words_of

#: Steps of one exponent unit, and sections an interval is cut into per round of the bisection.
UNIT, SECTIONS = 1_000_000, 100


def shuffle_key(id_col: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def find_exponent(shares: DataFrame, spread: float, repetitions: float) -> float:
    """The largest mixing temperature that both targets allow, as an exponent between 0 and 1.

    Weights are `share ** exponent`, normalised. Exponent 1 keeps the shares, 0
    makes them equal; entropy falls and the repetitions of the smallest source
    (beside one pass over the largest) fall as it grows. The target entropy lies
    `spread` of the way from that of the shares to that of equal weights. Each
    round evaluates all ends of the sections in one aggregate over the sources.
    """
    ends = shares.agg(F.count(F.lit(1)).alias("n"), F.sum(-F.col("share") * F.ln("share")).alias("own")).first()
    if not ends["n"]:
        return 1.0
    low, high = 0, UNIT
    while high > low:
        step = max(1, (high - low) // SECTIONS)
        tried = shares.select("share", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))).alias("k"))
        power = F.pow("share", F.col("k") / UNIT)
        sums = tried.groupBy("k").agg(
            F.sum(power).alias("z"), F.sum(power * F.ln(power)).alias("e"),
            F.max(F.col("share")).alias("top"), F.min(F.col("share")).alias("least"),
        )
        entropy = F.ln("z") - F.col("e") / F.col("z")
        target = F.lit(ends["own"]) + F.lit(spread) * (F.ln(F.lit(float(ends["n"]))) - F.lit(ends["own"]))
        most = F.pow(F.col("least") / F.col("top"), F.col("k") / UNIT - 1)
        fits = (F.round(entropy, 9) <= F.round(target, 9)) & (F.round(most, 9) <= F.lit(repetitions))
        found = sums.where(fits).agg(F.min("k").alias("k")).first()["k"]
        high = min(high, found if found is not None else high)
        low = high if step == 1 else max(low, high - step)
    return high / UNIT


def source_weights(
    sized: DataFrame, source_col: str, spread: float, repetitions: float, budget: float | str,
) -> DataFrame:
    """One row per source: its tokens, weight, and the whole epochs and rest of its token budget.

    `budget` is a multiple of all tokens, or "cover": the least budget in which
    every source appears at least once. A source without tokens passes once.
    """
    sums = materialise(sized.groupBy(F.col(source_col).alias("source")).agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    total = sums.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = sums.where("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(max(1, total)))).alias("share"))
    exponent = find_exponent(shares, spread, repetitions)
    power = F.pow("share", F.lit(exponent))
    whole = shares.agg(F.sum(power).alias("z"), F.max(F.col("share") / power).alias("c")).first()
    z, c = whole["z"] or 1.0, whole["c"] or 1.0
    tokens = total * c * z if budget == "cover" else total * budget
    share = F.col("tokens") / F.lit(float(max(1, total)))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    out = sums.withColumns({"exponent": F.lit(exponent), "weight": F.round(weight, 9)})
    out = out.withColumn("target", F.round(F.col("weight") * F.lit(float(tokens))).cast("long"))
    if budget == "cover":
        out = out.withColumn("target", F.greatest("target", "tokens"))
    return out.withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.greatest("tokens", F.lit(1)))).otherwise(1).cast("int"),
        "rest": F.when(F.col("tokens") > 0, F.col("target") % F.greatest("tokens", F.lit(1))).otherwise(0).cast("long"),
    })


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", spread: float = 0.5,
    repetitions: float = 4.0, budget: float | str = 1.0, seed: int = 42, row_col: str | None = None,
) -> DataFrame:
    """One row per document and pass: doc_id, source, epoch, block, order_key, n_tokens and, on request, its row.

    Every epoch is a permutation of its source in two levels: 4096 blocks in
    order, keyed order inside a block. Whole epochs take every document. The
    rest of a budget takes whole blocks by the running sum of their tokens, and
    only the block where it ends is sorted by document, so a source with a third
    of all rows never meets in one task. Documents are taken up to the last one
    that fits, so a source ends at most one document short of its target.

    Tokens are words. A null source is a source of its own, null and empty texts
    have no tokens, and a source that has only such texts passes once. Rows that
    share an id share their place and are counted one by one.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if row_col else []
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens"), *row,
    )
    sized = materialise(sized, "sized")
    plan = materialise(source_weights(sized, "source", spread, repetitions, budget), "weights")
    same = F.col("d.source").eqNullSafe(F.col("p.source"))

    passes = plan.select("source", F.explode(F.sequence(F.lit(1), F.col("epochs") + F.when(F.col("rest") > 0, 1).otherwise(0))).alias("epoch"), (F.col("epochs")).alias("whole"), "rest")
    passes = passes.where("epoch >= 1 AND epoch <= whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END")
    dealt = sized.alias("d").join(passes.alias("p"), same).select("d.*", "p.epoch", "p.whole", "p.rest")
    dealt = dealt.withColumn("order_key", shuffle_key(F.col("doc_id"), F.col("epoch"), seed))
    dealt = dealt.withColumn("block", F.conv(F.substring("order_key", 1, 3), 16, 10).cast("int"))

    last = dealt.where("epoch > whole")
    blocks = last.groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_tokens").over(before), F.lit(0)))
    blocks = blocks.where("_before <= rest").select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), F.col("_before"), (F.col("_before") + F.col("_tokens") <= F.col("rest")).alias("_whole"))
    kept = last.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    inside = Window.partitionBy("source").orderBy("order_key", F.col("doc_id").asc_nulls_last())
    edge = kept.where("NOT _whole").withColumn("_sum", F.sum("n_tokens").over(inside))
    edge = edge.where("_before + _sum <= rest")

    named = ["doc_id", "source", "epoch", "block", "order_key", "n_tokens", *(["_row"] if row_col else [])]
    out = dealt.where("epoch <= whole").select(*named).unionByName(kept.where("_whole").select(*named)).unionByName(edge.select(*named))
    return out.withColumnRenamed("_row", row_col) if row_col else out


SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
sums AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS BIGINT) AS t FROM sums),
shares AS (SELECT tokens / CAST(t AS DOUBLE) AS share FROM sums, total WHERE tokens > 0),
ends AS (SELECT sum(-share * ln(share)) AS own, ln(CAST(count(*) AS DOUBLE)) AS equal FROM shares),
grid(k, round) AS (SELECT unnest(range(0, 1000001, 10000)), 1),
f1 AS (SELECT k, ln(sum(pow(share, k / 1000000))) - sum(pow(share, k / 1000000) * ln(pow(share, k / 1000000))) / sum(pow(share, k / 1000000)) AS h,
       pow(min(share) / max(share), k / 1000000 - 1) AS most FROM shares, grid GROUP BY k),
k1 AS (SELECT coalesce(min(k), 1000000) AS k FROM f1, ends WHERE round(h, 9) <= round(own + 0.5 * (equal - own), 9) AND round(most, 9) <= 4),
g2 AS (SELECT unnest(range(greatest(k - 10000, 0), k + 1, 100)) AS k FROM k1),
f2 AS (SELECT k, ln(sum(pow(share, k / 1000000))) - sum(pow(share, k / 1000000) * ln(pow(share, k / 1000000))) / sum(pow(share, k / 1000000)) AS h,
       pow(min(share) / max(share), k / 1000000 - 1) AS most FROM shares, g2 GROUP BY k),
k2 AS (SELECT coalesce(min(f2.k), min(k1.k)) AS k FROM k1 LEFT JOIN (SELECT f2.k FROM f2, ends WHERE round(h, 9) <= round(own + 0.5 * (equal - own), 9) AND round(most, 9) <= 4) f2 ON true),
g3 AS (SELECT unnest(range(greatest(k - 100, 0), k + 1)) AS k FROM k2),
f3 AS (SELECT k, ln(sum(pow(share, k / 1000000))) - sum(pow(share, k / 1000000) * ln(pow(share, k / 1000000))) / sum(pow(share, k / 1000000)) AS h,
       pow(min(share) / max(share), k / 1000000 - 1) AS most FROM shares, g3 GROUP BY k),
k3 AS (SELECT coalesce(min(f3.k), min(k2.k)) / 1000000 AS a FROM k2 LEFT JOIN (SELECT f3.k FROM f3, ends WHERE round(h, 9) <= round(own + 0.5 * (equal - own), 9) AND round(most, 9) <= 4) f3 ON true),
z AS (SELECT sum(pow(share, a)) AS z FROM shares, k3),
plan AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN CAST(round(round(pow(tokens / CAST(t AS DOUBLE), a) / z, 9) * t) AS BIGINT) ELSE 0 END AS target FROM sums, total, k3, z),
cut AS (SELECT source, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN target % tokens ELSE 0 END AS rest FROM plan),
passes AS (SELECT source, whole, rest, unnest(range(1, whole + CASE WHEN rest > 0 THEN 2 ELSE 1 END)) AS epoch FROM cut),
dealt AS (SELECT d.doc_id, d.source, n_tokens, epoch, whole, rest, md5('42:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS order_key
          FROM sized d JOIN passes p ON d.source IS NOT DISTINCT FROM p.source),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY order_key, doc_id) AS s FROM dealt)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(CAST('0x' || substr(order_key, 1, 3) AS INTEGER) AS INTEGER) AS block, order_key, n_tokens
FROM summed WHERE epoch <= whole OR s <= rest
"""

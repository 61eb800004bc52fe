"""Exact dedup by content sort, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.llm.common import materialise

#: Leading characters of a text in the range key; bounds what the sampled splitters send to the driver.
LEAD = 32


def normalised(text: Column) -> Column:
    """White-space runs become one space; a single space is left untouched instead of being replaced by itself."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, slices: int = 4000,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and, on request, its whole row.

    Texts are range-partitioned by sampled splitters on (leading characters,
    digest, slice), sorted by the whole text, and each is compared in full with
    its neighbour. A group with more than `1 / slices` of all rows is cut into
    slices of about that size; only the first row of each slice, at most
    `2 * slices` rows, is compared again.

    Null texts count as empty, and empty texts equal each other. Rows that share
    text and id are copies of which one stays; a null id is larger than any
    other. An empty table gives an empty result.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if row_col else []
    texts = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"), *row)
    texts = texts.withColumn("_digest", F.sha2("_text", 256))
    total = max(1, docs.count())
    sizes = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * slices > total)
    cuts = F.broadcast(sizes.select("_digest", F.ceil(F.col("_n") * slices / total).alias("_cuts")))
    keyed = texts.join(cuts, "_digest", "left").withColumn("_lead", F.substring("_text", 1, LEAD))
    keyed = keyed.withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_cuts")), F.lit(-1)))

    slot = ["_lead", "_digest", "_slice"]
    content = Window.partitionBy(*slot).orderBy("_text", F.col("_id").asc_nulls_last())
    ranged = keyed.repartitionByRange(*slot)
    ranged = ranged.withColumn("_new", ~F.lag("_text").over(content).eqNullSafe(F.col("_text")))
    ranged = ranged.withColumn("_run", F.sum(F.col("_new").cast("int")).over(content))
    ranged = ranged.withColumn("_first_text", F.when(F.col("_new") & (F.col("_slice") >= 0), F.col("_text")))
    run = Window.partitionBy(*slot, "_run")
    marked = ranged.select(
        "_id", *slot, "_run", "_new", "_first_text", *["_row" for _ in row],
        F.min("_id").over(run).alias("_keep"), F.count(F.lit(1)).over(run).alias("_size"),
    )
    marked = materialise(marked.drop("_lead"), "copies")

    whole = marked.where("_slice < 0").withColumns({"_all_keep": F.col("_keep"), "_all_size": F.col("_size"), "_here": F.col("_new")})
    firsts = marked.where("_slice >= 0 AND _new").select("_digest", "_slice", "_run", "_first_text", "_keep", "_size")
    among = Window.partitionBy("_digest", "_first_text")
    joined = firsts.select(
        "_digest", "_slice", "_run", F.min("_keep").over(among).alias("_all_keep"), F.sum("_size").over(among).alias("_all_size"),
        (F.row_number().over(among.orderBy(F.col("_keep").asc_nulls_last(), "_slice")) == 1).alias("_lead_slice"),
    )
    cut = marked.where("_slice >= 0").join(F.broadcast(joined), ["_digest", "_slice", "_run"])
    cut = cut.withColumn("_here", F.col("_new") & F.col("_lead_slice")).drop("_lead_slice")
    return whole.unionByName(cut.select(*whole.columns)).select(
        F.col("_id").alias("doc_id"), F.col("_all_keep").alias("keep_id"), F.col("_all_size").alias("group_size"),
        F.col("_here").alias("kept"), F.col("_digest").alias("text_sha256"), *[F.col("_row").alias(row_col) for _ in row],
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `docs`."""
    return mark_copies(docs, id_col, text_col, row_col="row").where("kept").select("row.*")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""

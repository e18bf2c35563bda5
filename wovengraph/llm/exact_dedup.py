"""Exact duplicates by recipes of content-defined chunks; DataFrame functions only.

A text is cut where its content says so (the first sentence or line end at
least 512 characters after the last cut, 4,096 at most), so equal passages in
different texts give equal chunks. Every distinct chunk gets a verified
identifier: its 64-bit hash, together with its rank among the different chunks
that were found to share that hash. Texts are then equal exactly if their
ordered lists of hashes and of ranks are; only these short lists are grouped. The texts
are shuffled once, as chunks that each task has already reduced to distinct
ones, and never again.

Null text counts as empty; the empty text has the empty list. Rows with equal
``id_col`` count as separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.llm.common import fold, settle

LEAST, MOST = 512, 4096
RANKS = "array<struct<at:int,rank:int>>"
CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?[.!?;:\n]|.{{1,{MOST}}}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def clashes(texts: DataFrame) -> DataFrame | None:
    """(hash, chunk, rank >= 1) of chunks that share a 64-bit hash with a smaller, different chunk.

    ``texts`` has the column ``_text``. None if there is no clash, as in nearly
    every corpus; only otherwise are chunks read again, those with the hashes concerned.
    """
    found = texts.select(F.explode(F.array_distinct(chunks(F.col("_text")))).alias("chunk"))
    found = found.select(F.xxhash64("chunk").alias("hash"), "chunk")
    shared = found.distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    shared = settle(shared)
    if shared.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1
    return settle(found.join(shared, "hash", "left_semi").distinct().withColumn("rank", rank).where("rank > 0"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, recipe, ranks, text_sha256): the hashes of the ordered chunks, and the clashes among them.

    ``ranks`` holds (place, rank) of the chunks that share their hash with a
    smaller, different one, in order; it is empty in nearly every text.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), fold(F.col(f"`{text_col}`")).alias("_text"))
    plain = F.transform(chunks(F.col("_text")), lambda c: F.xxhash64(c))
    own = settle(texts.select("_id", plain.alias("recipe"), F.sha2("_text", 256).alias("text_sha256")))
    odd = clashes(texts)
    return own.withColumn("ranks", F.array().cast(RANKS)) if odd is None else _settle_clashes(own, texts, odd)


def _settle_clashes(own: DataFrame, texts: DataFrame, odd: DataFrame) -> DataFrame:
    at = texts.select(F.sha2("_text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("_text"))).alias("at", "chunk"))
    at = at.withColumn("hash", F.xxhash64("chunk")).join(odd, ["hash", "chunk"])
    # A text's digest stands for the text here, so that rows with equal or null ids need no telling apart.
    ranks = at.select("text_sha256", "at", "rank").distinct().groupBy("text_sha256")
    ranks = ranks.agg(F.array_sort(F.collect_list(F.struct("at", "rank"))).cast(RANKS).alias("ranks"))
    joined = own.join(ranks, "text_sha256", "left")
    return joined.select("_id", "recipe", F.coalesce("ranks", F.array().cast(RANKS)).alias("ranks"), "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Groups are counted with
    partial aggregation and written before they are joined back, so that a
    recipe held by a third of all rows is split by the engine's skew join.
    Null ids count as smallest; of rows with equal largest ids all are marked kept.
    Other columns are not read. No rows in, no rows out.
    """
    own = recipes(docs, id_col, text_col)
    same = ["recipe", "ranks"]
    groups = own.groupBy(*same).agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = settle(groups)
    joined = own.join(groups, same)
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, with its columns as they are: the one with the largest id.

    Of rows with that id and equal texts any one stays, whole. Columns may have any names.
    """
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(f"`{id_col}`").alias("keep"), F.col("text_sha256").alias("keep_sha"))
    own = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.sha2(fold(F.col(f"`{text_col}`")), 256).alias("sha"))
    same = (F.col("sha") == F.col("keep_sha")) & F.col("id").eqNullSafe(F.col("keep"))
    return own.join(kept, same, "left_semi").dropDuplicates(["id", "sha"]).select("row.*")

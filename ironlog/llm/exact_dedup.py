"""Exact duplicates by content-defined chunk recipes, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironlog.llm.common import SPACE, only, stored

#: A chunk has LEAST to MOST characters and ends at the first place after LEAST that follows one of these endings.
LEAST, MOST = 768, 8192
ENDING = r"(?:e |[.!|] ?[a-d])"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text cut where its content says so; the pieces put together are the text.

    Whether a place is a cut depends on the characters before it since the last cut, so an insertion shifts the
    cuts only until the next common one.
    """
    piece = rf"(?s).{{{least},{most - 8}}}?{ENDING}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(piece), F.lit(0))


def _fingerprint(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits) if bits < 64 else F.xxhash64(chunk)


def chunk_recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe): each row's text as the ordered list of its chunks' verified identifiers.

    Equal recipes are equal texts and the reverse.  A chunk's identifier is a hash of ``bits`` bits, verified: all
    distinct chunks are gathered once by hash (copies combined before the shuffle), and where one hash has several
    chunks, they are told apart by their rank among them.  So a text's bytes move once, those of a repeated chunk
    once per map task; only identifiers move after that.
    """
    docs = only(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("text"))
    pieces = F.col("chunks")
    held = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    distinct = (
        held.select(F.explode("chunks").alias("chunk"))
        .select(_fingerprint(F.col("chunk"), bits).alias("mark"), "chunk")
        .distinct()
    )
    clashing = distinct.groupBy("mark").count().where("count > 1").select("mark")
    clashing = stored(clashing, "clashing")
    plain = held.select("doc_id", "text_sha256", F.transform(pieces, lambda c: _fingerprint(c, bits)).alias("recipe"))
    if clashing.isEmpty():
        return plain.select("doc_id", "text_sha256", F.transform("recipe", lambda m: F.struct(m.alias("mark"), F.lit(0).alias("rank"))).alias("recipe"))

    # Different chunks share a hash: rank them, and look up the rank wherever such a hash occurs.
    ranked = distinct.join(clashing, "mark", "left_semi")
    below = ranked.select("mark", F.col("chunk").alias("other"))
    ranked = ranked.join(below, "mark").groupBy("mark", "chunk").agg(F.count_if(F.col("other") < F.col("chunk")).cast("int").alias("rank"))
    ranked = stored(ranked, "ranked")
    numbered = stored(held.withColumn("row", F.expr("uuid()")), "numbered")
    parts = numbered.select("row", F.posexplode("chunks").alias("at", "chunk"))
    parts = parts.withColumn("mark", _fingerprint(F.col("chunk"), bits)).join(ranked, ["mark", "chunk"], "left")
    lists = (
        parts.groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "mark", F.coalesce("rank", F.lit(0)).alias("rank")))).alias("l"))
        .select("row", F.transform("l", lambda x: F.struct(x["mark"].alias("mark"), x["rank"].alias("rank"))).alias("recipe"))
    )
    empty = F.array().cast("array<struct<mark:bigint,rank:int>>")
    return numbered.join(lists, "row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs became one space.  Of equal texts, the row with the
    smallest doc_id stays (rows without doc_id go first only if no other is there: keep_id is then null and all
    of them are kept).  Null and empty texts are one group.  Rows that share doc_id and text are one document:
    they are flagged alike, and ``survivors`` returns one of them.  An empty table gives an empty result.

    Groups are counted by recipe with map-side combining and joined back by equality, so a group that holds a
    third of all rows is one row before the join, and its join key can be split.
    """
    recipes = stored(chunk_recipes(docs, bits), "recipes")
    groups = stored(
        recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return recipes.join(groups, "recipe").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def survivors(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns; of rows that share doc_id and normalised text, one."""
    kept = exact_duplicates(docs).where("kept").select("doc_id", "text_sha256").distinct()
    whole = docs.withColumn("__sha", F.sha2(normalised(docs["text"]), 256))
    same = whole["doc_id"].eqNullSafe(kept["doc_id"]) & (whole["__sha"] == kept["text_sha256"])
    return whole.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__sha"]).drop("__sha")


#: The same result by a plain grouping of whole texts.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text, freed of white space, is cut into chunks where its own content says so (after sentence punctuation, between a least
and a greatest length), so equal texts are cut alike. Chunks are deduplicated to identifiers: the 64-bit hash of a chunk is
its identifier once every chunk with that hash is known to be the same text; hashes that distinct chunks share get a number
more. Texts are equal when their ordered lists of identifiers are. Only chunks move, each distinct one once a map task; the
documents themselves never do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut


def chunks_of(text: Column, least: int, most: int) -> Column:
    """The chunks of text in order; put together again they are the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 1}}}?[.!?;:。！？]|.{{1,{most}}}"), F.lit(0))


def hashed(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_dedup(docs: DataFrame, chunk_hash: Callable[[Column], Column] = hashed, least: int = 512, most: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of WHITE; of equal texts the one with most code points, then the
    smallest doc_id, stays. A null text is an empty one, and all empty texts are one group. A null doc_id sorts after every
    other. Rows that repeat an id with a text of the same length and content are one document: they are counted in
    group_size and share `kept`. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.length(text).cast("long").alias("n"), F.regexp_replace(text, f"{WHITE}+", "").alias("bare"))
    cutup = read.select("doc_id", "n", "bare", chunks_of(F.col("bare"), least, most).alias("chunks"))
    recipes = cut(cutup.select("doc_id", "n", F.sha2("bare", 256).alias("text_sha256"), F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe")))

    distinct = cutup.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = cut(distinct.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"))
    if shared.isEmpty():
        listed = recipes
    else:
        listed = _told_apart(cutup, recipes, distinct, shared, chunk_hash)

    first = F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"))
    groups = listed.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
    return listed.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("n") == -F.col("first.less"))).alias("kept"),
        "text_sha256",
    )


def _told_apart(cutup: DataFrame, recipes: DataFrame, distinct: DataFrame, shared: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """The recipes, where each identifier whose hash several chunks share is followed by the number of its chunk."""
    from pyspark.sql import Window

    numbered = distinct.join(shared, "h").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long"))
    at = cutup.select("doc_id", "n", F.sha2("bare", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    parts = at.join(numbered, ["h", "chunk"], "left").select("doc_id", "n", "text_sha256", F.struct("pos", "h", F.coalesce("number", F.lit(0).cast("long")).alias("number")).alias("part"))
    full = parts.groupBy("doc_id", "n", "text_sha256").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    full = full.select("doc_id", "n", "text_sha256", F.flatten(F.transform("parts", lambda p: F.array(p["h"], p["number"]))).alias("full"))
    same = [recipes[c].eqNullSafe(full[c]) for c in ("doc_id", "n", "text_sha256")]
    return recipes.join(full, same, "left").select(recipes.doc_id, recipes.n, recipes.text_sha256, F.coalesce("full", "recipe").alias("recipe"))

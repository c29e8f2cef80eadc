"""A training corpus from raw documents: quality, exact and near duplicates, benchmark passages, and packing.

STAGES lists the stages in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. The driver may write what a stage returns and read it again as the next one's docs, as run() does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import WHITE, cut, discard, table, unused
from sigloom.llm.decontamination import drop_leaks
from sigloom.llm.entries import vocabulary
from sigloom.llm.exact_dedup import exact_dedup
from sigloom.llm.packing import pack
from sigloom.llm.resampling import keep_drawn
from sigloom.llm.simhash import representatives, text_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws. Null and empty texts have weight 1; rows that repeat are drawn or left together; without a good label all are drawn."""
    return keep_drawn(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest of the texts that are equal but for white space, the smallest doc_id of several. Rows of one doc_id with such texts are one document: one stays."""
    kept = exact_dedup(docs.select("doc_id", "text")).filter("kept").select("doc_id", "text_sha256").distinct()
    return _decided(docs, kept, F.sha2(F.regexp_replace(_text(docs), f"{WHITE}+", ""), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates."""
    return _decided(docs, representatives(docs), text_digest(docs["text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark drops nothing."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. A null text is an empty one, of one token; every row is packed, repeated ones too, of any length."""
    return pack(docs, vocabulary(), added=True)


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def _decided(docs: DataFrame, names: DataFrame, digest: Column) -> DataFrame:
    """One row of docs, the longest and then the least by its columns, for each of the names (doc_id, digest); no two are alike.
    Columns of docs may have any name, and any type: what has no order is ordered by its form as a string."""
    stay, own, row = (unused(docs, c) for c in ("stay", "digest", "row"))
    held = docs.join(names.toDF(stay, own), docs["doc_id"].eqNullSafe(F.col(stay)) & (digest == F.col(own)))
    ordered = [docs[c].cast("string") if any(k in kind for k in ("map<", "variant", "interval")) else docs[c] for c, kind in docs.dtypes]
    first = F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.struct(-F.length(_text(docs)), *ordered))
    return held.groupBy(stay, own).agg(first.alias(row)).select(*(F.col(row)[c].alias(c) for c in docs.columns))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the whole table documents. A stage's table goes once the next one is written. An empty table gives no rows; columns beside doc_id and text may have any names and types."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done, docs = docs, cut(stage(spark, docs, sf_dir))
        discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hashes, fingerprints and tokenizers are beyond SQL: the rows are tested against a brute-force pipeline instead.
ORACLE_SQL = None

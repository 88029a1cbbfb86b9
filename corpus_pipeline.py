"""A corpus from `documents` to packed sequences: language, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A row is told from others by its id and the hash of its
text, so repeated rows, null texts, null ids, and ids that several texts share go through every stage; what becomes of
them is said at each. Columns beyond those of documents are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm import op4_packing, op6_decontamination, op8_secrets, op9_language, op10_jaccard
from brooklet.llm.common import stored, tables

#: Pairs of 8-byte numbers that may be broadcast (with their hash table about 40 MB); more of them join by a shuffle.
BROADCAST_PAIRS = 500_000


def _small(df: DataFrame, tag: str, pairs=None) -> DataFrame:
    """df, stored, to be broadcast where its pairs of numbers (one a row, or as the column says) are few."""
    df = stored(df, tag)
    n = df.agg(F.sum(F.lit(1) if pairs is None else pairs)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_PAIRS else df


def _same(docs: DataFrame, other: DataFrame):
    """Rows of docs with the id and text of a row of other (_id, _key), nulls being equal."""
    return docs["doc_id"].eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_key"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts, texts without a letter and texts that no language holds half of go."""
    return op9_language.keep_known(docs, op9_language.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the least id, null ids last, and of equal
    ids the one with the least hash of the text; of repeated rows one stays. Texts without words are no copies."""
    found = stored(op10_jaccard.jaccard_groups(docs), "copies").where("group is not null")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stays = found.groupBy("group").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    others = found.join(stays, "group").where(first != F.col("first"))
    drop = _small(others.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "drop")
    kept = docs.join(drop, _same(docs, drop), "left_anti")
    again = found.groupBy("doc_id", "text_key").count().where("count > 1").drop("count")
    if again.isEmpty():
        return kept
    again = _small(again.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "again")
    once = kept.join(again, _same(kept, again), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, _same(kept, again), "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of `benchmark`; null texts hold none."""
    found = op6_decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    drop = _small(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "leaks")
    return docs.join(drop, _same(docs, drop), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret's span replaced by a mark; n_chars follows the text where there is such a column. Null texts stay null."""
    found = op8_secrets.find_spans(docs).where(F.size("spans") > 0)
    spans = F.transform("spans", lambda s: F.struct(s["start"], s["stop"]))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.max(spans).alias("_spans"))
    found = _small(found, "secrets", F.size("_spans") + 1)
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_key"]), "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(op8_secrets.redacted(F.col("text"), F.col("_spans")))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(v.alias(c) for c, v in out.items()))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their place in a sequence; null text is empty (its end id alone)."""
    return op4_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: No stage but the joins can be written in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's tables go when its result is written, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tables() as made:
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), "stage")
            made.release(docs)
        return STAGES[-1][1](spark, docs, sf_dir)

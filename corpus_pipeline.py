"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet and reads them again for the next, so that every stage works on all that its
predecessor kept and lost executors cost no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import exact_dedup, jaccard_join, packing, quality, secretscan
from cairnwork.llm.common import load, mark, release, store

#: Near copies: five-word shingles, similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; null texts count as empty."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where(F.col("score") >= 0.5).select(docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the least doc_id; rows that share id and text are one document."""
    since = mark()
    found, path = store(exact_dedup.exact_dedup(docs).select("doc_id", "kept", "text_sha256"), "kept-exact")
    release(spark, since, path)
    kept = found.where("kept")
    if not found_twice(docs):
        return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    # ids that don't tell rows apart: text decides too, and of rows alike in both one stays
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))
    same = rows["id"].eqNullSafe(kept["doc_id"]) & (rows["digest"] == kept["text_sha256"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id (null last; of one id, the least hash of the text).

    Rows alike in id and text are one document; documents without words link with nothing and stay.
    """
    since = mark()
    found = jaccard_join.jaccard_components(docs, NEAR_WORDS, NEAR_PERCENT, with_tie=True)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    linked = found.where("component IS NOT NULL").groupBy("component").agg(F.min(first).alias("first")).select("first.doc_id", "first.tie")
    kept, path = store(linked.union(found.where("component IS NULL").select("doc_id", "tie").distinct()), "kept-near")
    release(spark, since, path)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    chosen = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["digest"] == kept["tie"]), "left_semi")
    if found_twice(docs):
        chosen = chosen.dropDuplicates(["id", "digest"])
    return chosen.select("row.*")


def found_twice(docs: DataFrame) -> bool:
    """Whether ids don't tell rows apart."""
    return not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty()


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret masked; n_chars follows the text."""
    masked = secretscan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: A learned model, a decoding worklist and packing have no SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline out of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of
``documents``.  Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm import decontamination, ngram_join, packing, secrets, toxicity
from voxelith.llm.common import DOCUMENT_COLUMNS, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.5 or more go."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), DOCUMENT_COLUMNS)
    return scored.filter("toxicity < 0.5").select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id stays.

    Documents without words and rows without doc_id stay.  Rows that repeat a doc_id and
    its text count as one document; if their texts differ, all rows of the least id stay.
    """
    named = materialize(ngram_join.join_documents(docs, n=5, percent=75), "named")
    gone = named.filter("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = docs.select(*DOCUMENT_COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    again = named.groupBy(F.col("doc_id").alias("again")).agg(F.count("*").alias("rows")).filter("rows > 1").select("again")
    if again.isEmpty():
        return kept
    once = kept.join(again, F.col("doc_id") == F.col("again"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, F.col("doc_id") == F.col("again"), "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark is found go.

    A row's text alone decides, by its 64-bit hash: rows without doc_id go as others do, and
    rows that share a doc_id are judged apart.
    """
    key = F.xxhash64("text")
    found = materialize(decontamination.find_items(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")), "contaminated")
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(gone, key == F.col("gone"), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes."""
    clean = secrets.redact(secrets.scan(docs.select(*DOCUMENT_COLUMNS)))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: Learned scores, alignments and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else materialize(out, name)
    return docs

"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the next stage's documents.

Quality rules drop documents, near-duplicate groups (similarity 0.8 or more) keep one document, documents
that hold a benchmark passage are dropped, secrets are blanked out, and the mix
chooses documents and how often they are repeated. Every stage's result is
written to the shared folder and read again, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import decontamination, mixing, near_dups, quality_rules, secret_scan
from meshlark.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.deduplicated(docs, whole=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_copies), ("decontamination", decontaminated), ("secret scans", secrets), ("mixing", mix)]

#: Boosted signatures and seeded hashes are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

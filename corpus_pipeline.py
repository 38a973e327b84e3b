"""The corpus pipeline: toxicity, quality, near-duplicates, secrets, packing.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` stores as Parquet and reads again as the next one's docs.
All stages but the last return the columns of ``documents``. Toxic and low-quality documents
go, one document of each near-duplicate group (SimHash fingerprints of three-word shingles
within two bits, chained) stays (the one with the smallest doc_id), secrets are masked in the
texts, and what is left is packed.

Nulls: a null text is an empty text for every decision and stays null in what is kept; rows
without doc_id are judged like others, and of a near-duplicate group without any doc_id one
row stays. Ties: of a group's rows with the smallest doc_id the one with the least text hash
stays, of rows equal in both one. Repeated rows are judged alike until then. Very long texts
are read whole by every stage. Columns other than those of ``documents`` are dropped before a
stage sees them, so their names cannot clash. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm import packing, quality, secret_scan, simhash, toxicity
from vigil.llm.common import DOCUMENT_COLUMNS, materialize, ship_package, table
from vigil.session import configure


def _documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    configure(spark)
    ship_package(spark)
    return docs.select(*DOCUMENT_COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(_documents(spark, docs), table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(_documents(spark, docs), table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(
        _documents(spark, docs), size=simhash.SHINGLE, distance=simhash.DISTANCE, partitions=simhash.PARTITIONS
    )


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(_documents(spark, docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, docs), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

# the classifiers and the tokenizer have no SQL form; tests/llm checks the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

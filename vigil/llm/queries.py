"""The registered queries of the corpus operators: ``opN_<name>`` and ``pipeline``.

Each applies its operator with production parameters to its whole table. Vocabulary paths
are parameters of the operators; the queries use the installed public files.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm import (
    bpe, decontaminate, fill_middle, hilbert, html_blocks, multi_index, packing, quality, resample, secret_scan, simhash, topk,
    toxicity,
)
from vigil.llm.common import ship_package, table
from vigil.session import configure

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def wrapped(spark: SparkSession, base_dir: str) -> DataFrame:
        configure(spark)
        ship_package(spark)
        return fn(spark, base_dir)

    wrapped.__name__, wrapped.__doc__ = fn.__name__, fn.__doc__
    REGISTRY[fn.__name__] = wrapped
    return wrapped


@query
def op1_byte_bpe(spark, d):
    """Encode and decode every text with the multilingual byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(table(spark, d, "documents"), path, public_tokenizers.PATTERN)


@query
def op2_simhash(spark, d):
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, d, "documents"))


@query
def op3_packing(spark, d):
    """Mixture-controlled packing of all documents into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_toxicity(spark, d):
    """Toxicity score of every text after deobfuscation."""
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op5_main_text(spark, d):
    """The main text of every page."""
    return html_blocks.extract_main_text(table(spark, d, "pages"))


@query
def op6_quality(spark, d):
    """Quality score of every text from its statistics."""
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op7_hilbert_shards(spark, d):
    """All documents in 16 shards along a Hilbert curve through their metadata."""
    return hilbert.shard_documents(table(spark, d, "documents"))


@query
def op8_top_products(spark, d):
    """The 10 largest integer inner products of every hundredth vector, exactly."""
    return topk.top_products(table(spark, d, "embeddings"))


@query
def op9_multi_index(spark, d):
    """20 near neighbours of every twentieth vector."""
    return multi_index.nearest(table(spark, d, "embeddings"))


@query
def op10_secrets(spark, d):
    """Credential spans of every text, with ownership counted over the corpus."""
    return secret_scan.scan_secrets(table(spark, d, "documents"))


@query
def op11_resample(spark, d):
    """A tenth of the documents, drawn to follow the benchmark's words."""
    return resample.resample(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("n_words")


@query
def op12_fill_middle(spark, d):
    """Every text, half of them cut in three and put out with the middle last."""
    return fill_middle.fill_in_middle_digests(table(spark, d, "documents"))


@query
def op13_decontaminate(spark, d):
    """The benchmark passages in every document."""
    return decontaminate.contamination_digests(table(spark, d, "documents"), table(spark, d, "benchmark"))


def registry() -> dict[str, Query]:
    return dict(REGISTRY)

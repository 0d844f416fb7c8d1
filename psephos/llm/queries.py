"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from psephos.llm import byte_bpe, license_scan, matroska, near_dedup, packing, pii, quality_ledger, token_blocks, toxicity, warc
from psephos.llm.common import ship, table
from psephos.llm.oracles import oracle_sql

__all__ = ["oracle_sql", "queries"]

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: For the registered queries over synthetic tables alone: whoever reads this can undo these surrogates.
TEST_KEY = "for synthetic tables only"


def pii_key(spark: SparkSession) -> bytes:
    """The key of surrogates, from the session; without one, the test key and a warning."""
    key = spark.conf.get("spark.psephos.pii.key", "")
    if not key:
        warnings.warn("spark.psephos.pii.key isn't set: surrogates under the public test key can be undone", stacklevel=2)
    return (key or TEST_KEY).encode()


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.token_file_query(_documents(spark, sf_dir), BYTE_BPE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(_documents(spark, sf_dir), pii_key(spark))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), BYTE_BPE)


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ledger.judged(_documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_documents(spark, sf_dir), BYTE_BPE_MULTI)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_documents(spark, sf_dir))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(_documents(spark, sf_dir))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_token_blocks, op2_toxicity, op3_pii_surrogates, op4_license_scan, op5_warc, op6_packing, op7_quality_ledger, op8_byte_bpe, op9_near_dedup, op10_matroska)}

"""The corpus pipeline: quality rules, toxicity, near-dedup, PII surrogates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents.  ``run`` writes each stage's rows as Parquet to the shared folder
and gives them to the next stage.

All stages take null and empty texts, texts of any length (whole), repeated rows, null doc_ids, ties and
columns beyond those of documents, which they drop whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm import near_dedup, packing, pii, quality_ledger, toxicity
from psephos.llm.common import ship, stored, table
from psephos.llm.queries import BYTE_BPE, pii_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the current policy passes; the rules see each row alone, so no join is needed.

    Null and empty texts have too few words and go; repeated rows and rows without doc_id stay or go each alone.
    """
    ship(spark)
    return quality_ledger.passing(docs).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what isn't predicted toxic, by a model of the labelled rows among ``docs``.

    Null and empty texts have zero features and are judged so; repeated rows are judged alike.  Where labels of a
    doc_id contradict, toxic holds; without labels nothing goes.
    """
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, that of the least doc_id, and one row of it.

    Null and empty texts are copies of each other; rows without doc_id belong to no class and stay.
    """
    ship(spark)
    return near_dedup.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace entities; n_chars follows the new text.

    Null texts stay null (n_chars too), empty ones empty; repeated rows and rows without doc_id are replaced alike.
    """
    ship(spark)
    return pii.with_surrogates(docs.select(*COLUMNS), pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids: one row for each piece.

    Null and empty texts are their end id alone; repeated rows and rows without doc_id are packed each.
    """
    ship(spark)
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", dedup), ("pii", private), ("packing", pack)]

#: Learned models, signatures and tokenizers have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

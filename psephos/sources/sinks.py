"""Sinks: JSON, CSV and history tables.  Spark's commit protocol makes each write whole."""

from __future__ import annotations

import platform
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.sources.files import present

# Columns of the preference facts in their order.
FACTS = ("created_at", "election_id", "random_ballot_id", "ballot_state", "box_location", "image_url", "row_num", "candidate_id", "candidate_name", "preference")


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = "["
    for batch in batches:
        lines = [(before if i == 0 else ",") + line for i, line in enumerate(batch.column(0).to_pylist())]
        if lines:
            before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])


def json_array(df: DataFrame, path: str, pretty: bool = False) -> None:
    """Files that hold one JSON array each, as ``files.manifest`` reads them; nulls and non-ASCII stay."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options).alias("value"))
    rows.mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def preference_csv(facts: DataFrame, path: str) -> None:
    """Facts with a header; an empty table still writes one."""
    facts.select(*FACTS).write.mode("overwrite").option("header", True).csv(path)


def false_negative_csv(missed: DataFrame, path: str) -> None:
    """Missed stamps with their cause first; without any, a header of the cause alone."""
    columns = ["cause", *[c for c in missed.columns if c != "cause"]] if missed.limit(1).count() else ["cause"]
    flat = [F.to_json(c).alias(c) if dict(missed.dtypes)[c].startswith(("array", "struct", "map")) else F.col(c) for c in columns]
    missed.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def ballots_and_preferences(ballots: DataFrame, preferences: DataFrame, path: str, run: str) -> None:
    """Parent then child table, added to the history by election and run.

    Both have election_id.  A run that is repeated replaces its own rows; other elections and runs stay.
    """
    for df, name in ((ballots, "ballot_papers"), (preferences, "ballot_preferences")):
        df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("election_id", "run").parquet(f"{path}/{name}")


def ids_in_use(spark: SparkSession, path: str, election: int, run: str) -> DataFrame | None:
    """Ids that other runs have given out in an election; None where there is no history yet."""
    table = f"{path}/ballot_papers"
    if not present(spark, table):
        return None
    return spark.read.parquet(table).filter((F.col("election_id") == election) & (F.col("run").cast("string") != run)).select("random_ballot_id")


def box_location(df: DataFrame, path: str, as_of: str) -> None:
    """A change of the box location, added to its history."""
    df.withColumn("updated_at", F.lit(as_of).cast("timestamp")).write.mode("append").parquet(path)


def audit_record(spark: SparkSession, inference: DataFrame, model: str, path: str, as_of: str, revision: str = "nogit") -> None:
    """An inference table with the model's hash and the environment, as JSON; rows aren't gathered."""
    content = spark.read.format("binaryFile").load(model).select(F.sha2("content", 256).alias("model_sha256"))
    fields = {"ts": F.date_format(F.lit(as_of).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "host": F.lit(platform.platform()), "python": F.lit(platform.python_version()), "git_rev": F.lit(revision)}
    json_lines(content.select(*[v.alias(k) for k, v in fields.items()], "model_sha256"), f"{path}/record")
    json_array(inference, f"{path}/inference")

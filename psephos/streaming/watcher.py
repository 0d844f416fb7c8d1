"""Watching a folder: new image files since the last look, what is there at the start left out if asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.operators import events
from psephos.sources.files import present

IMAGES = r"\.(png|jpe?g|bmp|tiff?)$"


def watch(spark: SparkSession, path: str, schema: str, most_files: int = 100) -> DataFrame:
    """A stream of listing rows (key first); folders and other types fall away."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    return rows.filter(~F.col("key").endswith("/") & F.lower("key").rlike(IMAGES))


def seeded(stream: DataFrame, existing: DataFrame | None) -> DataFrame:
    """The stream without keys that were there before it started."""
    return stream if existing is None else stream.join(existing.select("key").distinct(), "key", "left_anti")


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Work off what is there and stop; the checkpoint remembers it for the next run."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_newest(stream: DataFrame, order: Column, groups: list[str], sink: str, checkpoint: str) -> None:
    """Of each micro-batch only the newest event of a group goes on; a repeated batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        events.newest(batch, order, groups).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def poll(listing: DataFrame, outcomes: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """One look at a listing (key): what has no success yet is worked on; its outcomes (key, ok, error) are remembered.

    Failures come again with the next poll.  Gives the number of keys that were worked on.
    """
    spark = listing.sparkSession
    todo = listing.select("key").distinct()
    if present(spark, outcomes):
        past = spark.read.parquet(outcomes)
        todo = events.pending(todo, past.filter("ok"), "key")
        number = past.agg(F.max("poll")).first()[0] + 1
    else:
        number = 1
    work(todo).select("key", "ok", "error", F.lit(number).alias("poll")).write.mode("append").parquet(outcomes)
    return spark.read.parquet(outcomes).filter(F.col("poll") == number).count()

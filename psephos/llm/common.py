"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from psephos.session import remove_path, ship
from psephos.session import shared_path as scratch

__all__ = ["discard", "one_thread", "scratch", "ship", "slices", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever else the table has is pruned at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame | None) -> None:
    """Remove stored tables once all that was made of them is stored itself; others go with the application."""
    for table in tables:
        if table is not None and (path := vars(table).get("_stored_at")):
            remove_path(table.sparkSession, path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each part holds few rows and bytes; a single long text stays whole."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows, batch.num_rows - at)
            part = batch.slice(at, take)
            while take > 1 and part.nbytes > chars:
                take = (take + 1) // 2
                part = batch.slice(at, take)
            yield part
            at += take


def one_thread() -> None:
    """Keep the tokenizer library to the one core that a task owns."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"

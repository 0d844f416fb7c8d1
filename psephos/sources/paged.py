"""A table behind pages: a data source whose filters, columns and order go to the server.

``fetch`` answers one request (see Request) with at most ``limit`` rows; a shorter page is the last one.
Each partition reads every n-th page until a short one, so a scan of unknown length is split without
being counted first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Request(NamedTuple):
    """Equality filters, columns wanted, order, and the page."""

    filters: tuple[tuple[str, object], ...]
    columns: tuple[str, ...]
    order: str
    limit: int
    offset: int


Fetch = Callable[[Request], list[dict]]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, fetch: Fetch, filters: tuple, order: str, page: int, tasks: int):
        self.columns, self.fetch, self.filters, self.order, self.page, self.tasks = tuple(schema.names), fetch, filters, order, page, tasks

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = partition.value * self.page
        while True:
            rows = self.fetch(Request(self.filters, self.columns, self.order, self.page, at))
            yield from (tuple(row.get(c) for c in self.columns) for row in rows)
            if len(rows) < self.page:
                return
            at += self.page * self.tasks


def paged(spark: SparkSession, fetch: Fetch, schema: str, order: str, filters: dict[str, object] | None = None, page: int = 1000, tasks: int = 4, required: bool = False) -> DataFrame:
    """The rows that pass the filters; only the schema's columns are asked for.  ``required``: no rows are an error."""
    wanted = tuple(sorted((filters or {}).items()))
    if required and not fetch(Request(wanted, tuple(StructType.fromDDL(schema).names), order, 1, 0)):
        raise LookupError(f"no rows for {dict(wanted)}")

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "psephos_pages"

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(schema, fetch, wanted, order, page, tasks)

    spark.dataSource.register(Pages)
    return spark.read.format("psephos_pages").load()


def known(fetch: Fetch, column: str, value: object) -> bool:
    """Point lookup: one row with that value is asked for."""
    return bool(fetch(Request(((column, value),), (column,), column, 1, 0)))


def listed(spark: SparkSession, fetch: Fetch, prefix: str, page: int = 1000) -> DataFrame:
    """Keys below a prefix, page by page: (key, size); folders (keys that end in a slash) fall away."""
    return paged(spark, fetch, "key string, size long", "key", {"prefix": prefix}, page, tasks=1).filter("key NOT LIKE '%/'")

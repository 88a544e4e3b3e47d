"""Tables of SQLite files through Python's own library, read-only.

A table is read in one transaction, so rows are of one moment while its owner goes on writing; such
stores have thousands of rows. ``partitions`` above 1 gives up that and reads ranges of rowids.

Every error ends in no rows and a note, as a source that cannot be read must not stop the others.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rows(InputPartition):
    """Rows of a range of rowids, or all."""

    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _fitted(value: object, kind: T.DataType) -> object:
    """A value of SQLite's dynamic types as the column's type; null if it is of another kind."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    try:
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except (TypeError, ValueError):
        return None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "1"))

    def partitions(self) -> list[Rows]:
        if self.parts == 1:
            return [Rows(None, None)]
        with closing(opened(self.path)) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(at, min(high + 1, at + step)) for at in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        kinds = [f.dataType for f in self.schema.fields]
        some, bounds = (" WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)) if partition.low is not None else ("", ())
        with closing(opened(self.path)) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}"{some}', bounds):
                yield tuple(map(_fitted, row, kinds))


class SqliteTable(DataSource):
    """``format("sqlite_table")`` with ``path``, ``table`` and a schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


def problem(path: str, table: str, schema: T.StructType) -> str | None:
    """What keeps the table from being read, or None."""
    try:
        with closing(opened(path)) as db:
            db.execute(f"SELECT {', '.join(f'"{f.name}"' for f in schema.fields)} FROM \"{table}\" LIMIT 0")
    except sqlite3.Error as error:
        return str(error)
    return None


def scan(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").schema(schema).option("path", os.path.abspath(path)).option("table", table).load()

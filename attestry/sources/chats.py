"""Chats of a SQLite file as a data source: spark.read.format("sqlite_chats").option("path", …).load()."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class RowRange(InputPartition):
    """Rows from one row id to another, or with first None the newest rows."""

    def __init__(self, first: int | None, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class ChatsReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.names = options["path"], options.get("table", "chat"), schema.names
        self.order, self.newest = options.get("order", "updated_at"), int(options.get("newest", 0))
        self.parts = int(options.get("partitions", 8))

    def _rows(self, sql: str, *values: int) -> Iterator[tuple]:
        """The file is opened for reading only, so that a server may go on writing to it."""
        with sqlite3.connect(f"file:{self.path.removeprefix('file://')}?mode=ro", uri=True) as base:
            yield from base.execute(sql, values)

    def partitions(self) -> list[InputPartition]:
        if self.newest:
            return [RowRange(None, self.newest)]
        low, high = next(self._rows(f'SELECT min(rowid), max(rowid) FROM "{self.table}"'))
        if low is None:
            return [RowRange(0, -1)]  # no rows
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        columns = ", ".join(f'"{n}"' for n in self.names)
        if partition.first is None:
            return self._rows(f'SELECT {columns} FROM "{self.table}" ORDER BY "{self.order}" DESC, rowid LIMIT ?', partition.last)
        return self._rows(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', partition.first, partition.last)


class Chats(DataSource):
    """Options: path (a file that the driver and all executors see), table, partitions (ranges of row ids), and newest: the newest rows by
    the column `order` only, so many at most, which SQLite picks by its index. Columns are those of the given schema."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_chats"

    def schema(self) -> str:
        return "id string, user_id string, title string, chat string, updated_at long"

    def reader(self, schema: StructType) -> ChatsReader:
        return ChatsReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Chats)

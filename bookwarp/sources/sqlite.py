"""A data source for SQLite files, read-only but for ``write_values``, with the columns, filters and ranges that a scan needs pushed into SQLite.

``spark.read.format("sqlite").option("table", "books").load(path)``.  Options: ``columns`` (comma-separated), ``limit``,
``partitions`` with ``partition_column`` (ranges of an integer column, read in parallel).  Comparisons with constants on
plain columns are evaluated by SQLite.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

# SQL types by declared type.
TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "FLOAT": "double", "BOOL": "boolean", "BOOLEAN": "boolean", "BLOB": "binary"}
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def column_types(path: str, table: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of a table."""
    with _connect(path) as db:
        return [(r[1], TYPES.get((r[2] or "").upper().split("(")[0], "string")) for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        types = column_types(self.options["path"], self.options["table"])
        if not types:
            raise ValueError(f"no such table: {self.options['table']}")
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        chosen = [t for t in types if not wanted or t[0] in wanted]
        return ", ".join(f"`{n}` {t}" for n, t in chosen)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.limit = int(options["limit"]) if "limit" in options else None
        self.parts, self.column = int(options.get("partitions", 1)), options.get("partition_column")
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and isinstance(f, IsNotNull):
                self.where.append((f"{_quoted(column[0])} IS NOT NULL", None))
            elif len(column) == 1 and type(f) in COMPARISONS and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append((f"{_quoted(column[0])} {COMPARISONS[type(f)]} ?", f.value))
            else:
                yield f

    def partitions(self):
        if self.parts <= 1 or not self.column:
            return [Range(None, None)]
        with _connect(self.path) as db:
            low, high = db.execute(f"SELECT min({_quoted(self.column)}), max({_quoted(self.column)}) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a if a > low else None, a + step if a + step <= high else None) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = [w for w, _ in self.where], [v for w, v in self.where if w.endswith("?")]
        if partition.low is not None:
            where.append(f"{_quoted(self.column)} >= ?")
            values.append(partition.low)
        if partition.high is not None:
            # rows without a value of the column go with the first range
            where.append(f"({_quoted(self.column)} < ?" + (f" OR {_quoted(self.column)} IS NULL)" if partition.low is None else ")"))
            values.append(partition.high)
        flags = [f.dataType.typeName() == "boolean" for f in self.schema.fields]
        sql = f"SELECT {', '.join(_quoted(f.name) for f in self.schema.fields)} FROM {_quoted(self.table)}"
        sql += f" WHERE {' AND '.join(where)}" if where else ""
        sql += f" LIMIT {self.limit}" if self.limit is not None else ""
        with _connect(self.path) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            for row in db.execute(sql, values):
                yield tuple((None if v is None else bool(v)) if flag else v for v, flag in zip(row, flags, strict=True))


def read_sqlite(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    """A table of a SQLite file."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite").option("path", str(path)).option("table", table)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def write_values(path: str, table: str, column: str, on: list[str], rows: Iterator[tuple] | list[tuple]) -> int:
    """Sets a column where the key columns have the given values, in one transaction: rows are (value, *keys).

    The database's own function for sort titles is at hand, since its triggers may call it.  Returns the rows changed.
    """
    with closing(sqlite3.connect(path)) as db, db:
        db.create_function("title_sort", 1, sort_title)
        where = " AND ".join(f"{_quoted(k)} = ?" for k in on)
        return db.executemany(f"UPDATE {_quoted(table)} SET {_quoted(column)} = ? WHERE {where}", rows).rowcount


def sort_title(title: str | None) -> str | None:
    """The title with a leading English article moved behind."""
    first, _, rest = (title or "").strip().partition(" ")
    return f"{rest}, {first}" if first.lower() in ("a", "an", "the") and rest else title


def table_names(path: str) -> list[str]:
    with _connect(str(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def read_catalogue(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table of a SQLite catalogue."""
    return {name: read_sqlite(spark, path, name) for name in table_names(path)}


def describe(path: str) -> dict[str, dict[str, list[tuple]]]:
    """Columns, foreign keys and indexes of every table."""
    out = {}
    with _connect(str(path)) as db:
        for name in table_names(path):
            pragma = lambda what, name=name: [tuple(r) for r in db.execute(f"PRAGMA {what}({_quoted(name)})")]
            out[name] = {"columns": pragma("table_info"), "foreign_keys": pragma("foreign_key_list"), "indexes": pragma("index_list")}
    return out


def schema_text(path: str) -> str:
    """The columns of every table as text."""
    lines = []
    for name, parts in describe(path).items():
        lines.append(name)
        lines += [f"  {c[1]} {c[2] or 'ANY'}{' NOT NULL' if c[3] else ''}{' PRIMARY KEY' if c[5] else ''}" for c in parts["columns"]]
        lines += [f"  {k[3]} -> {k[2]}.{k[4]}" for k in parts["foreign_keys"]]
    return "\n".join(lines) + "\n"

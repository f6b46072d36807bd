"""Column chunks of Parquet files: what footers state, what dictionary pages hold, and scans of single chunks.

A unit of work is one row group of one file.  The list of files is a DataFrame (only their paths are read), footers are
read in tasks, and the row groups are dealt out to tasks again, so neither files nor chunks pass through the driver.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the Parquet format: page types and the encodings of dictionary indices.
DICTIONARY_PAGE = 2
DATA_PAGES = (0, 3)
INDEXED = (2, 8)
PER_SECOND = {"s": 1_000_000, "ms": 1_000, "us": 1}


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of all Parquet files at a path; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"))


def opened(uri: str):
    """A random-access file of any file system that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def kind_of(arrow_type) -> str:
    """s, b, i (integers, dates, moments) or d; empty for types that aren't profiled: nested, decimal, binary."""
    from pyarrow import types as t

    if t.is_string(arrow_type) or t.is_large_string(arrow_type):
        return "s"
    if t.is_boolean(arrow_type):
        return "b"
    if t.is_integer(arrow_type) or t.is_date32(arrow_type) or (t.is_timestamp(arrow_type) and arrow_type.unit in PER_SECOND):
        return "i"
    return "d" if t.is_floating(arrow_type) else ""


class Header:
    """A page header in thrift's compact form, as nested {field number: value}."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.fields = self._struct()

    def _byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def _number(self) -> int:
        out = shift = 0
        while (b := self._byte()) & 0x80:
            out |= (b & 0x7F) << shift
            shift += 7
        return out | b << shift

    def _signed(self) -> int:
        n = self._number()
        return n >> 1 ^ -(n & 1)

    def _value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self._byte()
        if kind in (4, 5, 6):
            return self._signed()
        if kind == 7:
            self.at += 8
            return struct.unpack("<d", self.data[self.at - 8 : self.at])[0]
        if kind == 8:
            n = self._number()
            if self.at + n > len(self.data):
                raise IndexError
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (9, 10):
            b = self._byte()
            n = b >> 4 if b >> 4 < 15 else self._number()
            return [self._value(b & 15) for _ in range(n)]
        if kind == 12:
            return self._struct()
        raise ValueError(f"type {kind} in a page header")

    def _struct(self) -> dict:
        out, number = {}, 0
        while b := self._byte():
            number = number + (b >> 4) if b >> 4 else self._signed()
            out[number] = self._value(b & 15)
        return out


def _header(handle, at: int) -> tuple[dict, int]:
    """The page header at a place of a file and where the page begins."""
    size = 512
    while True:
        data = handle.read_at(size, at)
        try:
            h = Header(data)
            return h.fields, at + h.at
        except IndexError:
            if len(data) < size:
                raise
            size *= 16


def dictionary_values(handle, column) -> list | None:
    """All different values of a column chunk from its dictionary page alone, or nothing if some page isn't indexed.

    Only headers of data pages are read.  Every entry of a dictionary is a value of the chunk, as writers make them so.
    """
    import pyarrow as pa

    start = column.dictionary_page_offset
    if not column.has_dictionary_page or start is None or column.physical_type not in ("BYTE_ARRAY", "INT64", "INT32", "DOUBLE", "FLOAT"):
        return None
    header, begin = _header(handle, start)
    if header.get(1) != DICTIONARY_PAGE:
        return None
    raw, size, count = handle.read_at(header[3], begin), header[2], header[7][1]
    at, end, seen = begin + header[3], start + column.total_compressed_size, 0
    while at < end and seen < column.num_values:
        page, begin = _header(handle, at)
        if page.get(1) in DATA_PAGES:
            inner = page.get(5) or page.get(8)
            if inner[2 if 5 in page else 4] not in INDEXED:
                return None
            seen += inner[1]
        at = begin + page[3]
    if seen < column.num_values:
        return None
    data = raw if column.compression == "UNCOMPRESSED" else pa.decompress(raw, size, column.compression.lower(), asbytes=True)
    if column.physical_type == "BYTE_ARRAY":
        out, at = [], 0
        for _ in range(count):
            n = int.from_bytes(data[at : at + 4], "little")
            out.append(data[at + 4 : at + 4 + n].decode())
            at += 4 + n
        return out
    return np.frombuffer(data, dtype={"INT64": "<i8", "INT32": "<i4", "DOUBLE": "<f8", "FLOAT": "<f4"}[column.physical_type], count=count).tolist()


class Chunks:
    """The column chunks of one row group."""

    def __init__(self, file: str, handle, group: int):
        import pyarrow.parquet as pq

        self.file, self.handle, self.number = file, handle, group
        self.parquet = parquet = pq.ParquetFile(handle)
        self.group = parquet.metadata.row_group(group)
        self.rows = self.group.num_rows
        self.place = {self.group.column(i).path_in_schema: i for i in range(self.group.num_columns)}
        self.types = {f.name: f.type for f in parquet.schema_arrow}

    def kind(self, column: str) -> str:
        return kind_of(self.types[column]) if column in self.place else ""

    def _moment(self, column: str, x: int) -> int:
        """Moments in microseconds, whatever the file's unit."""
        return x * PER_SECOND[self.types[column].unit] if hasattr(self.types[column], "unit") and hasattr(self.types[column], "tz") else x

    def stated(self, column: str):
        return self.group.column(self.place[column]).statistics

    def nulls(self, column: str) -> int | None:
        s = self.stated(column)
        return s.null_count if s is not None and s.has_null_count else None

    def constant(self, column: str) -> tuple[bool, object]:
        """(known, value): the only value of the rows that aren't null, where footers prove it.

        Bounds may be cut short, but if both are equal every value lies between them.  Floating-point bounds leave NaN out
        and prove nothing.
        """
        s = self.stated(column)
        if s is None or not s.has_min_max or self.kind(column) in ("d", "") or self.nulls(column) is None or s.min_raw != s.max_raw:
            return False, None
        return True, s.min if self.kind(column) in ("s", "b") else self._moment(column, int(s.min_raw))

    def bounds(self, column: str) -> tuple[int, int]:
        """Least and greatest value of a column of integers, dates or moments."""
        s = self.stated(column)
        return self._moment(column, int(s.min_raw)), self._moment(column, int(s.max_raw))

    def distinct(self, column: str) -> list | None:
        """Different values from the dictionary page."""
        found = dictionary_values(self.handle, self.group.column(self.place[column]))
        if found is None or self.kind(column) in ("s", "d"):
            return found
        return [self._moment(column, x) for x in found] if self.kind(column) == "i" else None

    def scan(self, columns: list[str]):
        """The named column chunks, texts as indices into a dictionary, moments in microseconds."""
        import pyarrow as pa

        texts = [c for c in columns if self.kind(c) == "s"]
        if texts:
            import pyarrow.parquet as pq

            parquet = pq.ParquetFile(self.handle, read_dictionary=texts)
        else:
            parquet = self.parquet
        table = parquet.read_row_group(self.number, columns=columns)
        out = {}
        for c in columns:
            a = table.column(c).combine_chunks()
            a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
            if self.kind(c) == "i":
                if pa.types.is_timestamp(a.type):
                    a = a.cast(pa.timestamp("us", a.type.tz))
                a = a.cast(pa.int32() if pa.types.is_date32(a.type) else a.type).cast(pa.int64())
            out[c] = a
        return out


def over_chunks(spark: SparkSession, paths: dict[str, str], each: Callable[[str, Chunks], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``each(table, chunks)`` gives for every row group of all tables, in tasks."""
    files = None
    for tbl, path in paths.items():
        part = parquet_files(spark, path).withColumn("tbl", F.lit(tbl))
        files = part if files is None else files.unionByName(part)

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for tbl, uri in zip(batch["tbl"], batch["file"], strict=True):
                with opened(uri) as handle:
                    rows += [(tbl, uri, g) for g in range(pq.ParquetFile(handle).metadata.num_row_groups)]
            yield pd.DataFrame(rows, columns=["tbl", "file", "chunk"]).astype({"chunk": "int32"})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for tbl, uri, g in zip(batch["tbl"], batch["file"], batch["chunk"], strict=True):
                with opened(uri) as handle:
                    rows = list(each(tbl, Chunks(uri, handle, g)))
                yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.mapInPandas(groups, "tbl string, file string, chunk int").repartition(tasks).mapInPandas(work, schema)

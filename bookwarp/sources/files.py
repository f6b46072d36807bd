"""CSV files, folders of Parquet tables and JSON settings."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns texts; a byte order mark is skipped and quoted line breaks belong to the value."""
    if "://" not in str(path) and not Path(path).exists():
        raise FileNotFoundError(f"CSV file not found: {path}")
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).option("encoding", "UTF-8").csv(str(path))
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Parquet tables <folder>/<name>.parquet."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def first_books(books: DataFrame, limit: int) -> DataFrame:
    return books.orderBy("id").limit(limit)


def catalog_text(tables: dict[str, DataFrame]) -> str:
    """The columns of DataFrames as text."""
    return "\n".join("\n".join([name, *(f"  {c} {t}" for c, t in df.dtypes)]) for name, df in sorted(tables.items())) + "\n"


def read_settings(path: str | Path) -> dict:
    """Settings from JSON; absent or unreadable ones are empty, and the database lies in the library unless stated."""
    try:
        settings = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    if not isinstance(settings, dict):
        return {}
    if settings.get("library") and not settings.get("metadata_db"):
        settings["metadata_db"] = str(Path(settings["library"]) / "metadata.db")
    return settings

"""Reading the parquet tables and cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the session's ``spark.checkpoint.dir``.  A machine-local one is made only where that setting is
    absent and the session runs in one machine; elsewhere a missing folder is an error, since its executors share none.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="bookwarp-ckpt-"))
    return df.checkpoint(eager=True)


def latest(df: DataFrame, key: str, when: str, *fields: str) -> DataFrame:
    """One row per ``key`` with the fields of the row that arrived last (ties: the greatest values)."""
    packed = F.max(F.struct(F.col(when), *[F.col(f) for f in fields])).alias("_last")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, f"_last.{when}", *[f"_last.{f}" for f in fields])


def latest_fields(df: DataFrame, key: str, when: str, *fields: str) -> DataFrame:
    """One row per ``key`` with each field as the row that arrived last has it (of several at once, the greatest).

    Every field is an aggregate of its own, so that fields which a query doesn't use are neither read nor shuffled.
    """
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.struct(F.col(when), F.col(f)))[f].alias(f) for f in fields])


def blank(column) -> F.Column:
    """Null, or nothing but white space."""
    return column.isNull() | column.rlike(r"(?U)^\s*$")

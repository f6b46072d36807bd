"""Answers kept by the hash of their address, one JSON file each, with a time to live."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEEK = 7 * 24 * 3600


class ResponseCache:
    """A folder of answers; entries that are too old or unreadable count as absent."""

    def __init__(self, folder: str | Path, ttl: float = WEEK, clock=time.time):
        self.folder, self.ttl, self.clock = Path(folder), ttl, clock

    def place(self, url: str) -> Path:
        return self.folder / f"{hashlib.sha256(url.encode()).hexdigest()}.json"

    def get(self, url: str):
        try:
            entry = json.loads(self.place(url).read_text(encoding="utf-8"))
            return None if self.clock() - entry["cached_at"] > self.ttl else entry["data"]
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def set(self, url: str, data) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self.place(url).write_text(json.dumps({"cached_at": self.clock(), "data": data}), encoding="utf-8")


def fresh(entries: DataFrame, cached_at: str = "cached_at", now: str = "now", ttl: float = WEEK) -> DataFrame:
    """The entries that are not older than the time to live."""
    return entries.filter(F.col(now) - F.col(cached_at) <= ttl)


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(key, cached_at, data) of all entries of a folder; unreadable ones are left out."""
    raw = spark.read.option("wholetext", True).text(str(folder)).select(F.regexp_extract(F.input_file_name(), r"([0-9a-f]{64})\.json$", 1).alias("key"), "value")
    return raw.select("key", F.get_json_object("value", "$.cached_at").cast("double").alias("cached_at"), F.get_json_object("value", "$.data").alias("data")).filter("key <> '' and cached_at is not null")


def cached_answers(requests: DataFrame, entries: DataFrame, now: float, ttl: float = WEEK) -> DataFrame:
    """Requests (with ``url``) with the answer kept for them, null if there is none."""
    kept = fresh(entries.withColumn("now", F.lit(now)), ttl=ttl).select("key", F.col("data").alias("body"))
    return requests.withColumn("key", F.sha2("url", 256)).join(kept, "key", "left").drop("key")

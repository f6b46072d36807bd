"""Positions within series that occur twice, and whole positions that are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bookwarp.functions.text import listed, short_number


def _placed(books: DataFrame) -> DataFrame:
    return books.filter("series is not null and series_index > 0").select("id", F.col("series.name").alias("series_name"), "series_index")


def duplicate_positions(books: DataFrame) -> DataFrame:
    """(series_name, series_index, book_ids): positions above 0 that several books of one series name claim."""
    return _placed(books).groupBy("series_name", "series_index").agg(F.array_sort(F.collect_list("id")).alias("book_ids")).filter(F.size("book_ids") > 1)


def gaps(books: DataFrame) -> DataFrame:
    """(series_name, missing, low, high): whole positions absent between the least and the greatest of a series.

    Each present position looks at the next one, so no series is expanded beyond what it lacks.
    """
    whole = _placed(books).filter("series_index = floor(series_index)").select("series_name", F.col("series_index").cast("bigint").alias("at")).distinct()
    after = F.lead("at").over(Window.partitionBy("series_name").orderBy("at"))
    steps = whole.withColumn("next", after)
    missing = F.when(F.col("next") > F.col("at") + 1, F.sequence(F.col("at") + 1, F.col("next") - 1)).otherwise(F.array().cast("array<bigint>"))
    found = steps.withColumn("m", missing).groupBy("series_name").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("missing"), F.min("at").alias("low"), F.max("at").alias("high"))
    return found.filter(F.size("missing") > 0)


def series_issues(books: DataFrame) -> DataFrame:
    """(series_name, issue_type, detail): duplicates by position, then the gap, of every series."""
    twice = duplicate_positions(books).select("series_name", F.lit("duplicate_position").alias("issue_type"), F.concat(F.lit("position "), short_number("series_index"), F.lit(" used by books "), listed("book_ids")).alias("detail"))
    lacking = gaps(books).select("series_name", F.lit("gap").alias("issue_type"), F.concat(F.lit("missing position(s) "), listed("missing"), F.lit(" between "), F.col("low").cast("string"), F.lit(" and "), F.col("high").cast("string")).alias("detail"))
    return twice.unionByName(lacking)

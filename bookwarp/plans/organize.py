"""Where each book's folder and files should be: Author/Title, numbered where two books want one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwarp.functions.text import path_component


def organize_plan(books: DataFrame) -> DataFrame:
    """(book_id, title, author, current_path, proposed_path, format_renames, folder_changed, has_changes).

    The first book in the order of ids keeps the plain path; paths that differ in case only count as one place.
    """
    first = F.try_element_at("authors", F.lit(1))["name"]
    author = path_component(F.when(F.size("authors") > 0, first).otherwise("Unknown"))
    title = path_component("title", F.concat(F.lit("Untitled ("), F.col("id").cast("string"), F.lit(")")))
    rows = books.withColumn("_author", author).withColumn("_title", title).withColumn("_path", F.concat_ws("/", "_author", "_title"))
    # the least id of each place is aggregated before the shuffle, so a place that very many books want is no hot window
    holders = rows.groupBy(F.lower("_path").alias("_place")).agg(F.min("id").alias("_holder"))
    rows = rows.withColumn("_place", F.lower("_path")).join(holders, "_place")
    path = F.when(F.col("id") == F.col("_holder"), F.col("_path")).otherwise(F.concat(F.col("_path"), F.lit(" ("), F.col("id").cast("string"), F.lit(")")))
    renames = F.transform("format_files", lambda f: F.struct(f["format"].alias("format"), f["name"].alias("old_name"), F.col("_title").alias("new_name")))
    out = rows.select(F.col("id").alias("book_id"), "title", F.col("_author").alias("author"), F.col("path").alias("current_path"), path.alias("proposed_path"), renames.alias("format_renames"))
    out = out.withColumn("folder_changed", F.col("current_path") != F.col("proposed_path"))
    return out.withColumn("has_changes", F.col("folder_changed") | F.exists("format_renames", lambda r: r["old_name"] != r["new_name"]))


def plan_report(plan: DataFrame) -> DataFrame:
    """The plan with the changed names as one text."""
    changed = F.filter("format_renames", lambda r: r["old_name"] != r["new_name"])
    shown = F.array_join(F.transform(changed, lambda r: F.concat(r["old_name"], F.lit(" -> "), r["new_name"])), "; ")
    return plan.select("book_id", "title", "author", "current_path", "proposed_path", shown.alias("format_renames"))

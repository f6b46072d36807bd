"""Changes of tables as new DataFrames: titles, paths, covers, file names, merged authors.

Nothing is changed in place; a change is a join with the table of changes, and the former table stays as the backup.
"""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwarp.functions.text import title_sort

# Messages.
MANUAL = "No suggested value - needs manual review"
UNKNOWN_FIELD = "Don't know how to apply repairs to field "


def updated(table: DataFrame, changes: DataFrame, on: list[str], column: str, value: str = "new_value") -> DataFrame:
    """``table`` with ``column`` replaced where ``changes`` (on..., value) has a row; a key with several rows takes the greatest value."""
    new = changes.groupBy(*on).agg(F.max(F.struct(F.lit(1).alias("hit"), F.col(value).alias("v"))).alias("_n"))
    joined = table.join(new, on, "left")
    return joined.withColumn(column, F.when(F.col("_n.hit").isNotNull(), F.col("_n.v")).otherwise(F.col(column))).select(*table.columns)


def retitled(books: DataFrame, changes: DataFrame) -> DataFrame:
    """Books with new titles from (id, new_value); the sort title follows where the title changed."""
    before = books.withColumn("_old", F.col("title"))
    after = updated(before, changes, ["id"], "title")
    return after.withColumn("sort", F.when(F.col("title").eqNullSafe(F.col("_old")), F.col("sort")).otherwise(title_sort("title"))).select(*books.columns)


def repair_results(suggestions: DataFrame) -> DataFrame:
    """(book_id, field, suggested_value, applied, error) of applying suggestions: only titles with a value can be."""
    error = F.when(F.coalesce("suggested_value", F.lit("")) == "", F.lit(MANUAL)).when(F.col("field") != "title", F.concat(F.lit(UNKNOWN_FIELD + "'"), F.col("field"), F.lit("'")))
    return suggestions.select("book_id", "field", "suggested_value", error.isNull().alias("applied"), F.coalesce(error, F.lit("")).alias("error"))


def apply_repairs(books: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Books with all suggestions applied that can be."""
    good = repair_results(suggestions).filter("applied").select(F.col("book_id").alias("id"), F.col("suggested_value").alias("new_value"))
    return retitled(books, good)


def moved_books(books: DataFrame, plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Books with the paths of an organize plan, but for the books in ``failed`` (book_id)."""
    moves = plan.filter("folder_changed").select(F.col("book_id").alias("id"), F.col("proposed_path").alias("new_value"))
    if failed is not None:
        moves = moves.join(failed.select(F.col("book_id").alias("id")), "id", "left_anti")
    return updated(books, moves, ["id"], "path")


def renamed_files(data: DataFrame, plan: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Files (book, format, name, ...) with the names of an organize plan, but for those in ``failed`` (book_id, format)."""
    names = plan.select(F.col("book_id").alias("book"), F.explode("format_renames").alias("r")).filter("r.old_name <> r.new_name").select("book", "r.format", F.col("r.new_name").alias("new_value"))
    if failed is not None:
        names = names.join(failed.select(F.col("book_id").alias("book"), "format"), ["book", "format"], "left_anti")
    return updated(data, names, ["book", "format"], "name")


def with_covers(books: DataFrame, saved: DataFrame) -> DataFrame:
    """Books that have a cover now: those in ``saved`` (book_id)."""
    return updated(books, saved.select(F.col("book_id").alias("id"), F.lit(True).alias("new_value")), ["id"], "has_cover")


def merge_map(groups: DataFrame) -> DataFrame:
    """(author, canonical) from groups with a canonical id and an array of duplicates."""
    return groups.select(F.explode("duplicate_author_ids").alias("author"), F.col("canonical_author_id").alias("canonical")).filter("author <> canonical").groupBy("author").agg(F.min("canonical").alias("canonical"))


def merged_links(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(book, author) after the duplicates gave their links to the canonical authors, each pair once."""
    to = merge_map(groups)
    return links.join(to, "author", "left").select("book", F.coalesce("canonical", "author").alias("author")).distinct()


def merged_authors(authors: DataFrame, groups: DataFrame) -> DataFrame:
    """The authors without the merged duplicates."""
    return authors.join(merge_map(groups).select(F.col("author").alias("id")), "id", "left_anti")


def outcome_counts(results: DataFrame, done: Column) -> DataFrame:
    """(done, failed) of a table of results with an ``error`` column."""
    return results.agg(F.count_if(done).alias("done"), F.count_if(F.col("error") != "").alias("failed"))


def snapshot(table: DataFrame, folder: str, name: str, at: datetime | None = None) -> str:
    """Writes a table beside its earlier backups and returns the place."""
    place = f"{folder}/{name}.{(at or datetime.now()):%Y%m%d_%H%M%S}.bak"
    table.write.mode("overwrite").parquet(place)
    return place


def backup_file(path: str | Path, at: datetime | None = None) -> Path:
    """Copies a database file to <stem>.<time>.bak beside it."""
    import shutil

    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"Database not found: {path}")
    target = path.with_name(f"{path.stem}.{(at or datetime.now()):%Y%m%d_%H%M%S}.bak")
    shutil.copy2(path, target)
    return target

"""All findings about a library at once, and the dashboard's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwarp.functions.text import strip
from bookwarp.operators.duplicates import isbn_groups, title_groups
from bookwarp.operators.score import analysis, scored
from bookwarp.operators.series import series_issues
from bookwarp.operators.statistics import summary
from bookwarp.stage import cut


def inspection(books: DataFrame) -> dict[str, DataFrame]:
    """The result sets of a full inspection, each lazy."""
    return {"analyses": analysis(books), "isbn_groups": isbn_groups(books), "title_groups": title_groups(books), "series_issues": series_issues(books), "scores": scored(books)}


def dashboard(books: DataFrame) -> DataFrame:
    """(label, value) of the tiles; the books are evaluated once, of a description only whether there is one."""
    told = F.when(strip("comments") == "", F.col("comments")).otherwise(F.lit("-"))
    kept = ("id", "title", "authors", "series", "series_index", "publisher", "isbn", "languages", "formats", "has_cover")
    books = cut(books.select(*kept, told.alias("comments")))
    # Labels by metric.
    labels = {"total_books": "Total books", "unique_authors": "Unique authors", "unique_series": "Unique series", "average_metadata_score": "Average health score", "missing_isbn": "Missing ISBN", "missing_cover": "Missing cover", "missing_description": "Missing description"}
    named = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    counts = summary(books).select(named[F.col("metric")].alias("label"), "value").filter("label is not null")
    extra = {"Books needing attention": analysis(books).filter("needs_attention"), "ISBN duplicate groups": isbn_groups(books), "Title duplicate groups": title_groups(books), "Series order issues": series_issues(books)}
    for label, rows in extra.items():
        counts = counts.unionByName(rows.agg(F.count("*").alias("value")).select(F.lit(label).alias("label"), "value"))
    return counts

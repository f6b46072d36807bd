"""Result tables in the shapes that reports have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwarp.operators.assemble import author_names, series_name
from bookwarp.operators.duplicates import duplicate_report
from bookwarp.operators.score import analysis, repair_suggestions, score, scored
from bookwarp.operators.series import series_issues
from bookwarp.operators.statistics import statistics_long, summary
from bookwarp.plans.organize import organize_plan, plan_report


def health(books: DataFrame) -> DataFrame:
    return scored(books).select("book_id", "title", "score", F.array_join("failed", ", ").alias("failed_checks"))


def library_analysis(books: DataFrame) -> DataFrame:
    shown = F.transform("repair_suggestions", lambda s: F.concat(s["field"], F.lit(": "), F.when(s["suggested_value"] == "", "(review manually)").otherwise(s["suggested_value"])))
    return analysis(books).select("book_id", "title", "score", F.array_join("failed_checks", ", ").alias("failed_checks"), F.array_join("issues", "; ").alias("issues"), F.array_join(shown, "; ").alias("repair_suggestions"))


def health_summary(books: DataFrame) -> DataFrame:
    return summary(books).filter("metric <> 'missing_series'")


def search_results(books: DataFrame) -> DataFrame:
    return books.select(F.col("id").alias("book_id"), "title", author_names().alias("author"), series_name().alias("series"), "rating", score().alias("metadata_score"), "isbn", F.array_join("formats", ", ").alias("formats"), "has_cover")


REPORTS = {
    "health": health, "analysis": library_analysis, "repair": repair_suggestions, "summary": health_summary, "series": series_issues,
    "statistics": statistics_long, "organize": lambda books: plan_report(organize_plan(books)), "search": search_results,
}
DUPLICATES = duplicate_report

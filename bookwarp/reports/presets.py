"""Short texts of reports, for a screen."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bookwarp.operators.duplicates import isbn_groups, title_groups
from bookwarp.operators.score import average_score, repair_suggestions, worst
from bookwarp.operators.series import series_issues
from bookwarp.operators.statistics import largest_books, summary, top_authors

SHOWN = 20


def lines(df: DataFrame, limit: int = SHOWN) -> list[str]:
    """The first rows, one line each."""
    return ["  ".join("" if v is None else str(v) for v in row) for row in df.limit(limit).collect()]


def preset(name: str, books: DataFrame) -> str:
    """The text of one preset: health, duplicates, series, repairs, statistics."""
    if name == "health":
        body = [f"Average score: {average_score(books).first()[0]}", *lines(worst(books, 10))]
    elif name == "duplicates":
        body = [*lines(isbn_groups(books)), *lines(title_groups(books))]
    elif name == "series":
        body = lines(series_issues(books).orderBy("series_name", "issue_type", "detail"))
    elif name == "repairs":
        body = lines(repair_suggestions(books).orderBy("book_id"))
    elif name == "statistics":
        body = [*lines(summary(books)), *lines(top_authors(books)), *lines(largest_books(books))]
    else:
        raise ValueError(f"Unknown preset: {name!r}")
    return "\n".join(body) if body else "Nothing found."


def failures(results: list, limit: int = 10) -> list[str]:
    """The first failures of applying a plan, and how many more there are."""
    bad = [f"{r.book_id}: {r.error}" for r in results if r.error]
    return bad[:limit] + ([f"... and {len(bad) - limit} more"] if len(bad) > limit else [])

"""Completeness score and validation rules of each book, in one pass without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwarp.functions.text import has_by_clause, isbn_valid, quoted, strip, without_by_clause

# The checks in their order.
CHECKS = ("title", "author", "isbn", "cover", "description")


def _check(name: str) -> Column:
    return {
        "title": strip("title") != "",
        "author": F.size("authors") > 0,
        "isbn": F.col("isbn") != "",
        "cover": F.col("has_cover"),
        "description": strip("comments") != "",
    }[name]


def passed_checks() -> Column:
    return F.array_compact(F.array(*[F.when(_check(c), F.lit(c)) for c in CHECKS]))


def failed_checks() -> Column:
    return F.array_compact(F.array(*[F.when(~_check(c), F.lit(c)) for c in CHECKS]))


def score() -> Column:
    """Percent of the checks passed."""
    return (F.size(passed_checks()) * (100 // len(CHECKS))).cast("int")


def scored(books: DataFrame) -> DataFrame:
    """(book_id, title, score, passed, failed)."""
    return books.select(F.col("id").alias("book_id"), "title", score().alias("score"), passed_checks().alias("passed"), failed_checks().alias("failed"))


def average_score(books: DataFrame) -> DataFrame:
    """(average_score): rounded half to even, 0 without books."""
    return books.agg(F.coalesce(F.bround(F.avg(score())), F.lit(0)).cast("int").alias("average_score"))


def worst(books: DataFrame, limit: int = 10) -> DataFrame:
    """The books of least score, ties by id."""
    return scored(books).select("book_id", "title", "score").orderBy("score", "book_id").limit(limit)


def issues() -> Column:
    """array<struct<code,message>> in the order of the rules; an empty title ends the checks."""
    title = strip("title")
    issue = lambda code, message: F.struct(F.lit(code).alias("code"), message.alias("message"))
    echo = lambda a, part, label: F.when((F.coalesce(a[part], F.lit("")) != "") & (F.lower(title) == F.lower(a[part])), issue("title_matches_author", F.concat(F.lit(f"Title matches the author{label} name ("), quoted(a[part]), F.lit(")"))))
    echoes = F.array_compact(F.flatten(F.transform("authors", lambda a: F.array(echo(a, "name", ""), echo(a, "sort", "'s sort")))))
    rest = F.array_compact(F.array(
        F.when(has_by_clause("title"), issue("title_contains_by_clause", F.lit("Title appears to end with a 'by <author>' clause"))),
        F.when(F.col("series").isNotNull() & (F.col("series_index") == 0), issue("series_index_zero", F.concat(F.lit("In series "), quoted("series.name"), F.lit(" but series_index is 0")))),
        F.when((F.col("isbn") != "") & ~isbn_valid("isbn"), issue("invalid_isbn", F.concat(F.lit("ISBN "), quoted("isbn"), F.lit(" fails checksum validation")))),
    ))
    return F.when(title == "", F.array(issue("empty_title", F.lit("Title is empty")))).otherwise(F.concat(echoes, rest))


def suggestions() -> Column:
    """array<struct<field,current_value,suggested_value,reason>>: repairs of titles; an empty value needs a person."""
    title = strip("title")
    made = lambda value, reason: F.struct(F.lit("title").alias("field"), F.col("title").alias("current_value"), value.alias("suggested_value"), reason.alias("reason"))
    clause = F.when(has_by_clause("title"), made(without_by_clause("title"), F.lit("Title appears to end with a 'by <author>' clause")))
    manual = F.transform("authors", lambda a: F.when((a["name"] != "") & (F.lower(title) == F.lower(a["name"])), made(F.lit(""), F.concat(F.lit("Title matches the author name ("), quoted(a["name"]), F.lit("); the real title is unknown and cannot be suggested automatically")))))
    return F.when(title == "", F.array_compact(F.array(F.lit(None).cast("struct<field:string,current_value:string,suggested_value:string,reason:string>")))).otherwise(F.array_compact(F.concat(F.array(clause), manual)))


def validation_issues(books: DataFrame) -> DataFrame:
    """(book_id, n, code, message): one row per issue, in order."""
    return books.select(F.col("id").alias("book_id"), F.posexplode(issues()).alias("n", "_i")).select("book_id", "n", "_i.code", "_i.message")


def books_with_issues(books: DataFrame) -> DataFrame:
    return books.filter(F.size(issues()) > 0)


def repair_suggestions(books: DataFrame) -> DataFrame:
    """(book_id, field, current_value, suggested_value, reason)."""
    return books.select(F.col("id").alias("book_id"), F.explode(suggestions()).alias("_s")).select("book_id", "_s.*")


def analysis(books: DataFrame) -> DataFrame:
    """Score, failed checks, issues, suggestions and whether a book needs attention, computed once per book."""
    out = books.select(F.col("id").alias("book_id"), "title", score().alias("score"), failed_checks().alias("failed_checks"), F.transform(issues(), lambda i: i["message"]).alias("issues"), suggestions().alias("repair_suggestions"))
    return out.withColumn("needs_attention", (F.col("score") < 100) | (F.size("issues") > 0))

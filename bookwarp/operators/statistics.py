"""Library statistics: counts, rankings and the long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwarp.operators.score import score

# Fixed value: the year that stands for an unknown date.
UNKNOWN_YEAR = "0101"


def _tally(books: DataFrame, *tags: Column) -> DataFrame:
    """(kind, label, n): sums of the (kind, label, n) that arrays of each book give, combined before the only shuffle."""
    every = F.concat(*tags) if len(tags) > 1 else tags[0]
    return books.select(F.explode(every).alias("_t")).groupBy("_t.kind", "_t.label").agg(F.sum("_t.n").alias("n"))


def _tag(kind: str, label, n=1) -> Column:
    number = n if isinstance(n, Column) else F.lit(n)
    return F.struct(F.lit(kind).alias("kind"), (label if isinstance(label, Column) else F.lit(label)).cast("string").alias("label"), number.cast("bigint").alias("n"))


def _tagged(kind: str):
    return lambda x: _tag(kind, x)


def _none() -> Column:
    return F.array().cast("array<struct<kind:string,label:string,n:bigint>>")


def summary(books: DataFrame) -> DataFrame:
    """(metric, value): library-wide counts; one pass, in which a book gives its flags and its names, and one shuffle of the
    different names."""
    flags = {
        "total_books": F.lit(1), "score": score(), "missing_isbn": F.col("isbn") == "", "missing_description": F.col("comments") == "", "missing_cover": ~F.col("has_cover"),
        "missing_publisher": F.col("publisher") == "", "missing_language": F.size("languages") == 0, "missing_series": F.col("series").isNull(),
    }
    own = F.array(*[_tag("", name, F.coalesce(value.cast("bigint"), F.lit(0))) for name, value in flags.items()])
    named = {"unique_authors": F.transform("authors", lambda a: a["name"]), "unique_series": F.array(F.col("series.name")), "unique_formats": F.col("formats")}
    names = [F.transform(F.array_distinct(F.array_compact(values)), _tagged(k)) for k, values in named.items()]
    counted = _tally(books, own, *names)
    total = lambda name: F.coalesce(F.sum(F.when((F.col("kind") == "") & (F.col("label") == name), F.col("n"))), F.lit(0))
    one = counted.agg(
        *[total(name).alias(name) for name in flags if name != "score"], *[F.count_if(F.col("kind") == k).alias(k) for k in named],
        F.coalesce(F.bround(total("score") / F.nullif(total("total_books"), F.lit(0))), F.lit(0)).alias("average_metadata_score"),
    )
    order = ["total_books", "unique_authors", "unique_series", "unique_formats", "average_metadata_score", "missing_isbn", "missing_description", "missing_cover", "missing_publisher", "missing_language", "missing_series"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value")) for n in order]))
    return one.select(rows.alias("r")).select("r.metric", "r.value")


def _ranked(values: DataFrame) -> DataFrame:
    """(label, n, first_id, first_at) of (label, id, at): ties of the count go by first appearance."""
    return values.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("f")).select("label", "n", F.col("f.id").alias("first_id"), F.col("f.at").alias("first_at"))


def books_per_author(books: DataFrame) -> DataFrame:
    """An author counts once for each link."""
    return _ranked(books.select("id", F.posexplode("authors").alias("at", "a")).select(F.col("a.name").alias("label"), "id", "at"))


def top_authors(books: DataFrame, limit: int = 10) -> DataFrame:
    return books_per_author(books).orderBy(F.desc("n"), "first_id", "first_at").limit(limit).select("label", "n")


def books_per_series(books: DataFrame) -> DataFrame:
    return _ranked(books.filter("series is not null").select(F.col("series.name").alias("label"), "id", F.lit(0).alias("at")))


def books_per_language(books: DataFrame) -> DataFrame:
    return _ranked(books.select("id", F.posexplode("languages").alias("at", "label")))


def books_per_year(books: DataFrame) -> DataFrame:
    """Four digits at the beginning of the date; the stand-in year is left out."""
    year = F.regexp_extract("pubdate", "^([0-9]{4})", 1)
    return _ranked(books.select(year.alias("label"), "id", F.lit(0).alias("at")).filter(f"label <> '' and label <> '{UNKNOWN_YEAR}'"))


def largest_books(books: DataFrame, limit: int = 10) -> DataFrame:
    return books.select("id", "title", "size").orderBy(F.desc("size"), "id").limit(limit)


def smallest_books(books: DataFrame, limit: int = 10) -> DataFrame:
    """Books of unknown size are left out."""
    return books.select("id", "title", "size").filter("size > 0").orderBy("size", "id").limit(limit)


def statistics_long(books: DataFrame) -> DataFrame:
    """(category, label, value) for all breakdowns; those by name share one pass and one shuffle."""
    year = F.regexp_extract("pubdate", "^([0-9]{4})", 1)
    counted = _tally(
        books,
        F.transform("authors", lambda a: _tag("books_per_author", a["name"])),
        F.when(F.col("series").isNotNull(), F.array(_tag("books_per_series", F.col("series.name")))).otherwise(_none()),
        F.transform("languages", lambda x: _tag("books_per_language", x)),
        F.when(~F.coalesce(year, F.lit("")).isin("", UNKNOWN_YEAR), F.array(_tag("books_per_year", year))).otherwise(_none()),
    )
    out = counted.select(F.col("kind").alias("category"), "label", F.col("n").alias("value"))
    for k, p in (("largest_books", largest_books(books)), ("smallest_books", smallest_books(books))):
        out = out.unionByName(p.select(F.lit(k).alias("category"), F.col("title").alias("label"), F.col("size").alias("value")))
    return out

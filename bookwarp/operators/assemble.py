"""Assembling books from the normalised tables: children are aggregated first, then joined from the left.

Each child is reduced to one row per book before the join, so a book's joins are one-to-one; the joins share the book id
as key, and where a child is small at run time the adaptive plan broadcasts it.  No per-book queries are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwarp.model import ENTITY, FORMAT


def _entity(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("id", "name", "sort", "link")])


def _ordered(order: list[str], value: Column | str) -> Column:
    """The values of a group in the order of the given columns."""
    packed = F.struct(*order, (F.col(value) if isinstance(value, str) else value).alias("_v"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["_v"])


def book_authors(links: DataFrame, authors: DataFrame) -> DataFrame:
    """(book, authors): per book in the order of the link rows; a name that is null is empty."""
    people = authors.select(F.col("id").alias("author"), F.struct("id", F.coalesce("name", F.lit("")).alias("name"), "sort", "link").alias("a"))
    return links.select(F.col("id").alias("link_id"), "book", "author").join(people, "author").groupBy("book").agg(_ordered(["link_id"], "a").alias("authors"))


def book_identifiers(identifiers: DataFrame) -> DataFrame:
    """(book, identifiers): of several rows of one type the last wins."""
    last = identifiers.filter("type is not null").groupBy("book", "type").agg(F.max_by(F.coalesce("val", F.lit("")), "id").alias("val"))
    return last.groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "val")))).alias("identifiers"))


def book_publishers(links: DataFrame, publishers: DataFrame) -> DataFrame:
    """(book, publisher): the first that has a name."""
    named = publishers.filter("name <> ''").select(F.col("id").alias("publisher"), "name")
    return links.select("id", "book", "publisher").join(named, "publisher").groupBy("book").agg(F.min_by("name", "id").alias("publisher"))


def book_ratings(links: DataFrame, ratings: DataFrame) -> DataFrame:
    """(book, rating): the last positive one, from 0 to 5."""
    positive = ratings.filter("rating > 0").select(F.col("id").alias("rating"), F.col("rating").alias("value"))
    return links.select("id", "book", "rating").join(positive, "rating").groupBy("book").agg((F.max_by("value", "id") / 2).alias("rating"))


def book_languages(links: DataFrame, languages: DataFrame) -> DataFrame:
    coded = languages.select(F.col("id").alias("lang_id"), F.col("lang_code").alias("code"))
    return links.select("id", "book", F.col("lang_code").alias("lang_id"), "item_order").join(coded, "lang_id").groupBy("book").agg(_ordered(["item_order", "id"], "code").alias("languages"))


def book_tags(links: DataFrame, tags: DataFrame) -> DataFrame:
    return links.select("book", "tag").join(tags.select(F.col("id").alias("tag"), "name"), "tag").groupBy("book").agg(F.array_sort(F.collect_list("name")).alias("tags"))


def book_formats(data: DataFrame) -> DataFrame:
    packed = F.struct("format", "name", F.coalesce("uncompressed_size", F.lit(0)).cast("bigint").alias("size"))
    return data.groupBy("book").agg(_ordered(["id"], packed).alias("format_files"))


def book_series(links: DataFrame, series: DataFrame) -> DataFrame:
    named = series.select(F.col("id").alias("series"), _entity().alias("s"))
    return links.select("id", "book", "series").join(named, "series").groupBy("book").agg(F.min_by("s", "id").alias("series"))


def book_comments(comments: DataFrame) -> DataFrame:
    return comments.groupBy("book").agg(F.min_by(F.coalesce("text", F.lit("")), "id").alias("comments"))


def assemble(tables: dict[str, DataFrame]) -> DataFrame:
    """All books in the shape of ``model.BOOK``; tables that are absent count as empty.

    Text that is null becomes empty, an unknown rating or size 0, a missing series null.
    """
    own = ("id", "uuid", "title", "sort", "author_sort", "series_index", "pubdate", "has_cover", "path", "timestamp", "last_modified")
    books = tables["books"].select(*[c for c in own if c in tables["books"].columns])  # further columns may bear children's names
    have = lambda *names: all(n in tables for n in names)
    children = []
    if have("books_authors_link", "authors"):
        children.append(book_authors(tables["books_authors_link"], tables["authors"]))
    if have("identifiers"):
        children.append(book_identifiers(tables["identifiers"]))
    for name, single, build in (("publishers", "publisher", book_publishers), ("ratings", "rating", book_ratings), ("languages", "languages", book_languages), ("tags", "tags", book_tags), ("series", "series", book_series)):
        if have(f"books_{name}_link", name):
            children.append(build(tables[f"books_{name}_link"], tables[name]))
    if have("comments"):
        children.append(book_comments(tables["comments"]))
    if have("data"):
        children.append(book_formats(tables["data"]))
    out = books
    for child in children:
        out = out.join(child, out["id"] == child["book"], "left").drop("book")
    empty = {"authors": f"array<{ENTITY}>", "languages": "array<string>", "tags": "array<string>", "format_files": f"array<{FORMAT}>"}
    get = lambda c, kind="string": F.col(c) if c in out.columns else F.lit(None).cast(kind)
    or_text = lambda c: F.coalesce(get(c).cast("string"), F.lit("")).alias(c)
    or_none = lambda c: F.coalesce(get(c, empty[c]), F.array().cast(empty[c]))
    ids = F.coalesce(get("identifiers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return out.select(
        "id", or_text("uuid"), or_text("title"), F.coalesce(get("sort"), F.lit("")).alias("title_sort"), or_none("authors").alias("authors"), or_text("author_sort"), get("series", ENTITY).alias("series"),
        F.coalesce(get("series_index", "double"), F.lit(0.0)).alias("series_index"), or_text("publisher"), or_text("pubdate"), F.coalesce(F.try_element_at(ids, F.lit("isbn")), F.lit("")).alias("isbn"), ids.alias("identifiers"),
        or_none("languages").alias("languages"), or_none("tags").alias("tags"), or_text("comments"), F.coalesce(get("rating", "double"), F.lit(0.0)).cast("double").alias("rating"), or_none("format_files").alias("format_files"),
        F.transform(or_none("format_files"), lambda f: f["format"]).alias("formats"), F.coalesce(get("has_cover", "boolean").cast("boolean"), F.lit(False)).alias("has_cover"), or_text("path"), or_text("timestamp"), or_text("last_modified"),
        F.aggregate(or_none("format_files"), F.lit(0).cast("bigint"), lambda acc, f: acc + f["size"]).alias("size"),
    )


def author_names() -> Column:
    """The names of a book's authors in one text, or Unknown."""
    return F.when(F.size("authors") > 0, F.array_join(F.transform("authors", lambda a: a["name"]), ", ")).otherwise("Unknown")


def series_name() -> Column:
    return F.coalesce(F.col("series.name"), F.lit(""))


def file_names() -> Column:
    """The file name of each format."""
    return F.transform("format_files", lambda f: F.concat(f["name"], F.lit("."), F.lower(f["format"])))


def table_rows(books: DataFrame) -> DataFrame:
    """The seven columns of a list of books."""
    return books.select(F.col("id").alias("book_id"), "title", author_names().alias("author"), series_name().alias("series"), "publisher", F.when(F.col("isbn") == "", "-").otherwise(F.col("isbn")).alias("isbn"), F.when(F.col("has_cover"), "Yes").otherwise("No").alias("cover"))


def detail_rows(books: DataFrame) -> DataFrame:
    """What a detail view shows of each book, with identifiers by key and the beginning of the comments."""
    from bookwarp.functions.text import preview

    shown = F.array_join(F.transform(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return books.select(F.col("id").alias("book_id"), "title", author_names().alias("author"), series_name().alias("series"), "series_index", "publisher", "pubdate", shown.alias("identifiers"), F.array_join("languages", ", ").alias("languages"), F.array_join("tags", ", ").alias("tags"), "rating", F.array_join(file_names(), ", ").alias("files"), preview("comments").alias("comments"))

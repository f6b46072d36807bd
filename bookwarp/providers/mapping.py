"""Answers of metadata services to candidate records, with JSON read by schema inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwarp.model import CANDIDATE

_text = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
_first = lambda c: F.try_element_at(c, F.lit(1))


def _preferred(*columns: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _candidate(source: str, title: Column, authors: Column, isbn: Column, publisher: Column, description: Column, cover_url: Column) -> Column:
    names = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.coalesce(a, F.lit("")))
    return F.struct(F.lit(source).alias("source"), _text(title).alias("title"), names.alias("authors"), _text(isbn).alias("isbn"), _text(publisher).alias("publisher"), _text(description).alias("description"), _text(cover_url).alias("cover_url"))


def _spread(bodies: DataFrame, items: Column, candidate) -> DataFrame:
    """The other columns of ``bodies`` with one row per item, as a candidate."""
    keep = [c for c in bodies.columns if c != "body"]
    rows = bodies.select(*keep, F.explode(items).alias("_item"))
    return rows.select(*keep, candidate(F.col("_item")).alias("_c")).select(*keep, "_c.*")


def open_library_search(bodies: DataFrame) -> DataFrame:
    """Candidates from search answers: ``bodies`` has ``body``, the JSON text, and any other columns."""
    schema = "docs array<struct<title:string,author_name:array<string>,isbn:array<string>,publisher:array<string>,cover_i:bigint>>"
    cover = lambda d: F.when(F.coalesce(d["cover_i"], F.lit(0)) != 0, F.concat(F.lit("https://covers.openlibrary.org/b/id/"), d["cover_i"].cast("string"), F.lit("-L.jpg")))
    return _spread(bodies, F.from_json("body", schema)["docs"], lambda d: _candidate("openlibrary", d["title"], d["author_name"], _first(d["isbn"]), _first(d["publisher"]), F.lit(""), cover(d)))


def open_library_records(bodies: DataFrame) -> DataFrame:
    """Candidates from answers by isbn: a map from key to record."""
    record = "struct<title:string,authors:array<struct<name:string>>,identifiers:struct<isbn_13:array<string>,isbn_10:array<string>>,publishers:array<struct<name:string>>,cover:struct<large:string,medium:string,small:string>,excerpts:array<struct<text:string>>,notes:string>"
    return _spread(
        bodies, F.map_values(F.from_json("body", f"map<string,{record}>")),
        lambda r: _candidate("openlibrary", r["title"], F.transform(r["authors"], lambda a: a["name"]), F.coalesce(_first(r["identifiers"]["isbn_13"]), _first(r["identifiers"]["isbn_10"])), _first(r["publishers"])["name"],
                             F.when(F.size(F.coalesce(r["excerpts"], F.array().cast("array<struct<text:string>>"))) > 0, _first(r["excerpts"])["text"]).when(~_text(r["notes"]).startswith("{"), r["notes"]), _preferred(r["cover"]["large"], r["cover"]["medium"], r["cover"]["small"])),
    )


def google_books(bodies: DataFrame) -> DataFrame:
    schema = "items array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string,description:string,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:map<string,string>>>>"

    def candidate(item: Column) -> Column:
        v = item["volumeInfo"]
        of = lambda kind: F.element_at(F.filter(F.coalesce(v["industryIdentifiers"], F.array().cast("array<struct<type:string,identifier:string>>")), lambda i: i["type"] == kind), -1)["identifier"]
        last = lambda kind: F.when(F.exists(F.coalesce(v["industryIdentifiers"], F.array().cast("array<struct<type:string,identifier:string>>")), lambda i: i["type"] == kind), of(kind))
        links = F.coalesce(v["imageLinks"], F.create_map().cast("map<string,string>"))
        cover = _preferred(*[F.try_element_at(links, F.lit(k)) for k in ("extraLarge", "large", "medium", "thumbnail", "smallThumbnail")])
        return _candidate("googlebooks", v["title"], v["authors"], _preferred(last("ISBN_13"), last("ISBN_10")), v["publisher"], v["description"], F.regexp_replace(cover, "^http://", "https://"))

    return _spread(bodies, F.from_json("body", schema)["items"], candidate)


def internet_archive(bodies: DataFrame, base_url: str = "https://archive.org") -> DataFrame:
    """Fields may be one value or a list; JSON texts that begin with a bracket are lists."""
    schema = "response struct<docs:array<struct<identifier:string,title:string,creator:string,isbn:string,publisher:string,description:string>>>"
    many = lambda c: F.when(_text(c) == "", F.array().cast("array<string>")).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    one = lambda c: _text(_first(many(c)))
    cover = lambda d: F.when(_text(d["identifier"]) != "", F.concat(F.lit(f"{base_url}/services/img/"), d["identifier"]))
    return _spread(bodies, F.from_json("body", schema)["response"]["docs"], lambda d: _candidate("internetarchive", d["title"], many(d["creator"]), one(d["isbn"]), one(d["publisher"]), one(d["description"]), cover(d)))


def local_candidates(books: DataFrame) -> DataFrame:
    """Each book as its own candidate, to be set beside those of services."""
    names = F.transform("authors", lambda a: a["name"])
    return books.select("id", _candidate("calibre", F.col("title"), names, F.col("isbn"), F.col("publisher"), F.col("comments"), F.lit("")).alias("_c")).select("id", "_c.*")


def comparison(local: DataFrame, found: DataFrame, length: int = 100) -> DataFrame:
    """Local records and candidates one below the other, descriptions cut short; both have ``id`` and the candidate's columns."""
    both = local.select("id", *[c.split()[0] for c in CANDIDATE.split(", ")]).unionByName(found.select("id", *[c.split()[0] for c in CANDIDATE.split(", ")]))
    return both.withColumn("description", F.substring("description", 1, length))

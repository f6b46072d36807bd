"""Queries of the catalogue operators over the test tables, and the same in SQL.

The tables hold books, authors, links and identifiers; the other tables of a catalogue are read out of them: series from
titles with a volume, and comments, files, tags, languages, publishers and ratings from the documents about a book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwarp.functions.text import isbn_valid, listed, name_signature, title_sort
from bookwarp.operators import assemble as A
from bookwarp.operators import covers, duplicates, inspect, score, search, series, statistics
from bookwarp.plans import changes, organize
from bookwarp.providers import mapping
from bookwarp.reports import tables as R
from bookwarp.sources.cache import fresh
from bookwarp.stage import latest, latest_fields, table

SERIES_TITLE = r"^(.*?),? (Vol\.|Book|Volume|Part) [0-9]+$"
BOOK_FIELDS = ("title", "sort", "timestamp", "pubdate", "series_index", "author_sort", "path", "uuid", "has_cover", "last_modified")


def normalised(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a catalogue, each record once."""
    t = lambda name: table(spark, sf_dir, name)
    books = latest_fields(t("books"), "id", "loaded_at", *BOOK_FIELDS)
    docs = t("documents").filter("book is not null")
    about = docs.select("doc_id", "book", "text", "kind", "source", "lang", "n_chars")
    name = F.regexp_extract("title", SERIES_TITLE, 1)
    in_series = books.select(F.col("id").alias("book"), name.alias("name")).filter("name <> ''")
    entity = lambda df: df.select(F.col("name").alias("id"), "name", F.col("name").alias("sort"), F.lit("").alias("link"))
    return {
        "books": books,
        "authors": latest_fields(t("authors"), "id", "loaded_at", "name", "sort", "link"),
        "books_authors_link": t("books_authors_link").select("id", "book", "author").distinct(),
        "identifiers": t("identifiers").select("id", "book", "type", "val").distinct(),
        "comments": about.filter("kind = 'blurb'").select(F.col("doc_id").alias("id"), "book", "text"),
        "data": about.select(F.col("doc_id").alias("id"), "book", F.upper("kind").alias("format"), F.col("source").alias("name"), F.col("n_chars").alias("uncompressed_size")),
        "tags": about.select(F.col("source").alias("id"), F.col("source").alias("name")).distinct(),
        "books_tags_link": about.select(F.col("doc_id").alias("id"), "book", F.col("source").alias("tag")),
        "languages": about.filter("lang is not null").select(F.col("lang").alias("id"), F.col("lang").alias("lang_code")).distinct(),
        "books_languages_link": about.filter("lang is not null").select(F.col("doc_id").alias("id"), "book", F.col("lang").alias("lang_code"), F.lit(0).alias("item_order")),
        "publishers": about.filter("kind = 'catalogue_note'").select(F.col("source").alias("id"), F.col("source").alias("name")).distinct(),
        "books_publishers_link": about.filter("kind = 'catalogue_note'").select(F.col("doc_id").alias("id"), "book", F.col("source").alias("publisher")),
        "ratings": spark.range(11).select("id", F.col("id").alias("rating")),
        "books_ratings_link": about.filter("kind = 'review'").select(F.col("doc_id").alias("id"), "book", (F.length(F.coalesce("text", F.lit(""))) % 11).cast("bigint").alias("rating")),
        "series": entity(in_series.select("name").distinct()),
        "books_series_link": in_series.select(F.col("book").alias("id"), "book", F.col("name").alias("series")),
    }


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assemble(normalised(spark, sf_dir))


def _authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir)["authors"]


def _on_library(f):
    return lambda spark, sf_dir: f(library(spark, sf_dir))


def _found(*terms, **kw):
    return lambda spark, sf_dir: search.search(library(spark, sf_dir), list(terms), **kw).select("id", "title")


def _sorted(sort: str, descending: bool = False):
    return lambda spark, sf_dir: search.places(search.search(library(spark, sf_dir), ["title:present", "series:present"]), sort, descending)


def _organized(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = normalised(spark, sf_dir)
    return tables, organize.organize_plan(A.assemble(tables))


def organize_applied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books' folders after all moves of the plan."""
    tables, plan = _organized(spark, sf_dir)
    return changes.moved_books(tables["books"], plan).select("id", "path")


def organize_applied_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' names after all renames of the plan."""
    tables, plan = _organized(spark, sf_dir)
    return changes.renamed_files(tables["data"], plan).select("id", "book", "format", "name")


def cover_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cover of each book among made-up shapes, a fifth of which the book has already."""
    shapes = table(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("book_id"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("origin"), *_shape(), (F.col("p_size") % 5 == 0).alias("is_duplicate"))
    seen = shapes.withColumn("quality", covers.quality()).withColumn("is_valid", F.size(covers.shape_issues()) == 0)
    return covers.best_covers(seen).select("book_id", "quality", "origin")


def _shape() -> list:
    return [(F.lit(150) + F.col("p_partkey") % 1400).cast("int").alias("width"), (F.lit(150) + (F.col("p_partkey") * 7) % 2100).cast("int").alias("height")]


def _json(df: DataFrame, value) -> DataFrame:
    return df.select("candidate_id", F.to_json(value).alias("body"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("title", "authors", "isbn", "publisher", "description", "cover_url")
    return latest(table(spark, sf_dir, "metadata_candidates"), "candidate_id", "fetched_at", *fields)


def provider_open_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _payloads(spark, sf_dir)
    docs = F.struct(F.array(F.struct("title", F.col("authors").alias("author_name"), F.array("isbn").alias("isbn"), F.array("publisher").alias("publisher"), F.col("candidate_id").alias("cover_i"))).alias("docs"))
    return mapping.open_library_search(_json(c, docs)).select("candidate_id", "title", F.array_join("authors", "; ").alias("authors"), "isbn", "publisher", "cover_url")


def provider_google_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _payloads(spark, sf_dir)
    ids = F.array(F.struct(F.lit("ISBN_10").alias("type"), F.lit("none").alias("identifier")), F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier")))
    info = F.struct("title", "authors", "publisher", "description", ids.alias("industryIdentifiers"), F.struct(F.regexp_replace("cover_url", "^https", "http").alias("large")).alias("imageLinks"))
    return mapping.google_books(_json(c, F.struct(F.array(F.struct(info.alias("volumeInfo"))).alias("items")))).select("candidate_id", "title", F.array_join("authors", "; ").alias("authors"), "isbn", "publisher", "cover_url")


def provider_internet_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _payloads(spark, sf_dir)
    doc = lambda creator: F.struct(F.struct(F.array(F.struct(F.col("candidate_id").cast("string").alias("identifier"), "title", creator.alias("creator"), "publisher", F.array("isbn").alias("isbn"))).alias("docs")).alias("response"))
    one, many = c.filter(F.size("authors") == 1), c.filter((F.size("authors") != 1) | F.col("authors").isNull())
    bodies = _json(one, doc(F.col("authors")[0])).unionByName(_json(many, doc(F.col("authors"))))
    return mapping.internet_archive(bodies).select("candidate_id", "title", F.array_join("authors", "; ").alias("authors"), "isbn", "publisher", "cover_url")


def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("cached_at"))
    now = events.agg(F.max("cached_at").alias("now"))
    return fresh(events.crossJoin(F.broadcast(now)), "cached_at", "now").select("key")  # one row


def sha256_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


def cover_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.lit(150) + F.col("p_partkey") % 1400).cast("int").alias("width"), (F.lit(150) + (F.col("p_partkey") * 7) % 2100).cast("int").alias("height"), F.col("p_size").cast("bigint").alias("kb"))
    return shapes.select("id", covers.quality().alias("quality"), F.array_join(covers.shape_issues(), "; ").alias("issues"))


def assembled_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = library(spark, sf_dir)
    ids = F.array_join(F.transform(F.array_sort(F.map_entries("identifiers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return books.select("id", "title", A.author_names().alias("authors"), A.series_name().alias("series"), "series_index", "publisher", "isbn", ids.alias("identifiers"), F.array_join("languages", ",").alias("languages"), F.array_join("tags", ",").alias("tags"), "rating", F.array_join("formats", ",").alias("formats"), "size", F.length("comments").alias("comment_length"), "has_cover")


def author_merge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = normalised(spark, sf_dir)
    return changes.merged_links(tables["books_authors_link"], duplicates.author_groups(tables["authors"]))


def author_merge_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = _authors(spark, sf_dir)
    return changes.merged_authors(authors, duplicates.author_groups(authors)).select("id", "name")


def author_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates.author_groups(_authors(spark, sf_dir))
    return found.select("canonical_author_id", listed("duplicate_author_ids").alias("duplicates"), F.array_join("names", "; ").alias("names"))


def repair_apply_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = normalised(spark, sf_dir)
    found = score.repair_suggestions(library(spark, sf_dir))
    after = changes.apply_repairs(tables["books"], found)
    return after.select("id", "title", "sort")


def isbn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalised(spark, sf_dir)["identifiers"].filter("type = 'isbn'")
    made = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("id"), F.concat(F.lit("978"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), (F.col("o_custkey") % 10).cast("string")).alias("val"))
    return rows.select("id", "val").unionByName(made).select("id", isbn_valid("val").alias("valid"))


def title_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(spark, sf_dir)["books"].filter("title is not null").select("id", title_sort("title").alias("title_sort"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authors(spark, sf_dir).select("id", F.array_join(name_signature("name"), " ").alias("signature"))


def line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as volumes of a series: the order is the series, the line number the position."""
    name = F.col("l_orderkey").cast("string")
    made = F.struct(F.col("l_orderkey").alias("id"), name.alias("name"), name.alias("sort"), F.lit("").alias("link"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), made.alias("series"), F.col("l_linenumber").cast("double").alias("series_index"))


def _report(f):
    return lambda spark, sf_dir: f(library(spark, sf_dir))


QUERIES = {
    "health_score": _on_library(lambda b: score.scored(b).select("book_id", "score", F.array_join("failed", ", ").alias("failed"))),
    "health_average": _on_library(score.average_score),
    "worst_books": _on_library(lambda b: score.worst(b, 20)),
    "validation_issues": _on_library(score.validation_issues),
    "repair_suggestions": _on_library(score.repair_suggestions),
    "library_analysis": _report(R.library_analysis),
    "needs_attention": _on_library(lambda b: score.analysis(b).filter("needs_attention").select("book_id")),
    "library_summary": _on_library(statistics.summary),
    "top_authors": _on_library(statistics.top_authors),
    "books_per_author": _on_library(lambda b: statistics.books_per_author(b).select("label", "n")),
    "books_per_series": _on_library(lambda b: statistics.books_per_series(b).select("label", "n")),
    "books_per_language": _on_library(lambda b: statistics.books_per_language(b).select("label", "n")),
    "books_per_year": _on_library(lambda b: statistics.books_per_year(b).select("label", "n")),
    "largest_books": _on_library(statistics.largest_books),
    "smallest_books": _on_library(statistics.smallest_books),
    "statistics_long": _on_library(statistics.statistics_long),
    "series_duplicate_positions": _on_library(lambda b: series.duplicate_positions(b).select("series_name", "series_index", listed("book_ids").alias("ids"))),
    "series_gaps": _on_library(lambda b: series.gaps(b).select("series_name", listed("missing").alias("missing"), "low", "high")),
    "series_issues": _on_library(series.series_issues),
    "line_duplicate_positions": lambda s, d: series.duplicate_positions(line_positions(s, d)).select("series_name", "series_index", listed("book_ids").alias("ids")),
    "line_gaps": lambda s, d: series.gaps(line_positions(s, d)).select("series_name", listed("missing").alias("missing"), "low", "high"),
    "isbn_valid": isbn_check,
    "isbn_duplicates": _on_library(lambda b: duplicates.isbn_groups(b).select("reason", listed("book_ids").alias("ids"))),
    "author_signatures": signatures,
    "author_duplicates": author_duplicates,
    "author_merge_links": author_merge_links,
    "author_merge_authors": author_merge_authors,
    "title_duplicates_exact": _on_library(lambda b: duplicates.equal_title_groups(b).select("reason", listed("book_ids").alias("ids"))),
    "title_duplicates_fuzzy": _on_library(lambda b: duplicates.title_groups(b).select("reason", listed("book_ids").alias("ids"))),
    "title_number_only_pairs": _on_library(duplicates.number_only_pairs),
    "title_sort": title_sorts,
    "search_exact": _found("title:exact=the quiet mill"),
    "search_contains": _found("title=lantern"),
    "search_starts_with": _found("title:starts_with=the b"),
    "search_ends_with": _found("author:ends_with=skov"),
    "search_regex": _found("title:regex=^(the|a) [b-d].* of "),
    "search_missing": _found("missing-isbn"),
    "search_present": _found("missing-series", "publisher:present"),
    "search_numeric": _found("rating>=2.5"),
    "search_flag": _found("has_cover:eq=1", "language=fr"),
    "search_and": _found("author=ha", "isbn:present", "format=REVIEW", "date_added:starts_with=2025-0"),
    "search_fuzzy": _found("title:fuzzy=the quiet mill"),
    "search_lte": _found("rating<=1.5", "rating:gt=0"),
    "search_gt": _found("rating>3"),
    "search_lt": _found("rating<2", "series:present"),
    "search_sort_title": _sorted("title"),
    "search_sort_author": _sorted("author"),
    "search_sort_date_added": _sorted("date_added"),
    "search_sort_last_modified": _sorted("last_modified", True),
    "search_sort_size": _sorted("size", True),
    "search_sort_series": _sorted("series"),
    "search_sort_rating_desc": _sorted("rating", True),
    "search_results": _report(lambda b: R.search_results(search.search(b, ["rating>=3"]))),
    "organize_plan": _on_library(lambda b: organize.plan_report(organize.organize_plan(b))),
    "organize_applied_paths": organize_applied_paths,
    "organize_applied_names": organize_applied_names,
    "cover_best": cover_best,
    "repair_apply_titles": repair_apply_titles,
    "duplicate_report": lambda s, d: duplicates.duplicate_report(library(s, d), _authors(s, d)),
    "dashboard": _on_library(inspect.dashboard),
    "assembled_books": assembled_books,
    "table_rows": _on_library(A.table_rows),
    "detail_rows": _on_library(A.detail_rows),
    "local_candidates": _on_library(lambda b: mapping.local_candidates(b).select("id", "title", F.array_join("authors", "; ").alias("authors"), "isbn", "publisher")),
    "provider_open_library": provider_open_library,
    "provider_google_books": provider_google_books,
    "provider_internet_archive": provider_internet_archive,
    "cache_ttl": cache_ttl,
    "sha256_duplicates": sha256_duplicates,
    "cover_quality": cover_quality,
}

_WS = r"[\s\p{Z}\x{85}\x{0b}]"
_strip = lambda x: rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_quote = lambda x: f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || replace({x}, '\\', '\\\\') || '\"' ELSE '''' || replace(replace({x}, '\\', '\\\\'), '''', '\\''') || '''' END"
_sig = lambda x: rf"list_sort(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'))"
_tsort = lambda x: rf"regexp_replace({x}, '^(the|a|an){_WS}+(.*)$', '\2, \1', 'is')"
_BY = rf"{_WS}+by{_WS}+[A-Z][\p{{L}}\p{{N}}\p{{M}}_.''-]*(?:{_WS}+[A-Z][\p{{L}}\p{{N}}\p{{M}}_.''-]*)+$"
_ids = lambda x: f"'[' || array_to_string({x}, ', ') || ']'"

_LIB = rf"""
WITH bk AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
au AS (SELECT * FROM authors QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
lk AS (SELECT DISTINCT id, book, author FROM books_authors_link),
ba AS (SELECT book, list({{'id': au.id, 'name': coalesce(au.name, ''), 'sort': au.sort}} ORDER BY lk.id) AS authors FROM lk JOIN au ON au.id = lk.author GROUP BY book),
it AS (SELECT book, type, arg_max(coalesce(val, ''), id) AS val FROM (SELECT DISTINCT id, book, type, val FROM identifiers) WHERE type IS NOT NULL GROUP BY book, type),
bi AS (SELECT book, string_agg(type || '=' || val, ',' ORDER BY type) AS identifiers, string_agg(type || ': ' || val, ', ' ORDER BY type) AS shown, any_value(val) FILTER (type = 'isbn') AS isbn FROM it GROUP BY book),
dc AS (SELECT doc_id, book, text, kind, source, lang, n_chars FROM documents WHERE book IS NOT NULL),
bc AS (SELECT book, arg_min(coalesce(text, ''), doc_id) AS comments FROM dc WHERE kind = 'blurb' GROUP BY book),
bf AS (SELECT book, list({{'format': upper(kind), 'name': source, 'size': coalesce(n_chars, 0)}} ORDER BY doc_id) AS files FROM dc GROUP BY book),
bt AS (SELECT book, list(source ORDER BY source) AS tags FROM dc WHERE source IS NOT NULL GROUP BY book),
bl AS (SELECT book, list(lang ORDER BY doc_id) AS languages FROM dc WHERE lang IS NOT NULL GROUP BY book),
bp AS (SELECT book, arg_min(source, doc_id) AS publisher FROM dc WHERE kind = 'catalogue_note' AND source <> '' GROUP BY book),
br AS (SELECT book, arg_max(length(coalesce(text, '')) % 11, doc_id) / 2 AS rating FROM dc WHERE kind = 'review' AND length(coalesce(text, '')) % 11 > 0 GROUP BY book),
lib AS (SELECT bk.id, coalesce(bk.title, '') AS title, coalesce(bk.sort, '') AS title_sort, coalesce(ba.authors, []) AS authors, nullif(regexp_extract(bk.title, '^(.*?),? (Vol\.|Book|Volume|Part) [0-9]+$', 1), '') AS series,
  coalesce(bk.series_index, 0.0) AS series_index, coalesce(bp.publisher, '') AS publisher, coalesce(bk.pubdate, '') AS pubdate, coalesce(bi.isbn, '') AS isbn, coalesce(bi.identifiers, '') AS identifiers, coalesce(bi.shown, '') AS shown,
  coalesce(bl.languages, []) AS languages, coalesce(bt.tags, []) AS tags, coalesce(bc.comments, '') AS comments, coalesce(br.rating, 0.0)::DOUBLE AS rating, coalesce(bf.files, []) AS files,
  coalesce(bk.has_cover, false) AS has_cover, coalesce(bk.path, '') AS path, coalesce(bk.timestamp, '') AS timestamp, coalesce(bk.last_modified, '') AS last_modified,
  coalesce(list_sum(list_transform(bf.files, lambda f: f.size)), 0)::BIGINT AS size, {_strip("coalesce(bk.title, '')")} AS stripped,
  CASE WHEN len(coalesce(ba.authors, [])) > 0 THEN array_to_string(list_transform(ba.authors, lambda a: a.name), ', ') ELSE 'Unknown' END AS author_names
  FROM bk LEFT JOIN ba ON ba.book = bk.id LEFT JOIN bi ON bi.book = bk.id LEFT JOIN bc ON bc.book = bk.id LEFT JOIN bf ON bf.book = bk.id LEFT JOIN bt ON bt.book = bk.id LEFT JOIN bl ON bl.book = bk.id LEFT JOIN bp ON bp.book = bk.id LEFT JOIN br ON br.book = bk.id),
sc AS (SELECT *, list_filter([CASE WHEN stripped = '' THEN 'title' END, CASE WHEN len(authors) = 0 THEN 'author' END, CASE WHEN isbn = '' THEN 'isbn' END, CASE WHEN NOT has_cover THEN 'cover' END,
  CASE WHEN {_strip('comments')} = '' THEN 'description' END], lambda x: x IS NOT NULL) AS failed, 100 - 20 * len(failed) AS score FROM lib)
"""
_CLEAN = "upper(regexp_replace(coalesce({0}, ''), '[\\s-]', '', 'g'))"
_VALID = lambda x: (
    f"CASE WHEN regexp_full_match({_CLEAN.format(x)}, '[0-9]{{9}}[0-9X]') THEN list_sum(list_transform(range(1, 11), lambda i: (11 - i) * (CASE WHEN substr({_CLEAN.format(x)}, i::INT, 1) = 'X' THEN 10 ELSE substr({_CLEAN.format(x)}, i::INT, 1)::INT END))) % 11 = 0 "
    f"WHEN regexp_full_match({_CLEAN.format(x)}, '[0-9]{{13}}') THEN list_sum(list_transform(range(1, 14), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) * substr({_CLEAN.format(x)}, i::INT, 1)::INT)) % 10 = 0 ELSE false END"
)
_ISSUES = _LIB + rf""",
ev AS (
  SELECT id, 0 AS k, 0 AS j, 'empty_title' AS code, 'Title is empty' AS message FROM lib WHERE stripped = '' UNION ALL
  SELECT id, 1, 2 * i, 'title_matches_author', 'Title matches the author name (' || ({_quote('a.name')}) || ')' FROM (SELECT id, stripped, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM lib) WHERE stripped <> '' AND a.name <> '' AND lower(stripped) = lower(a.name) UNION ALL
  SELECT id, 1, 2 * i + 1, 'title_matches_author', 'Title matches the author''s sort name (' || ({_quote('a.sort')}) || ')' FROM (SELECT id, stripped, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM lib) WHERE stripped <> '' AND a.sort <> '' AND lower(stripped) = lower(a.sort) UNION ALL
  SELECT id, 2, 0, 'title_contains_by_clause', 'Title appears to end with a ''by <author>'' clause' FROM lib WHERE regexp_matches(stripped, '{_BY}') UNION ALL
  SELECT id, 3, 0, 'series_index_zero', 'In series ' || ({_quote('series')}) || ' but series_index is 0' FROM lib WHERE stripped <> '' AND series IS NOT NULL AND series_index = 0 UNION ALL
  SELECT id, 4, 0, 'invalid_isbn', 'ISBN ' || ({_quote('isbn')}) || ' fails checksum validation' FROM lib WHERE stripped <> '' AND isbn <> '' AND NOT ({_VALID('isbn')})),
iss AS (SELECT id AS book_id, (row_number() OVER (PARTITION BY id ORDER BY k, j) - 1)::INT AS n, code, message FROM ev),
sug AS (
  SELECT id AS book_id, 0 AS j, 'title' AS field, title AS current_value, {_strip(f"regexp_replace(stripped, '{_BY}', '')")} AS suggested_value, 'Title appears to end with a ''by <author>'' clause' AS reason FROM lib WHERE regexp_matches(stripped, '{_BY}') UNION ALL
  SELECT id, i, 'title', title, '', 'Title matches the author name (' || ({_quote('a.name')}) || '); the real title is unknown and cannot be suggested automatically' FROM (SELECT id, title, stripped, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM lib) WHERE stripped <> '' AND a.name <> '' AND lower(stripped) = lower(a.name))
"""
_STATS = _LIB + """,
pa AS (SELECT x.a.name AS label, count(*) AS n, min(struct_pack(id := id, i := i)) AS f FROM (SELECT id, unnest(authors) AS a, generate_subscripts(authors, 1) AS i FROM lib) x GROUP BY 1),
ps AS (SELECT series AS label, count(*) AS n FROM lib WHERE series IS NOT NULL GROUP BY 1),
pl AS (SELECT unnest(languages) AS label, count(*) AS n FROM lib GROUP BY 1),
py AS (SELECT regexp_extract(pubdate, '^([0-9]{4})', 1) AS label, count(*) AS n FROM lib GROUP BY 1 HAVING label NOT IN ('', '0101')),
lb AS (SELECT id, title, size FROM lib ORDER BY size DESC, id LIMIT 10),
sb AS (SELECT id, title, size FROM lib WHERE size > 0 ORDER BY size, id LIMIT 10)
"""
_SERIES = _LIB + f""",
pos AS (SELECT id, series AS series_name, series_index FROM lib WHERE series IS NOT NULL AND series_index > 0),
dup AS (SELECT series_name, series_index, list(id ORDER BY id) AS ids FROM pos GROUP BY 1, 2 HAVING count(*) > 1),
who AS (SELECT DISTINCT series_name, series_index::BIGINT AS place FROM pos WHERE series_index = floor(series_index)),
rng AS (SELECT series_name, min(place) AS low, max(place) AS high FROM who GROUP BY 1 HAVING count(*) > 1),
gap AS (SELECT rng.series_name, low, high, list(g.x ORDER BY g.x) AS missing FROM rng, LATERAL (SELECT unnest(generate_series(low, high)) AS x) g WHERE NOT EXISTS (SELECT 1 FROM who w WHERE w.series_name = rng.series_name AND w.place = g.x) GROUP BY 1, 2, 3)
"""
_first = lambda part: f"authors[1].{part}"
_TITLES = _LIB + f""",
kept AS (SELECT id, CASE WHEN len(authors) > 0 THEN lower({_first('name')}) ELSE '' END AS block, lower(stripped) AS t FROM lib
  WHERE NOT (len(authors) > 0 AND ({_sig('title')} = {_sig(_first('name'))} OR {_sig('title')} = {_sig(_first('sort'))}))),
cls AS (SELECT block, t, min(id) AS first_id FROM kept GROUP BY 1, 2)
"""
_component = lambda x, fallback: f"substr(CASE WHEN ({{0}}) = '' THEN {fallback} ELSE ({{0}}) END, 1, 150)".format(
    rf"regexp_replace({_strip(rf'''regexp_replace(regexp_replace({_strip(x)}, '[<>:\"/\\|?*\x00-\x1f]', '', 'g'), '{_WS}+', ' ', 'g')''')}, '[.\s\p{{Z}}]+$', '')"
)
_AUTHORS = rf"""
WITH bk AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
au AS (SELECT * FROM authors QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
sg AS (SELECT id, coalesce(name, '') AS name, {_sig('name')} AS sig FROM au),
gr AS (SELECT list(id ORDER BY id) AS ids, list(name ORDER BY id, name) AS names FROM sg WHERE len(sig) > 0 GROUP BY sig HAVING count(*) > 1),
mp AS (SELECT author, min(canonical) AS canonical FROM (SELECT unnest(ids[2:]) AS author, ids[1] AS canonical FROM gr) GROUP BY author)
"""
_search = lambda where: _LIB + f"SELECT id, title FROM lib WHERE {where}"
_any = lambda xs, cond: f"len(list_filter({xs}, lambda v: {cond})) > 0"
_names = "list_transform(authors, lambda a: coalesce(a.name, ''))"
_place = lambda order: _LIB + rf"SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY {order}, id) AS place FROM lib WHERE {_strip('title')} <> '' AND series IS NOT NULL AND {_strip('series')} <> '')"
_CAND = "WITH c AS (SELECT * FROM metadata_candidates QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY fetched_at DESC) = 1) SELECT candidate_id, coalesce(title, '') AS title, array_to_string(list_transform(coalesce(authors, []), lambda a: coalesce(a, '')), '; ') AS authors, coalesce(isbn, '') AS isbn, coalesce(publisher, '') AS publisher, "

_PLACED = _LIB + f""", c AS (SELECT id, title, path, files, {_component("CASE WHEN len(authors) > 0 THEN authors[1].name ELSE 'Unknown' END", "'Unknown'")} AS author, {_component("title", "'Untitled (' || id || ')'")} AS t FROM lib)"""
SQL = {
    "health_score": _LIB + "SELECT id AS book_id, score::INT AS score, array_to_string(failed, ', ') AS failed FROM sc",
    "health_average": _LIB + "SELECT round_even(coalesce(avg(score), 0), 0)::INT AS average_score FROM sc",
    "worst_books": _LIB + "SELECT id AS book_id, title, score::INT AS score FROM sc ORDER BY score, id LIMIT 20",
    "validation_issues": _ISSUES + "SELECT * FROM iss",
    "repair_suggestions": _ISSUES + "SELECT book_id, field, current_value, suggested_value, reason FROM sug",
    "library_analysis": _ISSUES + """SELECT sc.id AS book_id, title, score::INT AS score, array_to_string(failed, ', ') AS failed_checks,
  coalesce((SELECT string_agg(message, '; ' ORDER BY n) FROM iss WHERE iss.book_id = sc.id), '') AS issues,
  coalesce((SELECT string_agg(field || ': ' || CASE WHEN suggested_value = '' THEN '(review manually)' ELSE suggested_value END, '; ' ORDER BY j) FROM sug WHERE sug.book_id = sc.id), '') AS repair_suggestions FROM sc""",
    "needs_attention": _ISSUES + "SELECT id AS book_id FROM sc WHERE score < 100 OR id IN (SELECT book_id FROM iss)",
    "library_summary": _LIB + """, c AS (SELECT count(*) AS n, round_even(coalesce(avg(score), 0), 0)::BIGINT AS s FROM sc)
SELECT 'total_books' AS metric, n AS value FROM c UNION ALL SELECT 'unique_authors', (SELECT count(DISTINCT a.name) FROM (SELECT unnest(authors) AS a FROM lib)) UNION ALL
SELECT 'unique_series', (SELECT count(DISTINCT series) FROM lib) UNION ALL SELECT 'unique_formats', (SELECT count(DISTINCT f.format) FROM (SELECT unnest(files) AS f FROM lib)) UNION ALL
SELECT 'average_metadata_score', s FROM c UNION ALL SELECT 'missing_isbn', (SELECT count(*) FROM lib WHERE isbn = '') UNION ALL SELECT 'missing_description', (SELECT count(*) FROM lib WHERE comments = '') UNION ALL
SELECT 'missing_cover', (SELECT count(*) FROM lib WHERE NOT has_cover) UNION ALL SELECT 'missing_publisher', (SELECT count(*) FROM lib WHERE publisher = '') UNION ALL
SELECT 'missing_language', (SELECT count(*) FROM lib WHERE len(languages) = 0) UNION ALL SELECT 'missing_series', (SELECT count(*) FROM lib WHERE series IS NULL)""",
    "top_authors": _STATS + "SELECT label, n FROM pa ORDER BY n DESC, f LIMIT 10",
    "books_per_author": _STATS + "SELECT label, n FROM pa",
    "books_per_series": _STATS + "SELECT label, n FROM ps",
    "books_per_language": _STATS + "SELECT label, n FROM pl",
    "books_per_year": _STATS + "SELECT label, n FROM py",
    "largest_books": _STATS + "SELECT id, title, size FROM lb",
    "smallest_books": _STATS + "SELECT id, title, size FROM sb",
    "statistics_long": _STATS + """SELECT 'books_per_author' AS category, label, n AS value FROM pa UNION ALL SELECT 'books_per_series', label, n FROM ps UNION ALL SELECT 'books_per_language', label, n FROM pl UNION ALL
SELECT 'books_per_year', label, n FROM py UNION ALL SELECT 'largest_books', title, size FROM lb UNION ALL SELECT 'smallest_books', title, size FROM sb""",
    "series_duplicate_positions": _SERIES + f"SELECT series_name, series_index, {_ids('ids')} AS ids FROM dup",
    "series_gaps": _SERIES + f"SELECT series_name, {_ids('missing')} AS missing, low, high FROM gap",
    "series_issues": _SERIES + f"""SELECT series_name, 'duplicate_position' AS issue_type, 'position ' || CASE WHEN series_index = floor(series_index) THEN series_index::BIGINT::VARCHAR ELSE series_index::VARCHAR END || ' used by books ' || {_ids('ids')} AS detail FROM dup
UNION ALL SELECT series_name, 'gap', 'missing position(s) ' || {_ids('missing')} || ' between ' || low || ' and ' || high FROM gap""",
    "line_duplicate_positions": f"SELECT l_orderkey::VARCHAR AS series_name, l_linenumber::DOUBLE AS series_index, {_ids('list(l_partkey ORDER BY l_partkey)')} AS ids FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "line_gaps": f"""WITH w AS (SELECT DISTINCT l_orderkey::VARCHAR AS s, l_linenumber::BIGINT AS n FROM lineitem), r AS (SELECT s, min(n) AS low, max(n) AS high, list(n) AS have FROM w GROUP BY 1),
m AS (SELECT s, low, high, list_sort(list_filter(range(low, high + 1), lambda x: NOT list_contains(have, x))) AS missing FROM r) SELECT s AS series_name, {_ids('missing')} AS missing, low, high FROM m WHERE len(missing) > 0""",
    "isbn_valid": f"SELECT id, {_VALID('val')} AS valid FROM (SELECT DISTINCT id, book, type, val FROM identifiers WHERE type = 'isbn' UNION ALL SELECT -o_orderkey, NULL, '', '978' || lpad(o_orderkey::VARCHAR, 9, '0') || (o_custkey % 10) FROM orders)",
    "isbn_duplicates": _LIB + f"SELECT 'isbn=' || isbn AS reason, {_ids('list(id ORDER BY id)')} AS ids FROM lib WHERE isbn <> '' GROUP BY isbn HAVING count(*) > 1",
    "author_signatures": _AUTHORS + "SELECT id, array_to_string(sig, ' ') AS signature FROM sg",
    "author_duplicates": _AUTHORS + f"SELECT ids[1] AS canonical_author_id, {_ids('ids[2:]')} AS duplicates, array_to_string(names, '; ') AS names FROM gr",
    "author_merge_links": _AUTHORS + "SELECT DISTINCT l.book, coalesce(mp.canonical, l.author) AS author FROM books_authors_link l LEFT JOIN mp ON mp.author = l.author",
    "author_merge_authors": _AUTHORS + "SELECT id, name FROM au WHERE id NOT IN (SELECT author FROM mp)",
    "title_duplicates_exact": _TITLES + f"SELECT 'similar title, same author' AS reason, {_ids('list(id ORDER BY id)')} AS ids FROM kept GROUP BY block, t HAVING count(*) > 1",
    "title_number_only_pairs": _TITLES + r"SELECT x.first_id AS a, y.first_id AS b FROM cls x JOIN cls y ON x.block = y.block AND regexp_replace(x.t, '\d+', '', 'g') = regexp_replace(y.t, '\d+', '', 'g') AND x.first_id < y.first_id",
    "title_sort": _AUTHORS + f"SELECT id, {_tsort('title')} AS title_sort FROM bk WHERE title IS NOT NULL",
    "search_exact": _search("lower(title) = 'the quiet mill'"),
    "search_contains": _search("contains(lower(title), 'lantern')"),
    "search_starts_with": _search("starts_with(lower(title), 'the b')"),
    "search_ends_with": _search(_any(_names, "ends_with(lower(v), 'skov')")),
    "search_regex": _search("regexp_matches(title, '^(the|a) [b-d].* of ', 'i')"),
    "search_missing": _search(f"{_strip('isbn')} = ''"),
    "search_present": _search(f"(series IS NULL OR {_strip('series')} = '') AND {_strip('publisher')} <> ''"),
    "search_numeric": _search("rating >= 2.5"),
    "search_flag": _search("has_cover AND " + _any("languages", "contains(lower(v), 'fr')")),
    "search_and": _search(_any(_names, "contains(lower(v), 'ha')") + f" AND {_strip('isbn')} <> '' AND " + _any("files", "contains(lower(v.format), 'review')") + " AND starts_with(lower(timestamp), '2025-0')"),
    "search_lte": _search("rating <= 1.5 AND rating > 0"),
    "search_gt": _search("rating > 3"),
    "search_lt": _search(f"rating < 2 AND series IS NOT NULL AND {_strip('series')} <> ''"),
    "search_sort_author": _place("lower(coalesce(CASE WHEN len(authors) > 0 THEN CASE WHEN coalesce(authors[1].sort, '') <> '' THEN authors[1].sort ELSE authors[1].name END END, ''))"),
    "search_sort_date_added": _place("timestamp"),
    "search_sort_last_modified": _place("last_modified DESC"),
    "search_sort_size": _place("size DESC"),
    "search_sort_title": _place("lower(CASE WHEN title_sort <> '' THEN title_sort ELSE title END)"),
    "search_sort_series": _place("lower(series), series_index"),
    "search_sort_rating_desc": _place("rating DESC"),
    "search_results": _LIB + "SELECT id AS book_id, title, author_names AS author, coalesce(series, '') AS series, rating, score::INT AS metadata_score, isbn, array_to_string(list_transform(files, lambda f: f.format), ', ') AS formats, has_cover FROM sc WHERE rating >= 3",
    "organize_applied_paths": _PLACED + "SELECT id, CASE WHEN row_number() OVER (PARTITION BY lower(author || '/' || t) ORDER BY id) = 1 THEN author || '/' || t ELSE author || '/' || t || ' (' || id || ')' END AS path FROM c",
    "organize_applied_names": _PLACED + "SELECT d.doc_id AS id, d.book, upper(d.kind) AS format, coalesce(c.t, d.source) AS name FROM dc d LEFT JOIN c ON c.id = d.book",
    "cover_best": """WITH s AS (SELECT p_partkey % 300 AS book_id, lpad(p_partkey::VARCHAR, 9, '0') AS origin, 150 + p_partkey % 1400 AS w, 150 + (p_partkey * 7) % 2100 AS h FROM part WHERE p_size % 5 <> 0)
SELECT book_id, least(100, greatest(0, round_even(w * h / 1500000.0 * 100, 0)))::INT AS quality, origin FROM s WHERE w >= 300 AND h >= 300 AND h / w BETWEEN 1.1 AND 2.2 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY quality DESC, origin) = 1""",
    "organize_plan": _PLACED + """
SELECT id AS book_id, title, author, path AS current_path, CASE WHEN row_number() OVER (PARTITION BY lower(author || '/' || t) ORDER BY id) = 1 THEN author || '/' || t ELSE author || '/' || t || ' (' || id || ')' END AS proposed_path,
  array_to_string(list_transform(list_filter(files, lambda f: f.name <> t), lambda f: f.name || ' -> ' || t), '; ') AS format_renames FROM c""",
    "repair_apply_titles": _ISSUES + f", ch AS (SELECT book_id, max(suggested_value) AS v FROM sug WHERE suggested_value <> '' GROUP BY 1) SELECT bk.id, coalesce(ch.v, bk.title) AS title, CASE WHEN ch.v IS NULL OR ch.v = bk.title THEN bk.sort ELSE {_tsort('ch.v')} END AS sort FROM bk LEFT JOIN ch ON ch.book_id = bk.id",
    "assembled_books": _LIB + "SELECT id, title, author_names AS authors, coalesce(series, '') AS series, series_index, publisher, isbn, identifiers, array_to_string(languages, ',') AS languages, array_to_string(tags, ',') AS tags, rating, array_to_string(list_transform(files, lambda f: f.format), ',') AS formats, size, length(comments)::INT AS comment_length, has_cover FROM lib",
    "table_rows": _LIB + "SELECT id AS book_id, title, author_names AS author, coalesce(series, '') AS series, publisher, CASE WHEN isbn = '' THEN '-' ELSE isbn END AS isbn, CASE WHEN has_cover THEN 'Yes' ELSE 'No' END AS cover FROM lib",
    "detail_rows": _LIB + "SELECT id AS book_id, title, author_names AS author, coalesce(series, '') AS series, series_index, publisher, pubdate, shown AS identifiers, array_to_string(languages, ', ') AS languages, array_to_string(tags, ', ') AS tags, rating, array_to_string(list_transform(files, lambda f: f.name || '.' || lower(f.format)), ', ') AS files, replace(left(comments, 100), chr(10), ' ') AS comments FROM lib",
    "local_candidates": _LIB + "SELECT id, title, array_to_string(list_transform(authors, lambda a: a.name), '; ') AS authors, isbn, publisher FROM lib",
    "provider_open_library": _CAND + "'https://covers.openlibrary.org/b/id/' || candidate_id || '-L.jpg' AS cover_url FROM c",
    "provider_google_books": _CAND.replace("coalesce(isbn, '') AS isbn", "CASE WHEN coalesce(isbn, '') = '' THEN 'none' ELSE isbn END AS isbn") + "coalesce(regexp_replace(cover_url, '^http://', 'https://'), '') AS cover_url FROM c",
    "provider_internet_archive": _CAND + "'https://archive.org/services/img/' || candidate_id AS cover_url FROM c",
    "cache_ttl": "SELECT sha256(event_id::VARCHAR) AS key FROM events WHERE (SELECT max(floor(epoch(ts))) FROM events) - floor(epoch(ts)) <= 604800",
    "sha256_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "cover_quality": """WITH s AS (SELECT p_partkey AS id, 150 + p_partkey % 1400 AS w, 150 + (p_partkey * 7) % 2100 AS h FROM part)
SELECT id, least(100, greatest(0, round_even(w * h / 1500000.0 * 100, 0)))::INT AS quality, array_to_string(list_filter([CASE WHEN w < 300 OR h < 300 THEN 'Resolution too low: ' || w || 'x' || h || ' (minimum 300x300)' END,
  CASE WHEN h / w < 1.1 OR h / w > 2.2 THEN 'Unusual aspect ratio for a book cover: ' || printf('%.2f', h / w) END], lambda x: x IS NOT NULL), '; ') AS issues FROM s""",
}

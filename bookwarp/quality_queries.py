"""Queries of the general data-quality problems (orphan references, column profile) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwarp.operators.orphans import orphan_references, orphan_report
from bookwarp.operators.profile import column_profile, departures, profile
from bookwarp.stage import table

DEPARTURE = 0.155
PROFILED = (
    ("books", "pubdate", ("absent", "invalid", "out_of_range", "top_share")),
    ("books", "has_cover", ("absent", "true_share")),
    ("metadata_candidates", "publisher", ("absent", "top_share", "new_share")),
)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"book": (table(spark, sf_dir, "books"), "id"), "author": (table(spark, sf_dir, "authors"), "id")}
    return orphan_references(table(spark, sf_dir, "books_authors_link"), targets)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference that is missing or late."""
    return _orphans(spark, sf_dir).select("link_id", "ref", "kind")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references by field and month."""
    return orphan_report(_orphans(spark, sf_dir))


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all loads, rounded for display."""
    found = profile(spark, [(t, f"{sf_dir}/{t}.parquet", c, m) for t, c, m in PROFILED])
    return found.select("tbl", "col", "load_id", "metric", F.round("value", 6).alias("value"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loads in which a column departs from its usual behaviour."""
    found = profile(spark, [(t, f"{sf_dir}/{t}.parquet", c, m) for t, c, m in PROFILED])
    return departures(found, DEPARTURE).select("tbl", "col", "load_id", "metric")


EVERY_COLUMN = ("books", "authors", "books_authors_link", "identifiers", "metadata_candidates")


def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls, distinct values and range of every flat column of the catalogue."""
    return column_profile(spark, {t: f"{sf_dir}/{t}.parquet" for t in EVERY_COLUMN})


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p7_profile": p7_profile, "column_profiles": column_profiles}

_ORPHANS = """
WITH l AS (SELECT id, book, author, min(loaded_at) AS at FROM books_authors_link GROUP BY id, book, author),
b AS (SELECT id, min(loaded_at) AS at FROM books GROUP BY id), a AS (SELECT id, min(loaded_at) AS at FROM authors GROUP BY id),
o AS (
  SELECT l.id AS link_id, 'book' AS ref, CASE WHEN b.id IS NULL THEN 'missing' ELSE 'late' END AS kind, l.at
  FROM l LEFT JOIN b ON b.id = l.book WHERE l.book IS NOT NULL AND (b.id IS NULL OR b.at > l.at)
  UNION ALL
  SELECT l.id, 'author', CASE WHEN a.id IS NULL THEN 'missing' ELSE 'late' END, l.at
  FROM l LEFT JOIN a ON a.id = l.author WHERE l.author IS NOT NULL AND (a.id IS NULL OR a.at > l.at))
"""

_PROFILE = r"""
WITH v AS (
  SELECT 'books' AS tbl, 'pubdate' AS col, load_id, pubdate AS value FROM books UNION ALL
  SELECT 'books', 'has_cover', load_id, CAST(has_cover AS VARCHAR) FROM books UNION ALL
  SELECT 'metadata_candidates', 'publisher', load_id, publisher FROM metadata_candidates),
f AS (SELECT *, value IS NULL OR trim(value) = '' AS gone,
  CASE WHEN regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\+00:00)?')
       THEN TRY_CAST(left(value, 10) AS DATE) END AS day,
  min(load_id) OVER (PARTITION BY tbl, col, value) AS first_load, min(load_id) OVER (PARTITION BY tbl, col) AS start FROM v),
c AS (SELECT tbl, col, load_id, value, count(*) AS n FROM f WHERE NOT gone GROUP BY ALL),
t AS (SELECT tbl, col, load_id, max(n) AS n_top FROM c GROUP BY ALL),
g AS (SELECT tbl, col, load_id, any_value(start) AS start, count(*) AS n, count(*) FILTER (gone) AS n_absent, count(*) FILTER (NOT gone) AS n_there,
  count(*) FILTER (NOT gone AND day IS NULL) AS n_invalid, count(*) FILTER (NOT gone AND day IS NOT NULL) AS n_valid,
  count(*) FILTER (NOT gone AND (year(day) < 1450 OR year(day) > 2026)) AS n_out,
  count(*) FILTER (value = 'true') AS n_true, count(*) FILTER (NOT gone AND first_load = load_id) AS n_new FROM f GROUP BY tbl, col, load_id),
m AS (SELECT g.*, t.n_top FROM g LEFT JOIN t USING (tbl, col, load_id)),
p AS (
  SELECT tbl, col, load_id, 'absent' AS metric, n_absent / n AS value FROM m UNION ALL
  SELECT tbl, col, load_id, 'invalid', n_invalid / n_there FROM m WHERE col = 'pubdate' AND n_there > 0 UNION ALL
  SELECT tbl, col, load_id, 'out_of_range', n_out / n_valid FROM m WHERE col = 'pubdate' AND n_valid > 0 UNION ALL
  SELECT tbl, col, load_id, 'true_share', n_true / n_there FROM m WHERE col = 'has_cover' AND n_there > 0 UNION ALL
  SELECT tbl, col, load_id, 'top_share', n_top / n_there FROM m WHERE col <> 'has_cover' AND n_there > 0 UNION ALL
  SELECT tbl, col, load_id, 'new_share', n_new / n_there FROM m WHERE col = 'publisher' AND n_there > 0 AND load_id > start)
"""

_TABLES = {
    "books": "id:i title sort timestamp pubdate series_index:d author_sort path uuid has_cover:b last_modified load_id:i loaded_at:t",
    "authors": "id:i name sort link load_id:i loaded_at:t",
    "books_authors_link": "id:i book:i author:i load_id:i loaded_at:t",
    "identifiers": "id:i book:i type val",
    "metadata_candidates": "candidate_id:i source title isbn publisher description cover_url load_id:i fetched_at:t",
}


def _columns_sql() -> str:
    parts = []
    for tbl, columns in _TABLES.items():
        for c in columns.split():
            name, _, kind = c.partition(":")
            value = f"epoch_us({name})" if kind == "t" else name
            parts.append(
                f"SELECT '{tbl}' AS tbl, '{name}' AS col, count(*) AS rows, count(*) FILTER ({name} IS NULL) AS nulls, round(count(*) FILTER ({name} IS NULL) / count(*), 6) AS null_rate, "
                f"count(DISTINCT {name}) AS distinct_values, CAST(min({value}) AS VARCHAR) AS low, CAST(max({value}) AS VARCHAR) AS high FROM {tbl}"
            )
    return " UNION ALL ".join(parts)


SQL = {
    "column_profiles": _columns_sql(),
    "p6_found": _ORPHANS + "SELECT link_id, ref, kind FROM o",
    "p6_report": _ORPHANS + "SELECT ref, kind, strftime(o.at, '%Y-%m') AS period, count(*) AS n FROM o GROUP BY ALL",
    "p7_profile": _PROFILE + "SELECT tbl, col, load_id, metric, round(value, 6) AS value FROM p",
    "p7_found": _PROFILE + ", u AS (SELECT tbl, col, metric, median(value) AS usual FROM p GROUP BY ALL) SELECT p.tbl, p.col, p.load_id, p.metric FROM p JOIN u USING (tbl, col, metric) WHERE abs(p.value - u.usual) > 0.155",
}

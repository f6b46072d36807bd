"""Queries of the operators in this subpackage, and their SQL where it can state them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookwarp.llm import components, fusion, leakage, lookalike, matching, names, packing, subjects
from bookwarp.stage import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and names that look the same in different characters."""
    titles = table(spark, sf_dir, "books").select(F.lit("books").alias("tbl"), "id", F.col("title").alias("text"))
    names = table(spark, sf_dir, "authors").select(F.lit("authors").alias("tbl"), "id", F.col("name").alias("text"))
    return lookalike.same_look_pairs(titles.unionByName(names))


def _survivors(spark: SparkSession, sf_dir: str, half_life: float | None) -> DataFrame:
    names = ("duplicate_groups", "author_duplicate_groups", "books", "books_authors_link", "authors")
    return fusion.survivors(*[table(spark, sf_dir, t) for t in names], half_life)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that supplies each surviving field; the value that changed last holds."""
    return _survivors(spark, sf_dir, fusion.HOLDS)


def p2_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same if values never change: all claims count alike, whenever they were made."""
    return _survivors(spark, sf_dir, None)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that a `same` row names, with its group."""
    return components.connected_groups(table(spark, sf_dir, "match_pairs").filter("decision = 'same'"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a stretch of an item's passage."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("metadata_candidates", "books", "books_authors_link", "authors", "identifiers")
    return matching.matches(*[table(spark, sf_dir, t) for t in names])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books that each candidate describes."""
    return _matched(spark, sf_dir).select("candidate_id", "book_id")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the calibrated confidence of each match."""
    return _matched(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two ids of one person or organisation."""
    return names.linked_authors(table(spark, sf_dir, "authors"), table(spark, sf_dir, "author_duplicate_groups"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every author id, named by its smallest id, and how sure its name's form is to stand for one only."""
    found = cut(names.name_groups(table(spark, sf_dir, "authors"), table(spark, sf_dir, "author_duplicate_groups")))
    first = found.groupBy("person").agg(F.min("id").alias("group_id"))
    return found.join(first, "person").select(F.col("id").alias("author_id"), "group_id", F.round("score", 6).alias("score"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece for each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_targets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "pack_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two subjects of every text."""
    return subjects.assign(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "document_subjects"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_voted": p2_voted, "p3_found": p3_found, "p4_found": p4_found, "p4_confidence": p4_confidence, "p5_found": p5_found, "p5_groups": p5_groups, "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found}



def _look_sql() -> str:
    """The look-alike table's form as an expression over ``t``, for checking: letters by translate, signs by patterns."""
    import unicodedata

    nfc = lambda x: unicodedata.normalize("NFC", x)
    letters = dict(lookalike.LETTER)
    for a, b in lookalike.LETTER.items():  # letters with marks, as far as there are composed ones
        for mark in range(0x300, 0x345):
            if len(x := nfc(a + chr(mark))) == 1:
                letters[x] = nfc(b + chr(mark))
    wide = {chr(n): lookalike.same_width(chr(n)) for n in (*range(0xFF01, 0xFF5F), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07))}
    quote = lambda x: x.replace("'", "''")
    expr = "t"
    for a, b in wide.items():
        if len(b) > 1:
            expr = f"replace({expr}, '{a}', '{quote(b)}')"
    single = {a: b for a, b in wide.items() if len(b) == 1}
    expr = f"translate({expr}, '{''.join(single)}', '{quote(''.join(single.values()))}')"
    kept = r"regexp_replace({0}, '(\p{{Arabic}})[\x{{200c}}\x{{200d}}]+(\p{{Arabic}})', '\1' || chr(57344) || '\2', 'g')"
    for _ in range(2):  # a letter between two joiners belongs to both
        expr = kept.format(expr)
    expr = rf"replace(regexp_replace({expr}, '[\p{{Cf}}\x{{0}}-\x{{8}}\x{{e}}-\x{{1b}}\x{{7f}}]', '', 'g'), chr(57344), chr(8204))"
    many = {a: b for a, b in letters.items() if len(b) > 1}
    expr = f"nfc_normalize({expr})"
    for a, b in many.items():
        expr = f"replace({expr}, '{a}', '{b}')"
    one = {a: b for a, b in letters.items() if len(b) == 1}
    expr = f"nfc_normalize(translate({expr}, '{''.join(one)}', '{''.join(one.values())}'))"
    return rf"trim(regexp_replace({expr}, '[\s\p{{Z}}\x{{85}}\x{{0b}}\x{{2800}}]+', ' ', 'g'))"


SQL = {
    "p1_found": f"""
WITH x AS (SELECT 'books' AS tbl, id, title AS t FROM books UNION SELECT 'authors', id, name FROM authors),
k AS (SELECT tbl, id, t, {_look_sql()} AS form FROM x WHERE t IS NOT NULL AND id IS NOT NULL)
SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.tbl = b.tbl AND a.form = b.form AND a.t <> b.t AND a.id < b.id WHERE a.form <> ''""",
    "p2_found": r"""
WITH stand AS (SELECT unnest(['unknown','untitled','n/a','na','none','null','nil','-','--','?','??','???','n.n.','anonymous','anon.','tbd','tba','no title','not known','[unknown]','(unknown)','']) AS s),
b AS (SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
a AS (SELECT * FROM authors QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1),
m AS (SELECT DISTINCT group_id, unnest(book_ids) AS id FROM duplicate_groups),
h AS (SELECT m.group_id, b.* FROM m JOIN b ON b.id = m.id),
n AS (SELECT m.group_id, unnest([x.name, x.sort]) AS name FROM m JOIN books_authors_link l ON l.book = m.id JOIN authors x ON x.id = l.author UNION SELECT group_id, author_sort FROM h),
e AS (SELECT DISTINCT group_id, list_sort(regexp_extract_all(lower(strip_accents(LOOK)), '[\p{L}\p{N}]+')) AS sig FROM (SELECT group_id, name AS t FROM n)),
ti AS (SELECT DISTINCT id, list_sort(regexp_extract_all(lower(strip_accents(LOOK)), '[\p{L}\p{N}]+')) AS sig FROM (SELECT id, title AS t FROM h)),
bc AS (
  SELECT group_id, 'title' AS field, id, last_modified AS chg FROM h WHERE title IS NOT NULL AND lower(trim(title)) NOT IN (SELECT s FROM stand)
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.group_id = h.group_id AND len(e.sig) > 0 AND e.sig = (SELECT ti.sig FROM ti WHERE ti.id = h.id))
  UNION ALL SELECT group_id, 'author_sort', id, last_modified FROM h WHERE author_sort IS NOT NULL AND lower(trim(author_sort)) NOT IN (SELECT s FROM stand)
  UNION ALL SELECT group_id, 'pubdate', id, last_modified FROM h WHERE regexp_full_match(pubdate, '[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\+00:00)?')
    AND year(TRY_CAST(left(pubdate, 10) AS DATE)) BETWEEN 1450 AND 2026),
am AS (SELECT DISTINCT group_id, unnest(list_prepend(canonical_author_id, duplicate_author_ids)) AS id FROM author_duplicate_groups),
ah AS (SELECT am.group_id, a.*, (a.sort IS NOT NULL AND lower(trim(a.sort)) NOT IN (SELECT s FROM stand)) AS s_ok,
  coalesce(regexp_full_match(lower(trim(a.link)), 'https?://[^\s/?#]+\.[^\s/?#.]+(:[0-9]+)?/\S+'), false) AS l_ok FROM am JOIN a ON a.id = am.id),
ac AS (SELECT group_id, 'sort' AS field, id, loaded_at AS chg FROM ah WHERE s_ok UNION ALL SELECT group_id, 'link', id, loaded_at FROM ah WHERE l_ok)
SELECT 'book' AS grp, group_id, field, id AS record_id FROM bc QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY chg DESC) = 1
UNION ALL SELECT 'author', group_id, field, id FROM ac QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY chg DESC) = 1
UNION ALL SELECT 'author', group_id, 'canonical_author_id', id FROM ah QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY s_ok::INT + l_ok::INT DESC, loaded_at DESC) = 1""".replace("LOOK", _look_sql()),
    "p3_found": """
WITH RECURSIVE e AS (
  SELECT kind, id_a AS a, id_b AS b FROM match_pairs WHERE decision = 'same' UNION SELECT kind, id_b, id_a FROM match_pairs WHERE decision = 'same'
  UNION SELECT kind, id_a, id_a FROM match_pairs WHERE decision = 'same' UNION SELECT kind, id_b, id_b FROM match_pairs WHERE decision = 'same'),
r(kind, a, g) AS (
  SELECT kind, a, min(b) FROM e WHERE a IS NOT NULL GROUP BY kind, a
  UNION
  SELECT e.kind, e.b, min(r.g) FROM r JOIN e ON e.kind = r.kind AND e.a = r.a WHERE e.b IS NOT NULL GROUP BY e.kind, e.b)
SELECT kind, a AS record_id, min(g) AS group_id FROM r GROUP BY kind, a""",
}

import re
from difflib import SequenceMatcher

import pytest

from bookwarp.model import Criterion
from bookwarp.operators import assemble, duplicates, score, search, series, statistics
from bookwarp.operators.inspect import dashboard, inspection
from bookwarp.plans import changes, files, organize
from bookwarp.reports import presets, sinks, tables
from bookwarp.sources import files as F
from bookwarp.sources import sqlite
from tests.books import make


def test_assembly_from_sqlite(spark, database):
    books = assemble.assemble(sqlite.read_catalogue(spark, database))
    one, two = books.orderBy("id").collect()
    assert (one.rating, one.languages, one.tags, one.series.name, one.size, one.publisher, one.isbn, one.has_cover) == (4.0, ["eng"], ["Horror"], "The Shining", 1000, "Scribner", "9781501144525", True)
    assert (two.series, two.rating, two.comments, two.publisher, two.authors, two.size) == (None, 0.0, "", "", [], 2000)
    assert [r.author for r in assemble.table_rows(books).orderBy("book_id").collect()] == ["Stephen King", "Unknown"]
    assert [r.score for r in score.scored(books).orderBy("book_id").collect()] == [100, 20]
    assert score.average_score(books).first()[0] == 60
    counts = {r.metric: r.value for r in statistics.summary(books).collect()}
    assert (counts["total_books"], counts["unique_authors"], counts["missing_isbn"], counts["missing_series"], counts["unique_formats"]) == (2, 1, 1, 1, 2)
    assert [r.id for r in search.search(books, ["author=King", "isbn:present"]).collect()] == [1]
    found = {r.book_id: r for r in score.analysis(books).collect()}
    assert found[1].needs_attention and found[2].repair_suggestions[0].suggested_value == "The Maze of Bones"
    assert {r.label: r.value for r in dashboard(books).collect()}["Books needing attention"] == 2


def test_only_books_and_empty(spark):
    books = spark.createDataFrame([(7, None)], "id bigint, title string")
    row = assemble.assemble({"books": books}).first()
    assert (row.title, row.authors, row.size, row.isbn) == ("", [], 0, "")
    none = make(spark)
    assert statistics.summary(none).filter("value <> 0").count() == 0 and score.average_score(none).first()[0] == 0
    assert duplicates.title_groups(none).count() == 0 and series.series_issues(none).count() == 0 and statistics.statistics_long(none).count() == 0


def test_sqlite_pushdown(spark, database):
    read = lambda **kw: sqlite.read_sqlite(spark, database, "books", **kw)
    assert read(columns="id,title").columns == ["id", "title"]
    assert read(partitions=2, partition_column="id").count() == 2 and read(limit=1).count() == 1
    assert [r.id for r in read().filter("id = 2 and title is not null").collect()] == [2]
    assert "books" in sqlite.table_names(database) and "title text" in sqlite.schema_text(database).lower()


LIBRARY = [
    {"title": "Doctor Sleep", "title_sort": "Doctor Sleep", "isbn": "9781501144525", "rating": 4.0, "has_cover": True, "languages": ["eng"], "tags": ["Horror"], "formats": ["EPUB", "PDF"], "timestamp": "2020-01-01", "last_modified": "2020-06-01", "series": "The Shining", "series_index": 2.0, "size": 1000, "author": "Stephen King"},
    {"title": "The Gunslinger", "title_sort": "Gunslinger, The", "formats": ["MOBI"], "timestamp": "2019-01-01", "last_modified": "2019-01-01", "series": "Dark Tower", "series_index": 1.0, "size": 500, "author": "Stephen King"},
    {"title": "The Maze of Bones by Rick Riordan", "title_sort": "Maze of Bones", "timestamp": "2021-01-01", "last_modified": "2021-01-01", "size": 200},
]


@pytest.mark.parametrize(
    ("terms", "ids"),
    [
        (["title=gunslinger"], [2]), (["title:exact=doctor sleep"], [1]), (["author=king"], [1, 2]), (["series:missing"], [3]), (["isbn:present"], [1]), (["missing-isbn"], [2, 3]), ([Criterion("has_cover", "eq", "1")], [1]),
        (["rating>=4"], [1]), (["title:starts_with=the"], [2, 3]), (["title:ends_with=riordan"], [3]), (["title:regex=^The Maze"], [3]), ([Criterion("title", "regex", "(?P<x>maze)")], [3]), (["title:fuzzy=doctor sleap"], [1]), (["author=king", "isbn:present"], [1]), (["rating=4"], [1]), (["language:missing"], [2, 3]), (["title=x:y"], []),
    ],
)
def test_search(spark, terms, ids):
    assert sorted(r.id for r in search.search(make(spark, *LIBRARY), terms).collect()) == ids


def test_search_sorts_and_errors(spark):
    books = make(spark, *LIBRARY)
    assert [r.id for r in search.search(books, [], "series").collect()] == [3, 2, 1]
    assert [r.id for r in search.search(books, [], "rating", True).collect()] == [1, 2, 3]
    assert [r.id for r in search.search(books, [], "size", limit=2).collect()] == [3, 2]
    for bad in (Criterion("nothing", "exact", "x"), Criterion("title", "like", "x"), Criterion("title", "regex", "(unclosed")):
        with pytest.raises(ValueError):
            search.search(books, [bad])
    with pytest.raises(ValueError):
        search.search(books, [], "colour")


def test_terms():
    parse = search.parse_term
    assert parse("rating>=4") == Criterion("rating", "gte", "4") and parse("rating=4").operator == "eq" and parse("missing-cover") == Criterion("has_cover", "missing")
    assert parse(r"path=C:\Books\Doctor Sleep.epub") == Criterion("path", "contains", r"C:\Books\Doctor Sleep.epub")
    assert parse("title:regex=a>b") == Criterion("title:regex=a", "gt", "b") and parse(" title : exact = x ") == Criterion("title", "exact", "x")
    with pytest.raises(ValueError):
        parse("just some text")


def groups(df):
    return sorted(r.book_ids for r in df.collect())


def test_duplicates(spark):
    isbn = make(spark, {"isbn": "9780306406157"}, {"isbn": "9780306406157"}, {"isbn": "0306406152"})
    assert groups(duplicates.isbn_groups(isbn)) == [[1, 2]]
    title = lambda *rows, t=0.95: groups(duplicates.title_groups(make(spark, *rows), t))
    by = lambda t, a="Stephen King", s=None: {"title": t, "author": a, "author_sort_name": s}
    assert title(by("Doctor Sleep"), by("Doctor Sleep "), by("The Gunslinger")) == [[1, 2]]
    assert title(by("Night Watch", "A"), by("Night Watch", "B")) == []
    assert title(by("Steve Berry", "Berry, Steve"), by("Berry Steve", "Berry, Steve")) == []
    assert title(by("Elminster 1 - Greenwood, Ed"), by("Elminster 2 - Greenwood, Ed")) == []
    assert title(by("Point Blank - Coulter, Catherine"), by("Point Blank - Coulter, Catherine(1)")) == [[1, 2]]
    assert title(by("Mystery Book", None), by("Mystery Book", None)) == [[1, 2]]
    assert title(by("Doctor Sleep"), by("Doctor Sleeq"), t=0.99) == [] and title(by("Doctor Sleep"), by("Doctor Sleeq"), t=0.8) == [[1, 2]]


def brute_titles(titles, threshold):
    out, taken = [], set()
    for i, a in enumerate(titles):
        if i in taken:
            continue
        group = [i + 1]
        for j in range(i + 1, len(titles)):
            b = titles[j]
            if j not in taken and (a == b or re.sub(r"\d+", "", a) != re.sub(r"\d+", "", b)) and SequenceMatcher(None, a, b).ratio() >= threshold:
                group.append(j + 1)
                taken.add(j)
        if len(group) > 1:
            taken.add(i)
            out.append(group)
    return sorted(out)


def test_title_groups_equal_a_pass_over_the_list(spark):
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(8, 45))).strip() for _ in range(12)]
    titles = []
    for _ in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice("abcdefgh1")
        titles.append("".join(t).strip())
    for threshold in (0.95, 0.85):
        got = groups(duplicates.title_groups(make(spark, *[{"title": t, "author": "A"} for t in titles]), threshold))
        assert got == brute_titles(titles, threshold)


def test_title_keys_are_few_and_lose_no_pair():
    import random

    import pandas as pd

    rng = random.Random(7)
    meets = 0
    for _ in range(4000):
        t = rng.choice((0.95, 0.9, 0.8))
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 45)))
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", *"abcd"])
        short, long = sorted((a, "".join(b)), key=len)
        if max(SequenceMatcher(None, short, long).ratio(), SequenceMatcher(None, long, short).ratio()) < t:
            continue
        frame = lambda title: iter([pd.DataFrame({"block": ["x"], "title": [title], "first_id": [1], "longer": [len(long)]})])
        cut_up, sought = (pd.concat(duplicates._keys(t, indexed)(frame(x))) for x, indexed in ((long, True), (short, False)))
        both = cut_up.merge(sought, on="key")
        assert any((p ^ q).bit_count() <= m for p, q, m in zip(both["signature_x"], both["signature_y"], both["most_y"], strict=True)), (short, long, t)
        meets += 1
    assert meets > 1000
    # a title of 30 characters looks for others of 30 to 33
    assert sum(len(duplicates._places(30, n, 0.95)[1]) for n in range(30, 34)) <= 20


def test_authors_and_merge(spark):
    authors = spark.createDataFrame([(1, "Stephen King"), (5, "King, Stephen"), (9, "King Stephen"), (10, "Jim Butcher"), (3, "Butcher, Jim"), (4, " "), (6, None)], "id bigint, name string")
    found = {r.canonical_author_id: r.duplicate_author_ids for r in duplicates.author_groups(authors).collect()}
    assert found == {1: [5, 9], 3: [10]}
    links = spark.createDataFrame([(1, 1, 1), (2, 2, 5), (3, 3, 1), (4, 3, 5)], "id bigint, book bigint, author bigint")
    two = duplicates.author_groups(authors)
    assert sorted(tuple(r) for r in changes.merged_links(links, two).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert sorted(r.id for r in changes.merged_authors(authors, two).collect()) == [1, 3, 4, 6]


@pytest.mark.parametrize(
    ("positions", "expected"),
    [([1, 2, 3], []), ([1, 1], ["duplicate_position"]), ([1, 2, 4], ["gap"]), ([0, 0], []), ([1, 1.5, 2], []), ([1, 1.5, 1.5, 2], ["duplicate_position"]), ([5], [])],
)
def test_series(spark, positions, expected):
    rows = series.series_issues(make(spark, *[{"series": "S", "series_index": float(p)} for p in positions])).collect()
    assert [r.issue_type for r in rows] == expected
    if expected == ["gap"]:
        assert rows[0].detail == "missing position(s) [3] between 1 and 4"
    if positions == [1, 1]:
        assert rows[0].detail == "position 1 used by books [1, 2]"


def test_statistics_and_validation(spark):
    books = make(spark, {"title": "Small", "size": 100, "pubdate": "2020-01-01"}, {"title": "Big", "size": 5000, "pubdate": "0101-01-01"}, {"title": "Empty", "author": "A"}, {"title": "Taylor, Roger", "author": "Taylor, Roger", "author_sort_name": "Taylor, Roger"}, {"title": "   ", "series": "A", "series_index": 0.0}, {"title": "T", "series": "A", "isbn": "1234567890"})
    assert [(r.label, r.n) for r in statistics.books_per_year(books).collect()] == [("2020", 1)]
    assert [r.title for r in statistics.largest_books(books, 2).collect()] == ["Big", "Small"] and [r.title for r in statistics.smallest_books(books).collect()] == ["Small", "Big"]
    codes = {}
    for r in score.validation_issues(books).orderBy("book_id", "n").collect():
        codes.setdefault(r.book_id, []).append(r.code)
    assert codes == {4: ["title_matches_author", "title_matches_author"], 5: ["empty_title"], 6: ["series_index_zero", "invalid_isbn"]}
    assert [r.suggested_value for r in score.repair_suggestions(books).collect()] == [""]
    assert set(inspection(books)) == {"analyses", "isbn_groups", "title_groups", "series_issues", "scores"}
    assert "Average score" in presets.preset("health", books) and presets.preset("series", make(spark)) == "Nothing found."


def test_organize_and_files(spark, tmp_path):
    books = make(spark, {"title": "Same Title", "author": "Same Author", "path": "Same Author/Same Title", "format_files": [("EPUB", "old", 1)]}, {"title": "same title", "author": "Same Author", "path": "x"}, {"title": "Some Book", "path": "gone"})
    plan = organize.organize_plan(books)
    assert [r.proposed_path for r in plan.orderBy("book_id").collect()] == ["Same Author/Same Title", "Same Author/same title (2)", "Unknown/Some Book"]
    assert organize.plan_report(plan).filter("book_id = 1").first().format_renames == "old -> Same Title"
    (tmp_path / "Same Author" / "Same Title").mkdir(parents=True)
    (tmp_path / "Same Author" / "Same Title" / "old.epub").write_text("x")
    (tmp_path / "x").mkdir()
    assert not any(r.moved for r in files.carry_out(plan, tmp_path))
    done = {r.book_id: r for r in files.carry_out(plan, tmp_path, apply=True)}
    assert done[1].renamed == ["Same Title"] and done[2].moved and "Source folder not found" in done[3].error
    assert presets.failures(list(done.values())) == [f"3: {done[3].error}"]


def test_leaders_as_in_a_pass(spark):
    import random

    rng = random.Random(3)
    for n in (3, 14):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
        lead = {}
        for v in range(n):
            before = [a for a, b in pairs if b == v and lead[a] == a]
            lead[v] = min(before, default=v)
        got = {r.id: r.leader for r in duplicates.leaders(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
        assert got == {v: a for v, a in lead.items() if a != v}


def test_places_without_one_task(spark):
    books = make(spark, *[{"title": f"T {i % 7}"} for i in range(40)])
    got = [r.id for r in search.places(books, "title", True).orderBy("place").collect()]
    want = [r.id for r in search.search(books, [], "title", True).collect()]
    assert got == want and [r.place for r in search.places(books, "title").orderBy("place").collect()] == list(range(1, 41))
    assert search.places(books.limit(0), "title").count() == 0


def test_organized_tables(spark):
    plan = spark.createDataFrame([(1, True, "new/a", [("EPUB", "old", "a")]), (2, True, "new/b", []), (3, False, "c", [("PDF", "x", "c"), ("EPUB", "c", "c")])], "book_id bigint, folder_changed boolean, proposed_path string, format_renames array<struct<format:string,old_name:string,new_name:string>>")
    books = spark.createDataFrame([(1, "a", False), (2, "b", None), (3, "c", True), (4, "d", False)], "id bigint, path string, has_cover boolean")
    failed = spark.createDataFrame([(2, "PDF")], "book_id bigint, format string")
    assert sorted(r.path for r in changes.moved_books(books, plan, failed).collect()) == ["b", "c", "d", "new/a"]
    data = spark.createDataFrame([(1, "EPUB", "old"), (3, "PDF", "x"), (3, "EPUB", "c"), (9, "PDF", "y")], "book bigint, format string, name string")
    assert sorted((r.book, r.format, r.name) for r in changes.renamed_files(data, plan).collect()) == [(1, "EPUB", "a"), (3, "EPUB", "c"), (3, "PDF", "c"), (9, "PDF", "y")]
    assert {r.id: r.has_cover for r in changes.with_covers(books, failed).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_changes(spark, tmp_path):
    books = spark.createDataFrame([(1, "A", "A"), (2, "The B by C D", "x")], "id bigint, title string, sort string")
    suggested = spark.createDataFrame([(2, "title", "The B"), (1, "title", ""), (1, "isbn", "9")], "book_id bigint, field string, suggested_value string")
    assert {(r.id, r.title, r.sort) for r in changes.apply_repairs(books, suggested).collect()} == {(1, "A", "A"), (2, "The B", "B, The")}
    assert sorted(r.error for r in changes.repair_results(suggested).collect()) == ["", "Don't know how to apply repairs to field 'isbn'", "No suggested value - needs manual review"]
    with pytest.raises(FileNotFoundError):
        changes.backup_file(tmp_path / "none.db")
    place = changes.snapshot(books, str(tmp_path), "books")
    assert spark.read.parquet(place).count() == 2


def test_reports_and_csv(spark, tmp_path):
    books = make(spark, {"title": "<script>", "author": "A"}, {"title": "B, \"C\"\nD"})
    table = tables.health(books).orderBy("book_id")
    path = sinks.write_report(table, tmp_path / "r.csv", "csv")
    assert path.read_bytes().startswith(b"book_id,title,score,failed_checks\r\n")
    assert [r.title for r in F.read_csv(spark, path).collect()] == ["<script>", "B, \"C\"\nD"]
    assert "&lt;script&gt;" in sinks.write_report(table, tmp_path / "r.html", "html").read_text()
    import json

    assert [r["score"] for r in json.loads(sinks.write_report(table, tmp_path / "r.json", "json").read_text())] == [40, 20]
    for kind in ("excel", "pdf"):
        try:
            sinks.write_report(table, tmp_path / "r.x", kind)
        except ImportError as error:
            assert "pip install" in str(error)
    with pytest.raises(ValueError):
        sinks.write_report(table, tmp_path / "r", "docx")
    with pytest.raises(FileNotFoundError):
        F.read_csv(spark, tmp_path / "none.csv")
    assert F.read_settings(tmp_path / "none.json") == {}
    for name, report in tables.REPORTS.items():
        assert report(books).columns, name


def test_cli(spark, database, tmp_path):
    import io

    from bookwarp import cli

    run = lambda *a: (out := io.StringIO(), cli.main(["--database", str(database), *a], spark, out))[0].getvalue()
    assert "Doctor Sleep" in run("preview") and "60" in run("health") and "Total books: 2" in run("analyze")
    assert "Doctor Sleep" in run("search", "author=king")
    assert "r.csv" in run("report", "series", "--output", str(tmp_path / "r.csv"))
    assert "The Maze of Bones" in run("repair", "--apply", str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new" / "books.parquet")).filter("title = 'The Maze of Bones'").count() == 1
    assert "Doctor Sleep" in run("organize", "--library", str(tmp_path))


def test_cli_writes_back(spark, database, tmp_path):
    """Moved folders, renamed files and saved covers are noted in the database, after a backup."""
    import io
    import shutil
    import sqlite3

    from bookwarp import cli
    from bookwarp.plans import files as plan_files
    from tests.test_providers import jpeg, png

    own = tmp_path / "own" / "metadata.db"
    own.parent.mkdir()
    shutil.copy(database, own)
    run = lambda *a: (out := io.StringIO(), cli.main(["--database", str(own), *a], spark, out))[0].getvalue()
    with sqlite3.connect(own) as db:
        path, = db.execute("select path from books where id = 1").fetchone()
        (tmp_path / path).mkdir(parents=True)
        for fmt, name in db.execute("select format, name from data where book = 1"):
            (tmp_path / path / f"{name}.{fmt.lower()}").write_text("x")
    said = run("organize", "--library", str(tmp_path), "--apply")
    assert "1 moved, 1 failed" in said and "backup" in said
    with sqlite3.connect(own) as db:
        assert dict(db.execute("select id, path from books"))[1] == "Stephen King/Doctor Sleep" and "(2)" in dict(db.execute("select id, path from books"))[2]
        assert {n for n, in db.execute("select name from data where book = 1")} == {"Doctor Sleep"}
    images = tmp_path / "images"
    images.mkdir()
    (images / "1.jpg").write_bytes(jpeg(1000, 1500))
    (images / "1.png").write_bytes(png(100, 150))
    (tmp_path / "Stephen King/Doctor Sleep/cover.jpg").write_bytes(png(1, 1))
    kept = plan_files.save_cover
    saved = []
    plan_files.save_cover = lambda folder, content: saved.append((str(folder), len(content))) or ""
    try:
        listed = run("covers", "--folder", str(images), "--book", "1", "--library", str(tmp_path))
        assert "[1]" in listed and "[2]" in listed and "Resolution too low" in listed and not saved
        assert "No candidate" in run("covers", "--folder", str(images), "--book", "1", "--apply", "--candidate", "9")
        assert "not valid" in run("covers", "--folder", str(images), "--book", "1", "--apply", "--candidate", "2")
        with sqlite3.connect(own) as db:
            db.execute("update books set has_cover = 0")
        assert "Cover saved" in run("covers", "--folder", str(images), "--book", "1", "--library", str(tmp_path), "--apply", "--best")
        (tmp_path / "Stephen King/Doctor Sleep/cover.jpg").write_bytes(jpeg(1000, 1500))
        assert "same as the present cover" in run("covers", "--folder", str(images), "--library", str(tmp_path))
    finally:
        plan_files.save_cover = kept
    assert len(saved) == 1 and saved[0][0].endswith("Stephen King/Doctor Sleep")
    with sqlite3.connect(own) as db:
        assert dict(db.execute("select id, has_cover from books")) == {1: 1, 2: 0}
    assert "not found" in run("covers", "--folder", str(images), "--book", "77") and "need --book" in run("covers", "--service", "openlibrary")


def test_latest_fields(spark):
    from bookwarp.stage import latest, latest_fields

    rows = spark.createDataFrame([(1, 1, "old", 5), (1, 2, "new", None), (1, 2, "even", 3), (None, 9, "x", 1), (2, None, "only", 4)], "id bigint, at int, a string, b int")
    assert sorted(tuple(r) for r in latest_fields(rows, "id", "at", "a", "b").collect()) == [(1, "new", 3), (2, "only", 4)]
    assert sorted(tuple(r) for r in latest(rows, "id", "at", "a").collect()) == [(1, 2, "new"), (2, None, "only")]
    plan = latest_fields(rows, "id", "at", "a", "b").select("id", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "b#" not in plan.split("LogicalRDD")[0]


def test_log(spark, database, tmp_path):
    import io

    from bookwarp import cli

    for _ in range(2):
        assert cli.main(["--database", str(database), "--log", str(tmp_path / "log"), "preview", "--limit", "1"], spark, io.StringIO()) == 0
    lines = (tmp_path / "log" / "library.log").read_text().splitlines()
    assert len(lines) == 4 and lines[0].endswith(f"INFO preview on {database}") and lines[1].endswith("INFO ended with 0")


ONCE = [{"title": "Doctor Sleep", "author": "A", "isbn": "1", "comments": "\n"}, {"title": "Doctor Sleep ", "author": "A", "isbn": "1", "comments": "Told."}, {"title": "B", "author": "A"}]


def stored(spark, path):
    make(spark, *ONCE).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_duplicate_report_evaluates_the_books_once(spark, tmp_path):
    authors = spark.createDataFrame([(1, "A", "A")], "id bigint, name string, sort string")
    report = duplicates.duplicate_report(stored(spark, tmp_path / "books"), authors)
    assert "FileScan" not in report._jdf.queryExecution().toString()  # the books come from one checkpoint
    assert sorted((r.type, r.ids) for r in report.collect()) == [("isbn", "[1, 2]"), ("title", "[1, 2]")]


def test_dashboard_evaluates_the_books_once(spark, tmp_path):
    tiles = dashboard(stored(spark, tmp_path / "books"))
    assert "FileScan" not in tiles._jdf.queryExecution().toString()
    got = {r.label: r.value for r in tiles.collect()}
    assert (got["Total books"], got["Missing description"], got["Title duplicate groups"], got["Average health score"]) == (3, 1, 1, 60)

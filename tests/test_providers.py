import json
import struct
import urllib.error

import pytest

from bookwarp.operators import covers
from bookwarp.providers import lookup, mapping
from bookwarp.sources.cache import ResponseCache, cached_answers, read_cache


def bodies(spark, value):
    return spark.createDataFrame([(1, json.dumps(value))], "id bigint, body string")


def test_mappings(spark):
    record = {"ISBN:1": {"title": "T", "authors": [{"name": "A"}], "identifiers": {"isbn_13": ["978"]}, "publishers": [{"name": "P"}], "cover": {"large": "L"}, "excerpts": [{"text": "E"}]}}
    assert tuple(mapping.open_library_records(bodies(spark, record)).first()) == (1, "openlibrary", "T", ["A"], "978", "P", "E", "L")
    doc = {"docs": [{"title": "T", "author_name": ["A", "B"], "isbn": ["9"], "publisher": ["P"], "cover_i": 5}, {"title": "U"}]}
    rows = mapping.open_library_search(bodies(spark, doc)).collect()
    assert rows[0].cover_url == "https://covers.openlibrary.org/b/id/5-L.jpg" and (rows[1].authors, rows[1].isbn, rows[1].cover_url) == ([], "", "")
    item = {"items": [{"volumeInfo": {"title": "T", "authors": ["A"], "industryIdentifiers": [{"type": "ISBN_10", "identifier": "1"}, {"type": "ISBN_13", "identifier": "3"}], "imageLinks": {"thumbnail": "http://x/y"}}}, {}]}
    rows = mapping.google_books(bodies(spark, item)).collect()
    assert (rows[0].isbn, rows[0].cover_url, rows[1].title, rows[1].isbn) == ("3", "https://x/y", "", "")
    docs = {"response": {"docs": [{"identifier": "id1", "title": "T", "creator": "A", "publisher": ["P", "Q"]}, {"title": "U", "creator": ["A", "B"]}]}}
    rows = mapping.internet_archive(bodies(spark, docs)).collect()
    assert (rows[0].authors, rows[0].publisher, rows[0].cover_url) == (["A"], "P", "https://archive.org/services/img/id1") and rows[1].authors == ["A", "B"]
    for f in (mapping.open_library_search, mapping.google_books, mapping.internet_archive, mapping.open_library_records):
        assert f(bodies(spark, {})).count() == 0


def test_cache_and_lookup(spark, tmp_path):
    now = [1000.0]
    cache = ResponseCache(tmp_path, 10, lambda: now[0])
    asked, slept = [], []

    def fetch(url, timeout, user_agent):
        asked.append(url)
        return {"docs": [{"title": "T"}]}

    find = lookup.Lookup("openlibrary", cache, fetch, clock=lambda: now[0], sleep=slept.append)
    assert find.candidates(spark, 1, "", "Title", "Unknown").first().title == "T"
    assert find.candidates(spark, 1, "", "Title", "Unknown").count() == 1 and len(asked) == 1
    assert find.candidates(spark, 1, "", "", "A").count() == 0
    find.answer("http://other")
    assert slept == [1.0]
    entries = read_cache(spark, tmp_path)
    requests = spark.createDataFrame([(asked[0],), ("none",)], "url string")
    assert cached_answers(requests, entries, 1010.0, 10).filter("body is not null").count() == 1
    assert cached_answers(requests, entries, 1010.1, 10).filter("body is not null").count() == 0
    now[0] = 1011
    assert cache.get(asked[0]) is None
    cache.place("bad").write_text("{")
    assert cache.get("bad") is None
    assert lookup.Lookup("googlebooks", cache, None, offline=True).answer("x") == {}

    def fail(*_, **__):
        raise urllib.error.URLError("down")

    with pytest.raises(lookup.ProviderUnavailable):
        lookup.Lookup("internetarchive", cache, fail).answer("y")
    with pytest.raises(NotImplementedError):
        lookup.IsbndbProvider().lookup(1)
    assert "%2Binauthor%3A" in lookup.SERVICES["googlebooks"].address("", "T", "A")


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" + b"\0" * 200


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", w, h) + b"\0" * 200


def webp(w, h):
    return b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + b"\0" * 200


def test_covers(spark, tmp_path):
    images = [(1, "a", jpeg(1000, 1500)), (1, "b", png(100, 150)), (1, "c", webp(1000, 1000)), (2, "d", b"x" * 500), (2, "e", b"tiny"), (3, "f", png(1200, 1800)), (3, "g", None)]
    found = covers.examined(spark.createDataFrame(images, "book_id bigint, origin string, content binary"))
    by = {r.origin: r for r in found.collect()}
    assert by["a"].is_valid and by["a"].quality == 100 and by["a"].format == "JPEG"
    assert "Resolution too low" in by["b"].issues[0] and "aspect ratio" in by["c"].issues[0] and "Corrupt" in by["d"].issues[0] and by["e"].issues == ["File too small (4 bytes)"]
    have = spark.createDataFrame([(1, jpeg(1000, 1500)), (3, b"other")], "book_id bigint, content binary")
    flagged = covers.flag_duplicates(found, have)
    assert [r.origin for r in flagged.filter("is_duplicate").collect()] == ["a"]
    assert [(r.book_id, r.origin) for r in covers.best_covers(flagged).collect()] == [(3, "f")]
    assert covers.candidate_lines(flagged).count() == 7
    (tmp_path / "5.jpg").write_bytes(jpeg(10, 20))
    (tmp_path / "x.jpg").write_bytes(jpeg(10, 20))
    assert [r.book_id for r in covers.user_folder_covers(spark, str(tmp_path)).collect()] == [5]
    assert covers.image_header(b"\xff\xd8\xff") is None and covers.image_header(b"") is None


def test_downloads_and_their_faults(spark):
    urls = [(1, "s", "good"), (1, "s", "slow"), (1, "s", "gone"), (1, "s", ""), (1, "s", None)]
    candidates = spark.createDataFrame(urls, "id bigint, source string, cover_url string")

    def fetch(url):
        if url == "slow":
            raise TimeoutError("10 s")
        if url == "gone":
            raise OSError("404")
        return b"\xff\xd8" + b"x" * 200

    folder = spark.createDataFrame([(1, "f.jpg", jpeg(1000, 1500))], "book_id bigint, origin string, content binary")
    found = {r.origin: r for r in covers.gathered(folder, covers.downloaded_covers(spark, candidates, fetch)).collect()}
    assert found["slow"].issues == ["Download timed out: 10 s"] and found["gone"].issues == ["Download failed: 404"] and not found["gone"].is_valid
    assert found["good"].issues == ["Corrupt or unreadable image"] and found["f.jpg"].is_valid and len(found) == 4

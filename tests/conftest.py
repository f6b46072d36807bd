import sqlite3

import pytest

from bookwarp.functions.text import title_sort  # noqa: F401  (the library must import without a session)
from bookwarp.session import local_session

SCHEMA = """
create table books (id integer primary key, title text, sort text, timestamp timestamp, pubdate timestamp, series_index real, author_sort text, path text, uuid text, has_cover bool, last_modified timestamp);
create table authors (id integer primary key, name text, sort text, link text);
create table books_authors_link (id integer primary key, book integer, author integer);
create table series (id integer primary key, name text, sort text, link text);
create table books_series_link (id integer primary key, book integer, series integer);
create table identifiers (id integer primary key, book integer, type text, val text);
create table comments (id integer primary key, book integer, text text);
create table publishers (id integer primary key, name text, sort text, link text);
create table books_publishers_link (id integer primary key, book integer, publisher integer);
create table ratings (id integer primary key, rating integer, link text);
create table books_ratings_link (id integer primary key, book integer, rating integer);
create table languages (id integer primary key, lang_code text, link text);
create table books_languages_link (id integer primary key, book integer, lang_code integer, item_order integer);
create table tags (id integer primary key, name text, link text);
create table books_tags_link (id integer primary key, book integer, tag integer);
create table data (id integer primary key, book integer, format text, uncompressed_size integer, name text);
"""
ROWS = {
    "books": [
        (1, "Doctor Sleep", "Doctor Sleep", "2020-01-01", "2013-01-01", 0, "King, Stephen", "Stephen King/Doctor Sleep (1)", "uuid-1", 1, "2020-06-01"),
        (2, "The Maze of Bones by Rick Riordan", "Maze of Bones by Rick Riordan, The", "2020-01-02", "", 1.0, "Unknown", "Unknown/The Maze of Bones by Rick Riordan (2)", "uuid-2", 0, "2020-01-02"),
    ],
    "authors": [(1, "Stephen King", "King, Stephen", "")],
    "books_authors_link": [(1, 1, 1)],
    "series": [(1, "The Shining", "Shining, The", "")],
    "books_series_link": [(1, 1, 1)],
    "identifiers": [(1, 1, "isbn", "9781501144525")],
    "comments": [(1, 1, "A haunted boy grows up.")],
    "publishers": [(1, "Scribner", None, "")],
    "books_publishers_link": [(1, 1, 1)],
    "ratings": [(1, 8, "")],
    "books_ratings_link": [(1, 1, 1)],
    "languages": [(1, "eng", "")],
    "books_languages_link": [(1, 1, 1, 0)],
    "tags": [(1, "Horror", "")],
    "books_tags_link": [(1, 1, 1)],
    "data": [(1, 1, "EPUB", 1000, "Doctor Sleep - Stephen King"), (2, 2, "PDF", 2000, "The Maze of Bones by Rick Riord - Unknown")],
}


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "metadata.db"
    with sqlite3.connect(path) as db:
        db.executescript(SCHEMA)
        for name, rows in ROWS.items():
            db.executemany(f"insert into {name} values ({','.join('?' * len(rows[0]))})", rows)
    return path

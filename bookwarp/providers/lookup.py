"""Asking metadata services: addresses, cache, throttle, injectable transport, registry.

A lookup is a side effect of few requests with a pause between them, so it runs on the driver; mapping the answers is done
by ``providers.mapping`` on DataFrames.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bookwarp.providers import mapping
from bookwarp.sources.cache import ResponseCache

RESULTS = 5
PAUSE = 1.0
USER_AGENT = "bookwarp/1.0"


class ProviderUnavailable(Exception):
    """The service can't be reached or answers nonsense, which differs from an empty answer."""


def fetch_json(url: str, timeout: float = 10, user_agent: str = USER_AGENT):
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=timeout) as answer:
        return json.loads(answer.read().decode("utf-8"))


@dataclass
class Service:
    """One service: how a book becomes an address, and how answers become candidates."""

    name: str
    by_isbn: Callable[[str], str]
    by_title: Callable[[str, str], str]
    read: Callable[[DataFrame, bool], DataFrame]

    def address(self, isbn: str, title: str, author: str) -> str | None:
        """By isbn if there is one, else by title and author; nothing without either."""
        if isbn:
            return self.by_isbn(isbn)
        return self.by_title(title, "" if author == "Unknown" else author) if title else None


def _google(query: str, key: str = "") -> str:
    return "https://www.googleapis.com/books/v1/volumes?" + urllib.parse.urlencode({"q": query, "maxResults": RESULTS, **({"key": key} if key else {})})


def _archive(query: str) -> str:
    wanted = ("identifier", "title", "creator", "publisher", "description", "isbn")
    return "https://archive.org/advancedsearch.php?" + urllib.parse.urlencode([("q", query), ("rows", RESULTS), ("output", "json"), *(("fl[]", f) for f in wanted)])


def _open_library_search(title: str, author: str) -> str:
    wanted = {"title": title, "limit": RESULTS, "fields": "title,author_name,isbn,publisher,cover_i", **({"author": author} if author else {})}
    return "https://openlibrary.org/search.json?" + urllib.parse.urlencode(wanted)


SERVICES = {
    "openlibrary": Service("openlibrary", lambda isbn: f"https://openlibrary.org/api/books?bibkeys=ISBN:{isbn}&format=json&jscmd=data", _open_library_search, lambda df, by_isbn: mapping.open_library_records(df) if by_isbn else mapping.open_library_search(df)),
    "googlebooks": Service("googlebooks", lambda isbn: _google(f"isbn:{isbn}"), lambda t, a: _google(f"intitle:{t}" + (f"+inauthor:{a}" if a else "")), lambda df, _: mapping.google_books(df)),
    "internetarchive": Service("internetarchive", lambda isbn: _archive(f"isbn:{isbn} AND mediatype:texts"), lambda t, a: _archive(f'title:("{t}") AND ' + (f'creator:("{a}") AND ' if a else "") + "mediatype:texts"), lambda df, _: mapping.internet_archive(df)),
}


class IsbndbProvider:
    """Not available."""

    def lookup(self, *_):
        raise NotImplementedError("The ISBNdb provider is not implemented")


class Lookup:
    """Asks a service, with cache and pause; offline it answers from the cache alone."""

    def __init__(self, service: str, cache: ResponseCache, fetcher=fetch_json, offline: bool = False, pause: float = PAUSE, clock=time.monotonic, sleep=time.sleep):
        self.service, self.cache, self.fetcher, self.offline = SERVICES[service], cache, fetcher, offline
        self.pause, self.clock, self.sleep, self.last = pause, clock, sleep, None

    def answer(self, url: str):
        kept = self.cache.get(url)
        if kept is not None:
            return kept
        if self.offline:
            return {}
        if self.last is not None and self.clock() - self.last < self.pause:
            self.sleep(self.pause - (self.clock() - self.last))
        self.last = self.clock()
        try:
            data = self.fetcher(url, timeout=10, user_agent=USER_AGENT)
        except TimeoutError as error:
            raise ProviderUnavailable(f"{self.service.name} timed out: {error}") from error
        except urllib.error.URLError as error:
            raise ProviderUnavailable(f"Could not reach {self.service.name}: {error}") from error
        except json.JSONDecodeError as error:
            raise ProviderUnavailable(f"{self.service.name} gave an unreadable answer: {error}") from error
        self.cache.set(url, data)
        return data

    def candidates(self, spark: SparkSession, book_id: int, isbn: str, title: str, author: str) -> DataFrame:
        """(id, candidate columns) for one book."""
        url = self.service.address(isbn, title, author)
        bodies = [(book_id, json.dumps(self.answer(url)))] if url else []
        return self.service.read(spark.createDataFrame(bodies, "id bigint, body string"), bool(isbn))

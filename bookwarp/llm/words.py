"""Plain words of a text, regardless of markup, case, accents, punctuation and line breaks."""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame

MARKUP = re.compile(r"<[^<>]{1,400}>")
BREAK_HYPHEN = re.compile(r"(?<=\w)[-‐‑­]\s*\n\s*(?=\w)")
INNER_HYPHEN = re.compile(r"(?<=\w)[-‐‑­'’`´](?=\w)")
INNER = re.compile(r"[-‐‑­'’`´]")
WORD = re.compile(r"[^\W_]+")
SIGNS_OF_BREAKAGE = re.compile("[ÃÂâÄÅ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


class _Seen(dict):
    """For translation: what has a look of its own stays, marks and invisible signs go."""

    def __missing__(self, n: int) -> int | None:
        c = chr(n)
        self[n] = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else n
        return self[n]


SEEN = _Seen()


def mended(text: str) -> str:
    """Undoes one wrong decoding of UTF-8 as an 8-bit code page, where the text shows signs of it and it can be undone."""
    if not text.isascii() and SIGNS_OF_BREAKAGE.search(text):
        for page in ("cp1252", "latin-1"):
            try:
                return text.encode(page).decode("utf-8")
            except UnicodeError:
                continue
    return text


def bare(text: str) -> str:
    """Lower case, no markup, accents or invisible signs; words broken at a line end are joined."""
    text = mended(text)
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = BREAK_HYPHEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(SEEN)
    return text.lower()


def words(text: str) -> list[str]:
    """The words of a text; hyphens and apostrophes inside a word are dropped."""
    text = bare(text)
    return WORD.findall(INNER_HYPHEN.sub("", text) if INNER.search(text) else text)


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

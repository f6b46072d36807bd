"""Text that looks the same in different characters: one consistent form, found by trie and edit automaton.

The vocabulary is every distinct token of all texts.  Tokens in plain spelling (composed, one script, full of nothing
invisible) form tries; every other token walks a trie with a weighted edit automaton, sign by sign as it is written.  A
look-alike letter, a character of another width (which may stand for several) and an ignorable sign cost nothing, any
other edit costs 1.  Among the words reached within the budget (0 for "looks the same") the canonical spelling is the one
in ASCII, of which there is at most one, else the most frequent, on a tie the smallest.  So a token in ASCII keeps itself
whatever the majority writes, and needs no walk.  A token that reaches no word is normalised by table.  Looking the same
is an equivalence, so all spellings of a word reach the same words and get the same canonical form.

Tokens meet in one trie by a key that is coarser than their look (no case, no marks), so the tries decide and not the key;
plain ASCII words go to a trie only if an odd token has their key.  A task sorts its tokens by that key and builds tries
of whole keys, ``TRIE`` tokens at a time, so its memory doesn't grow with the vocabulary.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that a reader can't tell from the Latin (or, last line, Greek) letter above them in place.
LOOKALIKES = {
    "аеорсухіјѕһԁԛԝѵ": "aeopcyxijshdqwv",  # Cyrillic, small
    "АВЕКМНОРСТХІЈЅԚԜҮѴԌ": "ABEKMHOPCTXIJSQWYVG",  # Cyrillic, capital
    "ονρϲϳ": "ovpcj",  # Greek, small
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",  # Greek, capital
    "օսոհՕՍՏ": "ounhOUS",  # Armenian
    "ɡɑ": "ga",  # Latin, phonetic
    "ГПФ": "ΓΠΦ",  # Cyrillic and Greek capitals without a Latin double
}
LETTER = {a: b for k, v in LOOKALIKES.items() for a, b in zip(k, v, strict=True)}
#: Scripts whose spelling needs joiners: Arabic, Syriac to Sinhala, Mongolian, Khmer, and signs beyond the first plane.
JOINING = ((0x0600, 0x08FF), (0x0900, 0x0DFF), (0x1780, 0x18AF), (0xA840, 0xABFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0x1F000, 0x1FAFF))
JOINERS = "‌‍"
SPACE = r"[\s\p{Z}\u0085⠀]+"
ODD = r"[^\x20-\x7E\s]"
#: Tokens in one trie, apart from what the last key has more.
TRIE = 100_000
FILLERS = frozenset("͏ᅟᅠ឴឵ㅤﾠ")


@lru_cache(65536)
def ignorable(ch: str) -> bool:
    """A character without a look of its own."""
    n = ord(ch)
    return ch in FILLERS or 0xFE00 <= n <= 0xFE0F or 0x180B <= n <= 0x180E or (unicodedata.category(ch) in ("Cf", "Cc") and not 0x0600 <= n <= 0x0605 and n not in (0x06DD, 0x070F))


@lru_cache(65536)
def same_width(ch: str) -> str:
    """A character in its usual width: wide, narrow, ligature and one-character numerals written out."""
    n = ord(ch)
    return unicodedata.normalize("NFKC", ch) if 0xFF01 <= n <= 0xFFEF or 0x2160 <= n <= 0x217F or 0xFB00 <= n <= 0xFB06 else ch


def _joins(ch: str) -> bool:
    n = ord(ch)
    return n > 127 and any(a <= n <= b for a, b in JOINING)


def visible(token: str) -> str:
    """The token in decomposed characters of usual width, without ignorables; a joiner that the script needs stays."""
    out: list[str] = []
    pending = ""
    for ch in unicodedata.normalize("NFD", "".join(map(same_width, token))):
        if ignorable(ch):
            if ch in JOINERS and out and _joins(out[-1]):
                pending = pending or ch
            continue
        if pending and _joins(ch):
            out.append(pending)
        pending = ""
        out.append(ch)
    return unicodedata.normalize("NFD", "".join(out))


def table_form(token: str) -> str:
    """The table's form: every letter replaced by the one it looks like."""
    return unicodedata.normalize("NFC", "".join(LETTER.get(ch, ch) for ch in visible(token)))


@lru_cache(65536)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0] if ch.isalpha() else ""


def plain(token: str) -> bool:
    """A spelling that can be canonical: composed, usual width, nothing invisible, letters of one script."""
    if token.isascii():
        return token.isprintable()
    return token == unicodedata.normalize("NFC", visible(token)) and not any(ch in LETTER and _script(ch) in ("LATIN", "ARMENIAN") or ch in "ϲϹϳͿ" for ch in token) and len({s for ch in token if (s := _script(ch))}) <= 1


def _classes() -> dict[str, str]:
    """For each letter all letters that look like it, itself first."""
    groups: dict[str, set[str]] = {}
    for a, b in LETTER.items():
        groups.setdefault(b, {b}).add(a)
    return {ch: ch + "".join(sorted(g - {ch})) for g in groups.values() for ch in g}


CLASSES = _classes()


class Trie:
    """Words in decomposed form, sorted; a node is a range of words and the length of their common beginning."""

    def __init__(self, counts: dict[str, int]):
        self.words = sorted(counts)
        self.counts = counts

    def step(self, low: int, high: int, prefix: str, ch: str) -> tuple[int, int]:
        begin = prefix + ch
        a = bisect_left(self.words, begin, low, high)
        return a, bisect_left(self.words, prefix + chr(ord(ch) + 1), a, high)

    def reach(self, token: str, budget: int = 0) -> list[tuple[int, str]]:
        """(cost, word) for all words that the automaton accepts within the budget."""
        signs = written(token)
        found: dict[str, int] = {}
        best: dict[tuple[str, int], int] = {}
        stack = [(0, len(self.words), "", 0, 0)]
        while stack:
            low, high, prefix, at, cost = stack.pop()
            if low >= high or best.get((prefix, at), budget + 1) <= cost:
                continue
            best[prefix, at] = cost
            alike = ""
            if at == len(signs):
                if self.words[low] == prefix:
                    found[prefix] = min(found.get(prefix, cost), cost)
            elif ignorable(signs[at]) and not (signs[at] in JOINERS and prefix and _joins(prefix[-1]) and _joins(_next_visible(signs, at))):
                stack.append((low, high, prefix, at + 1, cost))  # a sign without a look
            else:
                alike = CLASSES.get(signs[at], signs[at])
                for ch in alike:
                    stack.append((*self.step(low, high, prefix, ch), prefix + ch, at + 1, cost))
                if cost < budget:  # a sign of the token is too many
                    stack.append((low, high, prefix, at + 1, cost + 1))
            if cost < budget:  # another or an additional sign
                for ch in {w[len(prefix)] for w in self.words[low:high] if len(w) > len(prefix)}:
                    node = self.step(low, high, prefix, ch)
                    stack.append((*node, prefix + ch, at, cost + 1))
                    if alike and ch not in alike:
                        stack.append((*node, prefix + ch, at + 1, cost + 1))
        return sorted((c, w) for w, c in found.items())

    def canonical(self, token: str, budget: int = 0) -> str | None:
        """Of the words at the least cost the one in ASCII, else the most frequent."""
        reached = self.reach(token, budget)
        if not reached:
            return None
        least = reached[0][0]
        return min((w for c, w in reached if c == least), key=lambda w: (not w.isascii(), -self.counts[w], w))


def written(token: str) -> str:
    """The signs that the automaton reads: decomposed, those of another width as what they stand for."""
    return unicodedata.normalize("NFD", "".join(same_width(ch) for ch in unicodedata.normalize("NFD", token)))


def _next_visible(signs: str, at: int) -> str:
    return next((ch for ch in signs[at + 1 :] if not ignorable(ch)), " ")


def coarse(token: str) -> str:
    """A key that tokens of one look share: the table's form without case, marks and joiners."""
    return "".join(c for c in unicodedata.normalize("NFD", table_form(token).lower()) if not unicodedata.combining(c) and c not in JOINERS)


def _spelled(rows: list[tuple[str, int]]) -> pd.DataFrame:
    """(token, canon) of the tokens of some keys: builds the trie of the plain ones, then sends the odd ones through it."""
    trie = Trie({unicodedata.normalize("NFD", t): n for t, n in rows if plain(t)})
    out = []
    for t, _ in rows:
        if not t.isascii() or not t.isprintable():
            word = trie.canonical(t)
            if word is None:  # marks that invisible signs keep out of order
                word = trie.canonical(visible(t))
            out.append((t, unicodedata.normalize("NFC", word) if word is not None else table_form(t)))
    return pd.DataFrame(out, columns=["token", "canon"])


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of one task in the order of their keys, whole keys at a time."""
    rows: list[tuple[str, int]] = []
    last = None
    for batch in batches:
        for key, token, n in zip(batch["_lk_h"], batch["token"], batch["n"], strict=True):
            if len(rows) >= TRIE and key != last:
                yield _spelled(rows)
                rows = []
            rows.append((token, int(n)))
            last = key
    yield _spelled(rows)


@F.pandas_udf(T.StringType())
def _coarse(tokens: pd.Series) -> pd.Series:
    return tokens.map(coarse)


def canonical_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``texts`` with a column ``canon``: two texts have the same ``canon`` if and only if they look the same.

    Null and blank texts, and texts of nothing but invisible signs, get an empty ``canon``.  Repeated rows stay repeated.
    Columns of the input named ``canon`` or beginning with ``_lk_`` are replaced or dropped.
    """
    texts = texts.select(*[F.col(f"`{c}`") for c in texts.columns if c != "canon" and not c.startswith("_lk_")])
    rows = texts.withColumn("_lk_odd", F.coalesce(F.col(text).rlike(ODD), F.lit(False)))
    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")
    usual = F.coalesce(F.array_join(words, " "), F.lit(""))
    counts = rows.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    odd_token = counts.filter(F.col("token").rlike(ODD)).withColumn("_lk_h", F.xxhash64(_coarse("token")))
    usual_token = counts.filter(~F.col("token").rlike(ODD)).withColumn("_lk_h", F.xxhash64(F.lower("token")))
    usual_token = usual_token.join(odd_token.select("_lk_h").distinct(), "_lk_h", "left_semi")
    alike = odd_token.unionByName(usual_token.select("token", "n", "_lk_h")).repartition("_lk_h").sortWithinPartitions("_lk_h")
    forms = alike.select("_lk_h", "token", "n").mapInPandas(_resolve, "token string, canon string")
    odd_texts = rows.filter("_lk_odd").select(F.col(text).alias("_lk_t")).distinct()
    pieces = odd_texts.select("_lk_t", F.posexplode(F.filter(F.split("_lk_t", SPACE), lambda w: w != "")).alias("_lk_pos", "token"))
    spelled = pieces.join(forms, "token", "left").withColumn("_lk_w", F.struct("_lk_pos", F.coalesce("canon", "token").alias("w")))
    joined = spelled.groupBy("_lk_t").agg(F.array_sort(F.collect_list("_lk_w")).alias("_lk_ws"))
    joined = joined.select("_lk_t", F.array_join(F.filter(F.transform("_lk_ws", lambda x: x["w"]), lambda w: w != ""), " ").alias("_lk_c"))
    odd = rows.filter("_lk_odd").join(joined, F.col(text) == F.col("_lk_t"), "left").withColumn("canon", F.coalesce("_lk_c", F.lit(""))).drop("_lk_t", "_lk_c", "_lk_odd")
    return rows.filter(~F.col("_lk_odd")).withColumn("canon", usual).drop("_lk_odd").unionByName(odd)


def same_look_pairs(texts: DataFrame, group: str = "tbl", key: str = "id", text: str = "text") -> DataFrame:
    """(group, id_a, id_b), id_a < id_b: texts of a group that look the same but differ in their characters.

    Only texts that differ from their canonical form are paired with the texts of that form, so copies of one and the
    same text never meet.  Every text with which a record was sent counts; null ids, null and blank texts don't.
    """
    rows = texts.select(F.col(group).alias("tbl"), F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    known = canonical_texts(rows).filter("canon <> ''").withColumn("odd", F.col("text") != F.col("canon"))
    b = known.select("tbl", "canon", F.col("id").alias("id_b"), F.when(F.col("odd"), F.col("text")).alias("text_b"))
    a = known.filter("odd").select("tbl", "canon", F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    met = a.join(b, ["tbl", "canon"]).filter((F.col("id_a") != F.col("id_b")) & (F.col("text_b").isNull() | ((F.col("text_a") != F.col("text_b")) & (F.col("id_a") < F.col("id_b")))))
    return met.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


# Column expressions for the other operators: the table's form without leaving the JVM.


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and wide forms with their bare letter, by rule."""
    source, target = [], []
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = unicodedata.normalize("NFD", chr(n))[0]
        if bare != chr(n) and bare.isascii():
            source.append(chr(n))
            target.append(bare)
    for n in range(0xFF01, 0xFF5F):
        source.append(chr(n))
        target.append(chr(n - 0xFEE0))
    for a, b in (("Ł", "L"), ("ł", "l"), ("Ø", "O"), ("ø", "o"), ("Đ", "D"), ("đ", "d"), ("ı", "i")):
        source.append(a)
        target.append(b)
    return "".join(source), "".join(target)


def folded(column) -> F.Column:
    """Lower case, no accents, usual width, look-alikes replaced, no invisible signs, single spaces."""
    c = F.col(column) if isinstance(column, str) else column
    accents, bare = _plain_letters()
    letters = {a: b for a, b in LETTER.items() if b.isascii()}
    c = F.regexp_replace(c, r"[\p{Cf}\p{Mn}]", "")
    c = F.translate(c, "".join(letters) + accents, "".join(letters.values()) + bare)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, SPACE, " "), "[’‘ʼ＇]", "'")))

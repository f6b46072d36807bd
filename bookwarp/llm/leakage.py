"""Evaluation passages leaking into documents: embedding by random walk, bit-sampling hashing, exact edit verification.

Every window of twelve words of a passage and of a document is embedded by a random walk of CGK type: at each step
the word under the pointer is put out and a random bit of that word decides whether the pointer moves on.  Two windows a
few edits apart then agree in most places, so hashing a few sampled places, repeated, makes them meet with a probability
that the number of repetitions raises to the target recall.  What meets is verified exactly: a dynamic programme over
words finds a stretch of at least twelve successive passage words within the allowed share of changed words.

The evaluation items are a stated query set: they are taken in blocks of a bounded size, and the index of each block goes
to every executor once, so the documents are read once per block and nothing is shuffled.  A word that is in no passage of the
block equals no passage word, and a window in which fewer than ``KNOWN`` words are in passages can't be within reach, so
it isn't embedded; both steps lose nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwarp.llm.words import spread, words

WINDOW = 12
#: At most one changed word in so many, as the problem states it.
CHANGED = 6
REPEATS = 32
PLACES = 5
STEPS = 2 * WINDOW  # the walk is over after as many steps on average; later ones say little
#: Least passage words in a document window: three of the window's twelve words may be changed ones.
KNOWN = 9
#: Items that a pass over the documents takes.
BLOCK = 20_000
#: Documents whose windows are hashed together.
TOGETHER = 200
SEED = 20_250_101
SENTENCE = re.compile(r"(?<=[.:?!])\s+")


def passages(texts: list[str], instructions: frozenset[str]) -> list[list[str]]:
    """The words of each item's passage, without its instruction line and its closing questions."""
    out = []
    for text in texts:
        parts = SENTENCE.split((text or "").strip())
        if len(parts) > 1 and parts[0] in instructions:
            parts = parts[1:]
        while len(parts) > 1 and parts[-1].endswith("?"):
            parts.pop()
        out.append(words(" ".join(parts)))
    return out


def opening(text: str | None) -> tuple[str, str]:
    """(first sentence, rest); of a text of one sentence its first word."""
    text = (text or "").strip()
    parts = SENTENCE.split(text, maxsplit=1)
    if len(parts) == 1:
        parts = [*text.split(" ", 1), ""][:2]
    return parts[0], parts[1]


class Index:
    """The hashed windows of one block of passages."""

    def __init__(self, passages: list[list[str]], repeats: int = REPEATS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.passages = passages
        counts = Counter(w for p in passages for w in p)
        self.ids = {w: i for i, w in enumerate(sorted(counts))}
        self.unknown = len(self.ids)
        self.pad = self.unknown + 1
        self.bits = rng.integers(0, 2, (repeats, STEPS, self.pad + 1), dtype=np.int8)
        self.places = np.stack([np.sort(rng.choice(STEPS, PLACES, replace=False)) for _ in range(repeats)])
        self.mix = rng.integers(1, 2**62, (repeats, PLACES), dtype=np.uint64) | np.uint64(1)
        self.coded = [np.array([self.ids[w] for w in p], dtype=np.int32) for p in passages]
        self.member = np.zeros((len(passages), self.pad + 1), dtype=bool)
        for k, code in enumerate(self.coded):
            self.member[k, code] = True
        windows, owner = [], []
        for k, code in enumerate(self.coded):
            for w in self._windows(code):
                windows.append(w)
                owner.append(k)
        self.owner = np.array(owner, dtype=np.int64)
        self.tables = []
        if windows:
            for keys in self.keys(np.stack(windows)):
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], self.owner[order]))

    def _windows(self, code: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(code, WINDOW) if len(code) >= WINDOW else np.empty((0, WINDOW), dtype=np.int32)

    def keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """For each repetition the hash of the sampled places of each window's walk."""
        n = len(windows)
        padded = np.concatenate([windows, np.full((n, 1), self.pad, dtype=windows.dtype)], axis=1)
        rows = np.arange(n)
        for bits, places, mix in zip(self.bits, self.places, self.mix, strict=True):
            at = np.zeros(n, dtype=np.int64)
            key = np.zeros(n, dtype=np.uint64)
            sampled = dict(zip(places.tolist(), mix.tolist(), strict=True))
            for step in range(places[-1] + 1):
                word = padded[rows, at]
                if step in sampled:
                    key += (word.astype(np.uint64) + np.uint64(1)) * np.uint64(sampled[step])
                    key ^= key >> np.uint64(29)
                at = np.minimum(at + bits[step, word], WINDOW)
            yield key

    def _near(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, windows) of a coded document's windows with enough passage words."""
        if len(code) < WINDOW:
            code = np.concatenate([code, np.full(WINDOW - len(code), self.unknown, dtype=code.dtype)])
        known = np.concatenate([[0], np.cumsum(code != self.unknown)])
        at = np.flatnonzero(known[WINDOW:] - known[:-WINDOW] >= KNOWN)
        return at, np.lib.stride_tricks.sliding_window_view(code, WINDOW)[at]

    def candidates(self, codes: list[np.ndarray]) -> list[dict[int, list[int]]]:
        """For each coded document the passages met by its windows, with the windows' places."""
        out: list[dict[int, list[int]]] = [{} for _ in codes]
        near = [(d, *self._near(code)) for d, code in enumerate(codes) if len(code) >= KNOWN] if self.tables else []
        near = [(d, at, w) for d, at, w in near if len(at)]
        if not near:
            return out
        document = np.repeat([d for d, _, _ in near], [len(at) for _, at, _ in near])
        at, windows = np.concatenate([a for _, a, _ in near]), np.concatenate([w for _, _, w in near])
        met = []
        for (keys, owner), mine in zip(self.tables, self.keys(windows), strict=True):
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            n = high - low
            x = np.repeat(np.arange(len(at)), n)
            if len(x):
                within = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                met.append(np.unique(x * len(self.passages) + owner[low[x] + within]))
        if not met:
            return out
        x, k = np.divmod(np.unique(np.concatenate(met)), len(self.passages))
        reach = self.member[k[:, None], windows[x]].sum(axis=1) >= KNOWN  # within reach of this very passage
        for d, a, b in zip(document[x[reach]].tolist(), k[reach].tolist(), at[x[reach]].tolist(), strict=True):
            out[d].setdefault(a, []).append(b)
        return [{a: sorted(b) for a, b in o.items()} for o in out]

    def verify(self, code: np.ndarray, k: int, places: list[int]) -> bool:
        """Whether the document has a stretch of the passage near one of the places."""
        passage = self.coded[k]
        begin = None
        for p in places:  # places close together share one region
            if begin is None:
                begin, end = p, p
            elif p - end > len(passage):
                if stretch(passage, code[max(0, begin - len(passage)) : end + WINDOW + len(passage)]):
                    return True
                begin = end = p
            else:
                end = p
        return begin is not None and stretch(passage, code[max(0, begin - len(passage)) : end + WINDOW + len(passage)])

    def leaks(self, texts: list[str]) -> list[list[int]]:
        """For each text the passages of which it contains a stretch."""
        get, unknown = self.ids.get, self.unknown
        codes = []
        for text in texts:
            listed = words(text)
            codes.append(np.array([get(w, unknown) for w in listed], dtype=np.int32))
        return [[k for k, places in found.items() if self.verify(code, k, places)] for code, found in zip(codes, self.candidates(codes), strict=True)]


def stretch(passage: np.ndarray, region: np.ndarray, window: int = WINDOW, changed: int = CHANGED) -> bool:
    """Whether at least ``window`` successive words of the passage stand in the region, first and last unchanged, with at
    most one in ``changed`` words replaced, dropped or added."""
    n, m = len(passage), len(region)
    if n < window or m < window - window // changed:
        return False
    big = 1 << 12
    most = n // changed  # what the longest stretch may cost; a start that costs more is given up
    equal = passage[:, None] == region[None, :]
    offset = np.arange(m, dtype=np.int32)
    begin = np.flatnonzero(equal[: n - window + 1].any(axis=1))  # first word unchanged
    cost = np.where(equal[begin], 0, big).astype(np.int32)
    cost = np.minimum.accumulate(cost - offset, axis=1) + offset  # words added right after it
    for length in range(2, n + 1):
        live = (begin <= n - length) & (cost.min(axis=1) <= most)
        if not live.all():
            begin, cost = begin[live], cost[live]
        if not len(begin):
            return False
        row = equal[begin + (length - 1)]
        diagonal = np.full(row.shape, big, dtype=np.int32)
        diagonal[:, 1:] = cost[:, :-1]
        replaced = np.minimum(diagonal + ~row, cost + 1)
        if length >= window and (np.where(row, diagonal, big) <= length // changed).any():
            return True
        cost = np.minimum.accumulate(replaced - offset, axis=1) + offset  # words added
    return False


def repeated_openings(items: DataFrame) -> frozenset[str]:
    """The instruction lines of all items: first sentences with different continuations, of which there are few."""

    @F.pandas_udf("first string, more string")
    def parts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([opening(t) for t in texts], columns=["first", "more"])

    split = items.select(parts("text").alias("p")).select("p.first", F.xxhash64("p.more").alias("more")).distinct()
    return frozenset(r["first"] for r in split.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1").select("first").toLocalIterator())


def blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), so many at a time; one empty block if there are none."""
    part: list[tuple[int, str]] = []
    more = False
    for r in items.toLocalIterator():
        part.append((r.item_id, r.text))
        if len(part) == size:
            yield part
            part, more = [], True
    if part or not more:
        yield part


def leaks(documents: DataFrame, items: DataFrame, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): documents that contain a stretch of the passage of an item.

    Null and blank texts contain nothing and items without a passage of twelve words are in nothing.  Items with the
    same passage are all reported.  Repeated doc_ids are reported once per row; columns other than doc_id, text and
    item_id, text are ignored.
    """
    spark = documents.sparkSession
    rows = items.select("item_id", "text").filter("item_id is not null and text is not null")
    out = None
    lines = repeated_openings(rows)
    docs = spread(documents.select("doc_id", "text").filter("text is not null"))
    for part in blocks(rows, block):  # the stated query set; one block at a time is held here
        same: dict[tuple[str, ...], list[int]] = {}
        for (i, _), p in zip(part, passages([t for _, t in part], lines), strict=True):
            same.setdefault(tuple(p), []).append(i)
        # built once; a block has a bounded number of items, and an executor holds one copy
        shared = spark.sparkContext.broadcast((Index([list(p) for p in same], repeats), list(same.values())))

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index, owners = shared.value
            for batch in batches:
                for low in range(0, len(batch), TOGETHER):
                    part = batch.iloc[low : low + TOGETHER]
                    found = [(d, i) for d, ks in zip(part["doc_id"], index.leaks(part["text"].tolist()), strict=True) for k in ks for i in owners[k]]
                    yield pd.DataFrame(found, columns=["doc_id", "item_id"], dtype="int64")

        result = docs.mapInPandas(find, "doc_id bigint, item_id bigint")
        out = result if out is None else out.unionByName(result)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint")

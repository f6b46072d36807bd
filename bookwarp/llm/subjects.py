"""Subject areas of documents: term weighting, truncated singular value decomposition, refined seed centroids.

1. Texts are split into sentences and words once.  Document frequencies are counted over all documents; terms between two
   shares of the documents form the vocabulary, whose size is therefore bounded by the mean number of different words of a
   document divided by the lower share.
2. A term weighs its inverse document frequency times how strongly it is concentrated on few subjects in the checked
   sample (all of it, counted per term and subject).  Names and turns of phrase that all subjects share weigh nothing.
3. The leading right singular vectors of the weighted document-term matrix are found by subspace iteration; each pass sums
   a vocabulary-sized matrix per task, adds these up by blocks of terms, and only the sum reaches the driver.
4. Seed centroids are the means of the sample's documents by subject and language; they are refined by the documents
   that lie clearly nearest to one of them.
5. Each sentence is embedded and goes to the subject of the nearest centroid by cosine.  The subject with most sentences
   counts.  A second one counts in a text of up to three sentences if its sentences are as strong as the first one's, in a
   longer text if it has at least two sentences and a share of those that have a subject.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwarp.llm.words import bare, spread
from bookwarp.stage import blank, cut

LOW_SHARE, HIGH_SHARE = 5e-4, 0.5
DIMENSIONS = 64
PASSES = 3
REFINEMENTS = 3
PRIOR = 3.0
SENTENCE_COSINE = 0.2
SENTENCE_WEIGHT = 0.05
SECOND_SHARE = 0.15
#: Least strength of the second subject's sentences, on average, against those of the first: in texts of up to three sentences and in longer ones.
SECOND_STRENGTH = (1.0, 0.2)
CLEAR = (0.5, 0.2)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n|</p>|<br\s*/?>")
QUOTED = re.compile(r"[\"“][A-ZÀ-Þ][^\"“”\n]{0,80}[\"”]")
TERM = re.compile(r"[^\W\d_]{2,}")
BLOCK = 256
# Frequent words that tell languages apart.
LANGUAGES = {
    "en": frozenset("the of and with is to for that".split()),
    "de": frozenset("der die das und von auf ist mit".split()),
    "fr": frozenset("le les et des du est une dans".split()),
    "es": frozenset("el los las y una por se del".split()),
}


def sentences(text: str) -> list[list[str]]:
    """The terms of each sentence; titles in quotation marks are left out."""
    parts = SENTENCE.split(QUOTED.sub(" ", text))
    return [TERM.findall(bare(p)) for p in parts if p.strip()]


def language(found: list[list[str]]) -> int:
    """Index of the language with most frequent words in the text."""
    every = [w for s in found for w in s]
    return int(np.argmax([sum(map(stop.__contains__, every)) for stop in LANGUAGES.values()]))


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        split = [sentences(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": np.array([language(s) for s in split], dtype=np.int32), "words": ["\n".join(" ".join(s) for s in d) for d in split]})


class Rows:
    """Weighted sparse rows of unit length, one per document, as (row, term, weight) in the order of rows."""

    def __init__(self, ids: list[np.ndarray], weights: np.ndarray):
        self.number, v = len(ids), max(1, len(weights))
        flat = np.concatenate([np.asarray(i, dtype=np.int64) for i in ids] or [np.zeros(0, dtype=np.int64)])
        cells, n = np.unique(np.repeat(np.arange(len(ids)), [len(i) for i in ids]) * v + flat, return_counts=True)
        self.row, self.term = np.divmod(cells, v)
        w = (1 + np.log(n)) * weights[self.term]
        size = np.sqrt(np.bincount(self.row, weights=w * w, minlength=self.number))
        self.weight = (w / np.maximum(size, 1e-9)[self.row]).astype(np.float32)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((self.number, matrix.shape[1]), dtype=np.float32)
        if len(self.row):
            filled, first = np.unique(self.row, return_index=True)
            out[filled] = np.add.reduceat(self.weight[:, None] * matrix[self.term], first, axis=0)
        return out

    def add_transposed(self, matrix: np.ndarray, sums: np.ndarray) -> None:
        """Adds the transposed rows times a matrix (a row per document) to ``sums``."""
        if len(self.row):
            order = np.argsort(self.term, kind="stable")
            terms, first = np.unique(self.term[order], return_index=True)
            sums[terms] += np.add.reduceat(self.weight[order, None] * matrix[self.row[order]], first, axis=0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _add_up(parts: DataFrame, kind: type = np.float64) -> dict[int, np.ndarray]:
    """Sums (block, data) rows of matrices of this kind by block, in tasks; the sums come to the driver."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch["block"], batch["data"], strict=True):
                x = np.frombuffer(data, dtype=kind)
                sums[b] = sums[b] + x if b in sums else x.copy()
        yield pd.DataFrame({"block": pd.Series(list(sums), dtype="int32"), "data": pd.Series([s.tobytes() for s in sums.values()], dtype=object)})

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = parts.repartition(tasks, "block").mapInPandas(total, "block int, data binary")
    return {r.block: np.frombuffer(r.data, dtype=kind) for r in summed.collect()}


def _singular(encoded: DataFrame, weights: np.ndarray, dimensions: int, passes: int) -> np.ndarray:
    """The leading right singular vectors of the weighted matrix by subspace iteration, most important first."""
    v = len(weights)
    if not v:
        return np.zeros((0, 1))
    k = min(dimensions, v)
    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(v, k)))[0]
    context = encoded.sparkSession.sparkContext
    for _ in range(passes):
        shared = context.broadcast((basis.astype(np.float32), weights))  # one copy an executor

        def partial(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            basis, weights = shared.value
            y = np.zeros((v, k), dtype=np.float32)
            for batch in batches:
                for low in range(0, len(batch), 256):
                    x = Rows(list(batch["ids"].iloc[low : low + 256]), weights)
                    x.add_transposed(x.times(basis), y)
            yield pd.DataFrame({"block": list(range((v + BLOCK - 1) // BLOCK)), "data": [y[b : b + BLOCK].astype(np.float64).tobytes() for b in range(0, v, BLOCK)]}).astype({"block": "int32"})

        sums = _add_up(encoded.select("ids").mapInPandas(partial, "block int, data binary"))
        y = np.concatenate([sums[b].reshape(-1, k) for b in sorted(sums)])
        u, s, _ = np.linalg.svd(y, full_matrices=False)
        basis = u
    return basis


def _term_weights(vocabulary: list[str], idf: np.ndarray, counts: dict[tuple[str, str], int], sizes: dict[str, int], subjects: list[str]) -> np.ndarray:
    """Inverse document frequency times concentration on subjects; without a sample, the former alone."""
    if not sizes:
        return idf.astype(np.float32)
    k = len(subjects)
    share = np.array([sizes.get(s, 0) + 1.0 for s in subjects])
    share /= share.sum()
    place = {w: i for i, w in enumerate(vocabulary)}
    number = {s: i for i, s in enumerate(subjects)}
    m = np.zeros((k, len(vocabulary)))
    for (w, s), n in counts.items():
        m[number[s], place[w]] = n
    q = (m + PRIOR * share[:, None]) / (m.sum(axis=0) + PRIOR) / share[:, None]
    q /= q.sum(axis=0)
    concentration = np.maximum(0, 1 + (q * np.log(q + 1e-12)).sum(axis=0) / np.log(k)) if k > 1 else np.ones(len(vocabulary))
    return (idf * concentration**2).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """What the assignment needs: term vectors, unit centroids by subject and language, and the most frequent subject."""

    subjects: list[str]
    projected: np.ndarray
    centres: np.ndarray
    shape: tuple[int, int, int]
    usual: int

    def decide(self, ids: np.ndarray, ends: np.ndarray, cosine: float = SENTENCE_COSINE, weight: float = SENTENCE_WEIGHT, share: float = SECOND_SHARE) -> list[int]:
        """One or two subjects from the sentences of a document."""
        if not len(ids):
            return [self.usual]
        running = np.concatenate([np.zeros((1, self.shape[2])), np.cumsum(self.projected[ids], axis=0, dtype=np.float64)])
        rows = running[ends] - running[np.concatenate([[0], ends[:-1]])]
        size = np.linalg.norm(rows, axis=1)
        near = (_unit(rows) @ self.centres.T).reshape(len(rows), *self.shape[:2]).max(axis=2)
        best = near.argmax(axis=1)
        says = (near.max(axis=1) >= cosine) & (size >= weight)
        if not says.any():
            return [int((near * size[:, None]).sum(axis=0).argmax())]
        votes = np.bincount(best[says], minlength=self.shape[0])
        strength = np.bincount(best[says], weights=size[says], minlength=self.shape[0])
        order = np.lexsort((-strength, -votes))
        first, second = int(order[0]), int(order[min(1, len(order) - 1)])
        if second == first or not votes[second]:
            return [first]
        ratio = strength[second] / votes[second] * votes[first] / strength[first]
        if len(ends) < 4:  # an aside names one term, a sentence about a subject several
            both = ratio >= SECOND_STRENGTH[0]
        else:
            both = votes[second] >= 2 and votes[second] >= share * votes.sum() and ratio >= SECOND_STRENGTH[1]
        return [first, second] if both else [first]


def fit(documents: DataFrame, areas: DataFrame, sample: DataFrame, dimensions: int = DIMENSIONS) -> tuple[DataFrame, Model] | None:
    """The encoded documents (doc_id, lang, ids, ends) and the model; nothing if there are no texts or no subjects."""
    spark = documents.sparkSession
    subjects = sorted({r.subject for r in areas.select("subject").union(sample.select("subject")).filter("subject is not null").distinct().collect()})
    if not subjects:
        return None
    tokens = cut(spread(documents.select("doc_id", "text").filter(~blank(F.col("text")))).mapInPandas(_tokenise, "doc_id bigint, lang int, words string"))
    total = tokens.count()
    if not total:
        return None
    terms = F.array_distinct(F.split("words", "[ \n]+"))
    frequent = tokens.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    least, most = max(min(3, total), LOW_SHARE * total), max(HIGH_SHARE * total, 3)
    known = sorted((r.term, r.n) for r in frequent.filter((F.col("n") >= least) & (F.col("n") <= most) & (F.col("term") != "")).collect())
    vocabulary = [t for t, _ in known]
    idf = np.log(total / np.array([n for _, n in known], dtype=float)) if known else np.zeros(0)
    checked = sample.filter("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    labelled = tokens.join(checked, "doc_id")
    word_list = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    counted = labelled.select("subject", F.explode(terms).alias("term")).groupBy("term", "subject").agg(F.count("*").alias("n")).join(word_list, "term", "left_semi")
    counts = {(r.term, r.subject): r.n for r in counted.collect()}  # vocabulary times subjects
    sizes = {r.subject: r.n for r in labelled.groupBy("subject").agg(F.count("*").alias("n")).collect()}
    weights = _term_weights(vocabulary, idf, counts, sizes, subjects)
    place = {t: i for i, t in enumerate(vocabulary) if weights[i] > 1e-6}
    about = {r.subject: r.about or "" for r in areas.filter("subject is not null").collect()}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ends = [], []
            for d in batch["words"]:
                coded = [[place[w] for w in s.split(" ") if w in place] for s in d.split("\n")]
                ids.append(np.array([i for s in coded for i in s], dtype=np.int32))
                ends.append(np.cumsum([len(s) for s in coded]).astype(np.int32))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "ids": ids, "ends": ends})

    encoded = cut(tokens.mapInPandas(encode, "doc_id bigint, lang int, ids array<int>, ends array<int>"))
    basis = _singular(encoded, weights, dimensions, PASSES).astype(np.float32)
    k, languages, number = basis.shape[1], len(LANGUAGES), {s: i for i, s in enumerate(subjects)}
    shape = (len(subjects), languages, k)
    shared = spark.sparkContext.broadcast((basis, weights))  # one copy an executor

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(shape)
        for batch in batches:
            basis, weights = shared.value
            x = Rows(list(batch["ids"]), weights).times(basis)
            np.add.at(sums, ([number[s] for s in batch["subject"]], batch["lang"]), _unit(x))
        yield pd.DataFrame({"block": [0], "data": [sums.tobytes()]}).astype({"block": "int32"})

    only = checked.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("subject").alias("subject")).filter("n = 1").select("doc_id", "subject")
    seeded = _add_up(encoded.join(only, "doc_id").select("ids", "lang", "subject").mapInPandas(seeds, "block int, data binary"))
    seed = seeded[0].reshape(shape).copy() if 0 in seeded else np.zeros(shape)
    for s, text in about.items():  # subjects that the sample doesn't show start from their description
        if not seed[number[s]].any():
            coded = np.array([place[w] for part in sentences(text) for w in part if w in place], dtype=np.int64)
            seed[number[s], 0] += Rows([coded], weights).times(basis)[0]
    centroids = seed
    for _ in range(REFINEMENTS):

        def refine(batches: Iterator[pd.DataFrame], centres=_unit(centroids).reshape(-1, k).astype(np.float32)) -> Iterator[pd.DataFrame]:
            sums, won = np.zeros(shape), np.zeros(len(subjects))
            basis, weights = shared.value
            for batch in batches:
                for low in range(0, len(batch), 256):
                    part = batch.iloc[low : low + 256]
                    x = _unit(Rows(list(part["ids"]), weights).times(basis))
                    near = (x @ centres.T).reshape(len(x), *shape[:2]).max(axis=2)
                    order = np.sort(near, axis=1)
                    second = order[:, -2] if near.shape[1] > 1 else np.zeros(len(x))
                    clear = (order[:, -1] > CLEAR[0]) & (order[:, -1] - second > CLEAR[1])
                    best = near.argmax(axis=1)
                    np.add.at(sums, (best[clear], part["lang"].to_numpy()[clear]), x[clear])
                    np.add.at(won, best[clear], 1)
            yield pd.DataFrame({"block": [0, 1], "data": [sums.tobytes(), won.tobytes()]}).astype({"block": "int32"})

        added = _add_up(encoded.select("ids", "lang").mapInPandas(refine, "block int, data binary"))
        centroids, won = seed + added[0].reshape(shape), added[1]
    centres = _unit(centroids).reshape(-1, k).astype(np.float32)
    projected = (basis * weights[:, None]).astype(np.float32)
    return encoded, Model(subjects, projected, centres, shape, int(won.argmax()))


def assign(documents: DataFrame, areas: DataFrame, sample: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, subject): one or two subjects for every text that isn't null or blank.

    A text without any weighted term gets the most frequent subject.  ``sample`` (doc_id, subject) may be empty; the seeds
    are then the words of ``areas`` (subject, about).  Without subjects there are no rows.  Repeated doc_ids are handled
    row by row; further columns are ignored.
    """
    fitted = fit(documents, areas, sample, dimensions)
    if fitted is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    encoded, fitted_model = fitted
    shared = documents.sparkSession.sparkContext.broadcast(fitted_model)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            rows = [(d, model.subjects[s]) for d, ids, ends in zip(batch["doc_id"], batch["ids"], batch["ends"], strict=True) for s in model.decide(np.asarray(ids), np.asarray(ends))]
            yield pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], dtype="Int64"), "subject": [s for _, s in rows]})

    return encoded.select("doc_id", "ids", "ends").mapInPandas(decide, "doc_id bigint, subject string")

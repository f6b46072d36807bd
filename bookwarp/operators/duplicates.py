"""Duplicate books: equal isbns, and titles that are nearly equal for the same first author.

Nearly equal titles are found without comparing all titles of an author: a title within the allowed number of unmatched
characters of another shares one of its equal parts at nearly the same place, so titles meet by an equi-join on author,
length, part and text.  Equal titles are one node.  What meets is compared exactly, and groups form around leaders in the
order of ids, as in a pass over the list, but resolved for all authors at once in rounds of joins: a title whose earlier
neighbours are all settled is taken by the earliest leader among them or leads itself.  An author with a third of all
books is therefore never one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookwarp.functions.text import listed, name_signature, strip, text, without_digits
from bookwarp.stage import cut

THRESHOLD = 0.95
#: Rounds after which the driver collects garbage: only then do plans, compiled code and checkpoints of earlier ones go.
COLLECT = 3


def isbn_groups(books: DataFrame) -> DataFrame:
    """(reason, book_ids): books with the same isbn as it is written."""
    grouped = books.filter("isbn <> ''").groupBy("isbn").agg(F.array_sort(F.collect_list("id")).alias("book_ids")).filter(F.size("book_ids") > 1)
    return grouped.select(F.concat(F.lit("isbn="), F.col("isbn")).alias("reason"), "book_ids")


def author_block() -> Column:
    return F.lower(text(F.try_element_at("authors", F.lit(1))["name"]))


def _echoes_author() -> Column:
    """The title is the first author's name or sort name in any order of words."""
    first = F.try_element_at("authors", F.lit(1))
    mine = name_signature("title")
    return (F.size("authors") > 0) & ((mine == name_signature(first["name"])) | (mine == name_signature(first["sort"])))


def _titled(books: DataFrame) -> DataFrame:
    """(id, block, title): books whose title isn't just their author."""
    return books.filter(~_echoes_author()).select("id", author_block().alias("block"), F.lower(strip("title")).alias("title"))


def _classes(titled: DataFrame) -> DataFrame:
    return titled.groupBy("block", "title").agg(F.min("id").alias("first_id"))


def title_classes(books: DataFrame) -> DataFrame:
    """(block, title, first_id): different titles of each first author, without those that only echo the author."""
    return _classes(_titled(books))


def number_only_pairs(books: DataFrame) -> DataFrame:
    """(a, b): titles of one first author that differ in their digits only, each by the id of its first book."""
    known = title_classes(books).withColumn("rest", without_digits("title"))
    a, b = known.select("block", "rest", F.col("first_id").alias("a")), known.select("block", "rest", F.col("first_id").alias("b"))
    return a.join(b, ["block", "rest"]).filter("a < b").select("a", "b")


@lru_cache(4096)
def unmatched(length: int, other: int, threshold: float) -> int:
    """The most characters of both texts together that may be unmatched at the threshold."""
    total = length + other
    allowed = 0
    while allowed < total and (total - (allowed + 1)) / total >= threshold:
        allowed += 1
    return allowed


@lru_cache(4096)
def _spans(length: int, pieces: int) -> list[tuple[int, int]]:
    """(begin, end) of each of so many parts of nearly equal length."""
    size, extra = divmod(length, pieces)
    out, at = [], 0
    for i in range(pieces):
        n = size + (i >= pieces - extra)
        out.append((at, at + n))
        at += n
    return out


@lru_cache(512)
def _places(n: int, longer: int, threshold: float) -> tuple[int, list[tuple[int, int, int]]]:
    """(most, places): the most unmatched characters of texts of these lengths, and (part, begin, end) in the shorter one
    of all parts of the longer one that may be there.

    The number of unmatched characters has the parity of the gap.  Each falls into one part, and of the first part with
    no more of them up to its end than its number, all are before it, exactly as many as its number: the part stands in
    the shorter text as it is, moved by as much as so many insertions and deletions can move it, and those that are left
    must make up for the rest of the gap.
    """
    gap, most = longer - n, unmatched(longer, n, threshold)
    most -= (most - gap) % 2
    places = []
    for i, (begin, end) in enumerate(_spans(longer, unmatched(longer, longer, threshold) + 1)[: most + 1]):
        for shift in range(-i, i + 1, 2):
            if abs(gap + shift) <= most - i and begin + shift >= 0 and end + shift <= n:
                places.append((i, begin + shift, end + shift))
    return most, places


def _signature(title: str) -> int:
    """One bit for each of 63 sets of characters: whether their number is odd.  A character more or less changes one."""
    bits = 0
    for c in title:
        bits ^= 1 << ord(c) % 63
    return bits


#: Rows of keys that a task holds at once.
KEYS = 100_000


def _keys(threshold: float, indexed: bool):
    """(key, id, signature, most): hashes of a block, a length and a part of a title; no texts leave the task.

    Of two texts, the longer one is cut into parts (``indexed``) and the shorter one looks for them.
    """

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "id", "signature", "most"]).astype({"key": "int64", "most": "int32"})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for block, title, first, longer in zip(batch["block"], batch["title"], batch["first_id"], batch["longer"], strict=True):
                if indexed:
                    most, places = 0, [(i, begin, end) for i, (begin, end) in enumerate(_spans(longer, unmatched(longer, longer, threshold) + 1))]
                else:
                    most, places = _places(len(title), longer, threshold)
                own, bits = f"{block}\0{longer}\0".encode(), _signature(title)
                for i, begin, end in places:
                    hashed = blake2b(own + f"{i}\0{title[begin:end]}".encode(), digest_size=8).digest()
                    rows.append((int.from_bytes(hashed, "little", signed=True), first, bits, most))
                if len(rows) > KEYS:
                    yield framed(rows)
                    rows = []
            yield framed(rows)

    return keys


def _close(threshold: float):
    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = []
            for a, b in zip(batch["a_title"], batch["b_title"], strict=True):
                m = SequenceMatcher(None, a, b)
                hit.append(m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold)
            yield batch.loc[hit, ["a", "b"]]

    return close


def close_titles(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): title classes (by first id, a < b) of one first author whose likeness reaches the threshold.

    Titles look only for lengths that other titles of the author have.  Those that meet are left out at once if their
    characters differ by too many, so that texts are joined to few pairs.
    """
    known = classes.withColumn("longer", F.length("title"))
    counted = known.groupBy("block", "longer").agg(F.count("*").alias("n"))
    lengths = counted.groupBy("block").agg(F.collect_list(F.struct("longer", "n")).alias("lengths"))  # as many as lengths
    # a length too many at most: there are no places in it
    greatest = F.floor(F.length("title") * ((2 - threshold) / threshold)) + 1
    near = lambda x: (x["longer"] >= F.length("title")) & (x["longer"] <= greatest) & ((x["n"] > 1) | (x["longer"] > F.length("title")))
    fields = ("block", "title", "first_id", "longer")
    wanted = classes.join(lengths, "block").withColumn("l", F.explode(F.filter("lengths", near))).select("block", "title", "first_id", F.col("l.longer").alias("longer"))
    shape = "key bigint, id bigint, signature bigint, most int"
    left = known.select(*fields).mapInPandas(_keys(threshold, True), shape).select("key", F.col("id").alias("x"), F.col("signature").alias("x_signature"))
    right = wanted.select(*fields).mapInPandas(_keys(threshold, False), shape).withColumnRenamed("id", "y")
    ids = left.join(right, "key").filter("x <> y and bit_count(x_signature ^ signature) <= most")
    ids = ids.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    texts = classes.select("first_id", "title", "block")
    pairs = ids.join(texts.toDF("a", "a_title", "a_block"), "a").join(texts.toDF("b", "b_title", "b_block"), "b").filter("a_block = b_block")
    pairs = pairs.filter(without_digits("a_title") != without_digits("b_title"))
    return pairs.mapInPandas(_close(threshold), "a bigint, b bigint")


def leaders(pairs: DataFrame) -> DataFrame:
    """(id, leader) for every node of (a, b), a < b, that isn't its own leader, as a pass in the order of ids assigns them.

    A node is its own leader unless an earlier neighbour is one.  In each round every node whose earlier neighbours are all
    decided is decided, and a node with a leader among them takes the smallest, so pairs that decide nothing any more
    leave the work; the rounds are as many as the longest run of titles of which each waits for the one before it.
    """
    open_pairs = cut(pairs.distinct())
    decided = None
    rounds = 0
    while not open_pairs.isEmpty():
        rounds += 1
        if rounds % COLLECT == 0:
            pairs.sparkSession.sparkContext._jvm.System.gc()
        # firsts wait for nobody: they lead, and all their later neighbours follow the smallest of them
        waiting = open_pairs.select(F.col("b").alias("a")).distinct()
        firsts = cut(open_pairs.join(waiting, "a", "left_anti"))
        led = cut(firsts.groupBy("b").agg(F.min("a").alias("leader")))
        # a follower whose earlier neighbours are not all decided may still get a smaller leader
        rest = open_pairs.join(led.select("b", F.col("leader").alias("least")), "b", "left")
        unsure = rest.filter("least is not null and a < least").join(led.select(F.col("b").alias("a")), "a", "left_anti").select("b").distinct()
        final = cut(led.join(unsure, "b", "left_anti"))
        decided = final if decided is None else decided.unionByName(final)
        gone = final.select(F.col("b").alias("id"))
        # followers neither wait nor lead; a pair with a leader is kept only for those who may still find a smaller one
        left = rest.join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti")
        open_pairs = cut(left.select("a", "b"))
    if decided is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("leader")).limit(0)
    return decided.select(F.col("b").alias("id"), "leader")


def title_groups(books: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(reason, book_ids) of nearly equal titles of one first author; ids in ascending order."""
    titled = cut(_titled(books))
    classes = cut(_classes(titled))
    follow = leaders(close_titles(classes, threshold))
    led = classes.join(follow.withColumnRenamed("id", "first_id"), "first_id", "left").withColumn("leader", F.coalesce("leader", "first_id"))
    grouped = titled.join(led, ["block", "title"]).groupBy("leader").agg(F.array_sort(F.collect_list("id")).alias("book_ids")).filter(F.size("book_ids") > 1)
    return grouped.select(F.lit("similar title, same author").alias("reason"), "book_ids")


def equal_title_groups(books: DataFrame) -> DataFrame:
    """(reason, book_ids) for titles that are equal but for case and white space at the ends."""
    grouped = _titled(books).groupBy("block", "title").agg(F.array_sort(F.collect_list("id")).alias("book_ids")).filter(F.size("book_ids") > 1)
    return grouped.select(F.lit("similar title, same author").alias("reason"), "book_ids")


def author_groups(authors: DataFrame) -> DataFrame:
    """(canonical_author_id, duplicate_author_ids, names): authors whose names have the same words in any order."""
    signed = authors.select("id", F.coalesce("name", F.lit("")).alias("name"), name_signature("name").alias("signature")).filter(F.size("signature") > 0)
    grouped = signed.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("m")).filter(F.size("m") > 1)
    ids = F.transform("m", lambda x: x["id"])
    return grouped.select(ids[0].alias("canonical_author_id"), F.slice(ids, 2, F.size(ids)).alias("duplicate_author_ids"), F.transform("m", lambda x: x["name"]).alias("names"))


def duplicate_report(books: DataFrame, authors: DataFrame) -> DataFrame:
    """(type, reason, ids) of all three kinds; the books are evaluated once, with what the groups need of them."""
    first = F.transform(F.slice("authors", 1, 1), lambda a: F.struct(a["name"].alias("name"), a["sort"].alias("sort")))
    books = cut(books.select("id", "isbn", "title", first.alias("authors")))
    isbn = isbn_groups(books).select(F.lit("isbn").alias("type"), "reason", listed("book_ids").alias("ids"))
    title = title_groups(books).select(F.lit("title").alias("type"), "reason", listed("book_ids").alias("ids"))
    people = author_groups(authors).select(F.lit("author").alias("type"), F.array_join("names", ", ").alias("reason"), listed(F.concat(F.array("canonical_author_id"), F.col("duplicate_author_ids"))).alias("ids"))
    return isbn.unionByName(title).unionByName(people)

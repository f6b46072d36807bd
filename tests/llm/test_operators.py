"""Each operator against a brute-force version or an exact round trip, and on awkward inputs."""

import random
import unicodedata
from datetime import datetime as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookwarp.llm import components, fusion, leakage, lookalike, matching, names, packing, subjects
from bookwarp.llm.words import bare, mended, words


# --- look-alikes -----------------------------------------------------------------------------------------------------

TEXTS = [
    (1, "The Blind Tower"), (2, "Тhe Blind Tοwer"), (3, "Ｔｈｅ Ｂｌｉｎｄ Ｔｏｗｅｒ"), (4, "the blind tower"), (5, "The Blind Tower"), (6, "​The  Blind Tower﻿"), (7, "Café"), (8, "Café"), (9, "Cafe"),
    (10, "کتاب‌ها"), (11, "کتابها"), (12, "ab‌c"), (13, "abc"), (14, "x² y"), (15, "x2 y"), (16, "Volume Ⅱ"), (17, "Volume II"), (18, None), (19, "  "), (20, "​"), (21, "​​"), (22, "ветер"), (23, "вeтep"), (24, "вётер"),
]


def test_same_look(spark):
    rows = spark.createDataFrame([("t", i, x, "extra") for i, x in TEXTS] + [("t", 5, "The Blind Tower", "again"), ("t", None, "Café", "")], "tbl string, id bigint, text string, canon2 string")
    got = sorted((r.id_a, r.id_b) for r in lookalike.same_look_pairs(rows).collect())
    alike = [1, 2, 3, 5, 6]
    want = [(a, b) for a in alike for b in alike if a < b and (a, b) != (1, 5)] + [(7, 8), (12, 13), (16, 17), (22, 23)]
    assert got == sorted(want)
    assert lookalike.same_look_pairs(rows.limit(0)).count() == 0


@pytest.mark.parametrize("latin, cyrillic", [(1, 4), (4, 1), (0, 3), (3, 0)])
def test_same_look_whatever_the_majority(spark, latin, cyrillic):
    """The Latin and the Cyrillic spelling of one look meet, whichever is more frequent."""
    texts = ["cop"] * latin + ["сор"] * cyrillic + ["cоp"]
    rows = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tbl string, id bigint, text string")
    got = {(r.id_a, r.id_b) for r in lookalike.same_look_pairs(rows).collect()}
    assert got == {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] != texts[b]}
    assert {r.canon for r in lookalike.canonical_texts(rows).collect()} == {"cop" if latin else "сор"}


def test_automaton_reads_signs_as_written(spark, monkeypatch):
    """Ignorables, width and look-alikes cost nothing inside the automaton; brute force compares normalised words."""
    rng = random.Random(8)
    alphabet = ["a", "е", "e", "ﬁ", "f", "i", "Ⅷ", "V", "I", "Ａ", "A", "\u200b", "\u200c", "ب", "ك", "é", "é", "\ufeff", "\u0323"]
    plain_words = sorted({w for _ in range(4000) if lookalike.plain(w := unicodedata.normalize("NFC", "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))))) and w})
    trie = lookalike.Trie({unicodedata.normalize("NFD", w): 1 for w in plain_words})
    by_form = {}
    for w in plain_words:
        by_form.setdefault(lookalike.table_form(w), set()).add(unicodedata.normalize("NFD", w))
    hit = 0
    for _ in range(3000):
        token = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))
        if "\u0323" in token:  # a mark that an invisible sign keeps from its place is left to the second walk
            continue
        want = by_form.get(lookalike.table_form(token), set())
        assert {w for _, w in trie.reach(token)} == want
        assert lookalike.coarse(token) == lookalike.coarse(lookalike.table_form(token))
        hit += bool(want)
    assert hit > 300
    monkeypatch.setattr(lookalike, "TRIE", 3)  # many small tries give the same
    test_same_look(spark)


def test_automaton_against_table(spark):
    rng = random.Random(3)
    letters = {b: a for a, b in lookalike.LETTER.items()}
    words_ = ["".join(rng.choice("abcdeopxyh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    trie = lookalike.Trie({w: words_.count(w) for w in words_})
    for w in words_[:80]:
        disguised = "".join(letters.get(c, c) if rng.random() < 0.5 else c for c in w)
        assert trie.canonical(disguised) == w == lookalike.table_form(disguised)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for w in ("abc", "hop", "x", "deadp"):
        want = sorted((d, v) for v in set(words_) if (d := edits(w, v)) <= 1)
        assert sorted(trie.reach(w, 1)) == want
    column = spark.createDataFrame([("Ｃａｆé​  РAT’S",)], "x string").select(lookalike.folded("x")).first()[0]
    assert column == "cafe pat's"
    assert unicodedata.normalize("NFC", lookalike.table_form("Ångström")) == "Ångström"


# --- components ------------------------------------------------------------------------------------------------------


def grouped(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in edges:
        ends = [x for x in (a, b) if x is not None]
        for e in ends:
            ra, rb = sorted((find((k, ends[0])), find((k, e))), key=lambda t: t[1])
            parent[rb] = ra
    return {(k, i, find((k, i))[1]) for k, i in list(parent)}


def shapes(rng):
    yield [("a", i, i + 1) for i in range(60)]  # a path
    yield [("a", i, (i + 1) % 41) for i in range(41)]  # a ring
    yield [("a", 0, i) for i in range(1, 300)] + [("a", 5, 1000)]  # a star
    ids = rng.sample(range(10_000), 80)
    yield [("a", ids[i], ids[(i + 1) % 80]) for i in range(80)]  # a ring of shuffled ids
    yield [("a", 10 * x + y, 10 * x + y + d) for x in range(9) for y in range(9) for d in (1, 10)]  # a grid
    yield [(rng.choice("ab"), rng.randrange(120), rng.randrange(120)) for _ in range(110)]  # a sparse random graph
    yield [("a", 3, 3), ("a", None, 4), ("a", 5, None), ("a", None, None), ("b", 2, 1), ("b", 1, 2), ("b", 1, 2)]


@pytest.mark.parametrize("k", range(7))
def test_groups(spark, k):
    edges = list(shapes(random.Random(1)))[k]
    pairs = spark.createDataFrame([(*e, 1) for e in edges], "kind string, id_a bigint, id_b bigint, v int")
    assert {tuple(r) for r in components.connected_groups(pairs).collect()} == grouped(edges)


def test_no_pairs_and_null_kind(spark):
    schema = "kind string, id_a bigint, id_b bigint"
    assert components.connected_groups(spark.createDataFrame([], schema)).count() == 0
    assert {tuple(r) for r in components.connected_groups(spark.createDataFrame([(None, 2, 1), ("-", 2, 3)], schema)).collect()} == {(None, 1, 1), (None, 2, 1), ("-", 2, 2), ("-", 3, 2)}


# --- fusion ----------------------------------------------------------------------------------------------------------


def test_survivors(spark):
    t = lambda d: D(2025, 1, d)
    books = spark.createDataFrame(
        [(1, "Old Title", "King, S", "2000-01-01", "2020-01-01", 1, t(1)), (2, "Untitled", None, "2001-02-30", "2021-01-01 10:00:00+00:00", 1, t(2)), (3, "Steρhen King", "n/a", "1200-01-01", "2022-01-01", 2, t(3)), (1, "Old Title", "King, S", "2000-01-01", "2020-01-01", 2, t(9)), (4, " ", "", None, None, 1, t(1))],
        "id bigint, title string, author_sort string, pubdate string, last_modified string, load_id bigint, loaded_at timestamp",
    )
    authors = spark.createDataFrame([(1, "Stephen King", "King, Stephen", "https://", 1, t(1)), (2, "King S", "-", "https://authors.example/1", 1, t(2)), (3, "K", None, None, 1, t(3))], "id bigint, name string, sort string, link string, load_id bigint, loaded_at timestamp")
    links = spark.createDataFrame([(1, 3, 1)], "id bigint, book bigint, author bigint")
    groups = spark.createDataFrame([(1, [3, 1, 2, 2, 77]), (2, [4]), (3, None), (None, [1])], "group_id bigint, book_ids array<bigint>")
    people = spark.createDataFrame([(1, 1, [2, 3, 3]), (2, 3, None), (3, 99, [98])], "group_id bigint, canonical_author_id bigint, duplicate_author_ids array<bigint>")
    got = {tuple(r) for r in fusion.survivors(groups, people, books, links, authors).collect()}
    assert got == {("book", 1, "title", 1), ("book", 1, "author_sort", 1), ("book", 1, "pubdate", 1), ("author", 1, "sort", 1), ("author", 1, "link", 2), ("author", 1, "canonical_author_id", 2), ("author", 2, "canonical_author_id", 3)}
    none = fusion.survivors(groups.limit(0), people.limit(0), books, links, authors)
    assert none.count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(fusion.author_claims(people, authors), 0)


def test_copied_votes_count_less(spark):
    """Sources 1 to 4 are independent; 6 and 7 copy source 5 with its false values."""
    rng = random.Random(2)
    rows = []
    for g in range(200):
        stated = ["t" if rng.random() < (0.75 if s <= 4 else 0.5) else f"f{rng.randrange(10)}" for s in range(1, 6)]
        for s, value in enumerate([*stated, stated[-1], stated[-1]], 1):
            rows.append(("book", g, "title", 10 * g + s, value, s, D(2025, 1, 1), D(2025, 1, 1)))
    claims = spark.createDataFrame(rows, "grp string, group_id bigint, field string, record_id bigint, value string, source bigint, at timestamp, arrived timestamp")
    fused = {r.group_id: r.value for r in fusion.fuse(claims, None).collect()}
    votes = {g: [r[4] for r in rows if r[1] == g] for g in range(200)}
    majority = sum(max(sorted(set(v)), key=v.count) == "t" for v in votes.values())
    right = sum(v == "t" for v in fused.values())
    assert right >= 180 and right > majority + 5


def test_old_claims_tell_how_good_their_sources_are(spark):
    """Source 2 contradicted three others in claims that a later one has replaced: it loses where moments are equal."""
    old, new = D(2025, 1, 1), D(2025, 2, 1)
    rows = []
    for g in range(60):
        for s in range(1, 5):
            rows.append(("book", g, "title", 10 * g + s, f"f{g}" if s == 2 else "t", s, old, old))
        rows.append(("book", g, "title", 10 * g + 5, "n", 5, new, new))
    for g in range(60, 70):  # source 2 arrives later
        rows += [("book", g, "title", 10 * g + 1, "a", 1, new, old), ("book", g, "title", 10 * g + 2, "b", 2, new, new)]
    claims = spark.createDataFrame(rows, "grp string, group_id bigint, field string, record_id bigint, value string, source bigint, at timestamp, arrived timestamp")
    found = {r.group_id: r.value for r in fusion.fuse(claims).collect()}
    assert found == {g: "n" if g < 60 else "a" for g in range(70)}


def test_newest_value_is_the_likeliest(spark):
    """The posterior alone chooses: the newest value however few state it, by votes where moments are equal."""
    rng = random.Random(12)
    at = lambda k: D(2025, 1, 1, 0, 0, 0, k)  # noqa: E731  (microseconds apart)
    rows, want = [], {}
    for g in range(300):
        n = rng.randint(1, 9)
        moments = rng.sample(range(20), n) if g % 3 else [rng.randrange(3) for _ in range(n)]
        for k, m in enumerate(moments):
            source = rng.choice([1, 2, 3, 4, 5, 5, None])
            rows.append(("book", g, "title", 100 * g + k, rng.choice("xyz"), source, None if rng.random() < 0.1 else at(m), at(m)))
        mine = [r for r in rows if r[1] == g]
        last = max((r[6] for r in mine if r[6] is not None), default=None)
        want[g] = {r[3] for r in mine if r[6] == last}
    claims = spark.createDataFrame(rows, "grp string, group_id bigint, field string, record_id bigint, value string, source bigint, at timestamp, arrived timestamp")
    found = {r.group_id: (r.record_id, r.value, r.p) for r in fusion.fuse(claims).collect()}
    assert found.keys() == want.keys() and all(found[g][0] in want[g] for g in want)
    best = {}
    for r in fusion.posteriors(claims, half_life=fusion.HOLDS).collect():
        best[r.group_id] = max(best.get(r.group_id, (0, "")), (r.p, r.value))
    assert all(found[g][1] == best[g][1] or abs(found[g][2] - best[g][0]) < 1e-6 for g in want)
    assert sum(len(w) > 1 for w in want.values()) > 30


# --- matching --------------------------------------------------------------------------------------------------------


def test_titles_are_parsed():
    parse = lambda t, a=(): matching.parse_title(t, [matching.author_words(x) for x in a])[:3]
    assert parse("The Quiet Mill, Book 3") == ("the quiet mill", "quiet mill", 3) == parse("Quiet Mill, The, Book 3")[:0] + parse("The Quiet Mill #3") == parse("THE QUIET MILL Vol. 3 (Paperback)")
    assert parse("Quiet Mill II, The") == ("the quiet mill", "quiet mill", 2)
    assert parse("A Copper Beacon by Helen Ash (Paperback)", ["Ash, Helen"])[0] == "a copper beacon"
    assert parse("Married by Morning", ["Someone Else"])[0] == "married by morning"
    assert parse("Naïve Mill: A Novel")[0] == "naive mill" and parse("Helen Ash", ["Ash, Helen"])[0] == "" and parse(None)[0] == ""
    assert matching.title_likeness("quiet mill", "quite mill") == 1 and matching.title_likeness("letter clock", "clock letter") < 0.99
    assert matching.same_author("ashlund helen", "ashlund h") and not matching.same_author("ashlund helen", "ashlund robert") and matching.same_author("ashlund bob", "ashlund robert")
    assert not matching.same_author("alpha association health of public", "association beta of research")


def test_meeting_parts():
    rng = random.Random(5)
    known = ["ashlund helen", "ashlund h", "li wu", "bob", "katherine moor", "catherine moor", "mohr robert", "university york", "univ yorkshire", "society of birds the", "birds of the society", "council ax", "ax council", "william smith", "will smyth", "jo li", "ashlund"]
    def typo(name):  # noqa: E306
        i = rng.randrange(len(name))
        return " ".join((name[:i] + rng.choice(["", "x", name[i : i + 1] * 2, name[i + 1 : i + 2] + name[i : i + 1]]) + name[i + 1 :]).split())
    every = known + [t for n in known for _ in range(8) if (t := typo(n))]
    agreeing = 0
    for a in every:
        for b in every:
            if matching.same_author(a, b):
                agreeing += 1
                assert matching.meeting_parts([a], False) & matching.meeting_parts([b], True), (a, b)
    assert agreeing > 2 * len(every)
    assert matching.same_author("smith ronald j", "john smith r") and matching.same_author("ashlund helen mary", "ashlund h")
    assert not matching.same_author("bellamy wilfred r", "crane wilfred r") and not matching.same_author("bellamy hannah n", "hannah norton p")


def test_crowded_titles(spark):
    """More than 30 books of one title: found by misspelt, abbreviated and nickname authors, or alone if they are one author's."""
    rng = random.Random(6)
    surnames = sorted({"".join(rng.choice(["ka", "lo", "mi", "tre", "vos", "bru"]) for _ in range(4)).capitalize() + rng.choice("nrst") * 2 for _ in range(90)})[:60]
    books = spark.createDataFrame([(i, "Distant Beacon") for i in range(60)] + [(100 + i, "Same Hand") for i in range(40)], "id bigint, title string")
    authors = spark.createDataFrame([(i, f"William {n}") for i, n in enumerate(surnames)] + [(99, "Ada Solitary")], "id bigint, name string")
    links = spark.createDataFrame([(i, i) for i in range(60)] + [(100 + i, 99) for i in range(39)], "book bigint, author bigint")
    isbns = spark.createDataFrame([], "book bigint, type string, val string")
    shapes = [lambda n: f"Bill {n}", lambda n: f"W. {n}", lambda n: f"William {n[:3]}x{n[4:]}"]
    asked = [(i, "Distant Beacon", [shapes[i % 3](n)], None, None) for i, n in enumerate(surnames)]
    asked += [(200, "Same Hand", None, None, None), (201, "Same Hand", ["Zoe Other"], None, None), (202, "Distant Beacon", None, None, None)]
    candidates = spark.createDataFrame(asked, "candidate_id bigint, title string, authors array<string>, isbn string, fetched_at timestamp")
    found = {(r.candidate_id, r.book_id) for r in matching.matches(candidates, books, links, authors, isbns).collect()}
    one = lambda a, b: matching.same_author(matching.author_words(a[2][0]), matching.author_words(f"William {surnames[b]}"))
    want = {(a[0], b) for a in asked[:60] for b in range(60) if one(a, b)} | {(200, 100 + i) for i in range(40)} | {(201, 139)}
    assert {(i, i) for i in range(60)} <= want and found == want


def test_misspelt_rare_title_words(spark):
    """All pairs that reranking accepts, by comparing all with all."""
    rng = random.Random(9)
    rare = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(400)]
    titles = [f"Beacon of {rare[i]} and {rare[(7 * i + 1) % 400]}" for i in range(400)]
    people = [f"Ada {rng.choice(rare).capitalize()}" for _ in range(400)]
    def typo(word):  # noqa: E306
        i = rng.randrange(len(word))
        return word[:i] + rng.choice(["", "x", word[i] * 2]) + word[i + 1 :]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, title string, bare string, volume int, authors array<string>, isbns array<string>")
    parsed = lambda i, t, a: (i, *matching.parse_title(t, [matching.author_words(a)]), [])
    books = [parsed(i, t, a) for i, (t, a) in enumerate(zip(titles, people, strict=True))]
    asked = []
    for i, (t, a) in enumerate(zip(titles, people, strict=True)):
        ws = t.split(" ")
        ws[2] = typo(ws[2])
        ws[4] = typo(ws[4]) if i % 3 == 0 else ws[4]
        asked.append(parsed(i, " ".join(ws), "A. " + a.split()[1]))
    told = lambda r: (r[2], r[3], r[4], r[5])
    want = {(c[0], b[0]) for c in asked for b in books if matching.agree(told(c), told(b))[0]}
    c, b = frame(asked), frame(books)
    got = {(r.candidate_id, r.book_id) for r in matching.scored_pairs(c, b, matching.settled_titles(b)).filter("describes").collect()}
    assert len(want) >= 390 and got == want
    assert len(set(matching.respelt("a b c", [(0, ["x"]), (1, ["y", "z"]), (2, ["w"])]))) == 11
    assert len(set(matching.respelt("a b c", [(0, ["x"]), (1, ["y", "z"]), (2, ["w"])], limit=5))) == 9


def test_calibration_takes_all_pairs(spark):
    """The first 20,000 rows say the opposite of the rest, and their order changes nothing."""
    n = F.col("id")
    cosine, first = n % 100 / 100, n < 20_000
    equal = F.when(first, n % 100 < 50).otherwise(n % 100 >= 50)
    pairs = spark.range(0, 80_000, 1, 4).select(n.alias("candidate_id"), cosine.alias("cosine"), F.lit(10.0).alias("rarity"), F.lit(True).alias("titles"), F.lit(matching.SAME).alias("authors"), equal.alias("same_isbn"))
    pairs = pairs.unionByName(pairs.filter("not same_isbn").withColumn("same_isbn", F.lit(True)).withColumn("titles", F.lit(False)))  # every candidate's isbn is known
    weights, by_isbn = matching.calibration(pairs)
    again = matching.calibration(pairs.orderBy(F.desc("candidate_id")))
    assert weights[matching.SAME][1] > 0 and (again[0] == weights).all() and again[1] == by_isbn
    assert abs(by_isbn - 0.5) < 0.01
    assert matching.calibration(pairs.limit(0))[0][:, 0].tolist() == list(matching.PRIOR)


def test_all_records_count_in_the_fit(spark):
    """Rarities and vectors come from every record; words of one record end nearer to each other than to others."""
    rng = np.random.default_rng(4)
    made = lambda: "".join(rng.choice(list("bdfgklmnprstaeiou"), 9))
    own = [[made() for _ in range(3)] for _ in range(5500)]
    rows = [(i, f"{a} {b}", [c], []) for i, (a, b, c) in enumerate(own)]
    fitted = matching.fit_embedding(spark.createDataFrame(rows[:500], matching_shape := "id bigint, title string, authors array<string>, isbns array<string>"), spark.createDataFrame(rows[500:], matching_shape))
    words = {w for r in own for w in r}
    having = np.zeros(matching.BUCKETS)
    for w in words:
        having[list(set(matching.buckets(w)))] += 1
    assert fitted.records == 5500 and np.allclose(fitted.rarity, np.log((len(words) + 2) / (having + 1)) ** 2, rtol=1e-4)
    a, b, c = (fitted.sums([r[k] for r in own]) for k in range(3))
    assert (a * b).sum(axis=1).mean() - (a * np.roll(c, 7, axis=0)).sum(axis=1).mean() > 0.03
    none = matching.fit_embedding(spark.createDataFrame([], matching_shape))
    assert np.isfinite(none.table).all()


def test_trigrams_are_taken_in_arrays(monkeypatch):
    """The fit hashes a word at a time, not a trigram at a time, and gives what plain loops give."""
    rng = np.random.default_rng(4)
    words = ["", "a", "ab", "дом", "naïve", "a日b", "x" * 300, *("".join(rng.choice(list("abcdefghé9"), rng.integers(1, 12))) for _ in range(300))]
    flat, begin, size = matching.spread(words)
    assert [flat[b : b + n].tolist() for b, n in zip(begin, size, strict=True)] == [matching.buckets(w) for w in words]
    runs = np.array([1, 2, 15, 16, 17, 256, 257, 5000])
    values, rows = rng.normal(size=(50, 3)), rng.integers(0, 50, runs.sum())
    assert np.allclose(matching.summed(values, rows, runs), np.add.reduceat(values[rows], np.cumsum(runs) - runs, axis=0))
    records = [{f"word{i}" for i in rng.integers(0, 40, 3)} for _ in range(200)] + [{"alone"}, set()]
    basis, sketch = rng.normal(size=(matching.BUCKETS, 4)).astype(np.float32), np.ones(matching.SKETCH)
    vector = {w: basis[matching.buckets(w)].sum(axis=0) / len(matching.buckets(w)) / np.sqrt(2) for r in records for w in r}
    want = np.zeros_like(basis)
    for r in records:
        for w in r:
            for b in matching.buckets(w):
                want[b] += sum(vector[v] for v in r if v != w) / len(matching.buckets(w)) / np.sqrt(2)
    hashed, plain = [], matching._bucket
    monkeypatch.setattr(matching, "_bucket", lambda text: hashed.append(text) or plain(text))
    assert np.allclose(matching.neighbours(records, basis, sketch), want, atol=1e-4) and not want[plain("<alone>")].any()
    assert len(hashed) <= len(vector)


def test_vectors_are_trained():
    """Tokens of one record end nearer to each other than to those of other records, unlike before training."""
    rng = np.random.default_rng(1)
    made = lambda: "".join(rng.choice(list("bdfgklmnprstaeiou"), 9))
    records = []
    for _ in range(60):
        own = [made() for _ in range(4)]
        records += [[own[:2], own[2:], []] for _ in range(8)]
    walks = matching.random_walks(records, np.random.default_rng(2))
    unit = lambda table, w: (lambda v: v / np.linalg.norm(v))(table[matching.buckets(w)].mean(axis=0))
    def nearer(table):  # noqa: E306
        same = [unit(table, r[0][0]) @ unit(table, r[1][0]) for r in records[::8]]
        other = [unit(table, r[0][0]) @ unit(table, q[1][0]) for r, q in zip(records[::8], records[8::8], strict=False)]
        return np.mean(same) - np.mean(other)
    start = matching.skip_gram(walks, np.random.default_rng(3), epochs=0)
    assert nearer(matching.skip_gram(walks, np.random.default_rng(3))) > 0.3 > 0.15 > abs(nearer(start))


def test_regression_settles():
    """Counts that a full step overshoots: hits only where rarity is high, nearly none elsewhere."""
    rarity = np.array([7.0, 7.5, 8.0, 12.0, 13.0, 20.0])
    n, m = np.array([3e4, 4e5, 3e4, 30.0, 20.0, 5.0]), np.array([1e2, 1.5e3, 9e1, 28.0, 20.0, 5.0])
    x = matching.features(np.ones(6), rarity)
    w = matching.fitted(x, n, m, np.array([-2.0, 0.0, 0.0]))
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(w).max() < 20 and (p[:3] < 0.05).all() and (p[3:] > 0.5).all()
    assert matching.fitted(x[:0], n[:0], m[:0], np.array([-2.0, 0.0, 0.0])).tolist() == [-2.0, 0.0, 0.0]


def test_pieces_meet():
    """Words one edit apart, one of more than three letters, share a piece."""
    rng = random.Random(7)
    for _ in range(20_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 15)))
        i, kind = rng.randrange(len(a)), rng.randrange(4)
        b = [a[:i] + a[i + 1 :], a[:i] + rng.choice("abc") + a[i:], a[:i] + rng.choice("abc") + a[i + 1 :], a[:i] + a[i : i + 2][::-1] + a[i + 2 :]][kind]
        if max(len(a), len(b)) > 3 and min(len(a), len(b)) > 2:
            assert matching.one_edit(a, b) and matching.pieces(a) & matching.pieces(b), (a, b)


def test_isbns_need_their_check_digit():
    clean = matching.clean_isbn
    assert clean("ISBN-13: 978-0-306-40615-7 (pbk)") == "9780306406157" and clean("0-306-40615-2") == "0306406152" and clean("080442957x") == "080442957X"
    assert not any(map(clean, ("9780306406158", "0000000000", "0000000000000", "97803064061X7", "12", "", None)))


def test_matches(spark):
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "tre", "vos", "bru", "den", "gri", "pu", "sa"]
    name = lambda n: "".join(rng.choice(syllables) for _ in range(n)).capitalize()
    people = [f"{g} {name(4)}" for g in ("Ada", "Ben", "Clara", "Dan") for _ in range(25)]
    titles = [f"The {rng.choice(('Quiet', 'Broken', 'Amber'))} {rng.choice(('Mill', 'Tower', 'River'))} of {name(4)}" for _ in range(300)]
    books = spark.createDataFrame([(i, t, 0) for i, t in enumerate(titles)] + [(900, None, 0), (901, "", 0), (None, "x", 0)], "id bigint, title string, volume bigint")
    authors = spark.createDataFrame(list(enumerate(people)) + [(None, "y"), (500, None)], "id bigint, name string")
    links = spark.createDataFrame([(i, i, i % 100) for i in range(300)] + [(999, None, 3), (998, 900, 4)], "id bigint, book bigint, author bigint")
    isbns = spark.createDataFrame([(i, i, "isbn", f"97950000{i:05d}") for i in range(0, 300, 2)] + [(700, None, "isbn", "1"), (701, 3, "ISBN", None)], "id bigint, book bigint, type string, val string")
    asked, want = [], set()
    for i in range(0, 300, 3):
        t, a = titles[i], people[i % 100]
        kind = i % 5
        if kind == 0:
            row = (t.upper() + " (Paperback)", [", ".join(reversed(a.split()))], None)
        elif kind == 1:
            row = (t, None, f"979-5-0000-{i:04d}-0")
        elif kind == 2:
            row = (t + ", Book 2", [a], None)  # another volume
        elif kind == 3:
            row = (t.replace("The ", "") + ", The", ["Zoe Unknownson", a[0] + ". " + a.split()[1]], "")
        else:
            row = ("Entirely Different " + name(5), ["Nobody Atall"], "9795000999999")
        asked.append((i, *row, D(2025, 1, 1)))
        if kind in (0, 1, 3):
            want.add((i, i))
    asked += [(5001, None, None, None, None), (5002, "", [], "", None), (5003, "???", [None], "x", None), (None, titles[0], None, None, None), (0, *asked[0][1:])]
    candidates = spark.createDataFrame(asked, "candidate_id bigint, title string, authors array<string>, isbn string, fetched_at timestamp")
    got = matching.matches(candidates, books, links, authors, isbns)
    found = {(r.candidate_id, r.book_id) for r in got.collect()}
    assert len(found - want) <= 1 and len(want - found) <= 3
    assert matching.matches(candidates.limit(0), books, links, authors, isbns).count() == 0
    assert matching.matches(candidates, books.limit(0), links, authors, isbns).count() == 0


# --- names -----------------------------------------------------------------------------------------------------------


def test_names(spark):
    base = [f"{g} {s}" for g in ("Robert", "Eleanor", "Alice", "Adam", "John", "Clara", "Julia") for s in ("Tekradolund", "Mivororasen", "Hokestavist", "Burkalograd", "Vonasimark", "Pretokivist")]
    people = [(i, n) for i, n in enumerate(base)]
    more = {
        100: ("Tekradolund, Robert", 0), 101: ("Bob Tekradolund", 0), 102: ("Dr. Robert Tekradolund, PhD", 0), 103: ("Rоbеrt Tekradolund", 0), 104: ("R. Tekradolund", 0), 105: ("Robert Tekradoluund", 0), 106: ("Nell Mivororasen", 7), 107: ("Tekradolund| Robert", 0),
        108: ("A. Tekradolund", None), 109: ("Elaenor Mivororasen", 7), 110: ("Robert Q. Tekradolund", 0),
    }
    same = {200: "Brokavist University Department of Rural Studies", 201: "Univ. Dept. of Rural Studies, Brokavist", 202: "THE BROKAVIST UNIVERSITY DEPARTMENT FOR RURAL STUDIES", 203: "Brokavisst University Department of Rural Studies"}
    other = {300: "Drelavist University Department of Rural Studies", 301: "John Sarkovin Jr.", 302: "John Sarkovin Sr.", 303: None, 304: " ", 305: "??", 306: "X"}
    rows = people + [(i, n) for i, (n, _) in more.items()] + list(same.items()) + list(other.items()) + [(None, "Robert Tekradolund"), (0, base[0])]
    authors = spark.createDataFrame(rows, "id bigint, name string")
    groups = spark.createDataFrame([(1, 0, [101])], "group_id bigint, canonical_author_id bigint, duplicate_author_ids array<bigint>")
    owner = {i: i for i, _ in people} | {i: o for i, (_, o) in more.items() if o is not None} | dict.fromkeys(same, 200)
    want = {(a, b) for a in owner for b in owner if a < b and owner[a] == owner[b]}
    got = {tuple(r) for r in names.linked_authors(authors, groups).collect()}
    assert got == want
    assert names.linked_authors(authors.limit(0)).count() == 0


def test_legal_forms_and_whole_words(spark):
    """Companies with and without their legal form are one; words that only begin alike are two."""
    alike = [
        ["Acme Publishing Ltd", "Acme Publishing Limited", "Acme Publishing", "ACME PUBLISHING, INC.", "Publishing, Acme (LLC)", "The Acme Publishing Co."],
        ["Brokavist Institute of Ecology", "Brokavist Institute of Ecology, Inc.", "Brokavist Inst. for Ecology", "Institute of Ecology, Brokavist", "Brokavist Institute of Ecologgy"],
        ["Brokavist Institute of Economics", "Brokavist Institute of Economics GmbH"], ["Müller Verlag", "Müller Verlag GmbH & Co. KG", "Muller Verlag G.m.b.H."],
        ["Dupont Editions", "Dupont Editions S.A.R.L.", "Éditions Dupont SA", "Dupont Editions, société anonyme"], ["Popular Science Society", "Popular Sci. Soc.", "Pop. Sci. Society"],
        ["Robert Tekradolund"], ["Helen Press"], ["King, S. A."], ["John Co"],
    ]
    rows = [(100 * g + k, n) for g, ns in enumerate(alike) for k, n in enumerate(ns)]
    authors = spark.createDataFrame(rows, "id bigint, name string")
    got = {tuple(r) for r in names.linked_authors(authors).collect()}
    assert got == {(a, b) for a, _ in rows for b, _ in rows if a < b and a // 100 == b // 100}


def test_groups_have_a_score(spark):
    """An abbreviated name that may be two persons' is in a group of its own, with half the score."""
    base = [f"{g} {s}" for g in ("Robert", "Ruth", "Clara", "Adam", "Julia", "John") for s in ("Hokestavist", "Burkalograd", "Vonasimark", "Pretokivist", "Mivororasen")]
    rows = [*enumerate(base), (100, "R. Hokestavist"), (101, "C. Hokestavist"), (102, "Hokestavist, R.")]
    got = {r.id: (r.person, r.score) for r in names.name_groups(spark.createDataFrame(rows, "id bigint, name string")).collect()}
    assert got.keys() == {i for i, _ in rows} and got[100] == got[102] and got[100][1] == 0.5
    assert got[101] == got[10] and got[10][1] == 1.0 and got[100][0] not in {got[i][0] for i in range(len(base))}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words(spark, seed):
    rng = random.Random(seed)
    words_ = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(150)})
    df = spark.createDataFrame([(w, 1) for w in words_], "word string, n bigint")
    got = {(r.word, r.other) for r in names.near_words(df).collect()}
    assert got == {(a, b) for a in words_ for b in words_ if a != b and names.one_edit(a, b)}


def test_one_edit():
    def apart(a, b):
        near = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        near |= {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "abc" for k in (0, 1)}
        return b in near

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in "ab")
        assert names.one_edit(a, b) == apart(a, b), (a, b)


# --- packing ---------------------------------------------------------------------------------------------------------


def plain_sum_of_squares(sizes, capacity):
    gaps, out = [], []
    for s in sizes:
        best = None
        for g in [*sorted({g for g in gaps if g >= s}), None]:
            after = [*gaps]
            if g is None:
                after.append(capacity - s)
            else:
                after[after.index(g)] = g - s
            cost = sum(after.count(x) ** 2 for x in set(after) if x)
            if best is None or cost < best[0]:
                best = (cost, g)
        g = best[1]
        if g is None:
            out.append(len(gaps))
            gaps.append(capacity - s)
        else:
            k = max(i for i, x in enumerate(gaps) if x == g)
            out.append(k)
            gaps[k] = g - s
    return out, gaps


def test_sum_of_squares():
    rng = np.random.default_rng(1)
    for capacity in (7, 20, 64):
        sizes = rng.integers(1, capacity + 1, 150)
        got = packing.sum_of_squares(sizes, capacity)
        fill = np.bincount(got, weights=sizes)
        assert fill.max() <= capacity
        want, gaps = plain_sum_of_squares(sizes.tolist(), capacity)
        assert sorted(capacity - fill) == sorted(gaps) and len(fill) == len(gaps)
    assert len(packing.sum_of_squares(np.array([], dtype=int), 5)) == 0


def test_packing(spark, monkeypatch):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(("alpha", "beta", "gamma ray")) for _ in range(rng.choice((3, 10, 60, 400)))), "x") for i in range(150)] + [(900, None, ""), (901, "", ""), (None, "lost", "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, capacity_tokens string")
    targets = spark.createDataFrame([(1, 64), (2, 512), (2, 100), (3, None), (None, 5), (4, 0)], "target_id bigint, capacity_tokens bigint")
    monkeypatch.setattr(packing, "SHARD", 40)
    rows = packing.pack(docs, targets).collect()
    sizes = {r.doc_id: r.n for r in packing.token_counts(docs).collect()}
    for target, capacity in ((1, 64), (2, 512)):
        mine = [r for r in rows if r.target_id == target]
        fill, whole = {}, {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.tokens
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
        assert max(fill.values()) <= capacity and whole == {d: n for d, n in sizes.items() if n}
        assert all(sum(1 for r in mine if r.doc_id == d) == -(-n // capacity) for d, n in sizes.items() if n)
        assert sum(fill.values()) > 0.9 * capacity * (len(fill) - 1)
    assert packing.pack(docs.limit(0), targets).count() == 0 and packing.pack(docs, targets.limit(0)).count() == 0


# --- leakage ---------------------------------------------------------------------------------------------------------


def all_stretches(passage, doc, window=12, changed=6):
    """By trying every stretch of the passage against every stretch of the document."""
    for i in range(len(passage)):
        for j in range(i + window, len(passage) + 1):
            allowed = (j - i) // changed
            for p in range(len(doc)):
                if doc[p] != passage[i]:
                    continue
                for q in range(p + j - i - allowed, min(len(doc), p + j - i + allowed) + 1):
                    if doc[q - 1] != passage[j - 1]:
                        continue
                    row = list(range(q - p + 1))
                    for n, x in enumerate(passage[i:j], 1):
                        row, last = [n], row
                        for m, y in enumerate(doc[p:q], 1):
                            row.append(min(last[m] + 1, row[-1] + 1, last[m - 1] + (x != y)))
                    if row[-1] <= allowed:
                        return True
    return False


def test_stretch_and_recall():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 24))] for _ in range(12)]
    index = leakage.Index(passages)
    found = missed = 0
    for _ in range(120):
        k = rng.randrange(12)
        n = rng.randint(9, len(passages[k]))
        at = rng.randrange(len(passages[k]) - n + 1)
        quote = passages[k][at : at + n]
        for _ in range(rng.randint(0, 3)):
            x = rng.randrange(len(quote))
            quote[x : x + rng.randint(0, 1)] = [rng.choice(vocabulary + ["zz"])] * rng.randint(0, 1)
        doc = [f"o{rng.randrange(99)}" for _ in range(rng.randint(0, 15))] + quote + [rng.choice(vocabulary) for _ in range(5)]
        want = {p for p in range(12) if all_stretches(passages[p], doc)}
        got = set(index.leaks([" ".join(doc)])[0])
        assert got <= want
        found, missed = found + len(want & got), missed + len(want - got)
    assert found > 40 and missed <= 0.02 * (found + missed)


def test_one_change_in_six():
    rng = random.Random(7)
    passages = [[f"p{k}w{i}" for i in range(40)] for k in range(20)]
    index = leakage.Index(passages)
    for n, changes in ((12, 2), (13, 2), (18, 3), (20, 3)):
        for kind in ("replaced", "dropped", "added"):
            for k, passage in enumerate(passages):
                quote = passage[5 : 5 + n]
                places = rng.sample(range(1, n - 1), changes) if k else [1, n - 2, 4][:changes]  # also right after the first word
                for x in sorted(places, reverse=True):
                    quote[x : x + (kind != "added")] = [] if kind == "dropped" else ["other"]
                assert index.leaks([" ".join(["before"] * 5 + quote + ["after"] * 5)]) == [[k]], (n, kind, places)
    assert not leakage.stretch(np.arange(12), np.array([0, 1, 99, 3, 4, 98, 6, 7, 97, 9, 10, 11]))  # three in twelve


def test_leaks(spark):
    passage = "Neither Mufi nor the stubborn lock-smith repaired the oak baskets that Hefa pretended to inspect before mid-summer"
    items = [(1, f"Answer using only the text below. {passage}. Who moved it?"), (2, f"Read the passage. {passage}. Why?"), (3, "Answer using only the text below. Another tale of ten slow geese on a very long road to the old town. Why?"), (4, None), (5, "Read the passage. Short. Why?")]
    wrapped = passage.upper().replace("PRETENDED ", "PRETEN-\nDED ").replace("OAK", "<b>ÔAK</b>")
    docs = [(1, f"Intro text. {wrapped}. More"), (2, passage.replace("oak", "elm").replace("Hefa", "Bufo")), (3, "Neither Mufi nor the stubborn lock-smith repaired"), (4, None), (5, " "), (6, "Answer using only the text below. Who moved it?"), (7, "word " * 5000 + passage)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, text string").withColumn("suite", F.lit("x"))
    want = {(d, i) for d in (1, 2, 7) for i in (1, 2)}
    for block in (1, 100):
        assert {tuple(r) for r in leakage.leaks(frame(docs, "doc_id"), frame(items, "item_id"), block=block).collect()} == want
    assert leakage.leaks(frame(docs, "doc_id").limit(0), frame(items, "item_id")).count() == 0
    assert leakage.leaks(frame(docs, "doc_id"), frame(items, "item_id").limit(0)).count() == 0


def test_words():
    assert words("<p>Chapel-\nyard's Ärger &amp; café</p>") == ["chapelyards", "arger", "cafe"]
    assert mended("cafÃ©") == "café" and mended("café") == "café" and bare("A­B") == "ab"


# --- subjects --------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(8)
    terms = {"law": "verdict statute jury bail clause plaintiff".split(), "music": "fugue sonata melody chord quartet tempo".split(), "sport": "striker stadium referee sprint goalkeeper hurdle".split()}
    frames = ["Readers praise the pages on the {} and the {}.", "Each exercise pairs one {} with one {}.", "Two appendices cover the {} and the {} there."]
    def text(subject, n):  # noqa: E306
        return " ".join(rng.choice(frames).format(*rng.sample(terms[subject], 2)) for _ in range(n))
    docs, truth = [], {}
    for i in range(400):
        s = rng.choice(list(terms))
        both = i % 10 == 0
        other = rng.choice([x for x in terms if x != s])
        body = text(s, 5) + (" " + text(other, 4) if both else ' Do not confuse it with "The ' + terms[other][0] + '" by the same press.')
        docs.append((i, body, "en"))
        truth[i] = {s, other} if both else {s}
    docs += [(900, None, ""), (901, "  ", ""), (902, "12345 !!", ""), (903, "x" * 50_000, "")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    areas = spark.createDataFrame([(s, " ".join(t[:2])) for s, t in terms.items()] + [(None, "x")], "subject string, about string")
    sample = spark.createDataFrame([(i, s) for i in range(0, 200, 2) for s in truth[i]] + [(None, "law"), (5, None)], "doc_id bigint, subject string")
    got = {}
    for r in subjects.assign(frame, areas, sample).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) == set(truth) | {902, 903} and all(1 <= len(v) <= 2 for v in got.values())
    held = [i for i in truth if i % 2 or i >= 200]
    assert sum(got[i] == truth[i] for i in held) >= 0.95 * len(held)
    seeded = subjects.assign(frame, areas, sample.limit(0))
    assert seeded.select("doc_id").distinct().count() == len(got)
    assert subjects.assign(frame.limit(0), areas, sample).count() == 0 and subjects.assign(frame, areas.limit(0), sample.limit(0)).count() == 0


def test_sparse_rows_against_dense():
    rng = np.random.default_rng(4)
    weights = rng.random(40).astype(np.float32)
    ids = [rng.integers(0, 40, rng.integers(0, 30)) for _ in range(25)] + [np.array([], dtype=int)]
    dense = np.zeros((len(ids), 40))
    for i, terms in enumerate(ids):
        term, n = np.unique(terms, return_counts=True)
        dense[i, term] = (1 + np.log(n)) * weights[term]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    rows, basis, sums = subjects.Rows(ids, weights), rng.normal(size=(40, 5)), np.zeros((40, 5))
    assert np.allclose(rows.times(basis), dense @ basis, atol=1e-5)
    rows.add_transposed(dense @ basis, sums)
    assert np.allclose(sums, dense.T @ dense @ basis, atol=1e-4)
    assert subjects.Rows([], weights).times(basis).shape == (0, 5)


def test_openings_are_those_of_all_items(spark):
    texts = ["Read this. The mill stood.", "Read this. The clock ran.", "Once only. The clock ran.", "one two", "one three", None, ""]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").filter("text is not null")
    assert leakage.repeated_openings(items) == {"Read this.", "one"}
    assert [len(b) for b in leakage.blocks(items, 2)] == [2, 2, 2] and list(leakage.blocks(items.limit(0), 2)) == [[]]

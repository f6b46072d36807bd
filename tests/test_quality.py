import random
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from bookwarp.operators import orphans
from bookwarp.operators.profile import chunk_histograms, chunk_profiles, column_profile, departures, load_histogram, load_metrics
from bookwarp.sources.chunks import dictionary_values, opened
from bookwarp.streaming import references

LINK = "id bigint, book bigint, author bigint, loaded_at timestamp, n int"


def test_orphans(spark):
    t = lambda d: D(2025, 1, d)
    links = spark.createDataFrame([(1, 10, 1, t(5), 0), (2, 11, 1, t(5), 0), (3, 99, None, t(5), 0), (2, 11, 1, t(25), 0), (4, 12, 1, t(9), 0), (None, 99, 1, t(5), 0)], LINK)
    books = spark.createDataFrame([(10, t(1), 0), (11, t(20), 0), (12, t(9), 0), (10, t(30), 0)], "id bigint, loaded_at timestamp, n int")
    authors = spark.createDataFrame([(1, t(1))], "id bigint, loaded_at timestamp")
    found = orphans.orphan_references(links, {"book": (books, "id"), "author": (authors, "id")})
    assert sorted(((r.link_id, r.ref, r.kind) for r in found.collect()), key=str) == sorted([(2, "book", "late"), (3, "book", "missing"), (None, "book", "missing")], key=str)
    assert {(r.ref, r.kind, r.period): r.n for r in orphans.orphan_report(found).collect()} == {("book", "late", "2025-01"): 1, ("book", "missing", "2025-01"): 2}
    assert orphans.orphan_references(links.limit(0), {"book": (books, "id")}).count() == 0
    assert orphans.orphan_references(links, {"book": (books.limit(0), "id")}).filter("kind = 'missing'").count() == 5
    with pytest.raises(ValueError):
        orphans.orphan_references(links, {})


def test_signed_state(spark):
    rows = [(7, 1, 0), (7, 1, 0), (8, 1, 0), (8, 0, 1), (7, -1, 0)]
    delta = lambda part: spark.createDataFrame(part, "key bigint, refs bigint, existing bigint").withColumn("ref_at", F.lit(None).cast("timestamp")).withColumn("seen_at", F.lit(None).cast("timestamp"))
    assert [r.key for r in orphans.orphan_keys(orphans.merge_state(delta(rows[:2]), delta(rows[2:]))).collect()] == [7]


EVENT = "event string, key bigint, at timestamp, refs bigint, existing bigint"


def test_stream_equals_a_recount(spark, tmp_path):
    """Random appearances, retractions and repetitions in ten batches, some run twice, against a recount of all events."""
    rng = random.Random(5)
    t = lambda k: D(2025, 1, 1, 0, k)
    made, live, batches = [], [], []
    for n in range(10):
        batch = []
        for _ in range(25):
            if live and rng.random() < 0.3:  # a row disappears, with the moment at which it had come
                key, at, refs, existing = live.pop(rng.randrange(len(live)))
                batch.append((f"e{len(made)}", key, at, -refs, -existing))
            else:
                kind = rng.random() < 0.7
                row = (rng.randrange(12), t(rng.randrange(50)), int(kind), int(not kind))
                live.append(row)
                batch.append((f"e{len(made)}", *row))
            made.append(batch[-1])
        batches.append(batch + rng.sample(made, 6) + ([(None, None, t(1), 1, 0)] if n == 3 else []))  # sent again, and a null key
    folder = str(tmp_path / "state")
    for n, batch in enumerate(batches):
        for _ in range(2 if n in (0, 4, 9) else 1):  # as after a failure
            state = references.fold(spark.createDataFrame(batch, EVENT), folder, n, parts=5)
        known = [e for e in made if e in {x for b in batches[: n + 1] for x in b}]
        if n in (0, 5, 9):
            got = {r.key: (r.refs, r.existing, r.ref_at, r.seen_at) for r in references.keys(state).collect()}
            count = lambda k, i: sum(e[i] for e in known if e[1] == k)
            def first(k, i):  # noqa: E306
                moments = sorted({e[2] for e in known if e[1] == k})
                return next((m for m in moments if sum(e[i] for e in known if e[1] == k and e[2] == m) > 0), None)
            want = {k: (count(k, 3), count(k, 4), first(k, 3), first(k, 4)) for k in {e[1] for e in known}}
            assert {k: v for k, v in want.items() if v[:2] != (0, 0) or v[2:] != (None, None)} == got
            assert {r.key for r in references.current_orphans(spark, folder, n).collect()} == {k for k, v in want.items() if v[0] > 0 and v[1] <= 0}


def test_stream_writes_touched_parts_only(spark, tmp_path):
    folder = str(tmp_path / "state")
    made = spark.range(200).select(F.col("id").cast("string").alias("event"), F.col("id").alias("key"), F.lit(D(2025, 1, 1)).alias("at"), F.lit(1).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("existing"))
    references.fold(made, folder, 0, parts=16)
    references.fold(made.filter("key = 3").withColumn("event", F.lit("gone")).withColumn("refs", F.lit(-1).cast("bigint")), folder, 1, parts=16)
    assert len(list((tmp_path / "state/state/batch=000000000001").glob("part=*"))) == 1
    assert references.current_orphans(spark, folder, 1).count() == 199
    for n in range(2, 6):
        references.fold(made.limit(0), folder, n, parts=16)
    assert references.current_orphans(spark, folder, 5).count() == 199
    assert sorted(p.name for p in (tmp_path / "state/manifest").iterdir()) == [f"batch={n:012d}" for n in (3, 4, 5)]
    assert len(list((tmp_path / "state/state/batch=000000000000").glob("part=*"))) == 15


def test_stream(spark, tmp_path):
    made = spark.createDataFrame([("a", 7, D(2025, 1, 1), 1, 0), ("b", 8, D(2025, 1, 1), 1, 0), ("c", 8, D(2025, 1, 2), 0, 1), ("a", 7, D(2025, 1, 1), 1, 0), ("d", 9, D(2025, 1, 2), 1, 0)], EVENT)
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    references.maintain(stream, str(tmp_path / "state"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert sorted((r.key, r.refs) for r in references.current_orphans(spark, str(tmp_path / "state"), 0).collect()) == [(7, 1), (9, 1)]
    links = spark.createDataFrame([(1, 7, 1, D(2025, 1, 3)), (2, None, -1, D(2025, 1, 3))], "id bigint, book bigint, s int, loaded_at timestamp")
    assert [tuple(r) for r in references.events(links, "id", "book", "loaded_at", refs=1, sign="s").collect()] == [("1", 7, D(2025, 1, 3), 1, 0)]


def _day(load, *values):
    return [(load, v) for v in values]


def test_profile(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write = lambda rows: spark.createDataFrame(rows, "load_id bigint, value string").coalesce(1).write.mode("append").parquet(path)
    # two settled files (one constant, one all null) and one that must be scanned
    write(_day(1, "2020-01-01", "2020-01-01"))
    write(_day(2, None, None))
    write(_day(3, "2020-02-30", " ", "1200-01-01 00:00:00+00:00", "2020-01-01", None) + _day(None, "x"))
    chunks = chunk_histograms(spark, {"t": path}, {"t": ["value"]}).groupBy("how").agg(F.sum("n").alias("n")).collect()
    assert {c.how: c.n for c in chunks} == {"footer": 4, "file": 6}
    h = load_histogram(spark, {"t": path}, {"t": ["value"]})
    assert {(r.load_id, r.value): r.n for r in h.collect()}[1, "2020-01-01"] == 2
    got = {(r.load_id, r.metric): round(r.value, 3) for r in load_metrics(h).collect()}
    assert got[2, "absent"] == 1 and got[3, "absent"] == 0.4 and got[3, "invalid"] == 0.333 and got[3, "out_of_range"] == 0.5 and got[3, "new_share"] == 0.667
    assert (2, "invalid") not in got and (1, "new_share") not in got
    assert sorted(r.load_id for r in departures(load_metrics(h).filter("metric = 'absent'"), 0.155).collect()) == [1, 2]
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "load_id bigint, value string").write.parquet(empty)
    assert load_metrics(load_histogram(spark, {"e": empty}, {"e": ["value", "load_id"]})).count() == 0


def test_only_insufficient_chunks_are_scanned(spark, tmp_path):
    """One file whose row groups need a footer, a dictionary page or a scan, each as little as possible."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = pa.schema([("load_id", pa.int64()), ("value", pa.string()), ("n", pa.float64()), ("when", pa.timestamp("ms"))])
    rng = random.Random(4)
    long = "x" * 500
    groups = [
        _day(1, *["a"] * 50), _day(2, *[None] * 50), _day(3, *[long, None] * 25),
        _day(4, *[rng.choice("bcd") for _ in range(50)]), _day(5, *["e"] * 25) + _day(6, *["f"] * 25),
    ]
    path = tmp_path / "t.parquet"
    reals = [0.5, float("nan"), None, -2.0]
    with pq.ParquetWriter(path, schema, write_statistics=["load_id", "value", "when"]) as writer:
        for rows in groups:
            columns = {"load_id": [r[0] for r in rows], "value": [r[1] for r in rows], "n": [reals[i % 4] for i in range(50)], "when": [1000 * r[0] for r in rows]}
            writer.write_table(pa.table(columns, schema))
    found = chunk_histograms(spark, {"t": str(path)}, {"t": ["value"]}).collect()
    assert {(r.load_id, r.how) for r in found} == {(1, "footer"), (2, "footer"), (3, "footer"), (4, "scan"), (5, "scan"), (6, "scan")}
    assert {(r.load_id, r.value): r.n for r in found if r.load_id < 4} == {(1, "a"): 50, (2, None): 50, (3, None): 25, (3, long): 25}
    pieces = chunk_profiles(spark, {"t": str(path)}).filter("rows > 0").collect()
    how = {c: sorted(r.how for r in pieces if r.col == c) for c in ("load_id", "value", "n", "when")}
    assert how == {"load_id": ["dictionary"] + ["footer"] * 4, "value": ["dictionary"] * 2 + ["footer"] * 3, "n": ["scan"] * 5, "when": ["dictionary"] + ["footer"] * 4}
    got = {r.col: r for r in column_profile(spark, {"t": str(path)}).collect()}
    assert (got["value"].rows, got["value"].nulls, got["value"].distinct_values, got["value"].low, got["value"].high) == (250, 75, 7, "a", long)
    assert (got["load_id"].distinct_values, got["load_id"].low, got["load_id"].high) == (6, "1", "6") and (got["when"].low, got["when"].high) == ("1000000", "6000000")
    assert (got["n"].nulls, got["n"].distinct_values, float(got["n"].low), float(got["n"].high)) == (60, 3, -2.0, 0.5)
    quick = {r.col: r for r in column_profile(spark, {"t": str(path)}, distinct=False).collect()}
    assert quick["load_id"].distinct_values is None and (quick["load_id"].low, quick["load_id"].high) == ("1", "6")


@pytest.mark.parametrize("options", [{"data_page_version": "1.0"}, {"data_page_version": "2.0", "compression": "zstd"}, {"use_dictionary": False}, {"dictionary_pagesize_limit": 200}, {"data_page_size": 64, "compression": "none"}])
def test_dictionary_pages(tmp_path, options):
    """The dictionary page gives exactly the values of a chunk, or nothing where some page of data went without it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = random.Random(6)
    texts = [rng.choice([None, "", "é", *map(str, range(100))]) for _ in range(3000)]
    table = pa.table({"s": texts, "i": pa.array([rng.randrange(90) for _ in texts], pa.int32()), "d": [rng.randrange(9) / 4 for _ in texts]})
    pq.write_table(table, tmp_path / "x.parquet", **options)
    with opened(f"file:{tmp_path}/x.parquet") as handle:
        group = pq.ParquetFile(handle).metadata.row_group(0)
        for k, name in enumerate(table.column_names):
            got = dictionary_values(handle, group.column(k))
            if "use_dictionary" in options or ("dictionary_pagesize_limit" in options and name != "d"):
                assert got is None
            else:
                assert sorted(got) == sorted(set(table[name].to_pylist()) - {None})


def test_profile_of_awkward_tables(spark, tmp_path):
    """Nested columns are left out; an empty table has columns without values; many files make one profile."""
    path, none = str(tmp_path / "a.parquet"), str(tmp_path / "n.parquet")
    rows = [(i, f"t{i % 7}" if i % 5 else None, [1], i % 2 == 0, D(2025, 1, 1 + i % 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, tbl string, xs array<int>, col boolean, at timestamp_ntz")
    df.repartition(5).write.parquet(path)
    df.limit(0).write.parquet(none)
    got = {(r.tbl, r.col): (r.rows, r.nulls, r.distinct_values, r.low, r.high) for r in column_profile(spark, {"a": path, "n": none}).collect()}
    micros = [int(D(2025, 1, d).timestamp()) for d in (1, 9)]
    assert got["a", "id"] == (500, 0, 500, "0", "499") and got["a", "tbl"] == (500, 100, 7, "t0", "t6") and got["a", "col"] == (500, 0, 2, "false", "true") and ("a", "xs") not in got
    assert got["a", "at"][:3] == (500, 0, 9) and int(got["a", "at"][4]) - int(got["a", "at"][3]) == (micros[1] - micros[0]) * 1_000_000
    assert all(v == (0, 0, 0, None, None) for (t, _), v in got.items() if t == "n")


def test_histogram_is_the_same_whatever_settles_a_chunk(spark, tmp_path):
    """Settled, mixed and whole files of all types against a plain count."""
    rows = [(1, "a", D(2025, 1, 1), D(2025, 1, 1).date(), True, 0.5)] * 30 + [(1 + i % 3, "ab"[i % 2], D(2025, 1, 1 + i % 2, 0, 0, 0, i % 3), D(2025, 1, 1 + i % 2).date(), i % 2 == 0, float(i % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "load_id bigint, s string, t timestamp_ntz, d date, b boolean, r double")
    path = tmp_path / "t.parquet"
    df.limit(30).coalesce(1).write.parquet(str(path))
    df.filter("load_id > 1").coalesce(1).write.mode("append").parquet(str(path))
    import pyarrow as pa
    import pyarrow.parquet as pq

    part = df.coalesce(1).toPandas()
    schema = pa.schema([("load_id", pa.int64()), ("s", pa.string()), ("t", pa.timestamp("us")), ("d", pa.date32()), ("b", pa.bool_()), ("r", pa.float64())])
    pq.write_table(pa.Table.from_pandas(part, schema, preserve_index=False), path / "mixed.parquet", row_group_size=30)
    names = ["s", "t", "d", "b", "r"]
    found = chunk_histograms(spark, {"t": str(path)}, {"t": names})
    assert {r.how for r in found.select("how").distinct().collect()} == {"footer", "scan", "file"}
    got = {(r.col, r.load_id, r.value): r.n for r in load_histogram(spark, {"t": str(path)}, {"t": names}).collect()}
    every = spark.read.parquet(str(path))
    number = {"t": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', t)", "d": "unix_date(d)"}
    want = {(c, r.load_id, r.value): r.n for c in names for r in every.groupBy("load_id", F.expr(number.get(c, c)).cast("string").alias("value")).agg(F.count("*").alias("n")).collect()}
    assert got == want

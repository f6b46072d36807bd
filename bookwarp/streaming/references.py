"""The orphan report kept current by a stream of changes.

The state is a table of keys, split by a hash of the key into a fixed number of parts.  A micro-batch writes anew only the
parts that its keys fall into, under its own number, and then a manifest that says for every part which batch wrote it last.
The manifest of a batch is written after its parts, so a batch that runs again after a failure starts from the manifest
before it and gives the same state.  Keys whose counts are all zero are dropped; parts that no recent manifest names are
removed.

Changes are events: an event sent again has the id of the first one and counts once.  A part keeps the ids of its events for
``keep`` batches, which bounds how late a repetition may come.  Arrival times are kept as signed counts per moment, so a
retracted first reference gives way to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PARTS = 64
KEEP_MANIFESTS = 3
#: What a part holds: signed counts of references and records by key and moment, and the ids of recent events.
STATE = "part int, key bigint, at timestamp, refs bigint, existing bigint, event string, batch bigint"
MANIFEST = "part int, written bigint"


def _folder(folder: str, kind: str, batch: int) -> str:
    return f"{folder}/{kind}/batch={batch:012d}"


def events(rows: DataFrame, event: str, key: str, at: str, refs: int = 0, existing: int = 0, sign: str | None = None) -> DataFrame:
    """Events (event, key, at, refs, existing) of rows; ``sign`` names a column that is negative for rows that disappear."""
    amount = F.signum(F.col(sign)).cast("bigint") if sign else F.lit(1).cast("bigint")
    out = rows.select(F.col(event).cast("string").alias("event"), F.col(key).cast("bigint").alias("key"), F.col(at).cast("timestamp").alias("at"), (amount * refs).alias("refs"), (amount * existing).alias("existing"))
    return out.filter("key is not null")


def _manifest(spark: SparkSession, folder: str, batch: int) -> dict[int, int]:
    """For every part the batch that wrote it last; at most as many entries as parts."""
    if batch < 0:
        return {}
    return {r.part: r.written for r in spark.read.schema(MANIFEST).parquet(_folder(folder, "manifest", batch)).collect()}


def _read(spark: SparkSession, folder: str, manifest: dict[int, int], parts: set[int] | None = None) -> DataFrame:
    """The state of some parts, or of all."""
    wanted: dict[int, list[int]] = {}
    for part, batch in manifest.items():
        if parts is None or part in parts:
            wanted.setdefault(batch, []).append(part)
    places = [f"{_folder(folder, 'state', b)}/part={p}" for b, ps in sorted(wanted.items()) for p in sorted(ps)]
    return spark.read.schema(STATE).option("basePath", folder).parquet(*places).select(*[c.split()[0] for c in STATE.split(", ")]) if places else spark.createDataFrame([], STATE)


def fold(changes: DataFrame, folder: str, batch: int, keep: int = 100, parts: int = PARTS) -> DataFrame:
    """Folds a batch of events into the state and returns it; parts without a key of the batch are neither read nor written.

    Batches are numbered from 0 without gaps.  Null keys refer to nothing; an event without an id is never a repetition; a
    null moment is a moment of its own.
    """
    spark = changes.sparkSession
    manifest = _manifest(spark, folder, batch - 1)
    fresh = changes.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), "key", "at", "refs", "existing", "event", F.lit(batch).cast("bigint").alias("batch")).filter("key is not null")
    touched = {r.part for r in fresh.select("part").distinct().collect()}  # at most ``parts``
    before = _read(spark, folder, manifest, touched)
    seen = before.filter("event is not null").select("event", "key").distinct()
    named = fresh.filter("event is not null").groupBy("part", "key", "event", "batch").agg(F.min(F.struct("at", "refs", "existing")).alias("e")).select("part", "key", "e.at", "e.refs", "e.existing", "event", "batch")
    new = named.join(seen, ["event", "key"], "left_anti").select(*before.columns).unionByName(fresh.filter("event is null"))
    counts = before.filter("event is null").unionByName(new).groupBy("part", "key", "at").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")).filter("refs <> 0 or existing <> 0")
    counts = counts.withColumns({"event": F.lit(None).cast("string"), "batch": F.lit(batch).cast("bigint")})
    known = before.filter(F.col("event").isNotNull() & (F.col("batch") > batch - keep)).unionByName(new.filter("event is not null"))
    after = counts.unionByName(known.withColumns({"refs": F.lit(0).cast("bigint"), "existing": F.lit(0).cast("bigint")}))
    after.repartition("part").write.mode("overwrite").partitionBy("part").parquet(_folder(folder, "state", batch))
    left = {int(p.split("=")[1]) for p in _children(spark, _folder(folder, "state", batch)) if p.startswith("part=")}
    manifest = {p: b for p, b in manifest.items() if p not in touched} | dict.fromkeys(left, batch)
    spark.createDataFrame(sorted(manifest.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(_folder(folder, "manifest", batch))
    _sweep(spark, folder, batch)
    return _read(spark, folder, manifest)


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _children(spark: SparkSession, folder: str) -> list[str]:
    system, path = _files(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def _sweep(spark: SparkSession, folder: str, batch: int) -> None:
    """Removes manifests but the last ones and the parts that none of those names."""
    numbers = sorted(int(n.split("=")[1]) for n in _children(spark, f"{folder}/manifest") if n.startswith("batch="))
    kept = [n for n in numbers if batch - KEEP_MANIFESTS < n <= batch]
    used = {(b, p) for n in kept for p, b in _manifest(spark, folder, n).items()}
    for n in numbers:
        if n <= batch - KEEP_MANIFESTS:
            system, path = _files(spark, _folder(folder, "manifest", n))
            system.delete(path, True)
    for name in _children(spark, f"{folder}/state"):
        b = int(name.split("=")[1])
        parts = [int(p.split("=")[1]) for p in _children(spark, f"{folder}/state/{name}") if p.startswith("part=")]
        stale = [p for p in parts if (b, p) not in used]
        if b <= batch and stale:
            for place in [name] if len(stale) == len(parts) else [f"{name}/part={p}" for p in stale]:
                system, path = _files(spark, f"{folder}/state/{place}")
                system.delete(path, True)


def keys(state: DataFrame) -> DataFrame:
    """(key, refs, existing, ref_at, seen_at): counts and the first moments that still count."""
    return (
        state.filter("event is null").groupBy("key")
        .agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"), F.min(F.when(F.col("refs") > 0, F.col("at"))).alias("ref_at"), F.min(F.when(F.col("existing") > 0, F.col("at"))).alias("seen_at"))
    )


def maintain(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts folding a stream of events into the state under ``folder``."""
    return changes.writeStream.foreachBatch(lambda df, n: fold(df, folder, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_orphans(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """Keys that are referred to and don't exist after a batch."""
    return keys(_read(spark, folder, _manifest(spark, folder, batch))).filter("refs > 0 and existing <= 0")

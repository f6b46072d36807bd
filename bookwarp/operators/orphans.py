"""References to records that do not exist, kept as signed counts per key.

Every change is a delta: a reference appearing or disappearing counts +1 or -1 in ``refs``, a record appearing or
disappearing counts +1 or -1 in ``existing``.  Deltas are summed per key (map-side first, so a key that holds a third of
all references costs one row per task), and the current orphans are the keys with positive references and no existence.
State and new deltas have the same shape, so a state is carried forward by ``merge_state`` without rereading history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_deltas(links: DataFrame, key: str, at: str, sign: str | None = None) -> DataFrame:
    """Deltas (key, refs, existing, ref_at, seen_at) of referencing rows; null keys refer to nothing."""
    amount = F.col(sign).cast("bigint") if sign else F.lit(1).cast("bigint")
    rows = links.select(F.col(key).alias("key"), amount.alias("refs"), F.lit(0).cast("bigint").alias("existing"), F.col(at).alias("ref_at"))
    return rows.filter("key is not null").withColumn("seen_at", F.lit(None).cast(dict(rows.dtypes)["ref_at"]))


def existence_deltas(records: DataFrame, key: str, at: str, sign: str | None = None) -> DataFrame:
    """Deltas of the referenced table's own rows."""
    amount = F.col(sign).cast("bigint") if sign else F.lit(1).cast("bigint")
    rows = records.select(F.col(key).alias("key"), F.lit(0).cast("bigint").alias("refs"), amount.alias("existing"), F.col(at).alias("seen_at"))
    return rows.filter("key is not null").select("key", "refs", "existing", F.lit(None).cast(dict(rows.dtypes)["seen_at"]).alias("ref_at"), "seen_at")


def merge_state(*deltas: DataFrame) -> DataFrame:
    """Sums deltas and earlier states per key; ref_at and seen_at are the first arrivals."""
    every = deltas[0]
    for more in deltas[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"), F.min("ref_at").alias("ref_at"), F.min("seen_at").alias("seen_at"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.filter("refs > 0 and existing <= 0")


def orphan_references(links: DataFrame, targets: dict[str, tuple[DataFrame, str]], link_id: str = "id", at: str = "loaded_at") -> DataFrame:
    """(link_id, ref, kind, at): each reference that is `missing` or arrived before its record (`late`).

    ``targets`` maps a column of ``links`` to the table it refers to and that table's key.  A link row sent again is one
    row, which arrived when it first did.  Rows with a null key refer to nothing and are not reported; a null link id is
    an id of its own.  Empty links give no rows; an empty target makes every reference missing.  Only the named columns
    are read.
    """
    found = None
    for ref, (target, key) in targets.items():
        rows = links.filter(F.col(ref).isNotNull()).groupBy(F.col(link_id).alias("link_id"), F.col(ref).alias("key")).agg(F.min(at).alias("at"))
        state = merge_state(reference_deltas(links.select(ref, at), ref, at), existence_deltas(target.select(key, at), key, at))
        bad = state.filter("refs > 0 and (existing <= 0 or seen_at > ref_at)").select("key", "existing", "seen_at")
        hits = rows.join(bad, "key").filter("existing <= 0 or seen_at > at")
        hits = hits.select("link_id", F.lit(ref).alias("ref"), F.when(F.col("existing") <= 0, "missing").otherwise("late").alias("kind"), "at")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("no referenced tables given")
    return found


def orphan_report(references: DataFrame) -> DataFrame:
    """(ref, kind, period, n): orphan references by field and month of arrival."""
    return references.groupBy("ref", "kind", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"))

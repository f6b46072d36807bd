"""Filling containers of fixed capacity with documents: sum-of-squares packing.

Sizes are counted in tokens of a public tokenizer, whose vocabulary file is a parameter.  A document longer than the
capacity is cut into full pieces, which fill a container each, and a rest; everything else stays whole.  The rests and
the whole documents are dealt out to shards by hash and packed there one by one: each goes into the open container, or a
new one, after which the sum over all gaps of the squared number of open containers with that gap is smallest.  A shard
has a bounded number of items.  Containers that a shard leaves with a gap of more than ``LOOSE`` of the capacity are
items of the next round, in which containers of different shards are joined, until one shard holds all that is left or a
round leaves hardly fewer loose containers than the one before.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookwarp.llm.words import spread
from bookwarp.stage import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD = 20_000
LOOSE = 0.02
#: Rounds end when the loose containers of a round are less than so much fewer than those of the round before.
LESS = 0.05
#: Capacities that one projection puts beside every document.
TARGETS = 100
#: Targets up to which a table with one row for each is broadcast.
MANY = 100_000


def token_counts(documents: DataFrame, vocabulary: str = TOKENIZER) -> DataFrame:
    """(doc_id, n): length of each text in tokens; null texts are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(coder.encode_ordinary(t)) for t in batch["text"]]}).astype({"n": "int64"})

    return spread(documents.select("doc_id", "text").filter("doc_id is not null and text is not null")).mapInPandas(count, "doc_id bigint, n bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item, in the order given; every size is between 1 and the capacity."""
    open_by_gap: dict[int, list[int]] = {}
    n = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; a full one (gap 0) is closed and not counted
    out = np.empty(len(sizes), dtype=np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        have = n[size:]
        # the change of the sum of squares, if the item goes where the gap is g (g = size, size + 1, ...)
        change = 2 * (n[: capacity + 1 - size] - have) + 2
        change[0] = 1 - 2 * have[0]
        fresh = 2 * n[capacity - size] + 1 if size < capacity else 0
        change[have == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if change[best] <= fresh:
            gap = best + size
            container = open_by_gap[gap].pop()
            n[gap] -= 1
        else:
            gap, container = capacity, made
            made += 1
        rest = gap - size
        if rest:
            n[rest] += 1
            open_by_gap.setdefault(rest, []).append(container)
        out[i] = container
    return out


def _pack_round(items: DataFrame, number: int, shards: DataFrame, few: bool) -> DataFrame:
    """Items (target_id, capacity_tokens, item, size) with their container of this round and its fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "item"], kind="stable")
        local = sum_of_squares(pdf["size"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        fill = np.bincount(local, weights=pdf["size"])
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({"target_id": pdf["target_id"], "capacity_tokens": pdf["capacity_tokens"], "item": pdf["item"], "container": [f"r{number}-{shard}-{c}" for c in local], "fill": fill[local].astype(np.int64)})

    order = F.xxhash64("item", F.lit(number))
    dealt = items.join(F.broadcast(shards) if few else shards, "target_id").withColumn("order", order).withColumn("shard", F.pmod("order", "shards"))  # one row per target
    return dealt.groupBy("target_id", "shard").applyInPandas(pack, "target_id bigint, capacity_tokens bigint, item string, container string, fill bigint")


def _shards(items: DataFrame) -> DataFrame:
    return items.groupBy("target_id").agg(F.ceil(F.count("*") / SHARD).alias("shards"))


def pack(documents: DataFrame, targets: DataFrame, vocabulary: str = TOKENIZER) -> DataFrame:
    """(target_id, container_id, doc_id, piece, tokens): for each capacity every token of every text in one container.

    Null and empty texts have no tokens and no row.  Targets whose id or capacity is null or below 1 are ignored, a
    target given twice counts once (the greater capacity).  ``doc_id`` must be unique; further columns are ignored.
    """
    wanted = targets.filter("target_id is not null and capacity_tokens >= 1").groupBy("target_id").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    counts = cut(token_counts(documents, vocabulary).filter("n > 0"))
    # every target against all documents is the statement of the problem; targets are literals, a bounded number at a time
    known = [(r.target_id, r.capacity_tokens) for r in wanted.orderBy("target_id").toLocalIterator()]
    each = None
    for low in range(0, max(1, len(known)), TARGETS):
        beside = F.array(*[F.struct(F.lit(t).cast("bigint").alias("target_id"), F.lit(c).cast("bigint").alias("capacity_tokens")) for t, c in known[low : low + TARGETS]])
        part = counts.select("doc_id", "n", F.explode(beside).alias("_t")).select("doc_id", "n", "_t.*") if known else counts.select("doc_id", "n", F.lit(0).cast("bigint").alias("target_id"), F.lit(1).cast("bigint").alias("capacity_tokens")).limit(0)
        each = part if each is None else each.unionByName(part)
    each = each.withColumn("full", F.floor(F.col("n") / F.col("capacity_tokens"))).withColumn("rest", F.col("n") % F.col("capacity_tokens"))
    full = each.filter("full > 0").select("target_id", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"), F.col("capacity_tokens").alias("tokens"))
    full = full.select("target_id", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container_id"), "doc_id", F.col("piece").cast("int").alias("piece"), "tokens")
    rests = cut(each.filter("rest > 0").select("target_id", "capacity_tokens", "doc_id", F.col("full").cast("int").alias("piece"), F.col("rest").alias("tokens"), F.col("doc_id").cast("string").alias("item")))
    items = rests.select("target_id", "capacity_tokens", "item", F.col("tokens").alias("size"))
    placed = rests.select("target_id", "doc_id", "piece", "tokens", F.col("item").alias("container"))
    settled, before, number = None, None, 0
    while True:
        number += 1
        shards = cut(_shards(items))
        most = shards.agg(F.max("shards")).first()[0]
        if most is None:
            break
        packed = cut(_pack_round(items, number, shards, len(known) <= MANY))
        placed = placed.join(packed.select("target_id", F.col("item").alias("container"), F.col("container").alias("into"), "fill", "capacity_tokens"), ["target_id", "container"])
        placed = cut(placed.select("target_id", "doc_id", "piece", "tokens", F.col("into").alias("container"), "fill", "capacity_tokens"))
        loose_now = packed.filter((F.col("capacity_tokens") - F.col("fill")) > LOOSE * F.col("capacity_tokens")).select("target_id", "container").distinct().count()
        last = most <= 1 or not loose_now or (before is not None and loose_now > (1 - LESS) * before)
        before = loose_now
        loose = F.lit(False) if last else (F.col("capacity_tokens") - F.col("fill")) > LOOSE * F.col("capacity_tokens")
        done = placed.filter(~loose).select("target_id", F.col("container").alias("container_id"), "doc_id", "piece", "tokens")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        items = packed.select("target_id", "capacity_tokens", F.col("container").alias("item"), F.col("fill").alias("size")).filter((F.col("capacity_tokens") - F.col("size")) > LOOSE * F.col("capacity_tokens")).distinct()
        placed = placed.filter(loose).select("target_id", "doc_id", "piece", "tokens", "container")
    return full if settled is None else full.unionByName(settled)


def fill_report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, containers, tokens, fill): how full the containers of each capacity are."""
    per = packed.groupBy("target_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    return per.join(F.broadcast(targets.select("target_id", "capacity_tokens").distinct()), "target_id").select("target_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))

"""Consolidating pairwise matches into groups: connected components by graph reduction.

The graph is reduced until no edge is left and the removed vertices get their label back afterwards:

1. vertices of degree one are stripped, again while that removes half of the edges;
2. chains of vertices of degree two are compressed: both ends of every chain are found by list ranking (pointer jumping
   over directed arcs, so a chain of n vertices takes log2 n rounds) and one edge replaces the chain.  Arcs that run in
   rings never end; where nothing but rings is left, a vertex smaller than both its neighbours stays, which breaks them;
3. the rest, the core, is solved by hooking every vertex on its smallest neighbour, jumping to the roots and
   contracting, until no edge is left;
4. every removed vertex points at a vertex removed later or at a root; jumping along these pointers restores the labels
   in log2 of the number of steps, and the smallest id of each root is the label.

No step groups a component into one task: all work is equi-joins and aggregations on vertex ids, in which a hub that
holds a third of all edges is combined before the shuffle or split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bookwarp.stage import cut

#: Stripping goes on while it removes at least this share of the edges; else chains are compressed.
STRIP_SHARE = 0.5
#: Rounds after which the driver collects garbage: what earlier rounds left in memory, checkpoints and shuffle files goes
#: only when their last reference is collected, and the driver has no other reason to do so between many small jobs.
COLLECT = 6
_ROUNDS = [0]


def _cut(df: DataFrame, **counts: str) -> tuple[DataFrame, dict[str, int]]:
    """Materialises and counts the rows that fulfil each condition on the way."""
    seen = Observation()
    done = cut(df.observe(seen, *[F.count(F.when(F.expr(c), 1)).alias(k) for k, c in counts.items()]))
    _ROUNDS[0] += 1
    if _ROUNDS[0] % COLLECT == 0:
        df.sparkSession.sparkContext._jvm.System.gc()
    return done, seen.get


def _both(edges: DataFrame) -> DataFrame:
    """Directed copies of undirected edges: (kind, v, w)."""
    pair = F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("w")), F.struct(F.col("w").alias("v"), F.col("u").alias("w"))))
    return edges.select("kind", pair.alias("_p")).select("kind", "_p.v", "_p.w")


def _simple(edges: DataFrame) -> DataFrame:
    """Undirected edges (kind, u, w) with u < w, once each."""
    return edges.filter(F.col("u") != F.col("w")).select("kind", F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()


def _relabel(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges with their ends replaced by ``moved`` (kind, v, parent)."""
    a = moved.select("kind", F.col("v").alias("u"), F.col("parent").alias("_u"))
    b = moved.select("kind", F.col("v").alias("w"), F.col("parent").alias("_w"))
    out = edges.join(a.hint("merge"), ["u", "kind"], "left").join(b.hint("merge"), ["w", "kind"], "left")
    return _simple(out.select("kind", F.coalesce("_u", "u").alias("u"), F.coalesce("_w", "w").alias("w")))


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(removed, left, counts): vertices of degree one with their only neighbour; of an isolated edge only the larger end."""
    degrees = _both(edges).groupBy("kind", "v").agg(F.count("*").alias("n"))
    a, b = (degrees.select("kind", F.col("v").alias(x), F.col("n").alias("d" + x)) for x in "uw")
    known, n = _cut(edges.join(a.hint("merge"), ["u", "kind"]).join(b.hint("merge"), ["w", "kind"]), edges="true", leaves="du = 1 or dw = 1")
    end = F.when(F.col("dw") == 1, F.struct(F.col("w").alias("v"), F.col("u").alias("parent"))).otherwise(F.struct(F.col("u").alias("v"), F.col("w").alias("parent")))
    removed = known.filter("du = 1 or dw = 1").select("kind", end.alias("_e")).select("kind", "_e.v", "_e.parent")
    return removed, known.filter("du > 1 and dw > 1").select("kind", "u", "w"), n


def _jump(arcs: DataFrame) -> DataFrame:
    """Every arc that has a next one takes that one's end and next."""
    ahead = arcs.select("kind", F.col("v").alias("at"), F.col("side").alias("next_side"), F.col("at").alias("_at"), F.col("next_side").alias("_next"), F.lit(True).alias("_hit"))
    hit = arcs.join(ahead.hint("merge"), ["at", "next_side", "kind"], "left")
    return hit.select("kind", "v", "side", F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("at")).alias("at"), F.when(F.col("_hit"), F.col("_next")).alias("next_side"))


def _chains(edges: DataFrame, rings: bool) -> tuple[DataFrame, DataFrame, int] | None:
    """(removed, edges, number of edges): chain vertices with one end of their chain, and what replaces the chains."""
    ends = _both(edges).groupBy("kind", "v").agg(F.count("*").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    inner, n = _cut(ends.filter("n = 2 and not (v < lo and v < hi)" if rings else "n = 2").select("kind", "v", "lo", "hi"), all="true")
    if not n["all"]:
        return None
    # The arc (v, side) leads from chain vertex v to `at`; its next arc leaves `at` on the side that isn't towards v.
    towards = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("side"), F.col("hi").alias("at"))))
    arcs = inner.select("kind", "v", towards.alias("_a")).select("kind", "v", "_a.side", "_a.at")
    sides = inner.select("kind", F.col("v").alias("at"), F.col("lo").alias("_lo"))
    arcs = arcs.join(sides.hint("merge"), ["at", "kind"], "left").select("kind", "v", "side", "at", F.when(F.col("_lo") == F.col("v"), 1).when(F.col("_lo").isNotNull(), 0).alias("next_side"))
    before, left = -1, -2
    while left != 0 and left != before:  # while there are chains, each round ends some arcs; arcs in rings stay
        before = left
        arcs, n = _cut(_jump(_jump(arcs)) if before >= 0 else _jump(arcs), left="next_side is not null")
        left = n["left"]
    ranked = arcs.filter("next_side is null").groupBy("kind", "v").agg(F.min("at").alias("parent"), F.max("at").alias("other"), F.count("*").alias("n")).filter("n = 2")
    ranked, n = _cut(ranked.select("kind", "v", "parent", "other"), all="true")
    if not n["all"]:
        return None
    gone = ranked.select("kind", F.col("v").alias("u"))
    kept = edges.join(gone.hint("merge"), ["u", "kind"], "left_anti").join(gone.withColumnRenamed("u", "w").hint("merge"), ["w", "kind"], "left_anti")
    short = ranked.select("kind", F.col("parent").alias("u"), F.col("other").alias("w"))
    after, n = _cut(_simple(kept.select("kind", "u", "w").unionByName(short)), all="true")
    return ranked.select("kind", "v", "parent"), after, n["all"]


def _hook(edges: DataFrame) -> DataFrame:
    """Every vertex of the core that isn't a root, with the root of its tree of smallest neighbours."""
    tree = _both(edges).groupBy("kind", "v").agg(F.min("w").alias("m")).select("kind", "v", F.least("m", "v").alias("parent"), F.lit(True).alias("moved"))
    left = 1
    while left:
        up = tree.select("kind", F.col("v").alias("parent"), F.col("parent").alias("_up"))
        tree, n = _cut(tree.join(up.hint("merge"), ["parent", "kind"]).select("kind", "v", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")), left="moved")
        left = n["left"]
    return tree.filter("v <> parent").select("kind", "v", "parent")


def connected_groups(pairs: DataFrame, kind: str = "kind", a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(kind, record_id, group_id): group_id is the smallest id linked to the record directly or indirectly.

    Columns other than the three named are ignored, whatever their names.  Pairs in both directions, repeated pairs and
    self pairs are allowed; a pair with one null id still names the other record, a pair of two nulls names none.  A null
    kind is a kind of its own.  An empty input gives an empty result.
    """
    named = pairs.select(F.coalesce(F.concat(F.lit("="), F.col(kind)), F.lit("-")).alias("kind"), F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    named, n = _cut(named.select("kind", F.coalesce(F.least("a", "b"), "a", "b").alias("u"), F.coalesce(F.greatest("a", "b"), "b", "a").alias("w")).filter("u is not null").distinct(), edges="u <> w")
    edges, count = named.filter("u <> w"), n["edges"]
    removed: list[DataFrame] = []
    while count:
        leaves, edges, n = _strip(edges)
        if n["leaves"]:
            removed.append(leaves)
            count = n["edges"] - n["leaves"]
            if not count or n["leaves"] >= STRIP_SHARE * n["edges"]:
                continue
        reduced = _chains(edges, rings=False) or _chains(edges, rings=True)
        if reduced is None:
            hooked = _hook(edges)
            reduced = hooked, *(lambda e, c: (e, c["all"]))(*_cut(_relabel(edges, hooked), all="true"))
        removed.append(reduced[0])
        edges, count = reduced[1:]
    vertices = named.select("kind", F.explode(F.array("u", "w")).alias("v")).distinct()
    return _restore(vertices, removed)


def _restore(vertices: DataFrame, removed: list[DataFrame]) -> DataFrame:
    """Labels of all vertices from the pointers of the removed ones."""
    if not removed:
        return vertices.select(_kind(), F.col("v").alias("record_id"), F.col("v").alias("group_id"))
    pointers = removed[0]
    for more in removed[1:]:
        pointers = pointers.unionByName(more)
    pointers = cut(pointers)
    for _ in range((len(removed) - 1).bit_length()):
        up = pointers.select("kind", F.col("v").alias("parent"), F.col("parent").alias("_up"))
        pointers = cut(pointers.join(up.hint("merge"), ["parent", "kind"], "left").select("kind", "v", F.coalesce("_up", "parent").alias("parent")))
    rooted = vertices.join(pointers.hint("merge"), ["v", "kind"], "left").select("kind", "v", F.coalesce("parent", "v").alias("root"))
    least = rooted.groupBy("kind", "root").agg(F.min("v").alias("label"))
    return rooted.join(least.hint("merge"), ["root", "kind"]).select(_kind(), F.col("v").alias("record_id"), F.col("label").alias("group_id"))


def _kind() -> F.Column:
    return F.when(F.col("kind") == "-", None).otherwise(F.substring("kind", 2, 1 << 30)).alias("kind")

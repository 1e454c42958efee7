"""Pairwise matches to groups by low-diameter decomposition.

Each level: every vertex draws an exponential shift from a hash of its id; clusters grow hop by hop from the vertices
with the earliest start times; each cluster becomes one super-vertex; the next level works on the edges between
clusters only. The assignments of all levels are composed at the end. A level shuffles the edges a fixed number of
times and keeps a small fraction of them, so the total is a small multiple of the first level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.runtime import broadcast_if_small, clean_key, discard, read, stand_in, stash

#: Rate of the exponential shifts: adjacent vertices fall into one cluster with probability exp(-RATE), if the hops allow.
RATE = 0.05
#: Hops that a cluster may grow in one level: the radius is bounded by it, not by the shifts; what it cuts off is joined in later levels.
HOPS = 3
#: A level keeps a small part of the edges; this many levels are never needed.
MAX_LEVELS = 60


def links_from_keys(rows: DataFrame, member: str, key: str) -> DataFrame:
    """Pairs (src, dst) that link all members with one key to the smallest of them; nulls link nothing.

    Star pairs: a key with n members gives n - 1 pairs. The smallest member is found with map-side combining, and the
    join back on the key is left to AQE, which splits a hot key's rows.
    """
    rows = rows.select(F.col(member).alias("src"), F.col(key).alias("k")).where("src is not null and k is not null")
    hubs = rows.groupBy("k").agg(F.min("src").alias("dst"), F.max("src").alias("last")).where("dst < last").select("k", "dst")
    return rows.join(hubs, "k").where("src <> dst").select("src", "dst")


def _shift(vertex: Column, level: int, seed: int) -> Column:
    """Exponential with rate RATE, by a hash of the vertex: the same in every task and retry."""
    uniform = (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(seed), F.lit(level)), 11) + 0.5) / float(1 << 53)
    return -F.log(uniform) / RATE


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _decompose(edges: DataFrame, level: int, seed: int) -> DataFrame:
    """(v, c): the cluster's centre of each vertex of edges (a, b); v <> c rows and centres alike.

    t is the time at which a cluster reaches a vertex: hops less the centre's shift. Plain numbers in the aggregation
    buffers keep it a hash aggregation. Of equal times either centre will do: both are in the vertex's component.
    """
    both = _both(edges)
    earliest = [F.min("t").alias("t"), F.min_by("c", "t").alias("c")]
    first = both.select("v", F.col("u").alias("c"), (1 - _shift(F.col("u"), level, seed)).alias("t")).groupBy("v").agg(*earliest)
    own = first.withColumn("own", -_shift(F.col("v"), level, seed))
    state = own.select("v", F.least("t", "own").alias("t"), F.when(F.col("t") < F.col("own"), F.col("c")).otherwise(F.col("v")).alias("c"))
    for _ in range(HOPS - 1):
        arrived = both.join(state.withColumnRenamed("v", "u"), "u").select("v", (F.col("t") + 1).alias("t"), "c")
        state = state.unionByName(arrived).groupBy("v").agg(*earliest)
    return state.select("v", "c")


def _contract(edges: DataFrame, centre: DataFrame) -> DataFrame:
    at = lambda x: centre.select(F.col("v").alias(x), F.col("c").alias(f"c{x}"))
    crossing = edges.join(at("a"), "a").join(at("b"), "b").where("ca <> cb")
    return crossing.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def _hash(c: Column, seed: int) -> Column:
    return F.xxhash64(c, F.lit(seed))


def _number(pairs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The pairs as 64-bit vertices (a, b), and the vertices with their ids (id, v).

    A vertex is the hash of its id. Ids whose hash another id has too (about n * n / 2**65 of n) are hashed anew with
    further seeds until all differ; only these few are joined to the pairs.
    """
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id")))
    nodes, moved = stash(ends.distinct().select("id", _hash(F.col("id"), seed).alias("v")), "nodes"), None
    for attempt in range(1, MAX_LEVELS):
        shared = nodes.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v")
        if shared.isEmpty():
            break
        among = nodes.join(broadcast_if_small(stash(shared, "shared")), "v")
        kept = among.groupBy("v").agg(F.min("id").alias("kept"))
        again = stash(among.join(kept, "v").where("id <> kept").select("id", _hash(F.col("id"), seed + attempt).alias("w")), "again")
        ids = again.select("id") if moved is None else moved.select("id").unionByName(again.select("id")).distinct()
        nodes = stash(nodes.join(broadcast_if_small(again), "id", "left").select("id", F.coalesce("w", "v").alias("v")), "nodes")
        moved = stash(nodes.join(broadcast_if_small(ids), "id"), "moved")
    else:
        raise RuntimeError("ids without a number of their own are left")
    vertices = pairs.select("src", "dst", _hash(F.col("src"), seed).alias("x"), _hash(F.col("dst"), seed).alias("y"))
    if moved is not None:
        for end, v in (("src", "x"), ("dst", "y")):
            other = broadcast_if_small(moved).select(F.col("id").alias(end), F.col("v").alias("w"))
            vertices = vertices.join(other, end, "left").withColumn(v, F.coalesce("w", v)).drop("w")
    return vertices.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), nodes


def group_pairs(pairs: DataFrame, src: str = "src", dst: str = "dst", seed: int = 17) -> DataFrame:
    """(id, group_id) for every id in pairs: group_id is the smallest id connected with it, directly or not.

    Nulls: a pair with a null end is no pair. A pair of equal ends gives that id a group of its own. Repeated pairs and
    order change nothing. No pairs: no rows. Other columns of pairs are not used. Ids of any orderable type.
    """
    pairs = stash(pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null"), "pairs")
    edges, nodes = _number(pairs, seed)
    edges = stash(edges, "edges")
    discard(pairs)
    maps: list[DataFrame] = []
    for level in range(MAX_LEVELS):
        if edges.isEmpty():
            break
        maps.append(stash(_decompose(edges, level, seed), "centres"))
        crossing = stash(_contract(edges, maps[-1]), "edges")
        discard(edges)
        edges = crossing
    else:
        raise RuntimeError(f"edges left after {MAX_LEVELS} levels")
    if not maps:
        return nodes.select("id", F.col("id").alias("group_id"))
    label = maps[-1]
    for lower in reversed(maps[:-1]):
        upper = label.select(F.col("v").alias("c"), F.col("c").alias("top"))
        label = lower.join(upper, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    labelled = nodes.join(label, "v", "left").select("id", F.coalesce("c", "v").alias("c"))
    smallest = labelled.groupBy("c").agg(F.min("id").alias("group_id"))
    return labelled.join(smallest, "c").select("id", "group_id")


def firm_links(alias: DataFrame) -> DataFrame:
    """Firms that share an identity atom; stand-ins link nothing, cik ignores leading zeros."""
    value = clean_key(F.col("atom_value"))
    kind = F.col("atom_type")
    value = F.when(kind == "cik", F.regexp_replace(value, "^0+(?=.)", "")).otherwise(value)
    keyed = alias.where(~stand_in(clean_key(F.col("atom_value")))).select("firm_id", F.concat(kind, F.lit(":"), value).alias("k"))
    return links_from_keys(keyed, "firm_id", "k")


def event_links(events: DataFrame, details: DataFrame) -> DataFrame:
    """M&A events that share a deal id or a cluster hint."""
    ma = events.where(F.col("event_type").startswith("M&A")).select("event_id", "deal_id")
    deal = ma.select("event_id", clean_key(F.col("deal_id")).alias("x")).where(~stand_in(F.col("x"))).select("event_id", F.concat(F.lit("d:"), "x").alias("k"))
    hint = details.select("event_id", clean_key(F.col("cluster_key_hint")).alias("x")).where(~stand_in(F.col("x"))).select("event_id", F.concat(F.lit("h:"), "x").alias("k"))
    hint = hint.join(ma.select("event_id").distinct(), "event_id", "left_semi")
    return links_from_keys(deal.unionByName(hint), "event_id", "k")


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    firm = firm_links(read(spark, base, "firm_alias")).select(F.concat(F.lit("f"), "src").alias("src"), F.concat(F.lit("f"), "dst").alias("dst"))
    event = event_links(read(spark, base, "corp_events"), read(spark, base, "ma_details")).select(F.concat(F.lit("e"), "src").alias("src"), F.concat(F.lit("e"), "dst").alias("dst"))
    groups = group_pairs(firm.unionByName(event)).where("id <> group_id")
    kind = F.when(F.col("id").startswith("f"), "firm").otherwise("event")
    return groups.select(kind.alias("node_kind"), F.expr("substr(group_id, 2)").alias("group_id"), F.expr("substr(id, 2)").alias("member_id"))

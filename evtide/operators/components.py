"""Connected components by alternating large and small stars, and the canonicalisation steps built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtide.runtime import discard, stash

MAX_ROUNDS = 60


def hub_edges(rows: DataFrame, member: str, key: str) -> DataFrame:
    """(a, b): each member of a key linked to the smallest one; a shared-key graph with n - 1 edges per key."""
    rows = rows.select(F.col(member).alias("a"), F.col(key).alias("k")).where("a is not null and k is not null")
    hubs = rows.groupBy("k").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("b < last").drop("last")
    return rows.join(hubs, "k").where("a <> b").select("a", "b").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link larger neighbours (large) or smaller ones and the vertex itself (small) to the smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, root): root is the smallest id of the component of id.

    edges: (a, b), any order, repeats and loops allowed, rows with a null ignored. nodes: (id), optional further ids.
    """
    edges = edges.select("a", "b").where("a is not null or b is not null")
    ids = lambda e: e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id")))
    first = stash(edges.distinct(), "cc")  # the ids come from here too: the plan of edges runs once
    work, before = first.where("a is not null and b is not null and a <> b"), None
    for _ in range(MAX_ROUNDS):
        large = stash(_star(work, large=True), "cc")
        small = stash(_star(large, large=False), "cc")
        discard(large, work)
        work = small
        now = work.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    known = ids(first)
    if nodes is not None:
        known = known.unionByName(nodes.select("id"))
    return known.where("id is not null").distinct().join(work.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


#: Identity atoms of a company in the order in which they identify it.
ATOM_ORDER = ("ticker", "cik", "lei", "normalized_name")


def atom(kind: Column, value: Column) -> Column:
    """An identity atom as one string: tickers in upper case, names in lower case, others trimmed; null for blanks."""
    text = F.trim(value)
    cased = F.when(kind == "ticker", F.upper(text)).when(kind == "normalized_name", F.lower(text)).otherwise(text)
    return F.when(text != "", F.concat(kind, F.lit(":"), cased))


def atom_edges(refs: DataFrame) -> DataFrame:
    """(a, b): the first atom of each reference linked to its others. refs: (ref, atom, pos)."""
    first = refs.groupBy("ref").agg(F.min_by("atom", F.struct("pos", "atom")).alias("b"))
    return refs.join(first, "ref").where("atom <> b").select(F.col("atom").alias("a"), "b").distinct()


def firm_roots(refs: DataFrame, register_singletons: bool = False) -> DataFrame:
    """(id, root) of the atoms: firms are components of atoms. Atoms that are only ever alone are left out unless asked for."""
    return connected_components(atom_edges(refs), refs.select(F.col("atom").alias("id")) if register_singletons else None)


def value_bucket(amount: Column, scale: Column) -> Column:
    """The coarse bucket of a deal value: twenty units of its two-digit mantissa, half to even; null unless positive."""
    factor = F.coalesce(F.create_map(*[F.lit(x) for kv in {"units": 1.0, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}.items() for x in kv])[scale], F.lit(1.0))
    value = amount * factor
    power = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when((value > 0) & ~F.isnan(value), F.bround(value / power * 0.05, 0) * power / 0.05)


def surrogate(root: Column) -> Column:
    """A reproducible id of 128 bits from the smallest member of a cluster."""
    return F.substring(F.sha2(root.cast("string"), 256), 1, 32)

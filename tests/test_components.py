from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evtide.operators import components as C


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=30))
def test_like_union_find(spark, pairs):
    got = C.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r.id: r.root for r in got.collect()} == brute(pairs)


def test_hubs_nodes_and_nulls(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), ("w", 2), (None, 1), ("x", None), ("y", 1)], "m string, k int")
    edges = C.hub_edges(rows, "m", "k")
    assert {(r.a, r.b) for r in edges.collect()} == {("y", "x"), ("z", "x")}
    got = C.connected_components(edges, spark.createDataFrame([("w",), ("x",), (None,)], "id string"))
    assert {(r.id, r.root) for r in got.collect()} == {("x", "x"), ("y", "x"), ("z", "x"), ("w", "w")}


def test_singletons_are_registered_only_if_asked_for(spark):
    refs = spark.createDataFrame([("r1", "ticker:A", 1), ("r1", "cik:1", 2), ("r2", "cik:1", 2), ("r3", "lei:9", 3)], "ref string, atom string, pos int")
    assert {r.id for r in C.firm_roots(refs).collect()} == {"ticker:A", "cik:1"}
    assert {r.id for r in C.firm_roots(refs, register_singletons=True).collect()} == {"ticker:A", "cik:1", "lei:9"}


def test_value_buckets(spark):
    df = spark.createDataFrame([(11e9, None), (68e9, None), (69.3e9, None), (72.0, "billion"), (0.0, None), (-1.0, None), (None, None), (float("nan"), None)], "a double, s string")
    assert [r[0] for r in df.select(C.value_bucket(F.col("a"), F.col("s"))).collect()] == [2e10, 6e10, 6e10, 8e10, None, None, None, None]

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evtide.llm import grouping as G


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "src string, dst string, id string")
    return {r["id"]: r["group_id"] for r in G.group_pairs(df).collect()}


def test_chains_loops_nulls_repeats(spark):
    pairs = [("a", "b", "x"), ("b", "c", "x"), ("c", "b", None), ("d", "d", "x"), ("e", None, "x"), (None, "f", "x"), ("", "z", "x"), ("a", "b", "x")]
    assert groups(spark, pairs) == {"a": "a", "b": "a", "c": "a", "d": "d", "": "", "z": ""}


def test_empty(spark):
    assert groups(spark, []) == {}


def test_long_chain_and_hot_hub(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}", "") for i in range(300)]
    hub = [("h", f"m{i:04d}", "") for i in range(2000)]
    got = groups(spark, chain + hub)
    assert {got[f"c{i:04d}"] for i in range(301)} == {"c0000"}
    assert {got[f"m{i:04d}"] for i in range(2000)} == {"h"}


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_like_union_find(spark, pairs):
    named = [(f"n{a:02d}", f"n{b:02d}", "") for a, b in pairs]
    assert groups(spark, named) == brute([(a, b) for a, b, _ in named])


def test_ids_with_one_hash_stay_apart(spark, monkeypatch):
    few = lambda c, seed: G.F.pmod(G.F.xxhash64(c, G.F.lit(seed)), G.F.lit(40 if seed < 19 else 1 << 60))
    monkeypatch.setattr(G, "_hash", few)
    pairs = [(f"x{i:03d}", f"x{i + 1:03d}", "") for i in range(0, 200, 2)]
    assert groups(spark, pairs) == brute([(a, b) for a, b, _ in pairs])


def test_firm_and_event_links(spark):
    alias = spark.createDataFrame([("f1", "cik", "007"), ("f2", "cik", " 7 "), ("f3", "ticker", "AB"), ("f4", "ticker", "ab\t"), ("f5", "cik", "000"), ("f6", "cik", "0000"), ("f7", "lei", "n/a"), ("f8", "lei", "N/A"), ("f9", "ticker", None), ("f3", "ticker", "AB")], "firm_id string, atom_type string, atom_value string")
    assert {(r.src, r.dst) for r in G.firm_links(alias).collect()} == {("f2", "f1"), ("f4", "f3")}
    events = spark.createDataFrame([("e1", "M&A_announce", "D1"), ("e2", "M&A_rumor", "d1 "), ("e3", "IPO", "d1"), ("e4", "M&A_cancel", "none")], "event_id string, event_type string, deal_id string")
    details = spark.createDataFrame([("e2", "K"), ("e4", "k"), ("e3", "k"), ("e9", "k")], "event_id string, cluster_key_hint string")
    assert {(r.src, r.dst) for r in G.event_links(events, details).collect()} == {("e2", "e1"), ("e4", "e2")}

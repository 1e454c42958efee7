import os
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evtide.llm import mixing as M

needs_vocabulary = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer file")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(1, 300))
def test_less_than_one_block_off(parts, slots):
    weights = {f"s{i}": Fraction(p, sum(parts)) for i, p in enumerate(parts)}
    given_, order = dict.fromkeys(weights, 0), M.pfair(weights, slots)
    assert len(order) == slots
    for t, (s, k) in enumerate(order, 1):
        assert k == given_[s]
        given_[s] += 1
        assert all(abs(given_[x] - weights[x] * t) < 1 for x in weights)


SIZES = "id bigint, source string, tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, id int"


def test_quotas_repeats_and_shares(spark):
    sizes = spark.createDataFrame([(i, "big", 10) for i in range(300)] + [(1000 + i, "small", 10) for i in range(20)] + [(5000, "other", 100), (5001, "empty", 0)], SIZES)
    targets = spark.createDataFrame([(" BIG", 0.5, 1, 0), ("small", 0.15, 3, 0), ("none", 0.3, 2, 0), ("empty", 0.05, 9, 0), (None, 0.1, 1, 0)], TARGETS)
    mix = M.Mix(sizes, targets, slots=100)
    report = {r.source: r for r in mix.reached().collect()}
    assert report["big"].quota == 1650 and not report["big"].out_of_reach
    assert report["small"].quota == 495 and not report["small"].out_of_reach
    assert report["none"].quota == 0 and report["none"].out_of_reach and report["empty"].out_of_reach
    rows = mix.records().toPandas()
    used = rows.groupby("source")["tokens"].sum()
    assert abs(used["big"] - 1650) <= 10 and abs(used["small"] - 495) <= 10
    assert rows[rows["source"] == "small"]["copy"].max() == 2
    assert not rows.duplicated(["id", "copy"]).any()


def test_out_of_reach_gives_all_it_may(spark):
    sizes = spark.createDataFrame([(1, "a", 100), (2, "b", 1)], SIZES)
    mix = M.Mix(sizes, spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 2, 0)], TARGETS))
    assert {r.source: r.out_of_reach for r in mix.reached().collect()} == {"a": False, "b": True}
    assert mix.records().where("source = 'b'").count() == 2


def test_cycles_keep_the_shares_everywhere(spark):
    """Beyond SLOTS blocks the schedule repeats: the mixture is as even at its end as at its beginning."""
    sizes = spark.createDataFrame([(i, "a" if i % 4 else "b", 1) for i in range(8000)], SIZES)
    mix = M.Mix(sizes, spark.createDataFrame([("a", 0.7, 1, 0), ("b", 0.3, 2, 0)], TARGETS), slots=20, block_tokens=10)
    rows = mix.records().toPandas().sort_values(["slot", "place"])
    assert rows["slot"].max() >= 700 and len(mix.order) <= 20
    share = (rows["source"] == "a").to_numpy().cumsum() / range(1, len(rows) + 1)
    assert abs(share[400:] - 0.7).max() < 0.03
    assert rows[rows["source"] == "a"]["tokens"].sum() == 5600 and rows[rows["source"] == "b"]["tokens"].sum() == 2400


def test_more_ranges_change_nothing_but_the_order(spark, monkeypatch):
    sizes = spark.createDataFrame([(i, "a", 3) for i in range(500)], SIZES)
    monkeypatch.setattr(M, "RANGE_RECORDS", 7)
    mix = M.Mix(sizes, spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS))
    places = sorted(r.place for r in mix.records().collect())
    assert mix.n_ranges == 72 and places == list(range(0, 1500, 3))


def test_empty(spark):
    nothing = spark.createDataFrame([], SIZES)
    assert M.Mix(nothing, spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)).records().count() == 0
    assert M.Mix(spark.createDataFrame([(1, "a", 5)], SIZES), spark.createDataFrame([], TARGETS)).reached().count() == 0


@needs_vocabulary
def test_sizes(spark):
    rows = [(1, " News ", "hello world", 0), (2, None, None, 0), (3, "x", "", 0), (4, "x", "a" * 100_000, 0)]
    got = {r.id: (r.source, r.tokens) for r in M.sized(spark.createDataFrame(rows, "k bigint, s string, t string, tokens int"), "k", "s", "t").collect()}
    assert got[1] == ("news", 2) and got[2] == ("", 0) and got[3] == ("x", 0) and got[4][1] > 1000

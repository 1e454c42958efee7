from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evtide.plans import templates as T
from evtide.plans.views import Views

W = {"W_start": "2020-01-01", "W_end": "2020-01-31"}


def views(spark, events, companies=(), sources=()):
    return Views(
        spark.createDataFrame(list(events), "event_id string, event_type string, firm string, day date"),
        spark.createDataFrame(list(companies), "event_id string, role string, ticker string"),
        spark.createDataFrame(list(sources), "event_id string, url string"),
    )


def d(n):
    return date(2020, 1, 1) + timedelta(n)


EVENTS = [("e1", "A", "X", d(0)), ("e2", "A", "Y", d(30)), ("e3", "A", None, d(3)), ("e4", "A", "X", None), ("e5", "A", "X", d(31)), ("e6", "B", "X", d(5)), ("e7", "A", "Y", d(0)), ("e1", "A", "X", d(0))]


def test_windows_are_inclusive(spark):
    v = views(spark, EVENTS)
    assert sorted(r.event_id for r in T.run("A.1.1", v, {**W, "E": "A"}).collect()) == ["e1", "e1", "e2", "e7"]
    assert {r.firm_ticker: (r.first_event, r.last_event) for r in T.run("A.1.2", v, {**W, "E": "A"}).collect()} == {"X": ("e1", "e1"), "Y": ("e2", "e7")}


def test_any_role_fills_the_firm(spark):
    v = views(spark, EVENTS, [("e3", "target", "x"), ("e2", "seller", "Z"), ("e3", "seller", "x")])
    got = sorted((r.event_id, r.firm_ticker) for r in T.run("A.2.1", v, {**W, "E": "A", "F": "X"}).distinct().collect())
    assert got == [("e1", "X"), ("e3", "X")]


def test_anchor_order_and_ties(spark):
    v = views(spark, EVENTS)
    assert [r.event_id for r in T.run("B.1.1", v, {**W, "E": "A", "F_anchor": "X", "direction": "after"}).collect()] == ["e2"]
    assert T.run("B.1.1", v, {**W, "E": "A", "F_anchor": "nobody", "direction": "after"}).count() == 0
    assert {r.event_id for r in T.run("B.2.1", v, {**W, "E": "A", "position": "first"}).collect()} == {"e1", "e7"}
    assert T.b21(v, {**W, "E": "A", "position": "first"}, ties=False).count() == 1
    assert T.run("B.2.1", v, {**W, "E": "none", "position": "last"}).count() == 0


def test_days_between(spark):
    v = views(spark, EVENTS)
    p = {**W, "F": "X", "E1": "A", "E2": "B"}
    assert T.run("B.1.5", v, p).first().days_between == 5
    assert T.b15_contract(v, {**p, "E1": "B", "E2": "A"}).first().days_between == -5
    assert T.run("B.1.5", v, {**p, "F": "nobody"}).count() == 0 and T.run("B.1.5", v, {**p, "E1": "B", "E2": "C"}).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("XY"), st.integers(0, 30)), max_size=15), st.lists(st.tuples(st.sampled_from("XY"), st.integers(0, 30)), max_size=15), st.integers(-9, 3), st.integers(0, 9))
def test_band_join_like_the_plain_one(spark, left, right, low, more):
    frame = lambda rows, p: spark.createDataFrame([(f, f"{p}{i}", d(n)) for i, (f, n) in enumerate(rows)], "firm string, event_id string, day date")
    got = sorted((r.id1, r.id2) for r in T.band_join(frame(left, "l"), frame(right, "r"), "firm", low, low + more).collect())
    assert got == sorted((f"l{i}", f"r{j}") for i, (f, a) in enumerate(left) for j, (g, b) in enumerate(right) if f == g and low <= b - a <= low + more)


def test_deals_by_either_key_come_once(spark):
    a = spark.createDataFrame([(1, "b", "t", d(0)), (2, "b", "u", d(0)), (3, None, "t", d(0)), (4, "c", "t", d(2))], "hint int, buyer string, target string, day date")
    c = spark.createDataFrame([(1, "b", "t", d(9)), (9, "b", "t", d(5)), (2, "q", "q", d(10)), (4, "c", "t", d(1)), (3, "b", "u", d(40))], "hint int, buyer string, target string, day date")
    got = {(r.buyer_ticker, r.target_ticker): r.close_date for r in T.b14(a, c, {**W, "horizon_days": 10}).collect()}
    assert got == {("b", "t"): "2020-01-06", ("b", "u"): "2020-01-11"}


@pytest.mark.parametrize("day, unit, label", [("2020-12-31", "week", "2020-W53"), ("2021-01-01", "week", "2020-W53"), ("2021-01-04", "week", "2021-W01"), ("2021-03-31", "quarter", "2021-Q1"), ("2021-04-01", "quarter", "2021-Q2"), ("2021-04-01", "month", "2021-04"), ("2021-04-01", "day", "2021-04-01")])
def test_labels(spark, day, unit, label):
    assert spark.sql(f"SELECT DATE '{day}' AS d").select(T.bucket_label(T.F.col("d"), unit)).first()[0] == label


def test_provenance_is_one_join(spark):
    v = views(spark, EVENTS[:3], sources=[("e1", "u2"), ("e1", "u1"), ("e1", "u1"), ("e2", None)])
    got = {r.event_id: r.cited_urls for r in T.cited(T.run("A.1.1", v, {**W, "E": "A"}).distinct(), v.sources, "event_id").collect()}
    assert got == {"e1": ["u1", "u2"], "e2": []}


def test_bad_questions_are_reported(spark):
    plans, failed = T.answer_questions(views(spark, EVENTS), [("q1", "A.1.1", {**W, "E": "A"}), ("q2", "Z.9", {}), ("q3", "A.1.1", {})])
    assert set(plans) == {"q1"} and set(failed) == {"q2", "q3"}
    assert all(T.render(t, {**W, **{k: "x" for k in ("E", "F", "R", "F_anchor", "direction", "E1", "E2", "gap_days", "E_trigger", "E_followup", "lag_days", "horizon_days", "position", "W1_start", "W1_end", "W2_start", "W2_end", "N", "bucket_unit")}, "E_set": ["a", "b"]}) for t in T.PHRASES)

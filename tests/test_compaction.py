import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evtide.operators import compaction as C

FILES = "file_id bigint, file_path string, n_bytes bigint, content string, grp string, r int"


def files(spark, contents):
    return spark.createDataFrame([(i, f"d{i % 3}/f{i}.json", len(c or ""), c, "x", 1) for i, c in enumerate(contents)], FILES)


A, B = {"article_id": "a", "attempt": 1, "note": 'said "}" {'}, {"attempt": "2", "article_id": "b", "inner": {"article_id": "no"}}


def test_layouts():
    ids = lambda s: [(a, n) for a, n, _ in C.whole_records(s)]
    assert ids(json.dumps(A) + "\n" + json.dumps(B)) == [("a", 1), ("b", 2)]
    assert ids("﻿" + json.dumps([A, B], indent=1)) == [("a", 1), ("b", 2)]
    assert ids(json.dumps({"results": [A, B]})) == [("a", 1), ("b", 2)]
    assert ids(json.dumps([A, B])[:-20]) == [("a", 1)]
    assert ids('{"a": "x {", "b": [{"article_id": "in", "attempt": 1}], "c": "} {"}') == [("in", 1)]
    assert ids('{"article_id": "cut", "attempt": 1') == []
    assert ids('{"article_id": null} {"article_id": ""} {"x": 1} [] "s" 3 {') == []
    assert ids("claimed by w1 at 2025") == [] and ids("") == [] and ids("{" * 3000) == []
    assert ids('{"article_id": "a"}{"article_id": "a", "attempt": "x"}{"article_id": 5, "attempt": 2.0}') == [("a", None), ("a", None), ("5", 2)]


def test_bytes_are_kept():
    odd = '{"article_id": "a",  "n": 1e400, "x": 0.10000000000000000555, "k": 1, "k": 2, "u": "\\u00e9"}'
    assert [r for *_, r in C.whole_records(f'[{odd}, {{"r": {odd}}}]')] == [odd, odd]


def test_none_lost_none_twice(spark):
    contents = [json.dumps(A), json.dumps([A, B]), None, "", "\n", json.dumps(A)[:15], json.dumps({"article_id": "a"}), "x" * 100_000]
    got = C.compact(files(spark, contents), target=50).toPandas()
    assert {(a, 0 if n != n or n is None else int(n)) for a, n in zip(got["article_id"], got["attempt"])} == {("a", 1), ("a", 0), ("b", 2)} and len(got) == 3
    assert not got.duplicated(["article_id", "attempt"]).any()
    assert C.compact(files(spark, [])).count() == 0


def test_reconcile_notices(spark):
    df = spark.createDataFrame([("a", 1, "{1}"), ("b", 2, "{22}")], "article_id string, attempt bigint, record string")
    C.reconcile(df.union(df).union(spark.createDataFrame([("b", 2, "{}")], df.schema)), df)
    for other in (df.limit(1), df.union(df), spark.createDataFrame([("a", 1, "{1}"), ("c", 2, "{22}")], df.schema), spark.createDataFrame([("a", 1, "{1}"), ("b", 2, "{23}")], df.schema)):
        with pytest.raises(ValueError):
            C.reconcile(df, other)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 90)), max_size=30))
def test_groups_are_intervals_of_the_running_sum(spark, sizes):
    m = spark.createDataFrame([(i, f"p/{i % 4}/{i:03d}", s) for i, s in enumerate(sizes)], "file_id bigint, file_path string, n_bytes bigint")
    plan = C.plan_groups(m, 100).toPandas()
    assert sorted(plan["file_id"]) == list(range(len(sizes)))
    if sizes:
        total = plan.groupby("grp")["n_bytes"].sum()
        assert total.max() < 200 and plan["grp"].max() <= sum(s or 0 for s in sizes) // 100


def test_registered_plan_uses_the_production_target(spark, tmp_path):
    rows = [(i, f"p/{i}", 50 << 20, None) for i in range(4)]
    spark.createDataFrame(rows, "file_id bigint, file_path string, n_bytes bigint, content string").write.parquet(f"{tmp_path}/article_files.parquet")
    got = {r.grp: (r.files, r.bytes) for r in C.p5_plan(spark, str(tmp_path)).collect()}
    assert got == {k: (1, 50 << 20) for k in (0, 2, 4, 6)}  # 200 MiB: an eighth is 25 MiB


def test_target_follows_the_manifest(spark, monkeypatch):
    of = lambda *sizes: C.target_bytes(spark.createDataFrame([(s,) for s in sizes], "n_bytes bigint"))
    assert of() == of(None) == of(-5, 100) == C.SMALLEST
    assert of(16 << 20, None) == 2 << 20 and of(1 << 40) == C.LARGEST
    monkeypatch.setattr(C, "FILES_PER_RANGE", 7)  # one flat folder over several ranges
    m = spark.createDataFrame([(i, f"flat/{i:03d}", 10) for i in range(100)], "file_id bigint, file_path string, n_bytes bigint")
    assert {r.file_id: r.grp for r in C.plan_groups(m, 30).collect()} == {i: i * 10 // 30 for i in range(100)}


def test_several_groups_are_rewritten(spark, tmp_path):
    contents = [json.dumps([{"article_id": f"{i}-{k}", "attempt": k} for k in range(3)]) for i in range(12)] + [json.dumps({"article_id": "0-0", "attempt": 0})]
    path = f"{tmp_path}/out"
    got = C.compact(files(spark, contents), path, target=300).toPandas()
    assert got["grp"].nunique() > 2 and len(got) == 36 and not got.duplicated(["article_id", "attempt"]).any()
    assert spark.read.parquet(path).selectExpr("grp", "input_file_name() f").distinct().groupBy("f").count().where("count > 1").count() == 0

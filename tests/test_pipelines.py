from datetime import date

import pytest
from pyspark.sql import functions as F

from evtide.operators import etl as E
from evtide.operators import retrieval as R
from evtide.operators import scoring as S

GOLD = "qid string, firm string, event_type string, day date, urls array<string>"


def test_tolerant_recall(spark):
    gold = spark.createDataFrame([("q", "A", "x", date(2020, 1, 10), ["u"]), ("q", "B", "x", None, []), ("q", None, "x", date(2020, 1, 1), None)], GOLD)
    pred = spark.createDataFrame([("q", "A", "x", date(2020, 1, 17), ["u", None]), ("q", "A", "x", date(2020, 1, 17), ["u", None]), ("q", "B", "x", None, []), ("q", None, "x", date(2020, 1, 9), []), ("other", "A", "x", date(2020, 1, 10), [])], GOLD)
    strict, loose = S.list_recall(gold, pred).first(), S.list_recall(gold, pred, 7).first()
    assert (strict.no_prov, strict.with_prov) == (pytest.approx(1 / 3), 0.0)
    assert (loose.no_prov, loose.with_prov) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    one = S.one_to_one(gold, pred, 7).where("qid = 'q'").first()
    assert one.matched == 1 and one.n_gold == 3 and one.n_extra == 3


def test_dates(spark):
    cases = {"2020-1-5": date(2020, 1, 5), "2020/01/05 x": date(2020, 1, 5), "2020.1.05": date(2020, 1, 5), "20200105": date(2020, 1, 5), "2020-13-01": None, "5.1.2020": None, "": None, None: None, "202001051": date(2020, 1, 5)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.d for r in df.select("s", S.lenient_date(F.col("s")).alias("d")).collect()} == cases


def test_gold_urls(spark):
    chunk = "array<struct<article_url:string>>"
    df = spark.createDataFrame([([("b",), (None,)], None, [([("a",)],), (None,), ([("b",)],)]), (None, None, None)], f"golden_chunks {chunk}, golden_chunks_e1 {chunk}, qualifying_events array<struct<golden_chunks:{chunk}>>")
    assert [r[0] for r in df.select(S.gold_urls(df, ["golden_chunks", "golden_chunks_e1"], "qualifying_events")).collect()] == [["a", "b"], []]


@pytest.mark.parametrize("said, want", [(["NO"] * 10, "absent"), (["NO"] * 5, "uncertain"), (["YES"] + ["ERROR"] * 3, "covered"), (["NO"] * 6 + ["ERROR"] * 4, "absent"), ([], "absent")])
def test_verdicts(spark, said, want):
    judged = spark.createDataFrame([("e", v) for v in said], "event_id string, verdict string")
    assert E.verdicts(judged, spark.createDataFrame([("e",), ("e",)], "event_id string")).first().verdict == want


def test_packing(spark):
    rows = [("q", "e1", "u1", 1, 60), ("q", "e2", "u1", 2, 60), ("q", "e2", "big", 1, 500), ("q", "e3", "u3", 3, 30), ("q", "e1", "u4", 4, 10), ("q", "e1", "u5", 5, 1)]
    got = E.pack_budget(spark.createDataFrame(rows, "qid string, event_id string, url string, rank int, tokens bigint"), 100).orderBy("position").collect()
    assert [r.url for r in got] == ["u1", "u3", "u4"]


@pytest.mark.parametrize("text, want", [("```json\n[1, 2]\n```", "[1, 2]"), ('so: ["a"] done', '["a"]'), ('{"a": 1} x', '{"a": 1}'), ("none", None), (None, None)])
def test_json_slice(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(E.json_slice(F.col("t"))).first()[0] == want


def test_names(spark):
    cases = {"Alpha  Foods (old), Inc.": "alpha foods", "Beta Holdings Co. Ltd": "beta", "Inc": "inc", " (x) ": None, None: None, "The A.B. plc": "the a.b"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.p for r in df.select("s", E.plain_name(F.col("s")).alias("p")).collect()} == cases


def test_inference_resume_and_replay(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")
    asked = E.infer(df, "prompt", lambda: lambda prompts: [p.upper() for p in prompts], "k")
    assert {r.k: r.answer for r in asked.collect()} == {1: "A", 2: "B"}
    assert [r.k for r in E.resume(df, df.where("k = 1"), "k").collect()] == [2]
    assert E.replay(df, asked, "k").count() == 2
    with pytest.raises(Exception, match="no recorded answer"):
        E.replay(df, asked.where("k = 1"), "k").collect()
    with pytest.raises(Exception, match="no reference row"):
        E.looked_up(df, df.where("k = 1").select("k"), "k").collect()


def test_answer_rules(spark):
    rows = [("q", "A", None, None, ["u"]), ("q", None, "d", None, ["u"]), ("q", "B", "d", None, []), ("q", "C", "d", "extra", ["u"]), ("q", "D", "d", None, ["v"]), ("q", "E", None, None, None)]
    df = spark.createDataFrame(rows, "qid string, firm string, day string, other string, cited_urls array<string>")
    assert {r.firm for r in E.valid_answers(df, ["firm"], ["day"]).where("valid").collect()} == {"A", "D"}
    seen = spark.createDataFrame([("q", "u")], "qid string, url string")
    assert {r.firm for r in E.valid_answers(df, ["firm"], ["day"], seen).where("valid").collect()} == {"A"}


def test_dense_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [2.0, 0.0])], "doc int, v array<float>")
    got = R.dense(v, v.where("doc = 1").select(F.col("doc").alias("qid"), "v"), 3).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in got] == [(5, 1.0), (2, pytest.approx(0.707107)), (3, 0.0)]
    fused = R.fuse([spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, doc int, rank int"), spark.createDataFrame([(1, 8, 1)], "qid int, doc int, rank int")])
    assert R.top_k(fused, 1).first().doc == 8
    with pytest.raises(ValueError):
        R.cached_ranking(R.top_k(fused, 2), 5)
    assert R.roles(v)["vector"] == "v"
    rounds = R.search_rounds(R.top_k(fused, 2), 1, 2)
    assert [x.count() for x in rounds] == [1, 1]


def test_bm25_without_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc int, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "zzz"), (3, None)], "qid int, text string")
    assert [(r.qid, r.doc) for r in R.bm25(docs, q, 5).collect()] == [(1, 1)]
    assert R.bm25(docs.where("false"), q, 5).count() == 0

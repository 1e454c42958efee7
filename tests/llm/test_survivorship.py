from datetime import date, datetime

from pyspark.sql import functions as F

from evtide.llm import survivorship as S

EVENTS = "event_id string, loaded_at timestamp, event_date_value date, event_date_precision string, headline_summaries string, raw_extraction_count int, group_id string"
DETAILS = "event_id string, deal_value_amount double, deal_value_currency string, deal_value_scale string, deal_value_text string, member string"


def run(spark, events, details, groups):
    best = S.best_records(spark.createDataFrame(events, EVENTS), spark.createDataFrame(details, DETAILS), spark.createDataFrame(groups, "group_id bigint, event_id string, deal string"))
    return {r.group_id: r for r in best.collect()}


def test_best_of_each_field(spark):
    early, late = datetime(2020, 1, 1), datetime(2021, 1, 1)
    events = [
        ("a", early, date(2019, 1, 1), " DAY ", '["short", "  longer one "]', 3, "x"),
        ("b", late, date(2019, 1, 2), "month", '["a much longer headline', 5, "x"),
        ("c", late, date(2019, 1, 3), "day", '["longer one"]', 5, "x"),
        ("c", late, date(2019, 1, 3), "day", '["longer one"]', 5, "x"),
    ]
    details = [("a", 5.0, "USD", None, None, "m"), ("b", float("nan"), None, None, None, "m"), ("c", -1.0, None, None, None, "m"), ("a", 5.0, "USD", None, None, "m")]
    r = run(spark, events, details, [(1, "a", ""), (1, "b", ""), (1, "c", ""), (1, "a", ""), (None, "a", ""), (2, None, ""), (3, "zzz", "")])
    assert set(r) == {1}
    assert (r[1].event_date.member, r[1].deal_value.member, r[1].headline.member, r[1].extraction.member) == ("c", "a", "c", "b")
    assert r[1].deal_value.value.amount == 5.0 and r[1].headline.value == "longer one"


def test_nothing_known_and_empty(spark):
    r = run(spark, [("a", None, None, None, "[]", None, "x")], [], [(1, "a", "")])
    assert r[1].event_date is None and r[1].deal_value is None and r[1].headline is None and r[1].extraction is None
    assert run(spark, [], [], []) == {}
    r = run(spark, [("a", None, None, None, None, -(2**31), "x"), ("b", None, None, None, None, 2**31 - 1, "x")], [("a", float("inf"), None, None, None, "m")], [(1, "a", ""), (1, "b", "")])
    assert (r[1].extraction.member, r[1].deal_value.member) == ("b", "a")


def test_headlines(spark):
    cases = {'["a"]': "a", '["a", null, "  "]': "a", '[""]': None, "[]": None, "null": None, '["a"': None, "['a']": None, '["a"] tail': None, '{"a": 1}': None, None: None, "": None, '["bb","aa"]': "bb"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.h for r in df.select("s", S.longest_headline(F.col("s")).alias("h")).collect()} == cases


def test_null_recency_is_earliest_then_smaller_member(spark):
    r = run(spark, [("b", None, date(2020, 1, 1), "day", None, 1, ""), ("a", None, date(2020, 1, 1), "day", None, 1, ""), ("c", datetime(2000, 1, 1), date(2020, 1, 1), "day", None, 1, "")], [], [(1, "a", ""), (1, "b", ""), (1, "c", ""), (2, "a", ""), (2, "b", "")])
    assert (r[1].event_date.member, r[2].event_date.member) == ("c", "a")


def test_surviving_record_is_whole(spark):
    events = [("a", datetime(2020, 1, 1), date(2019, 1, 1), " MONTH ", '["h"]', 3, "x"), ("b", datetime(2021, 1, 1), date(2019, 1, 2), None, None, 5, "x")]
    details = [("a", 12.0, "JPY", "billion", "12 bn yen", "m")]
    df = S.surviving(spark.createDataFrame(events, EVENTS), spark.createDataFrame(details, DETAILS), spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "group_id bigint, event_id string"))
    one, two = sorted(df.collect())
    assert one.asDict() == {
        "group_id": 1, "event_date": date(2019, 1, 1), "event_date_precision": "month", "event_date_from": "a", "deal_amount": 12.0, "deal_currency": "JPY", "deal_scale": "billion", "deal_text": "12 bn yen",
        "deal_value_from": "a", "headline": "h", "headline_from": "a", "extraction": 5, "extraction_from": "b",
    }
    assert two.deal_amount is None and two.deal_value_from is None and two.event_date_from == "b" and two.event_date_precision is None

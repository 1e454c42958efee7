import json
from datetime import date

import pytest

from evtide.operators import canonical as K
from evtide.sources import files


def co(name, **more):
    return {"name": name, "normalized_name": name.lower().replace(" ", "_"), **more}


def ma(kind, acq, tgt, on, **details):
    return {"event_type": kind, "event_date": {"value": on, "precision": "day"}, "event_status": "confirmed", "headline_summary": f"{acq['name']} and {tgt['name']}", "geography": ["US"], "primary_companies": [acq], "source_article": {"url": "u"}, "details": {"acquirers": [acq], "targets": [tgt], **details}}


ARTICLES = [
    {"article_id": "a1", "article_date": "2020-01-02", "title": "t1", "ok": True, "parsed_events_all": [ma("M&A_announce", co("Alpha Foods", ticker="alp"), co("Beta Water", cik="7"), "2020-01-01", announcement_date={"value": "2020-01-01"}, deal_value={"amount": 68.0, "scale": "billion", "currency": "USD"}), None]},
    {"article_id": "a2", "article_date": "2020-01-05", "title": "t2", "ok": True, "parsed_events_all": [ma("M&A_announce", co("Alpha", ticker="ALP", lei="L"), co("Beta Water", cik="7"), "2020-01-03", deal_value={"amount": 69.3e9, "currency": "USD"})]},
    {"article_id": "a3", "article_date": None, "title": "t3", "ok": True, "parsed_events_all": [ma("M&A_complete", co("Alpha Foods", ticker="ALP"), co("Beta Water", cik="7"), "2020-06-01", announcement_date={"value": "2020-01-01"}), {"event_type": "CEO_change", "primary_companies": [{"normalized_name": "lonely"}], "details": {"company": {"normalized_name": "lonely"}}}]},
    {"article_id": "a4", "article_date": "2020-01-09", "title": "t4", "ok": False, "parsed_events_all": [ma("M&A_cancel", co("Alpha", ticker="ALP"), co("X", cik="1"), "2020-01-03")]},
]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("x") / "out.jsonl"
    f.write_text("\n".join([*map(json.dumps, ARTICLES), "", "{broken"]))
    return K.canonicalise(files.extraction_records(spark, str(f)))


def test_events_and_deals(star):
    events = star.events.toPandas()
    assert sorted(events["event_type"]) == ["CEO_change", "M&A_announce", "M&A_complete"]
    announced = events[events["event_type"] == "M&A_announce"].iloc[0]
    assert announced["raw_extraction_count"] == 2 and announced["firm_ticker"] == "ALP" and announced["event_date_value"] == date(2020, 1, 1)
    assert list(announced["headline_summaries"]) == ["Alpha Foods and Beta Water", "Alpha and Beta Water"]
    assert events[events["event_type"] != "CEO_change"]["deal_id"].nunique() == 1
    assert events[events["event_type"] == "CEO_change"].iloc[0]["firm_id"] is None
    deal = star.deals.collect()
    assert len(deal) == 1 and deal[0].announce_event_id == announced["event_id"] and deal[0].complete_event_id and deal[0].cancel_event_id is None


def test_firms_and_junctions(star):
    firms = {r.canonical_ticker: r for r in star.firms.collect()}
    assert set(firms) == {"ALP", None} and firms["ALP"].canonical_name == "alpha_foods" and firms["ALP"].n_aliases == 4
    roles = {(r.role, r.normalized_name) for r in star.companies.collect()}
    assert {("acquirer", "alpha_foods"), ("acquirer", "alpha"), ("target", "beta_water")} <= roles and not any(n == "lonely" for _, n in roles)
    assert star.sources.count() == 4


def test_registered_singletons(spark, star, tmp_path):
    f = tmp_path / "one.jsonl"
    f.write_text(json.dumps(ARTICLES[2]))
    events = K.canonicalise(files.extraction_records(spark, str(f)), register_singletons=True).events.toPandas()
    assert events[events["event_type"] == "CEO_change"].iloc[0]["firm_id"] is not None


def test_nothing(spark, tmp_path):
    f = tmp_path / "none.jsonl"
    f.write_text(json.dumps(ARTICLES[3]))
    assert K.canonicalise(files.extraction_records(spark, str(f))).events.count() == 0


def test_details(spark, tmp_path):
    who = {"company": co("Gamma Oil", ticker="GAM"), "person": {"full_name": "Ann Lee", "normalized_name": "ann_lee"}, "action": "appointed"}
    issuer, at = co("Delta Air", ticker="DEL"), lambda v, p="day": {"value": v, "precision": p}

    def other(kind, on, **details):
        return {"event_type": kind, "event_date": on, "duplicate_cluster_key_hint": kind, "details": details}

    rows = [
        ("b1", "2020-01-02", [
            ma("M&A_announce", co("Alpha Foods", ticker="ALP"), co("Beta Water", cik="7", ticker="B"), "2020-01-01", announcement_date=at("2020-01-01", "month"), deal_value={"amount": 68.0, "scale": "billion", "currency": "USD"}, deal_status="pending", consideration_type="stock", deal_name="Deal") | {"duplicate_cluster_key_hint": "d"},
            other("CEO_change", at("2020-02-01", "month"), **who, new_title="CEO", is_interim_or_acting=False),
            other("IPO", at("2020-03-01"), issuer=issuer, ipo_stage="filed", exchange="NYSE", offer_price={"amount": 20.0, "currency": "EUR"}),
            other("Stock_split", None, company=issuer, ratio={"ratio_text": "2-for-1", "new_shares": 2.0, "old_shares": 1.0}),
        ]),
        ("b2", "2020-01-05", [
            ma("M&A_announce", co("Alpha Foods", ticker="ALP"), co("Beta Water", cik="7", ticker="B"), "2020-01-01", announcement_date=at("2020-01-03"), deal_value={"amount": 70.0, "scale": "billion", "currency": "GBP"}, per_share_price={"amount": 5.5}, deal_status="agreed", consideration_type="cash", deal_name="The Deal", closing_date=at("2020-09-01")) | {"duplicate_cluster_key_hint": "D "},
            other("CEO_change", at("2020-02-03"), company=who["company"], action="unknown", new_title="Chief Executive", is_interim_or_acting=True),
            other("IPO", None, issuer=issuer, ipo_stage="priced", exchange="NASDAQ", is_spac_ipo=False, pricing_date=at("2020-03-02")),
            other("Stock_split", None, company=issuer, ratio={"ratio_text": "3-for-1", "new_shares": 3.0}, split_type="forward"),
        ]),
        ("b3", "2020-01-04", [ma("M&A_announce", co("Alpha Foods", ticker="ALP"), co("Beta Water", cik="7", ticker="B"), "2020-01-01", consideration_type="cash") | {"duplicate_cluster_key_hint": "d"}, other("Stock_split", None, ratio={"new_shares": 3.0})]),
    ]
    f = tmp_path / "details.jsonl"
    f.write_text("\n".join(json.dumps({"article_id": a, "article_date": on, "title": a, "ok": True, "parsed_events_all": events}) for a, on, events in rows))
    star = K.canonicalise(files.extraction_records(spark, str(f)))
    ids = {r.event_type: r for r in star.events.collect()}
    assert len(ids) == 4 and ids["CEO_change"].event_date_value == date(2020, 2, 3) and ids["CEO_change"].event_date_precision == "day"
    (m,), (e,), (i,), (s,) = (t.collect() for t in (star.ma_details, star.executive_change_details, star.ipo_details, star.stock_split_details))
    assert [x.event_id for x in (m, e, i, s)] == [ids[k].event_id for k in ("M&A_announce", "CEO_change", "IPO", "Stock_split")]
    assert tuple(m)[1:] == ("M&A_announce", "The Deal", None, "agreed", "cash", 70.0, "GBP", "billion", 5.5, date(2020, 1, 3), None, None, date(2020, 9, 1), "d", None)
    assert tuple(e)[1:] == ("CEO", "appointed", "Ann Lee", "ann_lee", None, None, None, "Chief Executive", None, None, True)
    assert tuple(i)[1:] == ("priced", None, None, False, "NYSE", None, date(2020, 3, 2), None, 20.0, "EUR")
    assert tuple(s)[1:] == ("forward", "2-for-1", 3.0, 1.0, None, None, None)

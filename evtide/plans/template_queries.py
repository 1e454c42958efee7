"""Registered template queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.plans import templates as T
from evtide.plans.views import DEALS, EC, EH, ES, EV, TC, TV, corporate, deal_sides, trade

Y18 = {"W_start": "2018-01-01", "W_end": "2018-12-31"}
Q97 = {"W_start": "1997-01-01", "W_end": "1997-03-31"}
IN18 = "day BETWEEN DATE '2018-01-01' AND DATE '2018-12-31'"
ANSWER = "firm AS firm_ticker, event_type, strftime(day, '%Y-%m-%d') AS anchor_date, event_id"
CEO18 = f"SELECT * FROM ev WHERE event_type = 'CEO_change' AND {IN18} AND firm IS NOT NULL"
ROLE97 = "SELECT DISTINCT ec.ticker AS firm, e.event_type, e.day, e.event_id FROM ev e JOIN ec ON e.event_id = ec.event_id WHERE ec.ticker IS NOT NULL"


def _corporate(template: str, **p: object):
    return lambda s, d: T.run(template, corporate(s, d), {**Y18, **p})


def _trade(template: str, **p: object):
    return lambda s, d: T.run(template, trade(s, d), {**Q97, **p})


def _deals(s: SparkSession, d: str) -> DataFrame:
    return T.b14(*deal_sides(s, d), {"W_start": "1997-01-01", "W_end": "1997-12-31", "horizon_days": 90})


def _provenance(s: SparkSession, d: str) -> DataFrame:
    v = corporate(s, d)
    rows = T.a11(v, {"W_start": "2014-01-01", "W_end": "2024-12-31", "E": "M&A_announce"}).distinct()
    return T.cited(rows, v.sources, "event_id").withColumn("cited_urls", F.array_join("cited_urls", "|"))


def _provenance_pairs(s: SparkSession, d: str) -> DataFrame:
    v = corporate(s, d)
    rows = T.by_identity(v, {"W_start": "2014-01-01", "W_end": "2024-12-31"}, "M&A_announce", "M&A_complete", 0, 120)
    return T.cited(rows, v.sources, "id1", "id2").withColumn("cited_urls", F.array_join("cited_urls", "|"))


QUESTIONS = [("q1", "CEO_change", "2016-01-01", "2016-12-31"), ("q2", "CFO_change", "2017-03-01", "2017-09-30"), ("q3", "IPO", "2015-01-01", "2019-12-31"), ("q4", "none_such", "2015-01-01", "2019-12-31")]


def _batch(s: SparkSession, d: str) -> DataFrame:
    """All questions of a template in one job: their parameters, a small stated table, are joined to the events."""
    questions = s.createDataFrame(QUESTIONS, "qid string, E string, a string, b string").withColumns({"a": F.col("a").cast("date"), "b": F.col("b").cast("date")})
    events = corporate(s, d).events.where("firm is not null")
    hit = events.join(F.broadcast(questions), (F.col("event_type") == F.col("E")) & F.col("day").between(F.col("a"), F.col("b")))
    return hit.select("qid", F.col("firm").alias("firm_ticker"), "event_type", F.date_format("day", "yyyy-MM-dd").alias("anchor_date"), "event_id")


def _pairs_sql(e1: str, e2: str, low: int, high: int, names: str) -> str:
    return f"""WITH {EV}, p AS (SELECT DISTINCT a.firm AS firm_ticker, strftime(a.day, '%Y-%m-%d') AS d1, strftime(b.day, '%Y-%m-%d') AS d2, date_diff('day', a.day, b.day) AS n, a.event_id AS id1, b.event_id AS id2
        FROM ev a JOIN ev b ON a.firm = b.firm AND a.event_type = '{e1}' AND b.event_type = '{e2}' AND date_diff('day', a.day, b.day) BETWEEN {low} AND {high}
        WHERE a.{IN18} AND b.{IN18}) SELECT firm_ticker, {names}, id1, id2 FROM p"""


def _bucket_sql(label: str) -> str:
    return f"WITH {EV} SELECT {ANSWER}, {label} AS bucket FROM ({CEO18})"


IDENTITY = f"""WITH {EV}, {ES}, x AS (SELECT firm, event_type, day, min(event_id) AS id, count(DISTINCT event_id) AS n FROM ev WHERE firm IS NOT NULL AND day BETWEEN DATE '2014-01-01' AND DATE '2024-12-31' GROUP BY 1, 2, 3),
    p AS (SELECT a.firm AS firm_ticker, strftime(a.day, '%Y-%m-%d') AS first_date, strftime(b.day, '%Y-%m-%d') AS second_date, date_diff('day', a.day, b.day) AS days, a.id AS id1, b.id AS id2, a.n * b.n AS n_pairs FROM x a JOIN x b ON a.firm = b.firm AND a.event_type = {{0}} AND b.event_type = {{1}} AND date_diff('day', a.day, b.day) BETWEEN {{2}} AND {{3}})"""

TABLE: dict[str, tuple[object, str]] = {
    "a11_window_filter": (_corporate("A.1.1", E="CEO_change"), f"WITH {EV} SELECT {ANSWER} FROM ({CEO18})"),
    "a12_distinct_firms": (_corporate("A.1.2", E="CEO_change"), f"WITH {EV} SELECT firm AS firm_ticker, min(event_id) AS first_event, max(event_id) AS last_event FROM ({CEO18}) GROUP BY firm"),
    "a21_firm_any_role": (_trade("A.2.1", E="1-URGENT", F="s3", W_start="1996-01-01", W_end="1998-12-31"), f"WITH {TV}, {TC} SELECT {ANSWER} FROM ev WHERE event_type = '1-URGENT' AND day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND (upper(firm) = 'S3' OR event_id IN (SELECT event_id FROM ec WHERE upper(ticker) = 'S3'))"),
    "a21_firm_any_role_corporate": (_corporate("A.2.1", E="M&A_announce", F="DCT", W_start="2014-01-01", W_end="2024-12-31"), f"WITH {EV}, {EC} SELECT coalesce(firm, 'DCT') AS firm_ticker, event_type, strftime(day, '%Y-%m-%d') AS anchor_date, event_id FROM ev WHERE event_type = 'M&A_announce' AND day BETWEEN DATE '2014-01-01' AND DATE '2024-12-31' AND (upper(firm) = 'DCT' OR event_id IN (SELECT event_id FROM ec WHERE upper(ticker) = 'DCT'))"),
    "a31_role_filter": (_trade("A.3.1", E="1-URGENT", R="Seller"), f"WITH {TV}, {TC} SELECT {ANSWER} FROM ({ROLE97} AND ec.role = 'seller' AND e.event_type = '1-URGENT' AND e.day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31')"),
    "b11_before_anchor": (_corporate("B.1.1", E="M&A_announce", F_anchor="DCT", direction="before"), f"WITH {EV} SELECT {ANSWER} FROM ev WHERE event_type = 'M&A_announce' AND {IN18} AND upper(firm) <> 'DCT' AND day < (SELECT min(day) FROM ev WHERE event_type = 'M&A_announce' AND {IN18} AND upper(firm) = 'DCT')"),
    "b11_after_anchor": (_corporate("B.1.1", E="M&A_announce", F_anchor="dct", direction="after"), f"WITH {EV} SELECT {ANSWER} FROM ev WHERE event_type = 'M&A_announce' AND {IN18} AND upper(firm) <> 'DCT' AND day > (SELECT min(day) FROM ev WHERE event_type = 'M&A_announce' AND {IN18} AND upper(firm) = 'DCT')"),
    "b12_symmetric_gap": (_corporate("B.1.2", E1="CEO_change", E2="CFO_change", gap_days=30), _pairs_sql("CEO_change", "CFO_change", -30, 30, "d1 AS e1_anchor_date, d2 AS e2_anchor_date, abs(n) AS gap_days")),
    "b13_directional_lag": (_corporate("B.1.3", E_trigger="M&A_announce", E_followup="M&A_complete", lag_days=120), _pairs_sql("M&A_announce", "M&A_complete", 0, 120, "d1 AS e_trigger_anchor_date, d2 AS e_followup_anchor_date, n AS lag_days")),
    "b14_deal_pairing": (_deals, f"""WITH {DEALS} SELECT an.buyer AS buyer_ticker, an.target AS target_ticker, strftime(an.day, '%Y-%m-%d') AS announce_date, strftime(min(cm.day), '%Y-%m-%d') AS close_date
        FROM an JOIN cm ON (an.hint = cm.hint OR (an.buyer = cm.buyer AND an.target = cm.target)) AND date_diff('day', an.day, cm.day) BETWEEN 0 AND 90 WHERE an.day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1, 2, an.day"""),
    "b14_corporate": (_corporate("B.1.4", W_start="2014-01-01", W_end="2024-12-31", horizon_days=400), f"""WITH {EV}, {EC}, {EH}, x AS (SELECT DISTINCT e.event_type, e.day, b.ticker AS buyer, t.ticker AS target, hint FROM ev e LEFT JOIN (SELECT * FROM ec WHERE role = 'acquirer' AND ticker IS NOT NULL) b ON b.event_id = e.event_id LEFT JOIN (SELECT * FROM ec WHERE role = 'target' AND ticker IS NOT NULL) t ON t.event_id = e.event_id LEFT JOIN eh ON eh.event_id = e.event_id WHERE e.day IS NOT NULL)
        SELECT a.buyer AS buyer_ticker, a.target AS target_ticker, strftime(a.day, '%Y-%m-%d') AS announce_date, strftime(min(c.day), '%Y-%m-%d') AS close_date FROM x a JOIN x c ON (a.hint = c.hint OR (a.buyer = c.buyer AND a.target = c.target)) AND date_diff('day', a.day, c.day) BETWEEN 0 AND 400
        WHERE a.event_type = 'M&A_announce' AND c.event_type = 'M&A_complete' AND a.buyer IS NOT NULL AND a.target IS NOT NULL AND a.day BETWEEN DATE '2014-01-01' AND DATE '2024-12-31' GROUP BY 1, 2, a.day"""),
    "b15_days_between": (_corporate("B.1.5", F="DCT", E1="CEO_change", E2="CFO_change", W_start="2014-01-01", W_end="2024-12-31"), f"WITH {EV}, a AS (SELECT min(day) AS d1 FROM ev WHERE upper(firm) = 'DCT' AND event_type = 'CEO_change' AND day BETWEEN DATE '2014-01-01' AND DATE '2024-12-31'), b AS (SELECT d1, (SELECT min(day) FROM ev WHERE upper(firm) = 'DCT' AND event_type = 'CFO_change' AND day >= d1) AS d2 FROM a) SELECT 'DCT' AS firm_ticker, strftime(d1, '%Y-%m-%d') AS e1_anchor_date, strftime(d2, '%Y-%m-%d') AS e2_anchor_date, date_diff('day', d1, d2) AS days_between FROM b WHERE d1 IS NOT NULL AND d2 IS NOT NULL"),
    "b15_contract": (lambda s, d: T.b15_contract(corporate(s, d), {"W_start": "2014-01-01", "W_end": "2024-12-31", "F": "DCT", "E1": "CEO_change", "E2": "CFO_change"}), f"WITH {EV}, b AS (SELECT min(day) FILTER (WHERE event_type = 'CEO_change') AS d1, min(day) FILTER (WHERE event_type = 'CFO_change') AS d2 FROM ev WHERE upper(firm) = 'DCT' AND day BETWEEN DATE '2014-01-01' AND DATE '2024-12-31') SELECT 'DCT' AS firm_ticker, strftime(d1, '%Y-%m-%d') AS e1_anchor_date, strftime(d2, '%Y-%m-%d') AS e2_anchor_date, date_diff('day', d1, d2) AS days_between FROM b WHERE d1 IS NOT NULL AND d2 IS NOT NULL"),
    "b21_extremal_limit1": (lambda s, d: T.b21(corporate(s, d), {**Y18, "E": "CEO_change", "position": "first"}, ties=False), f"WITH {EV} SELECT {ANSWER} FROM ({CEO18}) ORDER BY day, firm, event_id LIMIT 1"),
    "b21_extremal_ties": (_corporate("B.2.1", E="CEO_change", position="last"), f"WITH {EV}, x AS ({CEO18}) SELECT {ANSWER} FROM x WHERE day = (SELECT max(day) FROM x)"),
    "b22_ordered_multitype": (_trade("B.2.2", F="C5", E_set=["1-URGENT", "5-LOW"], W_start="1990-01-01", W_end="2005-12-31"), f"WITH {TV}, {TC} SELECT {ANSWER}, CAST(row_number() OVER (ORDER BY day, event_type, event_id) AS INTEGER) AS position FROM ev WHERE event_type IN ('1-URGENT', '5-LOW') AND (upper(firm) = 'C5' OR event_id IN (SELECT event_id FROM ec WHERE upper(ticker) = 'C5'))"),
    "b31_intersection": (_corporate("B.3.1", E1="CEO_change", E2="IPO"), f"WITH {EV} SELECT DISTINCT firm AS firm_ticker FROM ({CEO18}) WHERE firm IN (SELECT firm FROM ev WHERE event_type = 'IPO' AND {IN18})"),
    "b32_dual_window_role": (_trade("B.3.2", E="1-URGENT", R="seller", W1_start="1997-01-01", W1_end="1997-03-31", W2_start="1997-04-01", W2_end="1997-06-30"), f"WITH {TV}, {TC}, x AS ({ROLE97} AND ec.role = 'seller' AND e.event_type = '1-URGENT') SELECT DISTINCT firm AS firm_ticker FROM x WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' AND firm IN (SELECT firm FROM x WHERE day BETWEEN DATE '1997-04-01' AND DATE '1997-06-30')"),
    "b33_cross_type_role": (_trade("B.3.3", E1="1-URGENT", E2="5-LOW", R="buyer", W_end="1997-12-31"), f"WITH {TV}, {TC}, x AS ({ROLE97} AND ec.role = 'acquirer' AND e.day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31') SELECT DISTINCT firm AS firm_ticker FROM x WHERE event_type = '1-URGENT' AND firm IN (SELECT firm FROM x WHERE event_type = '5-LOW')"),
    "b41_count_threshold": (_corporate("B.4.1", E="M&A_announce", N=3), f"WITH {EV} SELECT firm AS firm_ticker, count(*) AS n_events FROM ev WHERE event_type = 'M&A_announce' AND {IN18} AND firm IS NOT NULL GROUP BY firm HAVING count(*) >= 3"),
    "b42_role_count_threshold": (_trade("B.4.2", E="1-URGENT", R="buyer", N=3, W_start="1996-01-01", W_end="1998-12-31"), f"WITH {TV}, {TC}, x AS ({ROLE97} AND ec.role = 'acquirer' AND e.event_type = '1-URGENT' AND e.day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31') SELECT firm AS firm_ticker, count(DISTINCT event_id) AS n_events FROM x GROUP BY firm HAVING count(DISTINCT event_id) >= 3"),
    "b43_bucket_week": (_corporate("B.4.3", E="CEO_change", bucket_unit="week"), _bucket_sql("strftime(day, '%G-W%V')")),
    "b43_bucket_month": (_corporate("B.4.3", E="CEO_change", bucket_unit="month"), _bucket_sql("strftime(day, '%Y-%m')")),
    "b43_bucket_quarter": (_corporate("B.4.3", E="CEO_change", bucket_unit="quarter"), _bucket_sql("year(day) || '-Q' || quarter(day)")),
    "b44_type_union": (_corporate("B.4.4", E_set=["CEO_change", "CFO_change"]), f"WITH {EV} SELECT {ANSWER} FROM ev WHERE event_type IN ('CEO_change', 'CFO_change') AND {IN18} AND firm IS NOT NULL"),
    "provenance_urls": (_provenance, f"WITH {EV}, {ES} SELECT {ANSWER}, coalesce((SELECT string_agg(url, '|' ORDER BY url) FROM es WHERE es.event_id = x.event_id), '') AS cited_urls FROM (SELECT DISTINCT * FROM ev WHERE event_type = 'M&A_announce' AND firm IS NOT NULL AND day BETWEEN DATE '2014-01-01' AND DATE '2024-12-31') x"),
    "provenance_of_pairs": (_provenance_pairs, IDENTITY.format("'M&A_announce'", "'M&A_complete'", 0, 120) + " SELECT p.*, coalesce((SELECT string_agg(DISTINCT url, '|' ORDER BY url) FROM es WHERE es.event_id IN (p.id1, p.id2)), '') AS cited_urls FROM p"),
    "b12_by_identity": (lambda s, d: T.by_identity(corporate(s, d), {"W_start": "2014-01-01", "W_end": "2024-12-31"}, "CEO_change", "CFO_change", -30, 30), IDENTITY.format("'CEO_change'", "'CFO_change'", -30, 30) + " SELECT * FROM p"),
    "b13_by_identity": (lambda s, d: T.by_identity(corporate(s, d), {"W_start": "2014-01-01", "W_end": "2024-12-31"}, "M&A_announce", "M&A_complete", 0, 120), IDENTITY.format("'M&A_announce'", "'M&A_complete'", 0, 120) + " SELECT * FROM p"),
    "batch_params_join": (_batch, f"WITH {EV}, q(qid, e, a, b) AS (VALUES " + ", ".join(f"('{q}', '{e}', DATE '{a}', DATE '{b}')" for q, e, a, b in QUESTIONS) + f") SELECT qid, {ANSWER} FROM ev JOIN q ON event_type = e AND day BETWEEN a AND b WHERE firm IS NOT NULL"),
}

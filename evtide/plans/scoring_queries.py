"""Registered scoring queries with their SQL: gold is the answers of one question per event type and year, predictions are the same with shifted dates and missing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evtide.operators import scoring as S
from evtide.plans.views import ES, EV, corporate
from evtide.runtime import read


def gold(s: SparkSession, d: str) -> DataFrame:
    v = corporate(s, d)
    rows = v.events.where("firm is not null and day is not null").distinct().join(v.sources, "event_id", "left")
    qid = F.concat_ws("-", "event_type", F.year("day").cast("string"))
    return rows.groupBy(qid.alias("qid"), "firm", "event_type", "day").agg(F.array_sort(F.collect_set("url")).alias("urls"))


def pred(g: DataFrame) -> DataFrame:
    kept = g.where((F.dayofmonth("day") % 7 != 0) & (F.col("event_type") != "IPO"))
    urls = F.when(F.dayofmonth("day") % 3 == 0, F.array().cast("array<string>")).otherwise(F.col("urls"))
    return kept.withColumn("urls", urls).withColumn("day", F.date_add("day", F.dayofmonth("day") % 11))


GP = f"""{EV}, {ES}, g AS (SELECT event_type || '-' || year(day) AS qid, firm, event_type, day, coalesce(list_sort(list(DISTINCT url) FILTER (WHERE url IS NOT NULL)), []) AS urls
    FROM (SELECT DISTINCT * FROM ev WHERE firm IS NOT NULL AND day IS NOT NULL) e LEFT JOIN es ON e.event_id = es.event_id GROUP BY ALL),
p AS (SELECT qid, firm, event_type, day + CAST(day(day) % 11 AS INTEGER) AS day, CASE WHEN day(day) % 3 = 0 THEN [] ELSE urls END AS urls FROM g WHERE day(day) % 7 <> 0 AND event_type <> 'IPO')"""


def _hits(days: int, more: str = "") -> str:
    same = f"p.qid = g.qid AND p.firm = g.firm AND p.event_type = g.event_type AND abs(date_diff('day', g.day, p.day)) <= {days}{more}"
    return f"h AS (SELECT qid, EXISTS (SELECT 1 FROM p WHERE {same}) AS hit, EXISTS (SELECT 1 FROM p WHERE {same} AND list_has_any(p.urls, g.urls)) AS cited FROM g)"


RECALL = "SELECT qid, avg(CAST(hit AS INTEGER)) AS no_prov, avg(CAST(cited AS INTEGER)) AS with_prov FROM h GROUP BY qid"


def _recall(days: int):
    return lambda s, d: S.list_recall(g := gold(s, d), pred(g), days)


def _ordered(s: SparkSession, d: str) -> DataFrame:
    """One question per firm and year; positions follow the dates."""
    g = gold(s, d).withColumn("qid", F.concat_ws("-", "firm", F.year("day").cast("string")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("day", "event_type"))
    return S.list_recall(g.withColumn("pos", place), pred(g).withColumn("pos", place), S.TOLERANCE_DAYS, by_position=True)


def _spans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = corporate(s, d).events.where("firm is not null")
    ends = e.groupBy(F.col("firm").alias("qid")).agg(F.min(F.when(F.col("event_type") == "CEO_change", F.col("day"))).alias("d1"), F.min(F.when(F.col("event_type") == "CFO_change", F.col("day"))).alias("d2"))
    g = ends.where("d1 is not null and d2 is not null").withColumn("days", F.datediff("d2", "d1"))
    return g, g.select("qid", F.date_add("d1", F.dayofmonth("d1") % 11).alias("d1"), "d2", (F.col("days") - F.dayofmonth("d1") % 11).alias("days"))


SPANS = f"{EV}, g AS (SELECT firm AS qid, min(day) FILTER (WHERE event_type = 'CEO_change') AS d1, min(day) FILTER (WHERE event_type = 'CFO_change') AS d2 FROM ev WHERE firm IS NOT NULL GROUP BY firm), c AS (SELECT qid, day(d1) % 11 AS n FROM g WHERE d1 IS NOT NULL AND d2 IS NOT NULL)"


def _counts(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d)
    n = lambda x: x.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return S.exact_number(n(g), n(pred(g)))


def questions(g: DataFrame) -> DataFrame:
    """(qid, id, sub_axis, cap) of the questions: the event type, the year's parity and whether it concerns a deal stand in for the catalogue."""
    year = F.substring("qid", -4, 4).cast("int")
    return g.select("qid").distinct().select("qid", F.expr("substring(qid, 1, length(qid) - 5)").alias("id"), F.when(year % 2 == 0, "even").otherwise("odd").alias("sub_axis"), F.when(F.col("qid").startswith("M&A"), "A").otherwise("B").alias("cap"))


def _all_scores(s: SparkSession, d: str) -> DataFrame:
    g = gold(s, d)
    p = pred(g)
    return S.with_missing(S.list_recall(g, p, S.TOLERANCE_DAYS), questions(g), p)


ALL = f"{GP}, {_hits(7)}, r AS ({RECALL}), a AS (SELECT r.qid, substring(r.qid, 1, length(r.qid) - 5) AS id, CASE WHEN CAST(right(r.qid, 4) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS sub_axis, CASE WHEN r.qid LIKE 'M&A%' THEN 'A' ELSE 'B' END AS cap, CASE WHEN r.qid IN (SELECT qid FROM p) THEN no_prov ELSE 0.0 END AS no_prov, CASE WHEN r.qid IN (SELECT qid FROM p) THEN with_prov END AS with_prov FROM r)"

TABLE: dict[str, tuple[object, str]] = {
    "score_strict_list": (_recall(0), f"WITH {GP}, {_hits(0)} {RECALL}"),
    "score_tolerant_list": (_recall(S.TOLERANCE_DAYS), f"WITH {GP}, {_hits(7)} {RECALL}"),
    "score_with_prov": (lambda s, d: _recall(S.TOLERANCE_DAYS)(s, d).where("with_prov > 0").select("qid", "with_prov"), f"WITH {GP}, {_hits(7)} SELECT qid, with_prov FROM ({RECALL}) WHERE with_prov > 0"),
    "score_positional": (_ordered, f"WITH {GP.replace('g AS (', 'g0 AS (', 1).replace('p AS (SELECT qid', 'p0 AS (SELECT qid', 1).replace('FROM g WHERE', 'FROM g0 WHERE', 1)}, g AS (SELECT firm || '-' || year(day) AS qid, firm, event_type, day, urls, row_number() OVER (PARTITION BY firm, year(day) ORDER BY day, event_type) AS pos FROM g0), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY day, event_type) AS pos FROM (SELECT firm || '-' || year(day) AS qid, firm, event_type, day + CAST(day(day) % 11 AS INTEGER) AS day, CASE WHEN day(day) % 3 = 0 THEN [] ELSE urls END AS urls FROM g0 WHERE day(day) % 7 <> 0 AND event_type <> 'IPO')), {_hits(7, ' AND p.pos = g.pos')} {RECALL}"),
    "score_composite": (lambda s, d: S.composite(*_spans(s, d), tolerant=True), f"WITH {SPANS} SELECT qid, CASE WHEN n <= 7 AND n <= 14 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM c"),
    "score_composite_strict": (lambda s, d: S.composite(*_spans(s, d), tolerant=False), f"WITH {SPANS} SELECT qid, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM c"),
    "score_int_empty": (_counts, f"WITH {GP}, n AS (SELECT qid, count(*) AS n FROM g GROUP BY qid), m AS (SELECT qid, count(*) AS m FROM p GROUP BY qid) SELECT n.qid, CAST(n.n = coalesce(m.m, 0) AS DOUBLE) AS int_match, CAST(CASE WHEN n.n = 0 THEN coalesce(m.m, 0) = 0 END AS DOUBLE) AS empty_check FROM n LEFT JOIN m ON n.qid = m.qid"),
    "score_missing": (_all_scores, f"WITH {ALL} SELECT * FROM a"),
    "score_summary_grouping_sets": (lambda s, d: S.summary(_all_scores(s, d)), f"WITH {ALL} SELECT CASE grouping(id, sub_axis, cap) WHEN 3 THEN 'id' WHEN 5 THEN 'sub_axis' WHEN 6 THEN 'cap' ELSE 'overall' END AS level, coalesce(id, sub_axis, cap, 'all') AS name, count(*) AS n, avg(no_prov) AS no_prov, count(with_prov) AS n_prov, avg(with_prov) AS with_prov FROM a GROUP BY GROUPING SETS ((id), (sub_axis), (cap), ())"),
    "score_legacy_one_to_one": (lambda s, d: S.one_to_one(g := gold(s, d), pred(g)), ""),
    "date_multi_format": (lambda s, d: read(s, d, "prediction").select("prediction_id", S.lenient_date(F.col("anchor_date")).alias("day")).where("day is not null").distinct(), r"WITH t AS (SELECT DISTINCT prediction_id, trim(anchor_date) AS t FROM prediction), u AS (SELECT prediction_id, CASE WHEN regexp_matches(t, '^\d{8}') THEN try_strptime(left(t, 8), '%Y%m%d') WHEN regexp_matches(t, '^\d{4}-\d{1,2}-\d{1,2}([^0-9]|$)') THEN try_strptime(regexp_extract(t, '^\d{4}-\d{1,2}-\d{1,2}'), '%Y-%m-%d') WHEN regexp_matches(t, '^\d{4}/\d{1,2}/\d{1,2}([^0-9]|$)') THEN try_strptime(regexp_extract(t, '^\d{4}/\d{1,2}/\d{1,2}'), '%Y/%m/%d') WHEN regexp_matches(t, '^\d{4}\.\d{1,2}\.\d{1,2}([^0-9]|$)') THEN try_strptime(regexp_extract(t, '^\d{4}\.\d{1,2}\.\d{1,2}'), '%Y.%m.%d') END AS d FROM t) SELECT prediction_id, CAST(d AS DATE) AS day FROM u WHERE d IS NOT NULL"),
}

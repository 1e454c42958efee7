"""The queries of the core and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evtide.operators import compaction, timestamp_sql, timestamps, units
from evtide.plans import canonical_queries, pipeline_queries, scoring_queries, template_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p3_found": units.p3_found,
    "p5_found": compaction.p5_found,
    "p5_plan": compaction.p5_plan,
    "p7_found": timestamps.p7_found,
    "p7_posteriors": timestamps.p7_posteriors,
}
#: A flat JSON object, braces inside its strings included.
_OBJECT = r"""\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}"""


def _word(*spellings: str) -> str:
    return f"'(^|[^\\p{{L}}])({'|'.join(spellings)})([^\\p{{L}}]|$)'"


def _currency(t: str) -> str:
    """The currency a spelling names, in SQL: the kinds of dollar before the plain one."""
    kinds = {"CAD": ("cad", r"c\$", "canadian dollars"), "AUD": ("aud", r"a\$", "australian dollars"), "USD": ("usd", r"us\$", r"\$", "dollars", r"u\.s\. dollars", "us cents"), "EUR": ("eur", "€", "euros?"), "GBP": ("gbp", "£", "pounds sterling", "stg", "p", "pence", "gbx"), "JPY": ("jpy", "¥", "yen"), "INR": ("inr", "₹", r"rs\.?", "rupees"), "CHF": ("chf", "sfr", "swiss francs")}
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({t}), {_word(*w)}) THEN '{c}'" for c, w in kinds.items()) + " END"


def _scale(t: str) -> str:
    kinds = {"1e12": ("trillion", "tn", "trn"), "1e9": ("billion", "bn", "bln", "b", "mrd"), "1e6": ("millions?", "mn", "mm", "m", "mio"), "1e7": ("crore", "cr"), "1e5": ("lakh",), "1e3": ("thousands?", "k", "000s"), "1": ("units?", "ones")}
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({t}), {_word(*w)}) THEN CAST({v} AS DECIMAL(13, 0))" for v, w in kinds.items()) + " END"


def _figure(t: str) -> str:
    raw = f"regexp_extract(regexp_replace({t}, '000s', ''), '[0-9][0-9.,]*[0-9]|[0-9]')"
    plain = f"CASE WHEN regexp_matches({raw}, '^[0-9]{{1,3}}(,[0-9]{{2,3}})*,[0-9]{{3}}(\\.[0-9]+)?$') THEN replace({raw}, ',', '') ELSE replace({raw}, ',', '.') END"
    words = {"forty": "40", "two": "2", "one and a half": "1.5", "half a": "0.5", "a quarter of a": "0.25", "three hundred": "300"}
    return f"coalesce(TRY_CAST({plain} AS DECIMAL(30, 8)), " + "CASE " + " ".join(f"WHEN {t} LIKE '{w} %' THEN {v}" for w, v in words.items()) + " END)"


_P3 = f"""WITH m AS (SELECT DISTINCT event_id, deal_value_amount AS a, deal_value_currency AS c, deal_value_scale AS s, deal_value_text AS t, per_share_price_amount AS pa, per_share_price_text AS pt FROM ma_details),
u AS (SELECT *, {_figure('t')} AS tf, {_figure('pt')} AS pf, {_currency('t')} AS tc, {_currency('c')} AS cc, {_currency('pt')} AS pc, {_scale('t')} AS ts, {_scale('s')} AS cs FROM m),
w AS (SELECT *, coalesce(tc, cc, 'USD') AS cur, coalesce(tf, CASE WHEN a > 0 AND NOT isnan(a) THEN CAST(a AS DECIMAL(30, 8)) END) AS fig, coalesce(ts, CASE WHEN tf IS NOT NULL THEN 1 END, cs, 1) AS sc, coalesce(pf, CASE WHEN pa > 0 AND NOT isnan(pa) THEN CAST(pa AS DECIMAL(30, 8)) END) AS pfig, CASE WHEN regexp_matches(lower(pt), {_word('cents', 'p', 'pence', 'gbx')}) THEN 1 ELSE 100 END AS minor FROM u),
x AS (SELECT event_id, 'deal_value' AS field_name, CAST(round(CAST(fig AS DECIMAL(20, 4)) * CAST(sc AS DECIMAL(13, 0)) * CAST(usd_per_unit AS DECIMAL(4, 3))) AS BIGINT) AS usd_value, a AS was FROM w JOIN fx_rate ON currency = cur
  UNION ALL SELECT event_id, 'per_share_price', CAST(round(CAST(pfig AS DECIMAL(20, 4)) * CAST(minor AS DECIMAL(3, 0)) * CAST(usd_per_unit AS DECIMAL(4, 3))) AS BIGINT), round(pa * 100, 4) FROM w JOIN fx_rate ON currency = coalesce(pc, cur))
SELECT DISTINCT event_id, field_name, usd_value FROM x WHERE usd_value > 0 AND NOT coalesce(CAST(usd_value AS DOUBLE) = was, false)"""

ORACLES: dict[str, str] = {
    "p3_found": _P3,
    "p7_found": timestamp_sql.SQL,
    "p5_plan": f"WITH m AS (SELECT file_id, greatest(coalesce(n_bytes, 0), 0) AS b, file_path AS p FROM article_files), t AS (SELECT greatest({compaction.SMALLEST}, least({compaction.LARGEST}, ceil(sum(b) / {compaction.LEAST_GROUPS}))) AS t FROM m), g AS (SELECT b, CAST((sum(b) OVER (ORDER BY p, file_id ROWS UNBOUNDED PRECEDING) - b) // CAST((SELECT t FROM t) AS BIGINT) AS BIGINT) AS grp FROM m) SELECT grp, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes FROM g GROUP BY grp",
    "p5_found": f"WITH r AS (SELECT unnest(regexp_extract_all(content, '{_OBJECT}')) AS j FROM article_files), v AS (SELECT j FROM r WHERE json_valid(j)) SELECT DISTINCT json_extract_string(j, '$.article_id') AS article_id, CAST(json_extract_string(j, '$.attempt') AS BIGINT) AS attempt FROM v WHERE trim(json_extract_string(j, '$.article_id')) <> ''",
}
for _table in (template_queries.TABLE, canonical_queries.TABLE, scoring_queries.TABLE, pipeline_queries.TABLE):
    for _name, (_query, _sql) in _table.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql

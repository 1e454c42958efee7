"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from evtide.llm import grouping, leaks, mixing, names, pii, splitting, survivorship

QUERIES = {
    "p1_found": grouping.p1_found,
    "p2_found": survivorship.p2_found,
    "p2_survivors": survivorship.p2_survivors,
    "p4_found": names.p4_found,
    "p6_found": splitting.p6_found,
    "p6_pieces": splitting.p6_pieces,
    "p8_found": leaks.p8_found,
    "p8_near": leaks.p8_near,
    "p9_found": mixing.p9_found,
    "p9_mix": mixing.p9_mix,
    "p9_report": mixing.p9_report,
    "p10_found": pii.p10_found,
    "p10_redacted": pii.p10_redacted,
}

_BLANK = r"E' \t\n\r'"
_KNOWN = "NOT IN ('', 'n/a', 'unknown', 'none', '-', 'null', 'tbd') AND NOT regexp_matches({c}, '^0+$')"
_LINKS = f"""WITH RECURSIVE fa AS (SELECT firm_id AS id, lower(trim(atom_value, {_BLANK})) AS c, atom_type AS t FROM firm_alias WHERE firm_id IS NOT NULL),
    k AS (SELECT 'f' || id AS id, t || ':' || CASE WHEN t = 'cik' THEN regexp_replace(c, '^0+(.)', '\\1') ELSE c END AS k FROM fa WHERE c {_KNOWN.format(c='c')}
    UNION SELECT 'e' || event_id, 'd:' || lower(trim(deal_id, {_BLANK})) FROM corp_events WHERE event_type LIKE 'M&A%' AND lower(trim(deal_id, {_BLANK})) {_KNOWN.format(c=f'trim(deal_id, {_BLANK})')}
    UNION SELECT 'e' || event_id, 'h:' || lower(trim(cluster_key_hint, {_BLANK})) FROM ma_details WHERE event_id IN (SELECT event_id FROM corp_events WHERE event_type LIKE 'M&A%') AND lower(trim(cluster_key_hint, {_BLANK})) {_KNOWN.format(c=f'trim(cluster_key_hint, {_BLANK})')}),
    e AS (SELECT k.id AS a, h.id AS b FROM k JOIN (SELECT k, min(id) AS id FROM k GROUP BY k) h ON k.k = h.k WHERE k.id <> h.id), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, x) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.id, s.b FROM r JOIN s ON r.x = s.a), g AS (SELECT id, min(x) AS m FROM r GROUP BY id)
    SELECT CASE WHEN id LIKE 'f%' THEN 'firm' ELSE 'event' END AS node_kind, substr(m, 2) AS group_id, substr(id, 2) AS member_id FROM g WHERE id <> m"""
_LONG = "[^\\s\\p{Z}]{1000}" * 6 + "[^\\s\\p{Z}]"

_FOLD = r"""list_filter(regexp_split_to_array(lower(strip_accents(translate(regexp_replace(regexp_replace({t}, '</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|''[^''<>]*''|[^\s"''<>=]+))*\s*/?>|<!--[^<>]*-->|&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z]+);', ' ', 'g'), '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{FE0F}}]', '', 'g'), '𝔞еоасрх', 'aeoacpx'))), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"""


def _runs(name: str, id_column: str, text: str, table: str) -> str:
    return f"{name}w AS (SELECT {id_column} AS id, {_FOLD.format(t=text)} AS w FROM {table} WHERE {text} <> ''), {name} AS (SELECT DISTINCT id, array_to_string(w[i:i + 12], ' ') AS run FROM (SELECT id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM {name}w WHERE len(w) > 12))"


ORACLES: dict[str, str] = {
    "p8_found": f"WITH {_runs('d', 'doc_id', 'text', 'documents')}, {_runs('i', 'item_id', 'item_text', 'eval_item')} SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM d JOIN i ON d.run = i.run",
    "p1_found": _LINKS,
    "p2_found": f"""WITH m AS (SELECT DISTINCT g.group_id, e.event_id, e.loaded_at, e.event_date_value AS d,
        CASE lower(trim(e.event_date_precision, {_BLANK})) WHEN 'day' THEN 0 WHEN 'month' THEN 1 WHEN 'quarter' THEN 2 WHEN 'year' THEN 3 WHEN 'approximate' THEN 3 ELSE 4 END AS p,
        CASE WHEN json_valid(e.headline_summaries) AND json_type(e.headline_summaries) = 'ARRAY' THEN list_max(list_transform(from_json(e.headline_summaries, '["VARCHAR"]'), lambda x: length(trim(x, {_BLANK})))) END AS h, e.raw_extraction_count AS n,
        EXISTS (SELECT 1 FROM ma_details a WHERE a.event_id = e.event_id AND a.deal_value_amount > 0 AND NOT isnan(a.deal_value_amount)) AS v FROM dup_group g JOIN corp_events e ON g.event_id = e.event_id),
    r AS (SELECT group_id, event_id, 'event_date' AS field_name, p AS k, loaded_at FROM m WHERE d IS NOT NULL UNION ALL SELECT group_id, event_id, 'deal_value', 0, loaded_at FROM m WHERE v
        UNION ALL SELECT group_id, event_id, 'headline', -h, loaded_at FROM m WHERE h > 0 UNION ALL SELECT group_id, event_id, 'extraction', -n, loaded_at FROM m WHERE n IS NOT NULL)
    SELECT group_id, field_name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY k, loaded_at DESC NULLS LAST, event_id) AS i FROM r) WHERE i = 1""",
    "p6_found": f"""WITH t AS (SELECT 'documents' AS source_table, CAST(doc_id AS VARCHAR) AS item_id, text FROM documents UNION SELECT 'mna', article_id, article_text FROM mna)
    SELECT source_table, item_id, CASE WHEN bool_or(regexp_matches(text, '{_LONG}')) THEN 'forced' ELSE 'natural' END AS cut_kind FROM t WHERE length(text) > 6000 GROUP BY ALL""",
}

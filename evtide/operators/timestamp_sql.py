"""The SQL that p7_found must agree with: an independent reading of the same notations."""

SQL = r"""
WITH v AS (SELECT 'event' AS record_kind, event_id AS record_id, event_date_text AS raw, source_zone AS place FROM corp_events UNION ALL SELECT 'prediction', prediction_id, anchor_date, NULL FROM prediction),
t AS (SELECT DISTINCT *, trim(regexp_replace(raw, '[\s\x{A0}]+', ' ', 'g'), ' ') AS t FROM v WHERE raw IS NOT NULL),
f AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{8}$') THEN regexp_extract(t, '^(\d{4})(\d{2})(\d{2})$', ['y', 'm', 'd'])
    WHEN regexp_matches(t, '^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T \[]|$)') THEN regexp_extract(t, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})', ['y', 'm', 'd'])
    WHEN regexp_matches(t, '^\d{1,2}/\d{1,2}/\d{4}') AND place LIKE 'America/%' THEN regexp_extract(t, '^(\d{1,2})/(\d{1,2})/(\d{4})', ['m', 'd', 'y'])
    WHEN regexp_matches(t, '^\d{1,2}[/.]\d{1,2}[/.]\d{4}') THEN regexp_extract(t, '^(\d{1,2})[/.](\d{1,2})[/.](\d{4})', ['d', 'm', 'y'])
    WHEN regexp_matches(t, '(^|[^\d])\d{1,2}(st|nd|rd|th)?( of)?[ -][A-Z][A-Za-z]{2,8}[ -]\d{4}') THEN regexp_extract(t, '(\d{1,2})(?:st|nd|rd|th)?(?: of)?[ -]([A-Z][A-Za-z]{2})[A-Za-z]*[ -](\d{4})', ['d', 'm', 'y'])
    WHEN regexp_matches(t, '[A-Z][A-Za-z]{2,8}\.? \d{1,2}(st|nd|rd|th)?,? \d{4}') THEN regexp_extract(t, '([A-Z][A-Za-z]{2})[A-Za-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})', ['m', 'd', 'y']) END AS x,
    CASE WHEN regexp_matches(t, '^\d{4} [A-Z]+ on ') THEN regexp_extract(t, '^(\d{2})(\d{2})()', ['h', 'n', 's']) WHEN regexp_matches(t, '^\d{1,2}:\d{2}') THEN regexp_extract(t, '^(\d{1,2}):(\d{2})(?::(\d{2}))?', ['h', 'n', 's']) WHEN regexp_matches(t, '[T ]\d{1,2}[:.]\d{2}([^\d]|$)') THEN regexp_extract(t, '[T ](\d{1,2})[:.](\d{2})(?::(\d{2}))?', ['h', 'n', 's']) END AS c,
    lower(regexp_extract(t, '\d ?([AaPp])\.?[Mm](?:\b|\.)', 1)) AS half,
    coalesce(nullif(regexp_extract(t, '\d([+-]\d{2}:?\d{2})$| ([+-]\d{2}:?\d{2})$', 1), ''), nullif(regexp_extract(t, ' ([+-]\d{4})$', 1), ''), nullif(regexp_extract(t, '([A-Z][A-Za-z]+/[A-Za-z_]+)\]?$', 1), ''), nullif(regexp_extract(t, '(?:[\d \[])(Z|UTC|GMT|BST|CEST|CET|EST|EDT|CST|CDT|PST|PDT|JST|IST|AEST|AEDT|ET|Eastern)\]?( |$)', 1), '')) AS z FROM t),
g AS (SELECT *, TRY_CAST(x.y || '-' || lpad(coalesce(CASE lower(x.m) WHEN 'jan' THEN '1' WHEN 'feb' THEN '2' WHEN 'mar' THEN '3' WHEN 'apr' THEN '4' WHEN 'may' THEN '5' WHEN 'jun' THEN '6' WHEN 'jul' THEN '7' WHEN 'aug' THEN '8' WHEN 'sep' THEN '9' WHEN 'oct' THEN '10' WHEN 'nov' THEN '11' WHEN 'dec' THEN '12' END, x.m), 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE) AS day,
    TRY_CAST(c.h AS INTEGER) % CASE half WHEN '' THEN 24 ELSE 12 END + CASE half WHEN 'p' THEN 12 ELSE 0 END AS h FROM f),
l AS (SELECT *, CAST(day AS TIMESTAMP) + to_seconds(h * 3600 + CAST(c.n AS INTEGER) * 60 + coalesce(TRY_CAST(c.s AS INTEGER), 0)) AS local,
    CASE WHEN regexp_matches(z, '^[+-]') THEN CAST(z[1] || '1' AS INTEGER) * (CAST(z[2:3] AS INTEGER) * 60 + CAST(right(z, 2) AS INTEGER)) ELSE map {'Z': 0, 'UTC': 0, 'GMT': 0, 'BST': 60, 'CET': 60, 'CEST': 120, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'PST': -480, 'PDT': -420, 'JST': 540, 'IST': 330, 'AEST': 600, 'AEDT': 660}[z] END AS minutes,
    CASE WHEN z IN ('ET', 'Eastern') THEN 'America/New_York' WHEN z LIKE '%/%' THEN z WHEN z IS NULL THEN coalesce(place, 'UTC') END AS zn FROM g),
i AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{10}$') THEN make_timestamp(CAST(t AS BIGINT) * 1000000) WHEN regexp_matches(t, '^\d{13}$') THEN make_timestamp(CAST(t AS BIGINT) // 1000 * 1000000)
    WHEN minutes IS NOT NULL THEN local - to_minutes(minutes) WHEN zn = 'UTC' THEN local ELSE timezone('UTC', CASE WHEN timezone(zn, timezone(zn, local) - INTERVAL 1 HOUR) = local THEN timezone(zn, local) - INTERVAL 1 HOUR ELSE timezone(zn, local) END) END AS instant FROM l),
o AS (SELECT record_kind, record_id, raw, coalesce(strftime(instant, '%Y-%m-%dT%H:%M:%SZ'), CASE WHEN c IS NULL THEN strftime(day, '%Y-%m-%d') END) AS utc_value FROM i)
SELECT DISTINCT record_kind, record_id, utc_value FROM o WHERE utc_value IS NOT NULL AND utc_value <> raw
"""

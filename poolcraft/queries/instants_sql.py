"""Problem 3 in SQL: a reading of its own, by splitting a value into date, time and zone, that the cascade of patterns must agree with."""

from __future__ import annotations

_BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}]"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?"
_TAIL = r"^(.*?)(?:(?:,?\s+|[Tt]\s*)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:([AaPp])\.?[Mm]\.?)?\s*\[?([Zz]|[+-]\d{2}(?:[:'']?\d{2}''?)?|[A-Z]{3,4}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?\]?)?$"


def instants(values: str) -> str:
    """CTEs up to ``instant`` (the columns of ``values``, us): ``values`` names a CTE with value, tz_name and date_order; us is null where a value can't be read."""
    return rf"""
clean AS (SELECT *, regexp_replace(value, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t0 FROM {values}),
-- File metadata, compact and ctime spellings become the plain one.
plain AS (SELECT *, CASE
    WHEN regexp_full_match(t0, '(?i)D:\d{{8}}(?:\d{{4}}(?:\d{{2}})?)?(?:z(?:00''?(?:00''?)?)?|[+-]\d{{2}}(?:''?\d{{2}}''?)?)?')
        THEN regexp_replace(regexp_replace(regexp_replace(t0, '(?i)z(?:00''?(?:00''?)?)?$', 'Z'), '(?i)^D:(\d{{4}})(\d{{2}})(\d{{2}})(\d{{2}})(\d{{2}})(\d{{2}})?', '\1-\2-\3 \4:\5:\6'), '(?i)^D:(\d{{4}})(\d{{2}})(\d{{2}})', '\1-\2-\3')
    WHEN regexp_matches(t0, '(?i)^\d{{8}}t\d{{4}}') THEN regexp_replace(t0, '(?i)^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?', '\1-\2-\3 \4:\5:\6')
    WHEN regexp_matches(t0, '{_CLOCK}(?:\s+\S+)?\s+\d{{4}}$') THEN regexp_replace(t0, '^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3,9}})\s+(\d{{1,2}})\s+({_CLOCK})(\s+\S+)?\s+(\d{{4}})$', '\1 \2, \5 \3\4')
    ELSE t0 END AS t1 FROM clean),
split AS (SELECT * EXCLUDE (t1), regexp_replace(t1, '(:\d{{2}}):([^\d]|$)', '\1\2') AS t FROM plain),
cut AS (SELECT *, regexp_extract(t, '{_TAIL}', ['d', 'h', 'mi', 's', 'f', 'ap', 'z']) AS p FROM split),
dated AS (SELECT *, CASE
    WHEN regexp_full_match(p.d, '\d{{4}}-\d{{2}}-\d{{2}}') THEN [p.d[1:4], p.d[6:7], p.d[9:10]]
    WHEN regexp_full_match(p.d, '\d{{1,2}}/\d{{1,2}}/(?:\d{{4}}|\d{{2}})') AND date_order = 'mdy' THEN [split_part(p.d, '/', 3), split_part(p.d, '/', 1), split_part(p.d, '/', 2)]
    WHEN regexp_full_match(p.d, '\d{{1,2}}/\d{{1,2}}/(?:\d{{4}}|\d{{2}})') AND date_order = 'dmy' THEN [split_part(p.d, '/', 3), split_part(p.d, '/', 2), split_part(p.d, '/', 1)]
    WHEN regexp_full_match(p.d, '\d{{1,2}}\.\d{{1,2}}\.(?:\d{{4}}|\d{{2}})') THEN [split_part(p.d, '.', 3), split_part(p.d, '.', 2), split_part(p.d, '.', 1)]
    WHEN regexp_full_match(p.d, '(?:[A-Za-z]{{3,9}},?\s+)?\d{{1,2}}\s+[A-Za-z]{{3,9}}\s+\d{{4}}') THEN [p.d[-4:], regexp_extract(p.d, '([A-Za-z]+)\s+\d{{4}}$', 1), regexp_extract(p.d, '(\d{{1,2}})\s+[A-Za-z]', 1)]
    WHEN regexp_full_match(p.d, '(?:[A-Za-z]{{3,9}},?\s+)?[A-Za-z]{{3,9}}\s+\d{{1,2}},\s*\d{{4}}') THEN [p.d[-4:], regexp_extract(p.d, '([A-Za-z]+)\s+\d{{1,2}},', 1), regexp_extract(p.d, '(\d{{1,2}}),', 1)]
    END AS ymd FROM cut),
named AS (SELECT *, CASE WHEN len(ymd[1]) = 2 THEN '20' || ymd[1] ELSE ymd[1] END AS y, coalesce(TRY_CAST(ymd[2] AS INT), (list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(ymd[2][1:3])))) AS mo,
    TRY_CAST(nullif(p.h, '') AS INT) AS h FROM dated),
hours AS (SELECT *, CASE WHEN p.h = '' THEN 0 WHEN p.ap = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN lower(p.ap) = 'p' THEN 12 ELSE 0 END END AS hour FROM named),
wall AS (SELECT *, TRY_CAST(y || printf('-%02d-', mo) || lpad(ymd[3], 2, '0') || printf(' %02d:', hour) || CASE WHEN p.mi = '' THEN '00' ELSE p.mi END || ':' || CASE WHEN p.s = '' THEN '00' ELSE p.s END
    || '.' || rpad(p.f[1:6], 6, '0') AS TIMESTAMP) AS w, CASE WHEN p.z = '' THEN tz_name WHEN contains(p.z, '/') THEN p.z END AS place,
    CASE WHEN upper(p.z) = 'Z' THEN 0 WHEN p.z[1] IN ('+', '-') THEN (CASE WHEN p.z[1] = '-' THEN -1 ELSE 1 END) * (p.z[2:3]::INT * 60 + coalesce(TRY_CAST(regexp_extract(p.z[4:], '(\d{{2}})', 1) AS INT), 0))
        ELSE CASE p.z WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CST' THEN -360 WHEN 'CDT' THEN -300 WHEN 'PST' THEN -480 WHEN 'PDT' THEN -420 WHEN 'GMT' THEN 0 WHEN 'UTC' THEN 0 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 END END AS away FROM hours),
late AS (SELECT *, CASE WHEN place IN (SELECT name FROM pg_timezone_names()) THEN timezone(place, w) END AS i FROM wall),
instant AS (SELECT * EXCLUDE (t0, t, p, ymd, y, mo, h, hour, w, place, away, i), CASE WHEN regexp_full_match(t0, '\d{{1,16}}(?:\.\d{{1,9}})?') THEN CASE
        WHEN t0::DECIMAL(38, 9) BETWEEN 1577836800 AND 1924991999.999999999 THEN floor(t0::DECIMAL(28, 9) * 1000000)::BIGINT
        WHEN t0::DECIMAL(38, 9) BETWEEN 1577836800000 AND 1924991999999.999999999 THEN floor(t0::DECIMAL(28, 9) * 1000)::BIGINT
        WHEN t0::DECIMAL(38, 9) BETWEEN 1577836800000000 AND 1924991999999999.999999999 THEN floor(t0::DECIMAL(28, 9))::BIGINT END
    WHEN away IS NOT NULL THEN epoch_us(w) - away * 60000000::BIGINT
    -- Of a time that occurs twice the earlier instant.
    WHEN timezone(place, i - INTERVAL 1 HOUR) = w THEN epoch_us(i - INTERVAL 1 HOUR) WHEN timezone(place, i - INTERVAL 30 MINUTE) = w THEN epoch_us(i - INTERVAL 30 MINUTE) ELSE epoch_us(i) END AS us FROM late)"""


FOUND = rf"""WITH pieces AS (SELECT 'candidates' AS src, id, opening_id, unnest(['created_date', 'updated_date']) AS field, unnest([created_date, updated_date]) AS value FROM candidates
    UNION ALL SELECT 'parsed', id, opening_id, unnest(['created', 'modified']), unnest([meta.created, meta.modified]) FROM parsed),
v AS (SELECT pieces.*, tz_name, date_order FROM pieces LEFT JOIN openings USING (opening_id) WHERE value IS NOT NULL), {instants("v")}
SELECT DISTINCT src, id, field, us AS epoch_us FROM instant WHERE us IS NOT NULL AND id IS NOT NULL"""

"""The check of verdicts in SQL: the same JSON is put together from the assessments, then read with JSON functions and judged by the rules, not by how it was made."""

from __future__ import annotations

_RAW = """CASE id % 15 WHEN 10 THEN '[]' WHEN 14 THEN 'no json {' ELSE '{"redflag":{"flags":[{"tier":' || CASE id % 15 WHEN 8 THEN '4' ELSE '2' END || ',"kind":"","quote":"' || q || '"}' || CASE id % 15 WHEN 12 THEN ',7' ELSE '' END
    || ']},"fit":{"scores":{"depth":' || CASE id % 15 WHEN 11 THEN '5' ELSE '{"score":' || CASE id % 15 WHEN 1 THEN '"x"' WHEN 2 THEN '-1' WHEN 3 THEN '61' WHEN 4 THEN '"NaN"' ELSE (id % 60)::VARCHAR || '.5' END || ',"quote":"' || q || '"}' END
    || ',"' || CASE id % 15 WHEN 7 THEN 'width' ELSE 'breadth' END || '":{"score":0,"quote":""}},"bonus":' || CASE id % 15 WHEN 13 THEN 'null' ELSE '{"points":' || CASE id % 15 WHEN 9 THEN '9' ELSE '1' END || ',"justification":"wide"}' END || '}}' END"""


def _squeezed(x: str) -> str:
    return rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


def verdicts(rows: str, keys: str) -> str:
    """CTEs up to ``verdict`` (keys, errors, warnings, fit, flags, bonus, depth, breadth) of the CTE ``rows`` (keys with id)."""
    said = f"{_squeezed('x.quote')} <> '' AND contains({_squeezed('text')}, {_squeezed('x.quote')})"
    return f"""
told AS (SELECT {keys}, CASE id % 15 WHEN 5 THEN 'never said' WHEN 6 THEN '' ELSE 'BUILT pipelines' END AS q, 'CV of ' || id || ': built   pipelines' AS text FROM {rows}),
made AS (SELECT {keys}, text, TRY_CAST({_RAW} AS JSON) AS j FROM told),
shaped AS (SELECT *, coalesce(json_type(j, '$.redflag') = 'OBJECT' AND json_type(j, '$.fit') = 'OBJECT' AND json_type(j, '$.fit.scores') = 'OBJECT', false) AS fine, coalesce(json_keys(j, '$.fit.scores'), []) AS given,
    TRY_CAST(j->>'$.fit.bonus.points' AS DOUBLE) AS points, coalesce(trim(j->>'$.fit.bonus.justification'), '') AS reason FROM made),
listed AS (SELECT *, list_filter(list_transform(['breadth', 'depth'], lambda c: {{'key': c, 'there': coalesce(json_type(j, '$.fit.scores.' || c) = 'OBJECT', false), 'score': TRY_CAST(j->>('$.fit.scores.' || c || '.score') AS DOUBLE),
        'quote': coalesce(j->>('$.fit.scores.' || c || '.quote'), ''), 'top': CASE c WHEN 'depth' THEN 60 ELSE 40 END}}), lambda x: x.there) AS n,
    list_transform(coalesce(json_extract(j, '$.redflag.flags[*]'), []), lambda f: {{'object': coalesce(json_type(f) = 'OBJECT', false), 'tier': TRY_CAST(f->>'$.tier' AS DOUBLE), 'kind': coalesce(nullif(f->>'$.kind', ''), 'unspecified'), 'quote': coalesce(f->>'$.quote', '')}}) AS f FROM shaped),
wrong AS (SELECT *, CASE WHEN NOT fine THEN ['not an object'] ELSE flatten([
    list_transform(list_filter(['breadth', 'depth'], lambda c: NOT list_contains(given, c)), lambda c: 'missing: ' || c), list_transform(list_sort(list_filter(given, lambda c: c NOT IN ('breadth', 'depth'))), lambda c: 'unknown: ' || c),
    list_transform(list_filter(n, lambda x: x.score IS NULL OR isnan(x.score) OR x.score < 0 OR x.score > x.top), lambda x: 'score: ' || x.key),
    CASE WHEN (j->>'$.fit.bonus.points') IS NOT NULL AND (points IS NULL OR isnan(points) OR points < 0 OR points > 5) THEN ['bonus'] WHEN points > 0 AND reason = '' THEN ['bonus: no reason'] ELSE [] END,
    list_transform(list_filter(f, lambda x: NOT x.object OR x.tier IS NULL OR trunc(x.tier) NOT IN (1, 2, 3) OR trim(x.quote) = ''), lambda x: 'flag: ' || CASE WHEN x.object THEN x.kind ELSE 'not an object' END)]) END AS errors FROM listed),
kept AS (SELECT *, len(errors) = 0 AS ok, list_transform(n, lambda x: {{'key': x.key, 'score': CASE WHEN x.score > 0 AND NOT ({said}) THEN 0.0 ELSE x.score END, 'zeroed': x.score > 0 AND NOT ({said})}}) AS s,
    list_transform(f, lambda x: {{'kind': x.kind, 'found': {said}}}) AS g FROM wrong),
verdict AS (SELECT {keys}, array_to_string(errors, ';') AS errors, CASE WHEN ok THEN array_to_string(list_concat(list_transform(list_filter(s, lambda x: x.zeroed), lambda x: 'score: ' || x.key), list_transform(list_filter(g, lambda x: NOT x.found), lambda x: 'flag: ' || x.kind)), ';') END AS warnings,
    CASE WHEN ok THEN round_even(coalesce(list_sum(list_transform(s, lambda x: x.score)), 0.0::DOUBLE), 2) END AS fit, CASE WHEN ok THEN len(list_filter(g, lambda x: x.found))::INT END AS flags, CASE WHEN ok THEN coalesce(points, 0.0::DOUBLE) END AS bonus,
    list_filter(s, lambda x: x.key = 'depth')[1].score AS depth, list_filter(s, lambda x: x.key = 'breadth')[1].score AS breadth, ok FROM kept)"""

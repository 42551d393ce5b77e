"""Queries of the general operators (problems 2 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.operators import intervals, timestamps
from poolcraft.queries import instants_sql
from poolcraft.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.employment_periods(load(spark, d, "date_ranges", "candidate_id", "range_start", "range_end"))


def p2_months_by_candidate(spark: SparkSession, d: str) -> DataFrame:
    """Months covered and months free per candidate, from the periods."""
    ranges = load(spark, d, "date_ranges", "candidate_id", "range_start", "range_end")
    found = intervals.employment_periods(ranges)
    length = intervals.month_index(F.col("month_to")) - intervals.month_index(F.col("month_from")) + 1
    return found.groupBy("candidate_id").agg(
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("months_worked"),
        F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("months_free"),
        F.count_if(F.col("kind") == "gap").alias("gaps"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalised_instants(
        load(spark, d, "candidates", "opening_id", "id", "created_date", "updated_date"),
        load(spark, d, "parsed", "opening_id", "id", "meta"),
        load(spark, d, "openings", "opening_id", "tz_name", "date_order"),
    )


QUERIES = {"p2_found": p2_found, "p2_months_by_candidate": p2_months_by_candidate, "p3_found": p3_found}

_P2 = r"""
WITH r AS (SELECT candidate_id, trim(range_start, E' \t\n\r') AS a, CASE WHEN range_end IS NULL OR lower(trim(range_end, E' \t\n\r')) IN
    ('present','now','current','currently','ongoing','today','to date','till date','till now','until now') THEN '2026-08' ELSE trim(range_end, E' \t\n\r') END AS b FROM date_ranges),
m AS (SELECT candidate_id, regexp_extract(a, '^(\d{4})(?:[-/.](\d{1,2}))?$', ['y','m']) AS s, regexp_extract(b, '^(\d{4})(?:[-/.](\d{1,2}))?$', ['y','m']) AS e
    FROM r WHERE a IS NOT NULL),
n AS (SELECT candidate_id, TRY_CAST(s.y AS INT) AS sy, CASE WHEN s.m = '' THEN 1 ELSE TRY_CAST(s.m AS INT) END AS sm,
    TRY_CAST(e.y AS INT) AS ey, CASE WHEN e.m = '' THEN 1 ELSE TRY_CAST(e.m AS INT) END AS em FROM m),
v AS (SELECT DISTINCT candidate_id, sy * 12 + sm - 1 AS s, ey * 12 + em - 1 AS e FROM n
    WHERE candidate_id IS NOT NULL AND sm BETWEEN 1 AND 12 AND em BETWEEN 1 AND 12 AND sy IS NOT NULL AND ey IS NOT NULL AND sy * 12 + sm <= ey * 12 + em),
f AS (SELECT *, max(e) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f),
p AS (SELECT candidate_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
g AS (SELECT candidate_id, e + 1 AS s, lead(s) OVER (PARTITION BY candidate_id ORDER BY s) - 1 AS e FROM p),
found AS (SELECT candidate_id, 'period' AS kind, s, e FROM p UNION ALL SELECT candidate_id, 'gap', s, e FROM g WHERE e IS NOT NULL)
"""
_MONTH = "printf('%04d-%02d', {0} // 12, {0} % 12 + 1)"

SQL = {
    "p2_found": _P2 + f"SELECT candidate_id, kind, {_MONTH.format('s')} AS month_from, {_MONTH.format('e')} AS month_to FROM found",
    "p2_months_by_candidate": _P2 + """SELECT candidate_id, sum(CASE WHEN kind = 'period' THEN e - s + 1 ELSE 0 END)::BIGINT AS months_worked,
        sum(CASE WHEN kind = 'gap' THEN e - s + 1 ELSE 0 END)::BIGINT AS months_free, count(*) FILTER (kind = 'gap') AS gaps FROM found GROUP BY candidate_id""",
    "p3_found": instants_sql.FOUND,
}

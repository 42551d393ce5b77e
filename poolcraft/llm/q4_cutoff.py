"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from poolcraft.llm import cutoff
from poolcraft.session import cut_lineage, load


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "assessments", "run_id", "candidate_id", "source", "gate", "final", "assessed_at")
    return cut_lineage(cutoff.pools(rows, load(spark, d, "source_quotas")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return cutoff.kept(pool, cutoff.cutoffs(pool)).select("run_id", "source", "candidate_id")


def p4_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Cutoff, pool size, cap and number kept per run and source."""
    return cutoff.cutoffs(_pool(spark, d)).select("run_id", "source", "pool_size", "cap", "cutoff", "kept")


QUERIES = {"p4_found": p4_found, "p4_cutoffs": p4_cutoffs}

_POOL = """
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY run_id, candidate_id ORDER BY assessed_at DESC NULLS LAST, gate DESC NULLS LAST,
    final DESC NULLS LAST, source DESC NULLS LAST) AS k FROM assessments WHERE run_id IS NOT NULL AND candidate_id IS NOT NULL),
pool AS (SELECT run_id, q.source, candidate_id, CASE WHEN gate IS NULL AND NOT isnan(final) THEN final END AS score, keep_pct
    FROM latest JOIN source_quotas q ON lower(trim(latest.source)) = q.source WHERE k = 1),
size AS (SELECT run_id, source, count(*) AS pool_size, max(keep_pct) * count(*) // 100 AS cap FROM pool GROUP BY run_id, source),
reach AS (SELECT run_id, source, score, sum(count(*)) OVER (PARTITION BY run_id, source ORDER BY score DESC) AS n FROM pool WHERE score IS NOT NULL GROUP BY run_id, source, score),
cut AS (SELECT run_id, source, pool_size, cap, min(score) FILTER (n <= cap) AS cutoff, coalesce(max(n) FILTER (n <= cap), 0)::BIGINT AS kept
    FROM size LEFT JOIN reach USING (run_id, source) GROUP BY run_id, source, pool_size, cap)
"""

SQL = {
    "p4_found": _POOL + "SELECT run_id, source, candidate_id FROM pool JOIN cut USING (run_id, source) WHERE score >= cutoff",
    "p4_cutoffs": _POOL + "SELECT run_id, source, pool_size, cap::BIGINT AS cap, cutoff, kept FROM cut",
}

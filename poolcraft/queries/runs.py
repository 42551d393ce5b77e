"""The queries of ``relational`` that look at one or two runs, for every run of the assessments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolcraft.operators import judged, ranking, state
from poolcraft.queries import relational
from poolcraft.queries.verdicts_sql import verdicts
from poolcraft.session import load

_ORDER = relational._ORDER
_BY = ("run",)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """(run, id, final, barred, timezone_hint) of every run: each candidate's latest row in it; null and NaN finals count 0."""
    return _newest(_assessments(spark, d))


def _histories(spark: SparkSession, d: str) -> DataFrame:
    """:func:`_runs` without null ids, dealt and sorted by id and run, so what looks along an id's runs needs no shuffle or sort of its own."""
    return _newest(_assessments(spark, d).filter("candidate_id IS NOT NULL").repartition("candidate_id"))


def _assessments(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "assessments", "run_id", "candidate_id", "final", "gate", "timezone_hint", "assessed_at").filter("run_id IS NOT NULL")


def _newest(rows: DataFrame) -> DataFrame:
    newest = state.latest(rows, ("candidate_id", "run_id"), "assessed_at")
    return newest.select(F.col("run_id").alias("run"), F.col("candidate_id").alias("id"), F.coalesce(F.nanvl("final", F.lit(0.0)), F.lit(0.0)).alias("final"), F.col("gate").alias("barred"), "timezone_hint")


def _previous(pool: DataFrame) -> DataFrame:
    """(run, previous): every run with the one before it; the first has null. A row per run."""
    return pool.select("run").distinct().select("run", F.lag("run").over(Window.orderBy("run")).alias("previous"))


def every_rank_order(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ranked(_runs(spark, d).filter("barred IS NULL"), _ORDER, by=_BY).select("run", "id", "final", "rank")


def every_pool_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pool_numbers(_runs(spark, d), 0.2, by=_BY)


def every_run_cut(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cut_each(_runs(spark, d), _ORDER, 0.2, _BY).select("run", "id", "final", "rank", "status")


def every_sticky_cut(spark: SparkSession, d: str) -> DataFrame:
    """The runs in order, each with the seats that the ones before left."""
    return ranking.cut_sequence(_histories(spark, d), _ORDER, 0.2).select("run", "id", "final", "rank", "status")


def every_rebaseline_unseated(spark: SparkSession, d: str) -> DataFrame:
    """(run, id): who held a seat after the run before and would have none if this run were cut anew."""
    return ranking.sequence_unseated(_histories(spark, d), _ORDER, 0.2)


def every_calibrated_cut(spark: SparkSession, d: str) -> DataFrame:
    pool = _runs(spark, d)
    proposal = pool.select("run", "id", (-F.col("id")).alias("pos"))
    rows = ranking.cut_each(pool, _ORDER, 0.2, _BY, proposal=proposal).filter("status <> 'barred'")
    return rows.select("run", "id", F.col("place").cast("bigint").alias("place"), "status")


def every_cut_guards(spark: SparkSession, d: str) -> DataFrame:
    sums = ranking.sequence_guards(_histories(spark, d), _ORDER, 0.2)
    return sums.select("run", "seated", F.greatest(F.col("seated") - F.col("cap"), F.lit(0)).alias("over_cap"), (F.col("seated") / F.col("pool_size")).alias("accepted_share"), "inversions")


def every_ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    """(id, status, value, first_seen, changed) after all runs, each merged into what the ones before left."""
    pool = _runs(spark, d)
    rows = pool.select("run", "id", F.coalesce("barred", F.lit("open")).alias("status"), F.col("final").alias("value"))
    return state.merge_all(rows, "run", frozen=("G1",))


def every_run_delta(spark: SparkSession, d: str) -> DataFrame:
    """(run, id, part) of every run but the first, against the one before: new, gone or both."""
    pool = _runs(spark, d)
    pairs = _previous(pool).filter("previous IS NOT NULL")
    now = pool.select("run", "id").join(pairs.select("run"), "run").withColumn("now", F.lit(True))
    before = pool.select(F.col("run").alias("previous"), "id").join(pairs, "previous").select("run", "id", F.lit(True).alias("before"))
    part = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("both")
    return now.join(before, ["run", "id"], "full").select("run", "id", part.alias("part"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    raw = relational._flawed(_runs(spark, d)).withColumn("key", F.struct("run", "id"))
    return judged.check(raw, relational._RUBRIC, key="key").select("key.*", "*")


def every_verdict_check(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("run", *relational._verdict_columns())


def every_criterion_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).filter("size(errors) = 0").select("run", "id", *[F.col("scores")[k].alias(k) for k in relational._RUBRIC])


def every_barred_by_reason(spark: SparkSession, d: str) -> DataFrame:
    rows = _runs(spark, d).filter("barred IS NOT NULL")
    return rows.groupBy("run", "barred").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("final").alias("best"))


def every_report_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.cut_each(_runs(spark, d), _ORDER, 0.2, _BY)
    return ranking.first_of_each(rows, ("run", "status"), [F.col("final").desc(), F.col("id").asc()], 12).select("run", "status", "k", "id", "final", "more")


_NAMES = (
    every_rank_order, every_pool_cap, every_run_cut, every_sticky_cut, every_rebaseline_unseated, every_calibrated_cut, every_cut_guards, every_ledger_merge, every_run_delta, every_verdict_check,
    every_criterion_pivot, every_barred_by_reason, every_report_sections,
)
QUERIES = {f.__name__: f for f in _NAMES}

# --- the same in SQL; the sequences are tested against a walk -------------------------------------------------------------

_POOL = """newest AS (SELECT *, row_number() OVER (PARTITION BY a.run_id, candidate_id ORDER BY assessed_at DESC NULLS LAST, final DESC NULLS LAST, gate DESC NULLS LAST, timezone_hint DESC NULLS LAST) AS n FROM assessments a WHERE run_id IS NOT NULL),
a AS (SELECT run_id AS run, candidate_id AS id, CASE WHEN final IS NULL OR isnan(final) THEN 0 ELSE final END AS final, gate AS barred, timezone_hint FROM newest WHERE n = 1)"""
_CUT = _POOL + f""", caps AS (SELECT run, count(*) AS size, floor(0.2::DOUBLE * count(*))::BIGINT AS cap FROM a GROUP BY run), ranked AS (SELECT run, id, final, row_number() OVER (PARTITION BY run ORDER BY {relational._SORT}) AS rank FROM a WHERE barred IS NULL),
cut1 AS (SELECT run, id, final, rank, CASE WHEN rank <= cap THEN 'seated' ELSE 'no_slot' END AS status FROM ranked JOIN caps USING (run) UNION ALL SELECT run, id, final, NULL, 'barred' FROM a WHERE barred IS NOT NULL)"""  # fmt: skip
_VERDICTS = _POOL + ", " + verdicts("a", "run, id")

SQL = {
    "every_rank_order": f"WITH {_CUT} SELECT run, id, final, rank FROM ranked",
    "every_pool_cap": f"WITH {_CUT} SELECT run, size AS pool_size, cap FROM caps",
    "every_run_cut": f"WITH {_CUT} SELECT run, id, final, rank, status FROM cut1",
    "every_calibrated_cut": f"""WITH {_CUT}, w AS (SELECT run, id, rank, greatest(cap - 6, 0) AS lo, cap + 5 AS hi, cap FROM ranked JOIN caps USING (run)),
        p AS (SELECT run, id, cap, CASE WHEN rank > lo AND rank <= hi THEN lo + row_number() OVER (PARTITION BY run, rank > lo AND rank <= hi ORDER BY id DESC) ELSE rank END AS place FROM w)
        SELECT run, id, place, CASE WHEN place <= cap THEN 'seated' ELSE 'no_slot' END AS status FROM p""",
    "every_run_delta": f"""WITH {_POOL}, o AS (SELECT run, lag(run) OVER (ORDER BY run) AS previous FROM (SELECT DISTINCT run FROM a)), x AS (SELECT o.run, id FROM o JOIN a USING (run) WHERE previous IS NOT NULL), y AS (SELECT o.run, a.id FROM o JOIN a ON a.run = o.previous)
        SELECT coalesce(x.run, y.run) AS run, coalesce(x.id, y.id) AS id, CASE WHEN y.id IS NULL THEN 'new' WHEN x.id IS NULL THEN 'gone' ELSE 'both' END AS part FROM x FULL JOIN y ON x.run = y.run AND x.id = y.id""",
    "every_verdict_check": f"WITH {_VERDICTS} SELECT run, id, errors, warnings, fit, flags, bonus FROM verdict",
    "every_criterion_pivot": f"WITH {_VERDICTS} SELECT run, id, depth, breadth FROM verdict WHERE ok",
    "every_barred_by_reason": f"WITH {_POOL} SELECT run, barred, count(*) AS n, min(id) AS first_id, max(final) AS best FROM a WHERE barred IS NOT NULL GROUP BY run, barred",
    "every_report_sections": f"""WITH {_CUT}, k AS (SELECT *, row_number() OVER (PARTITION BY run, status ORDER BY final DESC, id) AS k, count(*) OVER (PARTITION BY run, status) AS n FROM cut1)
        SELECT run, status, k::INT AS k, id, final, greatest(n - 12, 0) AS more FROM k WHERE k <= 12""",
}

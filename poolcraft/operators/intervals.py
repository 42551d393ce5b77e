"""Continuous periods and gaps from overlapping time intervals (problem 2).

Every interval becomes bits of 64-bit words, one word per entity and time
shard of :data:`SHARD` units. ``bit_or`` unites the words: it combines on the
map side, so an entity that holds a third of all rows sends one word per shard
and input partition, no matter how many intervals it has. The words of an
entity (one per shard that has a set bit; empty shards are not stored) are then
read as run containers: starts of runs are bits whose lower neighbour is clear,
ends are bits whose upper neighbour is clear, neighbours across a shard
boundary included. All of it stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units in one word. 60 keeps the sign bit clear and makes a shard five years of months.
SHARD = 60

#: Words for an interval that still runs.
OPEN_WORDS = ("present", "now", "current", "currently", "ongoing", "today", "to date", "till date", "till now", "until now")

_BLANK = r"(?U)^\s+|\s+$"


def _month_of(clean: Column) -> Column:
    year, rest = F.substring(clean, 1, 4), F.substring(clean, 5, 100)
    month = F.when(rest == "", 1).when(rest.rlike(r"^[-/.]\d{1,2}$"), F.substring(rest, 2, 2).try_cast("int"))
    return F.when(year.rlike(r"^\d{4}$") & month.between(1, 12), year.try_cast("int") * 12 + month - 1)


def month_index(text: Column) -> Column:
    """Months since year 0 of ``YYYY``, ``YYYY-MM``, ``YYYY/M``…; null when unreadable.

    Outer blanks don't matter; a year alone is its January; month 0 or 13 is unreadable.
    """
    return _month_of(F.regexp_replace(text, _BLANK, ""))


def month_text(index: Column) -> Column:
    """``YYYY-MM`` of a month index."""
    return F.concat(
        F.lpad(F.floor(index / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(index, F.lit(12)) + 1).cast("string"), 2, "0")
    )


def union_words(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """(entity, shard, word) of integer intervals ``start..end``, both ends included."""
    low_shard, high_shard = F.floor(F.col(start) / SHARD).cast("int"), F.floor(F.col(end) / SHARD).cast("int")
    pieces = intervals.filter(F.col(entity).isNotNull() & (F.col(start) <= F.col(end))).select(
        F.col(entity).alias("entity"), F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e"),
        F.explode(F.sequence(low_shard, high_shard)).alias("shard"),
    )
    low = f"greatest(s - shard * {SHARD}, 0)"
    high = f"least(e - shard * {SHARD}, {SHARD - 1})"
    word = F.expr(f"shiftleft(2L, {high}) - shiftleft(1L, {low})")
    return pieces.groupBy("entity", "shard").agg(F.bit_or(word).alias("word"))


def runs(words: DataFrame) -> DataFrame:
    """(entity, kind, first, last): the set runs (``period``) and the clear runs between them (``gap``).

    One entity's words are gathered into one array: at most one word per shard of
    the time line (2,000 for 10,000 years of months), whatever the number of intervals.
    """
    per_entity = words.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("shard", "word"))).alias("w"))
    edges = per_entity.select(
        "entity",
        F.expr(f"""flatten(transform(w, (x, i) -> filter(transform(sequence(0, {SHARD - 1}), b -> IF(
            (shiftrightunsigned(x.word, b) & 1L) = 1L AND (CASE WHEN b > 0 THEN (shiftrightunsigned(x.word, b - 1) & 1L) = 0L
                WHEN i > 0 AND w[i - 1].shard = x.shard - 1 THEN (shiftrightunsigned(w[i - 1].word, {SHARD - 1}) & 1L) = 0L ELSE true END),
            x.shard * {SHARD} + b, NULL)), p -> p IS NOT NULL)))""").alias("starts"),
        F.expr(f"""flatten(transform(w, (x, i) -> filter(transform(sequence(0, {SHARD - 1}), b -> IF(
            (shiftrightunsigned(x.word, b) & 1L) = 1L AND (CASE WHEN b < {SHARD - 1} THEN (shiftrightunsigned(x.word, b + 1) & 1L) = 0L
                WHEN i < size(w) - 1 AND w[i + 1].shard = x.shard + 1 THEN (w[i + 1].word & 1L) = 0L ELSE true END),
            x.shard * {SHARD} + b, NULL)), p -> p IS NOT NULL)))""").alias("ends"),
    )
    listed = F.expr("""concat(
        transform(sequence(1, size(starts)), k -> struct('period' AS kind, starts[k - 1] AS first, ends[k - 1] AS last)),
        IF(size(starts) > 1, transform(sequence(1, size(starts) - 1), k -> struct('gap' AS kind, ends[k - 1] + 1 AS first, starts[k] - 1 AS last)),
           array()))""")
    return edges.select("entity", F.explode(listed).alias("r")).select("entity", "r.kind", "r.first", "r.last")


def periods_and_gaps(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous periods and gaps of integer intervals; see :func:`runs`.

    Intervals that share a unit or follow each other without a free unit form one
    period. Rows with a null entity or bound, or with the end before the start,
    don't count; an entity without a counting row gives no row; repeated rows
    change nothing; an empty input gives an empty result.
    """
    return runs(union_words(intervals, entity, start, end))


def month_ranges(date_ranges: DataFrame, *more: str, still_running: str = "2026-08") -> DataFrame:
    """(candidate_id, s, e, open, more...) of textual ranges: month indexes, null where unreadable; ``open`` when the end is null or a word for "still running"."""
    clean = date_ranges.select("candidate_id", *more, *[F.regexp_replace(c, _BLANK, "").alias(a) for c, a in (("range_start", "a"), ("range_end", "b"))])
    open_ = F.col("b").isNull() | F.lower("b").isin(*OPEN_WORDS)
    read = F.struct(_month_of(F.col("a")).alias("s"), _month_of(F.when(open_, F.lit(still_running)).otherwise(F.col("b"))).alias("e"), open_.alias("open"))
    # The generator keeps later filters on the months from copying their computation.
    return clean.select("candidate_id", *more, F.inline(F.array(read)))


def employment_periods(date_ranges: DataFrame, still_running: str = "2026-08") -> DataFrame:
    """(candidate_id, kind, month_from, month_to) of textual month ranges.

    ``range_end`` that is null or a word for "still running" means
    ``still_running``. A null or unreadable start, an unreadable (also empty) end,
    or an end before its start: the row doesn't count.
    """
    found = periods_and_gaps(month_ranges(date_ranges, still_running=still_running), "candidate_id", "s", "e")
    return found.select(
        F.col("entity").alias("candidate_id"), "kind", month_text(F.col("first")).alias("month_from"), month_text(F.col("last")).alias("month_to")
    )

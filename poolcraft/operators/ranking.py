"""Ranking a pool and cutting it at a fraction, with seats that stay between runs.

The cut is two steps: one aggregate gives the numbers (pool size, cap, seats kept, floor), which come to the driver as
one row; then a ranked selection with those numbers as literals. The rank itself is found in two levels, so no task ever
sorts the whole pool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolcraft.session import cut_lineage, written


@dataclass(frozen=True)
class Order:
    """Total order of a pool: score down, preferred values of ``tie`` first, then id up. Null and NaN scores come last."""

    score: str = "final"
    tie: str | None = None
    preferred: tuple[str, ...] = ()
    id: str = "id"

    def keys(self) -> list[Column]:
        score = F.when(~F.isnan(self.score), F.col(self.score))
        keys = [score.desc_nulls_last()]
        if self.tie:
            keys.append(F.when(F.col(self.tie).isin(*self.preferred), 0).otherwise(1).asc())
        return [*keys, F.col(self.id).asc()]


def ranked(pool: DataFrame, order: Order, into: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """``pool`` with its rank from 1, in each group of ``by`` (not null) anew. Ids must be distinct in a group. An empty pool gives no rows.

    Rows go to ranges of the whole key, id included, so a score that a third of the pool shares is split too; each range is
    sorted by one task and numbered, and shifted by the sizes of the ranges before it. The sorted rows are kept in the checkpoint
    folder, so numbers and sizes come from the same split even if a task runs again.
    """
    keys = [*map(F.col, by), *order.keys()]
    numbered = cut_lineage(pool.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()))
    # The upper bits are the range, the lower 33 the number in it.
    part, k = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("__p"), *by).agg(F.count(F.lit(1)).alias("__n"), F.min(k).alias("__first"))
    w = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select("__p", *by, (F.sum("__n").over(w) - F.col("__n") - F.col("__first")).alias("__before"))  # a row per range and group
    return numbered.withColumn("__p", part).join(before, ["__p", *by]).withColumn(into, F.col("__before") + k + 1).drop("__p", "__m", "__before")


def pool_numbers(pool: DataFrame, fraction: float, withdrawn: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one per group of ``by``: pool_size (distinct ids that are not withdrawn) and cap = floor(fraction * pool_size), in doubles."""
    left = pool.filter(~F.coalesce(withdrawn, F.lit(False))) if withdrawn is not None else pool
    return left.groupBy(*by).agg(F.countDistinct("id").alias("pool_size")).select(*by, "pool_size", F.floor(F.lit(float(fraction)) * F.col("pool_size")).alias("cap"))


@dataclass(frozen=True)
class Cut:
    """Rows (id, final, was, was_final, rank, place, status) and the numbers of a cut."""

    rows: DataFrame
    pool_size: int
    cap: int
    floor: float | None
    window: tuple[int, int]


def cut(
    pool: DataFrame, order: Order, fraction: float, ledger: DataFrame | None = None, delta: float = 5.0, window: int = 5, proposal: DataFrame | None = None, rebaseline: bool = False
) -> Cut:
    """Seats for the first ``cap`` of a ranked pool.

    ``pool``: id, final, barred (a reason, or null), the order's columns and, if there is one, state: ``withdrawn`` (counts nowhere), ``needs_review``
    (counts in the pool, has no place) or null. ``ledger``: id, status, final of the run before.
    Ids are distinct in both. Seats of the ledger stay (unless ``rebaseline``), barred or not; not those of records with a state. Newcomers need a final of
    at least the lowest seated final less ``delta``; whoever the ledger knows needn't. ``proposal`` (pos, id) reorders the ids
    within ``window`` places of the cut and can't bring others in. Status: the state, else seated, waiting, no_slot (good enough, no seat
    left) or barred. Change: newly_accepted, newly_gated, unseated (by a rebaseline) or null.

    Seats are filled in order by all who are eligible, whatever happens to others, so the k-th eligible gets a seat just if k is
    at most the number of free ones. The place of the last seat comes from counts by places, so the pool is sorted once.
    """
    spark = pool.sparkSession
    if ledger is None:
        ledger = spark.createDataFrame([], "id bigint, status string, final double")
    past = ledger.select(F.col("id"), F.col("status").alias("was"), F.col("final").alias("was_final"))
    if "state" not in pool.columns:
        pool = pool.withColumn("state", F.lit(None).cast("string"))
    here, seated = F.col("state").isNull(), (F.col("was") == "accepted") & F.lit(not rebaseline)
    known = cut_lineage(pool.join(past, "id", "left").withColumn("kept", here & F.coalesce(seated, F.lit(False))))
    fit = F.col("state").isNull() & (F.col("barred").isNull() | F.col("kept"))
    numbers = known.agg(
        F.count_if(~F.col("state").eqNullSafe("withdrawn")).alias("n"), F.count_if("kept").alias("kept"), F.min(F.when(F.col("kept"), F.col("was_final"))).alias("low"), F.count_if(fit).alias("able"),
    ).first()
    cap = int(float(fraction) * numbers.n // 1)
    floor = None if numbers.low is None else round(numbers.low - delta, 2)
    able = ranked(known.filter(fit), order).withColumn("place", F.col("rank").cast("double"))
    lo, hi = max(0, cap - window - 1), min(numbers.able, cap + window)
    if proposal is not None:
        # At most 2 * window + 1 places: the reordered ones go between lo and hi, in the proposal's order, then the others.
        inside = able.filter((F.col("rank") > lo) & (F.col("rank") <= hi)).join(proposal.groupBy("id").agg(F.min("pos").alias("pos")), "id", "left")
        place = F.lit(lo) + F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("pos").asc_nulls_last(), "rank"))
        moved = inside.withColumn("moved", place.cast("double")).select("id", "moved")
        able = able.join(moved, "id", "left").withColumn("place", F.coalesce("moved", "place")).drop("moved")
    good = F.col("was").isNotNull() | (F.lit(True) if floor is None else F.col("final") >= floor)
    able = able.withColumn("eligible", ~F.col("kept") & F.coalesce(good, F.lit(False)))
    last = _last_place(able.filter("eligible"), max(0, cap - numbers.kept))
    status = F.when(F.col("kept") | (F.col("eligible") & (F.col("place") <= last)), "seated").when(F.col("eligible"), "no_slot").otherwise("waiting")
    rows = able.withColumn("status", status)
    out = known.filter(~fit).withColumns({"rank": F.lit(None).cast("bigint"), "place": F.lit(None).cast("double"), "status": F.coalesce("state", F.lit("barred"))})
    accepted = F.col("was").eqNullSafe("accepted")
    change = F.when((F.col("status") == "seated") & ~F.col("kept"), "newly_accepted").when((F.col("status") == "barred") & ~F.col("was").eqNullSafe("gated"), "newly_gated")
    change = F.when(F.lit(rebaseline) & accepted & (F.col("status") != "seated"), "unseated").when(F.lit(rebaseline) & accepted & (F.col("status") == "seated"), None).otherwise(change)
    columns = ["id", "final", "was", "was_final", "rank", "place", "status"]
    kept = ["kept"]
    both = rows.select(*columns, *kept).unionByName(out.select(*columns, *kept))
    return Cut(both.withColumn("change", change).drop("kept"), numbers.n, cap, floor, (lo, hi))


#: Places that are counted together.
PLACES = 4096


def _last_place(waiting: DataFrame, free: int) -> float:
    """The place of the ``free``-th of ``waiting`` in order of place: 0 for none, infinity where there are seats enough."""
    if free <= 0:
        return 0.0
    block = F.floor(F.col("place") / PLACES)
    counts = waiting.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("b")  # a row per PLACES places
    reached = counts.select("b", "n", F.sum("n").over(w).alias("upto")).filter(F.col("upto") >= free).orderBy("b").limit(1).collect()
    if not reached:
        return float("inf")
    row = reached[0]
    return waiting.filter(block == row.b).select("place").orderBy("place").offset(free - (row.upto - row.n) - 1).limit(1).collect()[0].place


def cut_each(pool: DataFrame, order: Order, fraction: float, by: tuple[str, ...], window: int = 5, proposal: DataFrame | None = None) -> DataFrame:
    """(by, id, final, rank, place, status, cap, pool_size): :func:`cut` without a ledger for every group of ``by`` at once; ``proposal`` (by, pos, id)."""
    numbers = pool_numbers(pool, fraction, by=by)
    able = ranked(pool.filter("barred IS NULL"), order, by=by).join(numbers, [*by]).withColumn("place", F.col("rank").cast("double"))
    if proposal is not None:
        lo, hi = F.greatest(F.col("cap") - window - 1, F.lit(0)), F.col("cap") + window
        inside = able.filter((F.col("rank") > lo) & (F.col("rank") <= hi)).join(proposal.groupBy(*by, "id").agg(F.min("pos").alias("pos")), [*by, "id"], "left")
        place = lo + F.row_number().over(Window.partitionBy(*by).orderBy(F.col("pos").asc_nulls_last(), "rank"))
        able = able.join(inside.select(*by, "id", place.cast("double").alias("moved")), [*by, "id"], "left").withColumn("place", F.coalesce("moved", "place"))
    rows = able.withColumn("status", F.when(F.col("place") <= F.col("cap"), "seated").otherwise("no_slot"))
    barred = pool.filter("barred IS NOT NULL").join(numbers, [*by]).withColumns({"rank": F.lit(None).cast("bigint"), "place": F.lit(None).cast("double"), "status": F.lit("barred")})
    columns = [*by, "id", "final", "rank", "place", "status", "cap", "pool_size"]
    return rows.select(*columns).unionByName(barred.select(*columns))


#: Most seats of one run that the task walking the runs holds (about 50 bytes each); where a run has more, every run is cut by jobs of its own.
SEATS = 10_000_000


def cut_sequence(pool: DataFrame, order: Order, fraction: float, run: str = "run", delta: float = 5.0) -> DataFrame:
    """(run, id, final, rank, status, cap, pool_size): :func:`cut` of every run, in order of ``run``, each with the ledger the runs before left.

    Who is seated stays so, with the final the seat was given for, as long as the runs follow each other; who misses a run counts as withdrawn, and is known when
    back. So a row needs of the past only whether its id was seen at all, and of its neighbours whether the id is in the runs just before and after. What is left
    in turn is who gets the free seats: one task walks the rows in order and holds the seats of one run. The number of jobs doesn't depend on that of the runs.
    """
    held = _in_order(pool, fraction, run)
    if held.large:
        return _cut_in_turn(held.rows, order, fraction, run, delta)
    walked = cut_lineage(_walk(held, order, delta))
    seats = walked.filter("id IS NOT NULL").select("id", F.col("k").alias("__k"), F.lit(True).alias("__seat"))
    floors = walked.filter("id IS NULL").select(F.col("k").alias("__k"), F.col("final").alias("__floor"))
    rows = held.rows.join(F.broadcast(floors), "__k").join(seats, ["id", "__k"], "left").withColumn("__seated", F.col("__seat").isNotNull())
    able = F.col("state").isNull() & (F.col("barred").isNull() | F.col("__seated"))
    good = F.col("__seen") | F.col("__floor").isNull() | F.coalesce(F.col("final") >= F.col("__floor"), F.lit(False))
    status = F.when(F.col("__seated"), "seated").when(~able, F.coalesce("state", F.lit("barred"))).when(good, "no_slot").otherwise("waiting")
    rows = cut_lineage(rows.withColumns({"status": status, "__able": able}).drop("__seen", "__follows", "__stays", "__seat", "__floor", "__seated"))
    columns = [run, "id", "final", "rank", "status", "cap", "pool_size"]
    out = rows.filter(~F.col("__able")).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(rows.filter("__able"), order, by=(run,)).select(*columns).unionByName(out.select(*columns))


def sequence_guards(pool: DataFrame, order: Order, fraction: float, run: str = "run", delta: float = 5.0) -> DataFrame:
    """(run, cap, pool_size, seated, inversions) of :func:`cut_sequence`: inversions are those without a seat, neither barred nor with a state, whose final is above the lowest seated one.

    The walk gives the seats with their finals. Of all rows above the lowest of them the seated ones are taken off, so no rows are ranked or joined by id.
    """
    held = _in_order(pool, fraction, run)
    if held.large:
        seats = _cut_in_turn(held.rows, order, fraction, run, delta).filter("status = 'seated'").select(run, "id")
        walked = held.rows.join(seats, [run, "id"]).select("id", F.col("__k").alias("k"), "final", F.col("barred").isNotNull().alias("barred"))
    else:
        walked = _walk(held, order, delta).filter("id IS NOT NULL")
    walked = cut_lineage(walked)
    lows = walked.groupBy(F.col("k").alias("__k")).agg(F.count(F.lit(1)).alias("seated"), F.min("final").alias("__low"))  # a row per run
    free = held.rows.filter("barred IS NULL AND state IS NULL").select("__k", "final", F.lit(1).alias("__n"))
    above = free.unionByName(walked.filter("NOT barred").select(F.col("k").alias("__k"), "final", F.lit(-1).alias("__n"))).join(F.broadcast(lows), "__k").filter("final > __low")
    sums = above.groupBy("__k").agg(F.sum("__n").alias("inversions"))
    return held.runs.join(lows, "__k", "left").join(sums, "__k", "left").select(run, "cap", "pool_size", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("seated", "inversions")])


def sequence_unseated(pool: DataFrame, order: Order, fraction: float, run: str = "run", delta: float = 5.0) -> DataFrame:
    """(run, id): who has a seat of :func:`cut_sequence` in the run before and would have none if this run were cut anew. The walk tells both, as it sees the rows by rank."""
    held = _in_order(pool, fraction, run)
    if not held.large:
        return _walk(held, order, delta, unseated=True).join(F.broadcast(held.runs.select(F.col("__k").alias("k"), run)), "k").select(run, "id")
    seats = _cut_in_turn(held.rows, order, fraction, run, delta).filter("status = 'seated'").select(F.col(run).alias("__previous"), "id")
    anew = ranked(held.rows.filter("barred IS NULL AND state IS NULL"), order, by=(run,)).filter("rank <= cap").select(run, "id")
    return seats.join(F.broadcast(held.runs.select(run, "__previous")), "__previous").select(run, "id").join(anew, [run, "id"], "left_anti")


@dataclass(frozen=True)
class _Held:
    """Rows of all runs, with __k (the run's number), cap, pool_size, __seen (in an earlier run), __follows and __stays (here in the run just before, just after); ``runs``: a row per run."""

    rows: DataFrame
    runs: DataFrame
    caps: list[int]

    @property
    def large(self) -> bool:
        return max(self.caps, default=0) > SEATS


def _in_order(pool: DataFrame, fraction: float, run: str) -> _Held:
    """``pool`` (rows with an id) with what its rows tell of the runs before and after. One sort by id; none, where the pool comes sorted by id and run."""
    pool = pool.filter("id IS NOT NULL")
    if "state" not in pool.columns:
        pool = pool.withColumn("state", F.lit(None).cast("string"))
    here, counts, mine = F.col("state").isNull(), ~F.col("state").eqNullSafe("withdrawn"), Window.partitionBy("id").orderBy(run)
    beside = {name: F.when(step(here).over(mine), step(F.col(run)).over(mine)) for name, step in (("__before", F.lag), ("__after", F.lead))}
    held = written(pool.withColumns({**beside, "__seen": F.lag(run).over(mine).isNotNull()}))
    sizes = sorted((tuple(r) for r in held.groupBy(run).agg(F.count_if(counts)).collect()), key=lambda x: x[0])  # a row per run
    names, caps = [None, *(x[0] for x in sizes), None], [int(float(fraction) * n // 1) for _, n in sizes]
    field = held.schema[run]
    schema = [field, *_NUMBERS, T.StructField("__previous", field.dataType), T.StructField("__next", field.dataType)]
    runs = held.sparkSession.createDataFrame([(value, k, caps[k], n, names[k], names[k + 2]) for k, (value, n) in enumerate(sizes)], T.StructType(schema))
    ends = [F.coalesce(F.col(x) == F.col(y), F.lit(False)) for x, y in (("__before", "__previous"), ("__after", "__next"))]
    rows = held.join(F.broadcast(runs), run).withColumns({"__follows": ends[0], "__stays": ends[1]}).drop("__before", "__after", "__previous", "__next")
    return _Held(rows, runs, caps)


_NUMBERS = [T.StructField("__k", T.IntegerType()), T.StructField("cap", T.LongType()), T.StructField("pool_size", T.LongType())]


def _walk(held: _Held, order: Order, delta: float, unseated: bool = False) -> DataFrame:
    """(id, k, final, barred): the seats of every run, kept and given, with the final and whether a bar stands in that run; beside them each run's floor, with a null id.

    With ``unseated`` instead the id and k of those who have a seat in the run before k, but are not among the first ``cap`` of k.
    All rows that can have a seat go through one task in order of run and rank, in batches: those not barred, and barred ones that were in the run before.
    """
    caps = held.caps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the seats that the run at hand keeps, by id: the final the seat was given for, if it isn't null, and whether it lasts to the next run.
        ids, first, void, stays = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)
        k, free, floor, given = -1, 0, None, []
        # All seats of the run before, which of them are among the first of the run at hand, and how many of these are to come.
        before, again, ahead = ids, stays, 0

        def batch(ids, final, void, barred) -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(final), k, np.int32)), pa.array(final, pa.float64(), mask=void), pa.array(barred, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["id", "k", "final", "barred"])

        def upto(new: int) -> Iterator[pa.RecordBatch]:
            """Ends the run at hand and begins those up to ``new``: seats that last stay, and the lowest of their finals makes the floor."""
            nonlocal ids, first, void, stays, k, free, floor, given, before, again, ahead
            while k < new:
                yield from lost()
                k += 1
                ids, first, void, stays = (np.concatenate(x) for x in zip((ids, first, void, stays), *given, strict=True))
                by = np.argsort(ids)
                before, again, ahead = ids[by], np.zeros(len(by), bool), caps[k]
                kept = by[stays[by]]
                ids, first, void, stays, given = ids[kept], first[kept], void[kept], np.zeros(len(kept), bool), []
                lows = first[~void]
                # As in SQL a null is no final, and NaN the greatest.
                floor = round(float(np.fmin.reduce(lows)) - delta, 2) if len(lows) else None
                free = max(0, caps[k] - len(ids))
                if not unseated:
                    yield batch([None], np.array([floor or 0.0]), np.array([floor is None]), np.zeros(1, bool))

        def lost() -> Iterator[pa.RecordBatch]:
            gone = before[~again]
            if unseated and len(gone):
                yield batch(gone, np.zeros(len(gone)), np.ones(len(gone), bool), np.zeros(len(gone), bool))

        for rows in batches:
            at = rows.column(0).to_numpy()
            for number in np.unique(at).tolist():
                yield from upto(number)
                begin, end = np.searchsorted(at, [number, number + 1]).tolist()
                part = rows.slice(begin, end - begin)
                own, value, null = part.column(1).to_numpy(), part.column(5).fill_null(0.0).to_numpy(), part.column(5).is_null().to_numpy(zero_copy_only=False)
                last, seen, barred = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                seated, new = _among(own, ids), ~barred
                stays[np.searchsorted(ids, own[seated])] = last[seated]
                top = own[new][:ahead]
                ahead -= len(top)
                again[np.searchsorted(before, top[_among(top, before)])] = True
                new &= ~seated
                if floor is not None:
                    new &= seen | (~null & (np.isnan(value) | (value >= floor)))
                new = np.flatnonzero(new)[:free]
                free -= len(new)
                if len(new):
                    given.append((own[new], value[new], null[new], last[new]))
                    seated[new] = True
                if not unseated:
                    yield batch(own[seated], value[seated], null[seated], barred[seated])
        yield from upto(len(caps) - 1)
        yield from lost()

    rows = held.rows.filter("state IS NULL AND (barred IS NULL OR __follows)")
    ordered = rows.repartition(1).sortWithinPartitions("__k", *order.keys())
    columns = ["__k", F.col("id").cast("bigint"), "__stays", "__seen", F.col("barred").isNotNull().alias("__barred"), F.col("final").cast("double")]
    return ordered.select(*columns).mapInArrow(run, "id bigint, k int, final double, barred boolean")


def _among(values: np.ndarray, sorted_ids: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``sorted_ids``."""
    if not len(sorted_ids):
        return np.zeros(len(values), bool)
    return sorted_ids[np.minimum(np.searchsorted(sorted_ids, values), len(sorted_ids) - 1)] == values


def _cut_in_turn(held: DataFrame, order: Order, fraction: float, run: str, delta: float) -> DataFrame:
    """:func:`cut_sequence` with jobs of its own for every run, for few runs of any size; ``held``: with __seen."""
    done, before = [], None
    for value in sorted(r[0] for r in held.select(run).distinct().collect()):  # a row per run
        now = held.filter(F.col(run) == value).drop(run)
        ledger = None
        if before is not None:
            left = before.select("id", F.when(F.col("status") == "seated", "accepted").when(F.col("status") == "barred", "gated").otherwise("waitlist").alias("status"), F.col("held").alias("final"))
            ledger = now.filter("__seen").select("id").join(left, "id", "left").fillna("withdrawn", ["status"])
        one = cut(now, order, fraction, ledger=ledger, delta=delta)
        held_final = F.when(F.col("was") == "accepted", F.col("was_final")).otherwise(F.col("final"))
        before = cut_lineage(one.rows.select(F.lit(value).alias(run), "id", "final", "rank", "status", held_final.alias("held"), F.lit(one.cap).cast("bigint").alias("cap"), F.lit(one.pool_size).cast("bigint").alias("pool_size")))
        done.append(before.drop("held"))
    return reduce(DataFrame.unionByName, done)


def first_of_each(rows: DataFrame, group: str | tuple[str, ...], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group and how many more there are; a group's rows beyond k never leave the map side (a limit inside the window)."""
    group = [group] if isinstance(group, str) else [*group]
    w = Window.partitionBy(*group).orderBy(*order)
    top = rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return top.join(sizes, group).withColumn("more", F.greatest(F.col("n") - k, F.lit(0))).drop("n")

import random

import pytest
from pyspark.sql import functions as F

from poolcraft.operators import judged, ranking, state


def greedy(pool, ledger, fraction, delta, window, proposal, rebaseline):
    """The cut as a walk down the order, one by one."""
    rows = {p[0]: p for p in pool}
    was = {i: (s, f) for i, s, f in ledger}
    kept = {i for i in rows if not rebaseline and was.get(i, ("", 0))[0] == "accepted"}
    order = sorted((i for i, (_, f, b, tz) in rows.items() if b is None or i in kept), key=lambda i: (-rows[i][1], rows[i][3] not in ("ET", "CT"), i))
    cap = int(fraction * len(rows))
    lo, hi = max(0, cap - window - 1), min(len(order), cap + window)
    inside = order[lo:hi]
    if proposal:
        first = [i for i in dict.fromkeys(proposal) if i in inside]
        order = order[:lo] + first + [i for i in inside if i not in first] + order[hi:]
    floor = round(min(was[i][1] for i in kept) - delta, 2) if kept else None
    seats, out = set(kept), {i: "seated" for i in kept}
    for i in order:
        if i in kept:
            continue
        good = floor is None or rows[i][1] >= floor or i in was
        if good and len(seats) < cap:
            seats.add(i)
            out[i] = "seated"
        else:
            out[i] = "no_slot" if good else "waiting"
    out |= {i: "barred" for i in rows if i not in out}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cut_equals_walk(spark, seed):
    rng = random.Random(seed)
    pool = [(i, rng.choice([10.0, 50.5, 50.5, 70.0, rng.randrange(100) / 2]), rng.choice([None, None, None, "G1"]), rng.choice(["ET", "PT", None])) for i in range(60)]
    ledger = [(i, rng.choice(["accepted", "waitlist"]), 60.0) for i in rng.sample(range(70), 12)] if seed else []
    proposal = rng.sample(range(60), 20) if seed % 2 else []
    args = {"fraction": 0.25, "delta": 5.0, "window": 5, "rebaseline": seed == 3}
    df = spark.createDataFrame(pool, "id bigint, final double, barred string, tz string")
    led = spark.createDataFrame(ledger, "id bigint, status string, final double")
    prop = spark.createDataFrame(list(enumerate(proposal)), "pos int, id bigint") if proposal else None
    found = ranking.cut(df, ranking.Order("final", "tz", ("ET", "CT")), ledger=led, proposal=prop, **args)
    assert {r.id: r.status for r in found.rows.collect()} == greedy(pool, ledger, proposal=proposal, **args)


def test_cut_with_states(spark):
    pool = [(1, 90.0, None, None), (2, 80.0, None, "needs_review"), (3, 70.0, None, None), (4, 95.0, None, "withdrawn"), (5, 60.0, None, None), (6, 50.0, "G1", None), (7, 10.0, None, None)]
    ledger = [(2, "accepted", 80.0), (4, "accepted", 95.0), (5, "accepted", 61.0), (6, "gated", 50.0), (7, "waitlist", 9.0)]
    df = spark.createDataFrame(pool, "id bigint, final double, barred string, state string")
    led = spark.createDataFrame(ledger, "id bigint, status string, final double")
    found = ranking.cut(df, ranking.Order("final"), 0.34, ledger=led)
    # The withdrawn one isn't in the pool of six; neither it nor the unread one keeps a seat; the floor is 61 - 5.
    assert (found.pool_size, found.cap, found.floor) == (6, 2, 56.0)
    rows = {r.id: (r.status, r.change) for r in found.rows.collect()}
    assert rows == {1: ("seated", "newly_accepted"), 2: ("needs_review", None), 3: ("no_slot", None), 4: ("withdrawn", None), 5: ("seated", None), 6: ("barred", None), 7: ("no_slot", None)}
    again = {r.id: (r.status, r.change) for r in ranking.cut(df, ranking.Order("final"), 0.34, ledger=led, rebaseline=True).rows.collect()}
    assert again[5] == ("no_slot", "unseated") and again[1] == ("seated", "newly_accepted") and again[3] == ("seated", "newly_accepted") and again[2] == ("needs_review", "unseated")


def test_last_place_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PLACES", 7)
    waiting = spark.range(100).filter("id % 3 <> 0").selectExpr("CAST(id AS DOUBLE) AS place")
    places = sorted(r.place for r in waiting.collect())
    for free in (1, 5, 14, len(places)):
        assert ranking._last_place(waiting, free) == places[free - 1]
    assert ranking._last_place(waiting, 0) == 0 and ranking._last_place(waiting, 1000) == float("inf")


def test_rank(spark):
    rows = [(i, v) for i, v in enumerate([5.0] * 50 + [None, float("nan"), 7.0, 1.0])]
    got = {r.id: r["rank"] for r in ranking.ranked(spark.createDataFrame(rows, "id bigint, final double"), ranking.Order()).collect()}
    assert got[52] == 1 and [got[i] for i in range(50)] == list(range(2, 52)) and got[53] == 52 and {got[50], got[51]} == {53, 54}
    assert ranking.ranked(spark.createDataFrame([], "id bigint, final double"), ranking.Order()).count() == 0


def test_merge(spark):
    before = spark.createDataFrame([(1, "accepted", 9.0, "r1", "r1"), (2, "waitlist", 5.0, "r1", "r1"), (3, "waitlist", 4.0, "r1", "r1"), (4, "accepted", 8.0, "r1", "r1")], "id bigint, status string, value double, first_seen string, changed string")
    now = spark.createDataFrame([(1, "waitlist", 1.0), (2, "waitlist", 6.0), (5, "gated", 2.0)], "id bigint, status string, value double")
    rows = {r.id: tuple(r)[1:] for r in state.merge(before, now, "r2", frozen=("accepted",), present=now.select("id")).collect()}
    assert rows == {1: ("accepted", 9.0, "r1", "r1"), 2: ("waitlist", 6.0, "r1", "r1"), 3: ("withdrawn", 4.0, "r1", "r2"), 4: ("withdrawn", 8.0, "r1", "r2"), 5: ("gated", 2.0, "r2", "r2")}


def test_changes_and_pending(spark):
    remote = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id bigint, version string")
    cached = spark.createDataFrame([(2, "x"), (3, None), (4, "c")], "id bigint, version string")
    assert {r.id: r.change for r in state.changes(remote, cached).collect()} == {1: "new", 2: "updated", 3: "unchanged", 4: "gone"}
    wanted = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, None)], "id bigint, digest string")
    stored = spark.createDataFrame([(1, "d1"), (2, "old"), (3, None)], "id bigint, digest string")
    assert {r.id for r in state.pending(wanted, stored).collect()} == {2, 3}


def test_burst(spark):
    rows = spark.createDataFrame([(1, 0), (1, 100), (1, 300), (1, 301), (1, 301), (2, 5)], "k int, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.in_window for r in state.burst(rows, "k", "ts").collect()) == [1, 1, 2, 3, 4, 4]


def test_burst_slices(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(2), rng.randrange(5000)) for _ in range(400)] + [(1, None)]
    df = spark.createDataFrame(rows, "k int, s int").withColumn("ts", F.timestamp_seconds("s")).withColumn("seq", F.monotonically_increasing_id())
    for width in (7, 300, 1000):
        got = {r.seq: r.in_window for r in state.burst(df, "k", "ts", width, 300).collect()}
        kept = df.collect()
        assert got == {r.seq: None if r.s is None else sum(x.k == r.k and x.s is not None and r.s - width <= x.s <= r.s for x in kept) for r in kept}


def test_check(spark):
    good = '{"redflag":{"flags":[{"tier":2,"kind":"x","quote":"Built  PIPES"},{"tier":1.9,"quote":"never said"}],"years_experience_estimate":{"value":"6"}},"fit":{"scores":{"a":{"score":" 5 ","quote":"built pipes"},"b":{"score":3,"quote":"never"}},"bonus":{"points":2,"justification":"y"}}}'
    bad = '{"redflag":{"flags":[{"tier":"x","quote":"q"}]},"fit":{"scores":{"a":{"score":"NaN","quote":""},"c":{"score":1}},"bonus":{"points":1}}}'
    rows = [(1, good), (2, bad), (3, "[]"), (4, "no json"), (5, None)]
    df = spark.createDataFrame([(i, raw, "He built\npipes.") for i, raw in rows], "id bigint, raw string, text string")
    out = {r.id: r for r in judged.check(df, {"a": 10, "b": 10}).collect()}
    assert out[1].errors == [] and out[1].scores == {"a": 5.0, "b": 0.0} and [f.tier for f in out[1].flags] == [2] and out[1].warnings == ["score: b", "flag: unspecified"] and out[1].years == 6.0
    assert set(out[2].errors) == {"missing: b", "unknown: c", "score: a", "bonus: no reason", "flag: unspecified"} and out[2].scores is None
    assert all(out[i].errors == ["not an object"] for i in (3, 4, 5))
    assert out[1].confidence == "low"


def test_check_entry_by_entry(spark):
    loose = '{"redflag":{"flags":[],"years_experience_estimate":{"confidence":"high"}},"fit":{"scores":{"a":5,"b":{"score":"7","quote":"built pipes"}},"bonus":null}}'
    flags = '{"redflag":{"flags":[7,"x",{"tier":1,"quote":"built"}]},"fit":{"scores":{"a":{"score":0},"b":"no"}}}'
    listed = '{"redflag":{},"fit":{"scores":[1]}}'
    df = spark.createDataFrame([(1, loose), (2, flags), (3, listed)], "id bigint, raw string").withColumn("text", F.lit("He built pipes."))
    out = {r.id: r for r in judged.check(df, {"a": 10, "b": 10}).collect()}
    assert out[1].errors == [] and out[1].scores == {"b": 7.0} and out[1].confidence == "high"
    assert out[2].errors == ["flag: not an object"] * 2 and out[3].errors == ["not an object"]


def test_first_of_each(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "g string, v int")
    got = {(r.g, r.v, r.more) for r in ranking.first_of_each(rows, "g", [F.col("v").desc()], 2).collect()}
    assert got == {("a", 4, 3), ("a", 3, 3), ("b", 1, 0)}


def walk(runs):
    """Every run's statuses, and the ledger (status, final) carried as the reference carries it."""
    ledger, out = {}, {}
    for run, pool in sorted(runs.items()):
        found = greedy(pool, [(i, *x) for i, x in ledger.items()], 0.2, 5.0, 5, [], False)
        out |= {(run, i): s for i, s in found.items()}
        finals = {p[0]: p[1] for p in pool}
        for i in {*ledger, *found}:
            was, final = ledger.get(i, ("", 0.0))
            if i not in found:
                ledger[i] = ("withdrawn", final)
            else:
                ledger[i] = ({"seated": "accepted", "barred": "gated"}.get(found[i], "waitlist"), final if was == "accepted" else finals[i])
    return out


def test_every_run_is_cut_in_turn(spark):
    rng = random.Random(5)
    runs = {f"r{r}": [(i, rng.randrange(200) / 2, rng.choice([None, None, None, "G1"]), rng.choice(["ET", "PT", None])) for i in rng.sample(range(70), 45 - 3 * r)] for r in range(5)}
    rows = [(r, *p) for r, pool in runs.items() for p in pool]
    df = spark.createDataFrame(rows, "run string, id bigint, final double, barred string, tz string")
    got = ranking.cut_sequence(df, ranking.Order("final", "tz", ("ET", "CT")), 0.2).collect()
    assert {(r.run, r.id): r.status for r in got} == walk(runs) and {r.run: r.cap for r in got} == {r: len(p) // 5 for r, p in runs.items()}
    alone = ranking.cut_each(df, ranking.Order("final", "tz", ("ET", "CT")), 0.2, ("run",)).collect()
    assert {(r.run, r.id): r.status for r in alone} == {(run, i): s for run, pool in runs.items() for i, s in greedy(pool, [], 0.2, 5.0, 5, [], False).items()}


def sequence(runs, seed, states=(None,)):
    rng = random.Random(seed)
    finals = [None, float("nan"), *(x / 2 for x in range(60, 120))]
    return [(f"r{r:03}", i, rng.choice(finals), rng.choice([None, None, None, "G1"]), rng.choice(["ET", "PT", None]), rng.choice(states)) for r in range(runs) for i in rng.sample(range(70), 45 - 5 * (r % 3))]


_SEQUENCE = "run string, id bigint, final double, barred string, tz string, state string"


@pytest.mark.parametrize("states", [(None,), (None, None, None, "withdrawn", "needs_review")])
def test_runs_walked_equal_runs_cut_in_turn(spark, monkeypatch, states):
    df = spark.createDataFrame(sequence(5, 8, states), _SEQUENCE)
    order = ranking.Order("final", "tz", ("ET", "CT"))
    walked = sorted(str(r) for r in ranking.cut_sequence(df, order, 0.2).collect())
    monkeypatch.setattr(ranking, "SEATS", 3)
    assert walked == sorted(str(r) for r in ranking.cut_sequence(df, order, 0.2).collect()) and len(walked) == df.count()


def jobs_of(spark, name, action):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        action()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_sequence_do_not_grow_with_its_runs(spark):
    few, many = (spark.createDataFrame(sequence(n, 9), _SEQUENCE) for n in (2, 9))
    order = ranking.Order("final", "tz", ("ET", "CT"))
    jobs = [jobs_of(spark, f"sequence {k}", lambda df=df: ranking.cut_sequence(df, order, 0.2).collect()) for k, df in enumerate((few, many))]
    assert 0 < jobs[1] <= jobs[0] + 6


def test_jobs_of_unseated(spark, data):
    from poolcraft.queries import runs

    assert 0 < jobs_of(spark, "unseated", lambda: runs.every_rebaseline_unseated(spark, data).collect()) < 60


def test_jobs_of_guards(spark, data):
    from poolcraft.queries import runs

    assert 0 < jobs_of(spark, "guards", lambda: runs.every_cut_guards(spark, data).collect()) < 60


@pytest.mark.parametrize("states", [(None,), (None, None, None, "withdrawn", "needs_review")])
def test_guards_of_a_sequence(spark, monkeypatch, states):
    df = spark.createDataFrame(sequence(6, 12, states), _SEQUENCE)
    order = ranking.Order("final", "tz", ("ET", "CT"))
    want, rows = {}, ranking.cut_sequence(df, order, 0.2).collect()
    key = lambda x: (x != x, x)  # noqa: E731  NaN is the greatest
    for run in {r.run for r in rows}:
        own = [r for r in rows if r.run == run]
        low = min((key(r.final) for r in own if r.status == "seated" and r.final is not None), default=None)
        above = sum(low is not None and r.final is not None and r.status in ("waiting", "no_slot") and key(r.final) > low for r in own)
        want[run] = (own[0].cap, own[0].pool_size, sum(r.status == "seated" for r in own), above)
    assert {r.run: tuple(r)[1:] for r in ranking.sequence_guards(df, order, 0.2).collect()} == want and any(w[3] for w in want.values())
    monkeypatch.setattr(ranking, "SEATS", 3)
    assert {r.run: tuple(r)[1:] for r in ranking.sequence_guards(df, order, 0.2).collect()} == want


def test_guards_rank_nothing(spark, data, monkeypatch):
    from poolcraft.queries import runs

    monkeypatch.setattr(ranking, "ranked", None)
    assert runs.every_cut_guards(spark, data).count() > 2 and 0 < jobs_of(spark, "few", lambda: runs.every_cut_guards(spark, data).collect()) < 20


@pytest.mark.parametrize("states", [(None,), (None, None, None, "withdrawn", "needs_review")])
def test_unseated_of_a_sequence(spark, monkeypatch, states):
    rows = [r for r in sequence(6, 13, states) if r[0] != "r002"]
    rows += [("r002", i, 50.0, "G1", None, None) for i in range(40)]  # a run in which all are barred: all who held a seat lose it
    df = spark.createDataFrame(rows, _SEQUENCE)
    order = ranking.Order("final", "tz", ("ET", "CT"))
    seats = {(r.run, r.id) for r in ranking.cut_sequence(df, order, 0.2).collect() if r.status == "seated"}
    want, runs = set(), sorted({r[0] for r in rows})
    for before, run in zip(runs, runs[1:], strict=False):
        own = [r for r in rows if r[0] == run and r[5] is None and r[3] is None]
        own.sort(key=lambda r: (-r[2] if r[2] is not None and r[2] == r[2] else 0.0, r[4] not in ("ET", "CT"), r[1]))  # null and NaN last: all others are above 0
        cap = sum(r[0] == run and r[5] != "withdrawn" for r in rows) // 5
        want |= {(run, i) for s, i in seats if s == before} - {(run, r[1]) for r in own[:cap]}
    assert {tuple(r) for r in ranking.sequence_unseated(df, order, 0.2).collect()} == want and len({r for r, _ in want}) == len(runs) - 1
    monkeypatch.setattr(ranking, "SEATS", 3)
    got = ranking.sequence_unseated(df, order, 0.2).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_unseated_ranks_nothing(spark, data, monkeypatch):
    from poolcraft.queries import runs

    monkeypatch.setattr(ranking, "ranked", None)
    assert runs.every_rebaseline_unseated(spark, data).count() > 0 and 0 < jobs_of(spark, "less", lambda: runs.every_rebaseline_unseated(spark, data).collect()) < 20


def test_merge_all_equals_merges(spark):
    rng = random.Random(6)
    rows = [(f"r{r}", i, rng.choice(["open", "G1", "G2"]), float(rng.randrange(9))) for r in range(6) for i in rng.sample(range(25), 14)]
    df = spark.createDataFrame(rows, "run string, id bigint, status string, value double")
    held = spark.createDataFrame([], "id bigint, status string, value double, first_seen string, changed string")
    for r in range(6):
        now = df.filter(f"run = 'r{r}'").drop("run")
        held = spark.createDataFrame(state.merge(held, now, f"r{r}", frozen=("G1",), present=now.select("id")).collect(), held.schema)
    assert sorted(map(tuple, state.merge_all(df, "run", frozen=("G1",)).collect())) == sorted(map(tuple, held.collect()))


def test_queries_take_every_run(spark, data):
    from compare import tables
    from poolcraft.queries import runs

    rows = tables(data).execute("SELECT DISTINCT run_id, candidate_id FROM assessments WHERE run_id IS NOT NULL").fetchall()
    names = sorted({r for r, _ in rows})
    assert len(names) > 2 and {(r.run, r.id) for r in runs.every_sticky_cut(spark, data).collect()} == set(rows)
    assert {r.run for r in runs.every_cut_guards(spark, data).collect()} == set(names) and {r.id for r in runs.every_ledger_merge(spark, data).collect()} == {i for _, i in rows}
    assert {r.run for r in runs.every_rebaseline_unseated(spark, data).collect()} <= set(names[1:])

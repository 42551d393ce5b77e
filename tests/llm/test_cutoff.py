import random

import pytest

from poolcraft.llm import cutoff


def brute(pool):
    groups = {}
    for run, source, cand, score, pct in pool:
        groups.setdefault((run, source), (pct, []))[1].append(score)
    out = {}
    for key, (pct, scores) in groups.items():
        cap = pct * len(scores) // 100
        good = [s for s in scores if s is not None]
        cut = min((s for s in set(good) if sum(x >= s for x in good) <= cap), default=None)
        out[key] = (len(scores), cap, cut, 0 if cut is None else sum(x >= cut for x in good))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cutoffs(spark, seed):
    rng = random.Random(seed)
    pool = []
    for g, pct in enumerate([12, 20, 35, 0, 100, 150, 1, 50]):
        values = [lambda: rng.random() * 1e6, lambda: float(rng.randrange(5)), lambda: 7.0, lambda: rng.gauss(0, 1e-9)][(g + seed) % 4]
        pool += [("r", f"s{g}", i, None if rng.random() < 0.2 else values(), pct) for i in range(rng.choice([1, 3, 200]))]
    df = spark.createDataFrame(pool, "run_id string, source string, candidate_id bigint, score double, keep_pct int")
    limits = cutoff.cutoffs(df)
    assert {(r.run_id, r.source): (r.pool_size, r.cap, r.cutoff, r.kept) for r in limits.collect()} == brute(pool)
    wanted = brute(pool)
    assert cutoff.kept(df, limits).count() == sum(w[3] for w in wanted.values())


def test_pools(spark):
    rows = [
        ("r", 1, " Job_Board", None, 50.0, 1), ("r", 1, "job_board", None, 60.0, 2), ("r", 1, "job_board", None, 60.0, 2), ("r", 2, "job_board", "G1", 90.0, 1), ("r", 3, "job_board", None, float("nan"), 1),
        ("r", 4, None, None, 1.0, 1), ("r", 5, " ", None, 1.0, 1), ("r", 6, "walk_in", None, 1.0, 1), ("r", 7, "job_board", None, None, 1), (None, 8, "job_board", None, 1.0, 1), ("r", None, "job_board", None, 1.0, 1),
    ]
    df = spark.createDataFrame(rows, "run_id string, candidate_id bigint, source string, gate string, final double, at int").selectExpr("*", "timestamp_seconds(at) AS assessed_at", "'clash' AS keep_pct")
    quotas = spark.createDataFrame([("job_board", 50), (None, 3)], "source string, keep_pct int")
    got = {(r.candidate_id, r.score) for r in cutoff.pools(df, quotas).collect()}
    assert got == {(1, 60.0), (2, None), (3, None), (7, None)}
    assert cutoff.cutoffs(cutoff.pools(df.limit(0), quotas)).count() == 0

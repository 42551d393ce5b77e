"""Intervals and timestamps against brute force and on edge cases."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolcraft.operators import intervals, timestamps


def brute(rows):
    held = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and s <= t:
            held.setdefault(e, set()).update(range(s, t + 1))
    out = set()
    for e, bits in held.items():
        runs, ordered = [], sorted(bits)
        for b in ordered:
            if runs and b == runs[-1][1] + 1:
                runs[-1][1] = b
            else:
                runs.append([b, b])
        out |= {(e, "period", a, b) for a, b in runs}
        out |= {(e, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "who bigint, s int, e int").withColumn("entity", F.lit("clash")).withColumn("word", F.lit(7))
    return {tuple(r) for r in intervals.periods_and_gaps(df, "who", "s", "e").collect()}


def test_periods_random(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), (s := rng.randrange(0, 400)), s + rng.randrange(-3, 90)) for _ in range(300)]
    rows += [(None, 1, 2), (1, None, 2), (1, 5, None), (9, 59, 60), (9, 60, 61), (9, 119, 119), (9, 121, 700), (8, 0, 5000)] * 2
    assert run(spark, rows) == brute(rows)


def test_periods_empty(spark):
    assert run(spark, []) == set()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 200), st.integers(0, 200)), max_size=12))
def test_periods_property(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_months(spark):
    rows = [
        (1, "2019-3", "2019/05"), (1, " 2019-06 ", "2019-06"), (1, "2020", "2020"), (1, "????", "2021-01"), (1, "2021-01", "n.d."), (1, "2021-05", "2021-04"), (1, "2026-01", "Ongoing "),
        (2, "2026-07", None), (3, None, None), (None, "2020-01", "2020-02"), (4, "2020-13", "2021-01"), (4, "", ""),
    ] * 2
    df = spark.createDataFrame(rows, "candidate_id bigint, range_start string, range_end string")
    assert {tuple(r) for r in intervals.employment_periods(df).collect()} == {
        (1, "period", "2019-03", "2019-06"), (1, "gap", "2019-07", "2019-12"), (1, "period", "2020-01", "2020-01"), (1, "gap", "2020-02", "2025-12"), (1, "period", "2026-01", "2026-08"),
        (2, "period", "2026-07", "2026-08"),
    }


def us(*parts, tz="UTC", fold=0, micro=0):
    dt = datetime(*parts, microsecond=micro, tzinfo=ZoneInfo(tz), fold=fold).astimezone(timezone.utc)
    return (dt - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("2024-12-11T08:27:19Z", us(2024, 12, 11, 8, 27, 19)), ("2023-06-23", us(2023, 6, 23, tz="Europe/Berlin")), ("1766268949", 1766268949_000000), ("1770132729188", 1770132729188_000),
    ("1761796067612161", 1761796067612161), ("1756591836.6", 1756591836_600000), ("04/06/2023 22:54", us(2023, 6, 4, 22, 54, tz="Europe/Berlin")), ("13.07.2023 16:38", us(2023, 7, 13, 16, 38, tz="Europe/Berlin")),
    ("26/5/26 21:48", us(2026, 5, 26, 21, 48, tz="Europe/Berlin")), ("28/05/2026 12:55:42 AM", us(2026, 5, 28, 0, 55, 42, tz="Europe/Berlin")), ("2026-01-05 15:26:08 -0330", us(2026, 1, 5, 18, 56, 8)),
    ("2025-05-03 04:47:51 PDT", us(2025, 5, 3, 11, 47, 51)), ("2023-07-01 00:00:00 EST", us(2023, 7, 1, 5)), ("2023-04-03T10:23:23[America/New_York]", us(2023, 4, 3, 10, 23, 23, tz="America/New_York")),
    ("Wed, 20 Aug 2025 22:49:49 -0330", us(2025, 8, 21, 2, 19, 49)), ("Jul 13, 2024 3:32 PM", us(2024, 7, 13, 15, 32, tz="Europe/Berlin")), ("Sun Mar  8 02:56:26 2026", us(2026, 3, 8, 2, 56, 26, tz="Europe/Berlin")),
    ("D:20221119191909+11'00'", us(2022, 11, 19, 8, 19, 9)), ("D:20230120010203Z00'00'", us(2023, 1, 20, 1, 2, 3)), ("D:202404171206", us(2024, 4, 17, 12, 6, tz="Europe/Berlin")),
    ("20260101T173317Z", us(2026, 1, 1, 17, 33, 17)), ("2026-07-13t16:31:22z", us(2026, 7, 13, 16, 31, 22)), (" 2024-06-15T14:19:21.5Z\t", us(2024, 6, 15, 14, 19, 21, micro=500000)),
    ("2023-10-29 02:30:00", us(2023, 10, 29, 2, 30, tz="Europe/Berlin")), ("2023-03-26 02:33:20", us(2023, 3, 26, 3, 33, 20, tz="Europe/Berlin")),
    ("2025-02-30 10:15:00", None), ("2024-09-31", None), ("31/31/2025 09:00", None), ("0000-00-00 00:00:00", None), ("25:61 04.05.2025", None), ("2025-06-", None), ("13/9/23 13:00 PM", None),
    ("", None), ("-", None), ("null", None), (None, None), ("yesterday", None), ("12345", None), ("2024-01-01 10:00:00 Mars/Base", None), ("2024-01-01 24:00:00", None),
]


def _read(spark, values, **policy):
    openings = spark.createDataFrame([("b", "Europe/Berlin", "dmy"), ("u", "Nowhere/City", "mdy"), (None, "UTC", "mdy")], "opening_id string, tz_name string, date_order string")
    rows = spark.createDataFrame(values, "n int, opening_id string, value string").withColumn("tz_name", F.lit("clash"))
    return {r.n: r.epoch_us for r in timestamps.normalise(rows, openings, "opening_id", "value", **policy).collect()}


def test_timestamps(spark):
    found = _read(spark, [(i, "b", v) for i, (v, _) in enumerate(CASES)])
    for i, (value, wanted) in enumerate(CASES):
        assert found[i] == wanted, value


def test_timestamp_sources_and_policies(spark):
    found = _read(spark, [(0, None, "2024-01-01 10:00:00"), (1, None, "2024-01-01T10:00:00Z"), (2, "x", "04/06/2023"), (3, "u", "2024-01-01"), (4, "u", "1/2/2024 10:00 UTC")])
    assert found == {0: None, 1: us(2024, 1, 1, 10), 2: None, 3: None, 4: us(2024, 1, 2, 10)}
    twice = [(0, "b", "2023-10-29 02:30:00")]
    assert _read(spark, twice, ambiguous="later")[0] == us(2023, 10, 29, 2, 30, tz="Europe/Berlin", fold=1)
    assert _read(spark, twice, ambiguous="null")[0] is None
    assert _read(spark, [(0, "b", "2023-03-26 02:33:20"), (1, "b", "2023-03-26 01:33:20")], nonexistent="null") == {0: None, 1: us(2023, 3, 26, 1, 33, 20, tz="Europe/Berlin")}

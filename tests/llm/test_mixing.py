from pyspark.sql import functions as F

from poolcraft.llm import mixing

TARGETS = [("a", 0.5, 2), ("b", 0.3, 3), (" C ", 0.15, 4), ("none", 0.05, 2), ("a", 0.5, 2), (None, 0.1, 1)]


def run(spark, documents, block=64, targets=TARGETS):
    sized = spark.createDataFrame(documents, "source string, doc_id bigint, tokens bigint").withColumn("block", F.lit("clash"))
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mixture(sized, goals, block_tokens=block)


def test_shares_and_repeats(spark):
    documents = [("a", i, 40 + i % 90) for i in range(900)] + [("b", 2000 + i, 100) for i in range(200)] + [("c", 3000 + i, 1 if i else 9000) for i in range(30)] + [("d", 1, 50), (None, 2, 50), ("a", 9000, 0)]
    mixed, offered = run(spark, documents)
    report = {r.source: r for r in mixing.report(mixed, offered).collect()}
    assert set(report) == {"a", "b", "c", "none"} and report["none"].tokens_used == 0 and report["none"].actual_share == 0
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(report[source].actual_share - share / 0.95) < 0.01 and report[source].uses <= report[source].max_repeats
    # Every use of a block holds the same pieces, pieces of one use don't overlap, and no use goes beyond the limit.
    pieces = mixed.select("source", "doc_id", "use", "from_token", "to_token").collect()
    seen = {}
    for p in pieces:
        span = seen.setdefault((p.source, p.doc_id, p.use), set())
        own = set(range(p.from_token, p.to_token))
        assert own and not span & own
        span |= own
    sizes = {(s, d): n for s, d, n in documents}
    assert all(len(v) <= sizes[k[0], k[1]] for k, v in seen.items())
    # The first sources to run out sets the length: someone has used nearly all it may.
    assert max(r.tokens_used / (r.tokens * r.max_repeats) for r in report.values() if r.tokens) > 0.97
    assert sorted(map(tuple, run(spark, documents)[0].collect())) == sorted(map(tuple, mixed.collect()))


def test_prefix_shares(spark):
    mixed, _ = run(spark, [("a", i, 64) for i in range(400)] + [("b", i, 64) for i in range(400)] + [("c", i, 64) for i in range(400)])
    first = mixed.filter("slot < 200").groupBy("source").count().collect()
    assert all(abs(r["count"] / 200 - {"a": 0.5, "b": 0.3, "c": 0.15}[r.source] / 0.95) < 0.03 for r in first)


def test_points(spark):
    got = [r.p for r in spark.range(8).orderBy("id").select(mixing.van_der_corput(F.col("id")).alias("p")).collect()]
    assert got == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_empty(spark):
    mixed, offered = run(spark, [])
    assert mixed.count() == 0 and {r.source for r in mixing.report(mixed, offered).collect()} == {"a", "b", "c", "none"}


def test_points_of_late_slots(spark):
    rows = spark.createDataFrame([(2**40 + 5,), (2**50 + 1,), (2**61,)], "n bigint").select(mixing.van_der_corput(F.col("n")).alias("p")).collect()
    assert [r.p for r in rows] == [0.625 + 2.0**-41, 0.5 + 2.0**-51, 2.0**-62]

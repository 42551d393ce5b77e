"""Mixing sources to target weights (problem 8).

Every source's documents are shuffled (by a keyed hash), laid end to end and
cut into blocks of equal token numbers (to one token). Slot n of the mixture gets the van der
Corput point of n (its bits mirrored behind the binary point); the source whose
stretch of the cumulative weights holds the point fills the slot, with its next
block. Any prefix of the slots then has nearly the target shares. A source's
blocks are used again, in the same order, up to its number of repeats; the
schedule ends with the last slot that every source can fill.

All positions are exact prefix sums in two levels (within a bucket of bounded
size, and over the bucket totals), so no source is ever ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolcraft.session import cut_lineage

#: Bits of a slot number that are mirrored: all that a slot number (below 2**62) can have.
BITS = 62

#: Tokens a block should hold; a source's blocks are all of the one size nearest to it that divides the source evenly.
BLOCK_TOKENS = 64

#: Slots whose ranks are counted in one task.
SLOTS_PER_BUCKET = 1 << 14

#: Documents, on average, that are ordered in one task.
DOCUMENTS_PER_BUCKET = 4096


def clean_source(column: Column) -> Column:
    """Trimmed, lower case; empty becomes null."""
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))


def van_der_corput(n: Column) -> Column:
    """Point in [0, 1) of a slot number: its binary digits, mirrored."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(n), BITS, "0")), 2, 10).cast("bigint")
    return mirrored / F.lit(float(1 << BITS))


@dataclass(frozen=True)
class Stretch:
    """What a target source offers, and its part ``low <= point < high`` of the slots."""

    source: str
    target_share: float
    max_repeats: int
    documents: int
    tokens: int
    n_blocks: int
    low: float
    high: float


def stretches(targets: DataFrame, sized: DataFrame, block_tokens: int = BLOCK_TOKENS) -> list[Stretch]:
    """One stretch per target source, in order of source.

    Sources without tokens, or without a positive share or repeats, get none; those of the others fill
    [0, 1) in proportion to share / tokens per block, so that tokens, not slots, meet the shares. The
    list has a row per row of ``targets``, the mixture's settings, so it may come to the driver.
    """
    goals = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL").dropDuplicates(["source"])
    supply = sized.join(goals.select("source"), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    rows = sorted(goals.join(supply, "source", "left").fillna(0).collect(), key=lambda r: r.source)
    n_blocks = [max(1, round(r.tokens / block_tokens)) if r.tokens else 0 for r in rows]
    parts = [max(0.0, r.target_share) * n / r.tokens if n and r.max_repeats > 0 else 0.0 for r, n in zip(rows, n_blocks, strict=True)]
    whole, low, found = sum(parts), 0.0, []
    last = max((i for i, part in enumerate(parts) if part), default=-1)
    for i, (r, n, part) in enumerate(zip(rows, n_blocks, parts, strict=True)):
        high = 1.0 if i == last else low + (part / whole if whole else 0.0)
        found.append(Stretch(r.source, r.target_share, r.max_repeats, r.documents, r.tokens, n, low, high if part else low))
        low = found[-1].high
    return found


def blocks(sized: DataFrame, offered: list[Stretch], seed: str = "mix") -> DataFrame:
    """(source, block, doc_id, from_token, to_token): pieces of documents, block by block.

    ``sized`` has source, doc_id and tokens. Documents with no tokens have no piece, repeated rows are documents of their own.
    """
    sizes = sized.sparkSession.createDataFrame([(s.source, s.documents, s.tokens, s.n_blocks) for s in offered if s.tokens], "source string, docs bigint, supply bigint, n_blocks bigint")
    some = sized.filter("tokens > 0").join(sizes, "source").withColumn("h", F.xxhash64(F.lit(seed), "source", "doc_id"))
    bucket = F.pmod(F.shiftrightunsigned("h", 20), F.ceil(F.col("docs") / DOCUMENTS_PER_BUCKET).cast("bigint"))
    some = some.withColumn("bucket", bucket)
    totals = some.groupBy("source", "bucket").agg(F.sum("tokens").alias("total"))
    # One row per bucket: a source of a billion documents has 250,000.
    before = totals.select("source", "bucket", (F.sum("total").over(Window.partitionBy("source").orderBy("bucket")) - F.col("total")).alias("base"))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = some.withColumn("end", F.sum("tokens").over(order)).join(before, ["source", "bucket"]).withColumn("stop", F.col("base") + F.col("end")).withColumn("start", F.col("stop") - F.col("tokens"))
    # Block b holds the tokens from floor(b * supply / n_blocks) up to the next block's first.
    first, last = "(start * n_blocks + n_blocks - 1) DIV supply", "((stop - 1) * n_blocks + n_blocks - 1) DIV supply"
    pieces = placed.select("source", "doc_id", "start", "stop", "supply", "n_blocks", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    cut = pieces.withColumn("begins", F.expr("block * supply DIV n_blocks")).withColumn("ends", F.expr("(block + 1) * supply DIV n_blocks"))
    return cut.select(
        "source", "block", "doc_id",
        (F.greatest("start", "begins") - F.col("start")).cast("int").alias("from_token"),
        (F.least("stop", "ends") - F.col("start")).cast("int").alias("to_token"),
    ).filter("to_token > from_token")


def schedule(spark: SparkSession, offered: list[Stretch]) -> DataFrame:
    """(slot, source, rank, n_blocks): which source fills each slot, and with its which block, rank from 0.

    The schedule is as long as all sources can fill: it ends before the first slot whose source has used its
    ``n_blocks * max_repeats`` blocks. No stretch, no slot.
    """
    live = [s for s in offered if s.high > s.low]
    # A source is full after about blocks / share slots; the first to be so decides. The points of n slots miss a stretch's share
    # by at most log2(n) + 2 slots, hence the margin.
    bound = int(min(((s.n_blocks * s.max_repeats + 2 * BITS) / (s.high - s.low) for s in live), default=-1)) + 1
    point = F.col("point")
    which = n_blocks = limit = F.when(F.lit(False), None)
    for s in live:
        which = which.when(point < s.high, s.source)
        n_blocks, limit = n_blocks.when(point < s.high, s.n_blocks), limit.when(point < s.high, s.n_blocks * s.max_repeats)
    slots = spark.range(bound).select(F.col("id").alias("slot"), (F.col("id") / SLOTS_PER_BUCKET).cast("bigint").alias("bucket"), van_der_corput(F.col("id")).alias("point"))
    filled = slots.select("slot", "bucket", which.cast("string").alias("source"), n_blocks.cast("bigint").alias("n_blocks"), limit.cast("bigint").alias("limit"))
    counts = filled.groupBy("bucket", "source").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    order = Window.partitionBy("bucket", "source").orderBy("slot")
    ranked = filled.withColumn("k", F.row_number().over(order) - 1).join(before, ["bucket", "source"]).withColumn("rank", F.col("base") + F.col("k"))
    ranked = cut_lineage(ranked.select("slot", "source", "rank", "n_blocks", "limit"))
    stop = ranked.filter(F.col("rank") >= F.col("limit")).agg(F.min("slot")).first()[0]
    return ranked.filter(F.col("slot") < stop if stop is not None else F.lit(True)).select("slot", "source", "rank", "n_blocks")


def mixture(sized: DataFrame, targets: DataFrame, seed: str = "mix", block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, list[Stretch]]:
    """The mixture (slot, source, use, block, doc_id, from_token, to_token) and the stretches.

    ``sized``: source (trimmed, lower case; null: takes no part), doc_id, tokens. ``targets``: source, target_share,
    max_repeats; a repeated source counts once, a null one not at all. Empty inputs give an empty mixture.
    """
    part = cut_lineage(sized.filter("source IS NOT NULL").select("source", "doc_id", "tokens"))
    offered = stretches(targets, part, block_tokens)
    slots = schedule(sized.sparkSession, offered).withColumn("block", F.pmod(F.col("rank"), F.col("n_blocks"))).withColumn("use", F.expr("rank DIV n_blocks + 1"))
    mixed = slots.select("slot", "source", "use", "block").join(blocks(part, offered, seed), ["source", "block"])
    return mixed.select("slot", "source", "use", "block", "doc_id", "from_token", "to_token"), offered


def report(mixed: DataFrame, offered: list[Stretch]) -> DataFrame:
    """Per target source: documents and their tokens, most uses of a document, tokens used, target and actual share."""
    used = mixed.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("tokens_used"), F.max("use").alias("uses"))
    goals = mixed.sparkSession.createDataFrame(
        [(s.source, s.documents, s.tokens, s.max_repeats, s.target_share) for s in offered],
        "source string, documents bigint, tokens bigint, max_repeats int, target_share double",
    )
    joined = goals.join(used, "source", "left").fillna(0, ["tokens_used", "uses"])
    whole = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # a row per target
    return joined.select(
        "source", "documents", "tokens", "uses", "max_repeats", "tokens_used", "target_share",
        F.when(whole > 0, F.col("tokens_used") / whole).otherwise(0.0).alias("actual_share"),
    )

"""List items of documents, and passages that recur inside and across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolcraft.functions import text as T
from poolcraft.session import cut_lineage


def bullets(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, pos, bullet): the list items of each document with the number of their line. Null texts have none."""
    exploded = documents.select(key, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).filter(F.col("line").rlike(T.BULLET))
    return exploded.select(key, "pos", T.bullet(F.col("line")).alias("bullet")).filter("bullet <> ''")


def hashed(items: DataFrame, key: str = "id", min_words: int = 6) -> DataFrame:
    """(key, pos, bullet, h) of items with at least ``min_words`` words; short phrases recur by chance."""
    normal = items.withColumn("__n", T.normalize(F.col("bullet")))
    return normal.filter((F.col("__n") != "") & (F.size(F.split("__n", " ")) >= min_words)).select(key, "pos", "bullet", F.substring(F.sha1("__n"), 1, 16).alias("h"))


def _owners(items: DataFrame, key: str, min_words: int) -> DataFrame:
    """(h, key, bullet): one row per owner of a passage, with its last wording."""
    return hashed(items, key, min_words).groupBy("h", key).agg(F.max_by("bullet", "pos").alias("bullet"))


def shared_counts(items: DataFrame, key: str = "id", min_words: int = 6) -> DataFrame:
    """(key, passages, partners): how many of a document's passages others have too, and the sum of the other owners over them.

    Counted from the owners per passage, so a passage of a million owners makes a million rows and no pairs.
    """
    owners = cut_lineage(hashed(items, key, min_words).select("h", key).distinct())
    sizes = owners.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return owners.join(sizes, "h").groupBy(key).agg(F.count(F.lit(1)).alias("passages"), F.sum(F.col("n") - 1).alias("partners"))


def shared_passages(items: DataFrame, key: str = "id", min_words: int = 6) -> DataFrame:
    """(h, owners, first_owner, bullet): the passages with at least two owners, one row each."""
    owners = _owners(items, key, min_words)
    return owners.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.min(key).alias("first_owner"), F.min_by("bullet", key).alias("bullet")).filter("owners > 1")


def members(items: DataFrame, key: str = "id", min_words: int = 6) -> DataFrame:
    """(h, key, bullet): every owner of every passage with at least two owners, a row each, with the owner's last wording.

    The owners of a passage share ``h``, so who shares what with whom follows without a row per pair.
    """
    owners = cut_lineage(_owners(items, key, min_words))
    sizes = owners.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return owners.join(sizes, "h").select("h", key, "bullet")


def near_within(items: DataFrame, key: str = "id", threshold: float = 0.85, min_words: int = 6) -> DataFrame:
    """(key, pos_a, pos_b, similarity): pairs of one document's items whose words are at least ``threshold`` alike.

    Two items that alike share one of their first words, in an order that puts long words first; only items of a document that meet in one are compared, so a
    document of many items is no list of all pairs, and no task holds it.
    """
    normal = items.withColumn("__n", T.normalize(F.col("bullet"))).filter((F.col("__n") != "") & (F.size(F.split("__n", " ")) >= min_words))
    longest_first = F.transform(F.array_sort(F.transform(T.words(F.col("bullet")), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: x["w"])
    worded = cut_lineage(normal.select(key, "pos", longest_first.alias("w")).filter(F.size("w") > 0))
    # Alike items share ceil(threshold * size) words at least, hence one of each item's first size - that + 1.
    first = worded.select(key, "pos", F.size("w").alias("n"), F.explode(F.slice("w", F.lit(1), F.size("w") - F.ceil(F.lit(threshold) * F.size("w") - 1e-9).cast("int") + 1)).alias("word"))
    a, b = (first.select(key, F.col("pos").alias(f"pos_{x}"), F.col("n").alias(f"n_{x}"), "word") for x in "ab")
    close = (F.col("pos_a") < F.col("pos_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    met = a.join(b, [key, "word"]).filter(close).select(key, "pos_a", "pos_b").distinct()
    for x in "ab":
        met = met.join(worded.select(key, F.col("pos").alias(f"pos_{x}"), F.col("w").alias(f"w_{x}")), [key, f"pos_{x}"])
    shared = F.size(F.array_intersect("w_a", "w_b"))
    judged = met.withColumn("similarity", shared / (F.size("w_a") + F.size("w_b") - shared)).filter(F.col("similarity") >= threshold)
    return judged.select(key, "pos_a", "pos_b", F.bround("similarity", 3).alias("similarity"))

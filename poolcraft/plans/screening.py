"""From files and records to a ranked pool: the pipeline's stages put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.operators import contact, facts, judged, passages, ranking
from poolcraft.session import cut_lineage
from poolcraft.sources import files


def document_facts(texts: DataFrame, today: int, key: str = "id", text: str = "markdown") -> DataFrame:
    """One row of facts per document: placeholders, list items, skills, degree, shared passages and employment.

    Each detector makes one row per key, so the joins are by key only; the texts are read once from the checkpoint folder.
    """
    held = cut_lineage(texts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce(text, F.lit(""))).alias("markdown")))
    marks = facts.placeholders(held, key).groupBy(key).agg(F.count(F.lit(1)).alias("placeholders"))
    shared = passages.shared_counts(passages.bullets(held, key), key)
    ranges = facts.date_ranges(held, key).withColumn("end", F.coalesce("last", F.lit(today)))
    months = ranges.groupBy(key).agg(
        F.count_if(F.col("last").isNotNull() & (F.col("first") >= today - 60) & (F.col("last") - F.col("first") + 1 < 12)).alias("short_stints"),
        F.count_if(F.col("end") < F.col("first")).alias("malformed"), F.count(F.lit(1)).alias("ranges"), F.bool_and("precise").alias("precise"),
    )
    confidence = F.when((F.col("malformed") > 0) | (F.col("ranges") < 2), "low").when(F.col("precise"), "high").otherwise("medium")
    rows = held.select(key, F.length("markdown").alias("text_chars"))
    for part in (marks, facts.bullet_style(held, key), facts.skills(held, key), facts.degrees(held, key), shared, months.withColumn("confidence", confidence)):
        rows = rows.join(part, key, "left")
    return rows.fillna(0, ["placeholders", "bullet_count", "power_verb_density", "metric_count", "round_metric_ratio", "passages", "partners", "short_stints"])


def people_of(documents: DataFrame, side: DataFrame | None = None) -> DataFrame:
    """(id, first_name, last_name, email, phone) of :func:`files.documents`: names from the file's stem, the rest from ``side``, rows of :func:`files.side_input`.

    The stem up to its first space is the first name, what follows the last; rows are joined by the folded stem. Without a row, e-mail and phone are null.
    """
    name = F.trim("name")
    rows = documents.select("id", F.lower(name).alias("key"), F.substring_index(name, " ", 1).alias("first_name"), F.regexp_extract(name, r"(?s)^[^ ]* (.*)$", 1).alias("last_name"))
    if side is None:
        return rows.select("id", "first_name", "last_name", *[F.lit(None).cast("string").alias(c) for c in ("email", "phone")])
    given = {c.lower(): c for c in side.columns}
    contacts = side.select("key", *[F.col(f"`{given[c]}`").alias(c) if c in given else F.lit(None).cast("string").alias(c) for c in ("email", "phone")])
    return rows.join(contacts, "key", "left").select("id", "first_name", "last_name", "email", "phone")


def screen_folder(spark: SparkSession, folder: str, verdicts: DataFrame, rubric: dict[str, float], fraction: float, today: int, side_path: str | None = None) -> DataFrame:
    """(id, final, rank, status, problem) of the documents of a folder, judged by ``verdicts`` (id, raw).

    Texts are redacted before quotes are checked, with the names in the files' stems and the e-mails and phones in the CSV file ``side_path``. Documents that can't be read, or have no valid verdict, count in the pool and need review, with the reason; those with template text left in are barred.
    """
    documents = files.documents(spark, folder)
    parsed = cut_lineage(files.parsed(documents, min_chars=40))
    people = people_of(documents, files.side_input(spark, side_path) if side_path else None)
    clean = contact.redact(parsed.filter("problem IS NULL"), people).select("id", "text")
    checked = judged.check(clean.join(verdicts, "id").select("id", "raw", "text"), rubric)
    found = document_facts(parsed, today).select("id", "placeholders")
    joined = parsed.select("id", "problem").join(checked, "id", "left").join(found, "id", "left")
    unread = F.coalesce(F.col("problem"), F.when(F.col("errors").isNull(), "no verdict").when(F.size("errors") > 0, "bad verdict"))
    marked = F.when(F.col("placeholders") > 0, "placeholders")
    pool = joined.select("id", F.coalesce(judged.total(F.col("scores")) + F.col("bonus"), F.lit(0.0)).alias("final"), marked.alias("barred"), F.when(unread.isNotNull(), "needs_review").alias("state"))
    cut = ranking.cut(pool, ranking.Order("final"), fraction)
    return cut.rows.join(joined.select("id", F.coalesce(unread, marked).alias("problem")), "id").select("id", "final", "rank", "status", "problem")

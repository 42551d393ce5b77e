"""Replacing contact details in text by literal patterns, in a fixed order, with counts.

Every step is a projection of its own, with built-in expressions only: the patterns that all rows share are literals, compiled once; only a record's own e-mail, phone and names are
patterns made from its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and placeholders as the reference results need them.
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
PROFILE = r"(?i)(?:https?://)?(?:www\.)?(?:linkedin\.com/(?:in|pub)/[\w\-%]+|github\.com/[\w\-]+|twitter\.com/[\w\-]+|x\.com/[\w\-]+)/?"
STREET = r"(?i)\b\d{1,6}\s+[A-Z][A-Za-z.\-]*(?:\s+[A-Z][A-Za-z.\-]*)*\s+(?:St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Ln|Lane|Dr|Drive|Ct|Court|Way|Pl|Place)\b\.?"
CITY = r"\b([A-Z][a-zA-Z.\- ]{2,24}),\s*([A-Z]{2})\b(?:\s+\d{5}(?:-\d{4})?)?"
ZIP = r"\b\d{5}(?:-\d{4})?\b"
SCHOOL = r"\b(?:[A-Z][\w.\-]*\s+){0,4}(?:University|Universität|Universidad|College|Institute of Technology|Polytechnic|School of [A-Z]\w+)(?:\s+of\s+[A-Z][\w.\-]*(?:\s+[A-Z][\w.\-]*)?)?"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?"
GUARDED_PHONE = rf"(?=[+(\d](?:[\s.()-]{{0,3}}\d){{6}}){PHONE}"
HEAD = r"(?s)\A((?:[ \t\r]*\n)*(?:(?![ \t]*(?:[-*+][ \t]|\d+[.)][ \t]|#{2,}[ \t]))[^\n]*\S[^\n]*(?:\n|\z)(?:[ \t\r]*\n)*){0,5})"
STEPS = (("profile_url", PROFILE, "[PROFILE_URL]"), ("address", STREET, "[LOCATION]"), ("city_state", CITY, "[LOCATION]"), ("zip", ZIP, "[LOCATION]"), ("school", SCHOOL, "[SCHOOL]"))


def quoted(value: Column) -> Column:
    """A column's value as a literal pattern."""
    return F.regexp_replace(value, r"([\\.^$|?*+()\[\]{}-])", r"\\$1")


def redact(documents: DataFrame, records: DataFrame, key: str = "id", text: str = "markdown", email: str = "email", phone: str = "phone", first: str = "first_name", last: str = "last_name") -> DataFrame:
    """(key, text, kinds, tokens_replaced): one row per row of ``documents``; kinds has the kinds that occurred.

    ``records`` has one row per key; a document without a record has only the general patterns applied. Null texts count as empty.
    """
    known = records.select(key, *[F.coalesce(F.trim(F.col(c)), F.lit("")).alias(f"__{n}") for n, c in (("email", email), ("phone", phone), ("first", first), ("last", last))])
    rows = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t")).join(known, key, "left").fillna("", ["__email", "__phone", "__first", "__last"])
    kinds = ("email", "phone", "name", *dict.fromkeys(kind for kind, _, _ in STEPS))
    rows = rows.withColumns({f"__n_{kind}": F.lit(0) for kind in kinds})

    def step(df: DataFrame, kind: str, pattern: Column | str, mark: str | None = None, at: str = "__t") -> DataFrame:
        """Each match of ``pattern`` in column ``at`` replaced, and counted. A null pattern matches nowhere."""
        pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
        n, new = F.regexp_count(at, pattern), F.regexp_replace(at, pattern, mark or f"[{kind.upper()}]")
        return df.withColumns({at: F.coalesce(new, F.col(at)), f"__n_{kind}": F.col(f"__n_{kind}") + F.coalesce(n, F.lit(0))})

    def own(name: str, pattern: Column, at_least: int) -> Column:
        """A pattern with a literal of the row; null where that is too short."""
        return F.when(F.length(name) >= at_least, pattern)

    a, b, full = quoted(F.col("__first")), quoted(F.col("__last")), F.trim(F.concat_ws(" ", "__first", "__last"))
    rows = step(rows, "email", own("__email", F.concat(F.lit("(?i)"), quoted(F.col("__email"))), 5))
    rows = step(rows, "phone", own("__phone", F.concat(F.lit("(?i)"), quoted(F.col("__phone"))), 5))
    rows = step(rows, "email", EMAIL)
    both = F.concat(F.lit("(?i)\\b"), a, F.lit(r"(?:\s+[A-Z][A-Za-z.'\-]*){0,2}\s+"), b, F.lit("\\b"))
    rows = step(rows, "name", F.when((F.length("__first") > 2) & (F.length("__last") > 2), both))
    # The head of a document: up to the first list item, smaller heading or fifth line with text. There a name alone is the person's.
    rows = rows.withColumn("__h", F.regexp_extract("__t", HEAD, 1))
    rows = rows.withColumn("__rest", F.substr("__t", F.length("__h") + 1))
    for n, v in (("__first", a), ("__last", b)):
        rows = step(rows, "name", own(n, F.concat(F.lit("(?i)\\b"), v, F.lit("\\b")), 3), at="__h")
    rows = rows.withColumn("__t", F.concat("__h", "__rest")).drop("__h", "__rest")
    # The full name as it stands, however short its parts are.
    rows = step(rows, "name", F.when(F.length(full) > 2, F.concat(F.lit("(?i)\\b"), quoted(full), F.lit("\\b"))))
    # Elsewhere a lone name counts only as written and away from other capitalised words, which would make it an organisation's. The look back, which is dear, comes last.
    for n, v in (("__first", a), ("__last", b)):
        rows = step(rows, "name", own(n, F.concat(F.lit(r"\b(?="), v, F.lit(r"\b(?!\s+[A-Z]))(?<![A-Z][A-Za-z'\-]{0,40}\s\n?)"), v), 3))
    for kind, pattern, mark in STEPS:
        rows = step(rows, kind, pattern, mark)
    found = F.filter(F.regexp_extract_all("__t", F.lit(GUARDED_PHONE), F.lit(0)), lambda m: (F.length(F.regexp_replace(m, r"\D", "")) >= 7) & ~F.trim(m).rlike(r"^(?:19|20)\d{2}(?:[-/]\d{1,2})?$"))
    rows = rows.withColumn("__m", found)
    cleared = F.aggregate(F.array_distinct(F.transform("__m", F.trim)), F.col("__t"), lambda t, v: F.replace(t, v, F.lit("[PHONE]")))
    rows = rows.withColumns({"__t": cleared, "__n_phone": F.col("__n_phone") + F.size("__m")}).drop("__m")
    counts = F.create_map(*[x for kind in kinds for x in (F.lit(kind), F.col(f"__n_{kind}"))])
    total = F.lit(0)
    for kind in kinds:
        total = total + F.col(f"__n_{kind}")
    return rows.select(key, F.col("__t").alias("text"), F.map_filter(counts, lambda _, v: v > 0).alias("kinds"), total.alias("tokens_replaced"))


def leaks(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, leaks): what is still there of e-mail addresses, phones of ten digits or more and profile links, as a list of kinds."""
    t = F.coalesce(F.col(text), F.lit(""))
    long_phone = F.exists(F.regexp_extract_all(t, F.lit(PHONE), F.lit(0)), lambda m: F.length(F.regexp_replace(m, r"\D", "")) >= 10)
    found = F.array_compact(F.array(F.when(t.rlike(EMAIL), "email"), F.when(long_phone, "phone"), F.when(t.rlike(PROFILE), "profile url")))
    return texts.select(key, found.alias("leaks"))

"""Text primitives as Column -> Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as text editors see them; an explicit class, as ``\\R`` lacks some.
LINE_SEP = "\r\n|[\n\u000b\f\r\u001c-\u001e\u0085\u2028\u2029]"
# The marks of list items, headings and emphasis.
#: White space of any script at the ends.
OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
BULLET = r"^\s*(?:[-*+]|\d+[.)])\s+(.*\S)\s*$"
HEADING = r"^\s{0,3}(#{1,6})\s+(.*\S)\s*$"
EMPHASIS = "[*_`]{1,3}"


def normalize(text: Column) -> Column:
    """Lower case; every run of characters other than a-z and 0-9 becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def passage_hash(text: Column) -> Column:
    """16 hex digits that equal passages share, whatever their case and punctuation."""
    return F.substring(F.sha1(normalize(text)), 1, 16)


def lines(text: Column) -> Column:
    """The lines of a text; none for null."""
    return F.split(text, LINE_SEP)


def bullet(line: Column) -> Column:
    """Text of a list item without its marker and emphasis; empty for other lines."""
    return F.trim(F.regexp_replace(F.regexp_extract(line, BULLET, 1), EMPHASIS, ""))


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading, 0 for other lines."""
    # A mark can only stand in the first four places; other lines are told apart without the pattern.
    return F.when(F.instr(line, "#").between(1, 4), F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0)


def words(text: Column) -> Column:
    """Distinct normalised words without pure numbers."""
    return F.array_distinct(F.filter(F.split(normalize(text), " "), lambda w: (w != "") & ~w.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays of distinct values; 0 when one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def unified(text: Column) -> Column:
    """The text with every line end as a line feed."""
    return F.regexp_replace(text, LINE_SEP, "\n")


def section(text: Column, names: Sequence[str]) -> Column:
    """Body under the first heading that contains one of ``names``, up to the next heading of its level or above; null when there is none.

    ``text`` is :func:`unified` and should be a column (not an expression), as it is used several times. The patterns are literals and go over the text once each.
    """
    opening = rf"(?md)^[^\S\n]{{0,3}}(#{{1,6}})[^\S\n]+(?=[^\n]*(?i:{'|'.join(names)}))[^\n]*\S[^\S\n]*$(?s:(.*))"
    level, rest = F.length(F.regexp_extract(text, opening, 1)), F.regexp_extract(text, opening, 2)
    body = F.lit(None).cast("string")
    for most in range(6, 0, -1):
        stop = rf"(?md)\A(?s:(.*?))(?:^[^\S\n]{{0,3}}#{{1,{most}}}[^\S\n]+[^\n]*\S[^\S\n]*$|\z)"
        body = F.when(level == most, F.regexp_extract(rest, stop, 1)).otherwise(body)
    return F.nullif(F.regexp_replace(body, OUTER, ""), F.lit(""))


def squeezed(text: Column) -> Column:
    """Lower case with white space collapsed and trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def contains_quote(text: Column, quote: Column) -> Column:
    """The quote occurs in the text, white space and case aside; a blank quote never does. Null is false."""
    return F.coalesce((squeezed(quote) != "") & squeezed(text).contains(squeezed(quote)), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences: per line, without list marker and emphasis, split after . ! ? and white space; blanks dropped."""
    plain = F.transform(lines(text), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*+]|\d+[.)])\s+", ""), EMPHASIS, ""))
    cut = F.flatten(F.transform(plain, lambda x: F.split(x, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, OUTER, "")), lambda x: x != "")


def labelled_value(fields: Column, labels: Sequence[str], unlike: str | None = None) -> Column:
    """First non-blank value whose folded label equals one of ``labels``; null when there is none. Values that match ``unlike`` are passed over, and the next field is tried."""
    hits = F.filter(fields, lambda x: normalize(x["name"]).isin(*labels) & (F.trim(x["value"]) != "") & (~x["value"].rlike(unlike) if unlike else F.lit(True)))
    return F.trim(F.get(hits, F.lit(0))["value"])


def first_contained(text: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Answer of the first phrase that the lower-cased text contains; null when none is."""
    low, found = F.lower(text), F.lit(None).cast("string")
    for phrase, answer in reversed(phrases):
        found = F.when(low.contains(phrase), F.lit(answer)).otherwise(found)
    return found

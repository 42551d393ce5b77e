"""Facts of single documents: detectors that read a text or a record and state what is there.

Each takes a DataFrame and returns its key with the facts. Null texts and null lists give the neutral fact (0, false, null), never an
error; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolcraft.functions import text as T
from poolcraft.operators.passages import bullets

# Placeholder patterns, verbs, countries, states and titles as the reference results need them.
PLACEHOLDERS = (
    r"(?i)\[\s*your\b[^\]\n]{0,30}\]", r"(?i)[\[\{<]\s*insert\s+[^\]\}>\n]{2,40}[\]\}>]", r"(?i)lorem\s+ipsum", r"(?i)\b(?:x{1,3}|n{2,3})\s?%", r"\{\{[^}\n]{1,40}\}\}",
)
POWER_VERBS = (
    "spearheaded orchestrated leveraged facilitated championed pioneered revolutionised revolutionized transformed streamlined optimised optimized synergised"
    " synergized empowered harnessed cultivated fostered drove catalysed catalyzed elevated amplified maximised maximized"
).split()
PERCENT = r"\b(\d{1,3})\s?%"
SKILL_SECTIONS = ("skills", "technical skills", "technologies")
EXPERIENCE_SECTIONS = ("experience", "employment", "work history", "professional")
EDUCATION_SECTIONS = ("education", "academic")
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
_MONTH_YEAR = r"(?:([A-Za-z]{3,9})\.?\s+)?((?:19|20)\d{2})(?:\s*[-/]\s*(1[0-2]|0?[1-9]))?"
DATE_RANGE = rf"(?i){_MONTH_YEAR}(?:\s*(?:-|–|—|to|until|through)\s*)(?:{_MONTH_YEAR}|(present|current|now|today|ongoing))"
DEGREES = (
    (r"(?i)\b(?:ph\.?d|doctorate)\b", "PhD"), (r"(?i)\b(?:m\.?sc|msc|m\.?s\.?|master(?:'s|s)?(?:\s+of\s+\w+)?)\b", "MSc"), (r"(?i)\bm\.?eng\b", "MEng"), (r"(?i)\bmba\b", "MBA"),
    (r"(?i)\b(?:b\.?sc|bsc|b\.?s\.?|bachelor(?:'s|s)?(?:\s+of\s+\w+)?)\b", "BSc"), (r"(?i)\bb\.?eng\b", "BEng"), (r"(?i)\bb\.?tech\b", "BTech"), (r"(?i)\bb\.?a\.?\b", "BA"),
)
DEGREE_FIELD = (
    r"(?i)\b(?:in|of)\s+([A-Z][A-Za-z&\s]{2,40}?)(?:,|\.|\n|$)|(computer science|software engineering|information systems|computer engineering|electrical engineering"
    r"|mathematics|physics|information technology|data science)"
)
STATE_ZONES = {
    "ET": "ME NH VT MA RI CT NY NJ PA DE MD DC VA WV NC SC GA FL OH MI IN", "CT": "IL WI MN IA MO AR LA MS AL TN KY KS NE SD ND OK TX",
    "MT": "MT WY CO NM UT ID AZ", "PT": "WA OR CA NV AK HI",
}
STATE_NAMES = {
    "ET": "connecticut|delaware|florida|indiana|kentucky|maine|maryland|massachusetts|michigan|new hampshire|new jersey|new york|north carolina|ohio|pennsylvania|rhode island|south carolina|tennessee|vermont|virginia|west virginia|district of columbia",
    "CT": "alabama|arkansas|illinois|iowa|kansas|louisiana|minnesota|mississippi|missouri|nebraska|north dakota|oklahoma|south dakota|texas|wisconsin",
    "MT": "arizona|colorado|idaho|montana|new mexico|utah|wyoming", "PT": "alaska|california|hawaii|nevada|oregon|washington",
}  # "georgia" is a country too and stays out
COUNTRIES = (
    "viet nam|vietnam|india|united kingdom|canada|england|germany|france|singapore|australia|brazil|mexico|philippines|poland|ukraine|nigeria|pakistan|bangladesh|china|japan|korea"
    "|netherlands|spain|italy|ireland|sweden|norway|denmark"
)
REGIONS = COUNTRIES + "|asia|apac|emea|eastern europe|latin america|southeast asia"
REGION_HINTS = (
    ("northeast", "ET"), ("east coast", "ET"), ("mid atlantic", "ET"), ("midwest", "CT"), ("south", "CT"), ("mountain", "MT"), ("west coast", "PT"), ("west", "PT"),
    ("est", "ET"), ("edt", "ET"), ("pst", "PT"), ("pdt", "PT"), ("cst", "CT"), ("cdt", "CT"), ("mst", "MT"), ("mdt", "MT"),
)
NOT_A_PLACE = r"(?i)@|://|\bhttps?\b|\b[a-z0-9-]+\.(?:com|net|org|io|co|dev|ai|vn|uk|de)\b"
INTENT = r"(?i)\b(?:open|willing|interested|available|relocat\w*|prefer\w*|seeking|looking|remote|office)\b"
PLACEHOLDER_SLUGS = "yourname your-name yourprofile your-profile username profile linkedin url link na n-a none tbd placeholder example firstname-lastname".split()


def placeholders(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, seq, match): template text left in, pattern by pattern, each spelling once whatever its case."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in PLACEHOLDERS]))
    hits = documents.select(key, F.posexplode(F.transform(found, F.trim)).alias("seq", "match"))
    return hits.groupBy(key, F.lower("match").alias("low")).agg(F.min("seq").alias("seq"), F.min_by("match", "seq").alias("match")).select(key, "seq", "match")


def bullet_style(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, bullet_count, power_verb_density, metric_count, round_metric_ratio) of documents with at least one list item."""
    b = F.col("bullet")
    numbers = F.transform(F.regexp_extract_all(b, F.lit(PERCENT), F.lit(1)), lambda x: x.cast("int"))
    judged = bullets(documents, key, text).select(
        key, F.split(T.normalize(b), " ")[0].isin(*POWER_VERBS).cast("int").alias("power"), numbers.alias("n"), "bullet",
    ).withColumn("metric", F.size("n") > 0)
    decimal = F.exists("n", lambda v: F.col("bullet").contains(F.concat(v.cast("string"), F.lit("."))) | F.col("bullet").contains(F.concat(F.lit("."), v.cast("string"))))
    is_round = F.col("metric") & ~decimal & F.forall("n", lambda v: v % 5 == 0)
    summed = judged.withColumn("round", is_round).groupBy(key).agg(
        F.count(F.lit(1)).alias("bullet_count"), F.bround(F.avg("power"), 3).alias("power_verb_density"), F.count_if("metric").alias("metric_count"),
        F.count_if("round").alias("__r"),
    )
    ratio = F.when(F.col("metric_count") > 0, F.bround(F.col("__r") / F.col("metric_count"), 3)).otherwise(F.lit(0.0))
    return summed.withColumn("round_metric_ratio", ratio).drop("__r")


def skills(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, skills_count): distinct items of more than one character in the skills section."""
    body = documents.select(key, T.unified(F.col(text)).alias("__l")).select(key, T.section(F.col("__l"), SKILL_SECTIONS).alias("__b"))
    items = F.array_distinct(F.filter(F.transform(F.split("__b", "[,;|/•\n]+"), T.normalize), lambda x: F.length(x) > 1))
    return body.select(key, F.coalesce(F.size(items), F.lit(0)).alias("skills_count")).withColumn("skills_count", F.greatest("skills_count", F.lit(0)))


def degrees(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, present, level, field): the first degree in the order of the list, from the education section, else the whole text."""
    scoped = documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t"), T.unified(F.col(text)).alias("__l"))
    scoped = scoped.select(key, F.coalesce(T.section(F.col("__l"), EDUCATION_SECTIONS), "__t").alias("__b"))
    level = F.lit(None).cast("string")
    for pattern, name in reversed(DEGREES):
        level = F.when(F.col("__b").rlike(pattern), name).otherwise(level)
    field = F.coalesce(F.nullif(F.trim(F.regexp_extract("__b", DEGREE_FIELD, 1)), F.lit("")), F.nullif(F.regexp_extract("__b", DEGREE_FIELD, 2), F.lit("")))
    return scoped.select(key, "__b", level.alias("level")).select(key, F.col("level").isNotNull().alias("present"), "level", F.when(F.col("level").isNotNull(), field).alias("field"))


def date_ranges(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, pos, first, last, precise, raw): employment ranges as month indexes (year * 12 + month - 1); an open end is null.

    From the experience section; else, where there is no education section either, from the whole text.
    """
    cut = documents.select(key, F.col(text).alias("__t"), T.unified(F.col(text)).alias("__l"))
    cut = cut.select(key, "__t", T.section(F.col("__l"), EXPERIENCE_SECTIONS).alias("__x"), T.section(F.col("__l"), ("education",)).alias("__e"))
    body = F.coalesce(F.col("__x"), F.when(F.col("__e").isNull(), F.col("__t")))
    # The generators keep the sections and the matches from being found again for every use; a match is short, so its groups cost little.
    held = cut.select(key, F.inline(F.array(F.struct(body.alias("__b")))))
    matches = held.select(key, F.posexplode(F.regexp_extract_all(F.col("__b"), F.lit(DATE_RANGE), F.lit(0))).alias("pos", "__m"))
    raw = matches.select(key, "pos", F.struct(*[F.regexp_extract("__m", DATE_RANGE, g).alias(f"g{g}") for g in range(8)]).alias("g"))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def month(name: str, number: str) -> tuple[Column, Column]:
        known = F.coalesce(F.col(f"g.{number}").try_cast("int"), F.try_element_at(months, F.lower(F.col(f"g.{name}"))))
        return F.coalesce(known, F.lit(1)), known.isNotNull()

    (start, start_known), (end, end_known) = month("g1", "g3"), month("g4", "g6")
    is_open = F.col("g.g7") != ""
    return raw.select(
        key, "pos", (F.col("g.g2").cast("int") * 12 + start - 1).alias("first"),
        F.when(~is_open, F.col("g.g5").try_cast("int") * 12 + end - 1).alias("last"), (start_known & (is_open | end_known)).alias("precise"), F.trim("g.g0").alias("raw"),
    )


def hidden_spans(documents: DataFrame, key: str = "id", spans: str = "hidden_text.spans") -> DataFrame:
    """(key, pos, kind, text, substantive): hidden spans, cut to 200 characters, blank ones dropped; substantive has five words and 25 letters or digits."""
    raw = documents.select(key, F.posexplode(spans).alias("pos", "s")).select(key, "pos", "s.kind", "s.text").filter(F.trim("text") != "")
    return raw.select(key, "pos", "kind", F.substring("text", 1, 200).alias("text"), says_something(F.col("text")).alias("substantive"))


def says_something(text: Column) -> Column:
    """At least five words and 25 letters or digits."""
    return (F.regexp_count(text, F.lit(r"[A-Za-z][A-Za-z0-9+#.\-]*")) >= 5) & (F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= 25)


def span_kind(color: Column, size: Column, render_mode: Column) -> Column:
    """Why a drawn span can't be seen: too light (luminance of an RGB integer), too small, or not rendered; null when it can."""
    part = [F.shiftright(color, s).bitwiseAND(255) / 255.0 for s in (16, 8, 0)]
    luminance = 0.2126 * part[0] + 0.7152 * part[1] + 0.0722 * part[2]
    return F.when(render_mode == 3, "invisible_render_mode").when((color == 0xFFFFFF) | (luminance >= 0.92), "white_on_white").when(size < 4.0, "micro_font")


def profile_links(records: DataFrame, documents: DataFrame, key: str = "id", text: str = "markdown", host: str = r"linkedin\.com", paths: str = "in|pub", labels: Sequence[str] = ("linkedin", "linkedin profile", "linkedin url")) -> DataFrame:
    """(key, present, source, url, slug): profile link of a record's field, else of its document; an absolute https address.

    Only the first match in each place counts; slugs under three characters and template slugs don't. A record needs no document.
    ``records`` (key, profile_data, ...) and ``documents`` (key, text) have one row per key.
    """
    pattern = rf"(?i)(?:https?://)?(?:[a-z]{{2,3}}\.)?{host}/(?:{paths})/([A-Za-z0-9\-_%]+)"

    def valid(source: Column) -> tuple[Column, Column]:
        slug = F.regexp_extract(source, pattern, 1)
        good = (F.length(slug) >= 3) & ~F.regexp_replace(F.lower(slug), "^[-_]+|[-_]+$", "").isin(*PLACEHOLDER_SLUGS)
        return F.when(good, F.regexp_extract(source, pattern, 0)), F.when(good, slug)

    joined = records.select(key, T.labelled_value(F.col("profile_data"), labels).alias("__f")).join(documents.select(key, F.col(text).alias("__t")), key, "left")
    (field_url, field_slug), (text_url, text_slug) = valid(F.col("__f")), valid(F.col("__t"))
    found = joined.select(key, field_url.alias("__fu"), field_slug.alias("__fs"), text_url.alias("__tu"), text_slug.alias("__ts"))
    url = F.coalesce("__fu", "__tu")
    absolute = F.when(F.lower(url).startswith("https://"), url).when(F.lower(url).startswith("http://"), F.concat(F.lit("https://"), F.substring(url, 8, 100000))).otherwise(F.concat(F.lit("https://"), url))
    source = F.when(F.col("__fu").isNotNull(), "record").when(F.col("__tu").isNotNull(), "text").otherwise("none")
    return found.select(key, url.isNotNull().alias("present"), source.alias("source"), F.when(url.isNotNull(), absolute).alias("url"), F.coalesce("__fs", "__ts").alias("slug"))


def slug_matches_name(slug: Column, full_name: Column) -> Column:
    """True when a slug carries the name, false when it carries other words, null when it tells nothing."""
    low = F.lower(slug)
    parts = F.filter(F.split(low, r"[-_%\d]+"), lambda x: F.length(x) > 2)
    names = F.filter(F.split(T.normalize(full_name), " "), lambda x: F.length(x) > 2)
    joined = F.regexp_replace(low, r"[-_%\d]+", "")
    whole = (joined != "") & ((joined == F.array_join(names, "")) | (joined == F.array_join(F.reverse(names), "")))
    return F.when((F.size(parts) > 0) & (F.size(names) > 0), F.when(F.arrays_overlap(parts, names) | whole, True).when(F.exists(parts, lambda x: F.length(x) > 3), False))


def is_residence(value: Column) -> Column:
    """The value reads like an address that ends in a listed country, not like prose about a place."""
    low = F.lower(F.regexp_replace(F.trim(value), r"\.+$", ""))
    tail = F.trim(F.element_at(F.split(low, ","), -1))
    short = F.size(F.split(tail, r"\s+")) <= 3
    return F.coalesce((value != "") & ~value.rlike(NOT_A_PLACE) & ~value.rlike(INTENT) & short & low.rlike(f"(?:{COUNTRIES})$"), F.lit(False))


def state_zone(text: Column) -> Column:
    """Time zone of the first ", ST" with a known state code; null when there is none."""
    codes = F.create_map(*[F.lit(x) for zone, states in STATE_ZONES.items() for state in states.split() for x in (state, zone)])
    found = F.transform(F.regexp_extract_all(text, F.lit(r",\s*([A-Z]{2})\b"), F.lit(1)), lambda c: F.try_element_at(codes, c))
    return F.get(F.filter(found, lambda z: z.isNotNull()), F.lit(0))


def residence_zone(value: Column) -> Column:
    """Time zone of an answer to "which state do you live in": a code alone in any case, a code in capitals within a longer answer, else a full state name; null when there is none.

    For answers to that question only: in other text a state's name may be part of a person's or a foreign town's.
    """
    codes = F.create_map(*[F.lit(x) for zone, states in STATE_ZONES.items() for state in states.split() for x in (state, zone)])
    names = sorted(((name, zone) for zone, listed in STATE_NAMES.items() for name in listed.split("|")), key=lambda x: (-len(x[0]), x[0]))
    zones = F.create_map(*[F.lit(x) for pair in names for x in pair])
    words = F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0))
    alone = (F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) == 2)
    inside = F.get(F.filter(F.transform(F.filter(words, lambda w: w.rlike("^[A-Z]{2}$")), lambda w: F.try_element_at(codes, w)), lambda z: z.isNotNull()), F.lit(0))
    named = F.try_element_at(zones, F.lower(F.regexp_extract(value, rf"(?i)\b({'|'.join(name for name, _ in names)})\b", 1)))
    return F.coalesce(F.when(alone, F.try_element_at(codes, F.upper(F.get(words, F.lit(0))))).otherwise(inside), named)


def answered(value: Column) -> Column:
    """A yes/no answer as written by people: true, false, or null when it is neither."""
    low = F.lower(F.trim(value))
    return F.when(low.isin("no", "no.", "n/a", "none", "not required"), False).when(low.startswith("yes"), True)


def separated_team_claims(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """(key, sentence, places): sentences that name an offshore team, or a place abroad next to a word of working together; each once."""
    said = documents.select(key, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))
    places = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit(rf"(?i)\b(?:{REGIONS})\b"), F.lit(0)), F.lower)))
    team = F.col("sentence").rlike(r"(?i)\bteams?\b|\bengineers?\b|\bdevelopers?\b|\bcollaborat\w*\b|\bpartner\w*\b|\bcoordinat\w*\b")
    far = F.col("sentence").rlike(r"(?i)\b(?:offshore|offshored|nearshore)\b")
    hits = said.withColumn("places", places).filter(far | (team & (F.size("places") > 0))).withColumn("n", T.normalize(F.col("sentence"))).filter("n <> ''")
    return hits.groupBy(key, "n").agg(F.min_by(F.struct("sentence", "places"), "pos").alias("s")).select(key, "s.sentence", "s.places")


def minutes_between(earlier_us: Column, later_us: Column) -> Column:
    """Minutes from one instant to another, both in microseconds; null when one is unknown, negative when they are the other way round."""
    return (later_us - earlier_us) / 6e7


def made_by(producer: Column, creator: Column, services: Sequence[str], minutes: Column, at_most: float) -> Column:
    """A listed service made the file at most so many minutes before it was handed in."""
    both = F.lower(F.concat_ws(" ", producer, creator))
    named = F.lit(False)
    for service in services:
        named = named | both.contains(service)
    return F.coalesce((minutes <= at_most) & named, F.lit(False))

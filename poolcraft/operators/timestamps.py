"""Mixed timestamp spellings to one UTC instant (problem 3).

An ordered cascade of anchored patterns: the first pattern that matches the
whole value rewrites it to one canonical list of parts, the parts are checked
strictly (no 31 September, no hour 25, no 13 PM), and the zone is taken from
the value, else from the row's source by a lookup. Everything is built-in
expressions; a value costs one regex match per pattern up to the one that fits.

Policy for local times, stated rather than left to the library: a time that
occurs twice is the earlier instant unless ``ambiguous="later"`` or ``"null"``;
a time that a clock change skips moves forward by the length of the skip
unless ``nonexistent="null"``.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations and their offsets in minutes, in any season.
ABBREVIATIONS = {
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "PST": -480, "PDT": -420,
    "GMT": 0, "UTC": 0, "CET": 60, "CEST": 120,
}

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_NAME = r"(jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_AMPM = r"(?:\s*([ap])\.?m\.?)?"
_ZONE = r"(?:\s*\[?(z|[+-]\d{2}(?:[:']?\d{2}'?)?|(?-i:[A-Z]{3,4}|[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+))\]?)?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"

#: name, pattern, order of the groups as year|month|day|hour|minute|second|fraction|am-pm|zone. ``date_order`` picks
#: the branch for slashes.
CASCADE: tuple[tuple[str, str, str, str | None], ...] = (
    ("iso", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[t\s]\s*{_TIME}{_ZONE})?$", "$1|$2|$3|$4|$5|$6|$7||$8", None),
    ("pdf", r"(?i)^D:(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?(?:(z)(?:00'?(?:00'?)?)?|([+-]\d{2})(?:'?(\d{2})'?)?)?$", "$1|$2|$3|$4|$5|$6|||$7$8$9", None),
    ("basic", rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8", None),
    ("slash_mdy", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9", "mdy"),
    ("slash_dmy", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9", "dmy"),
    ("dots", rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9", None),
    ("day_month", rf"(?i)^{_DAY}(\d{{1,2}})\s+{_NAME}\s+(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9", None),
    ("month_day", rf"(?i)^{_DAY}{_NAME}\s+(\d{{1,2}}),\s*(\d{{4}})(?:,?\s+{_TIME}{_AMPM}{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9", None),
    ("ctime", rf"(?i)^{_DAY}{_NAME}\s+(\d{{1,2}})\s+{_TIME}{_ZONE}\s+(\d{{4}})$", "$8|$1|$2|$3|$4|$5|$6||$7", None),
)

#: Bare numbers: seconds, milliseconds or microseconds, whichever falls into these years.
_EPOCH_LOW, _EPOCH_HIGH = 1577836800, 1924992000  # 2020-01-01, 2031-01-01


def _zones(spark: SparkSession) -> list[str]:
    """Regions whose rules are known: the engine's own list, or where it can't be asked (a remote session) Python's. Tested as a hash set."""
    try:
        known = spark._jvm.java.time.ZoneId.getAvailableZoneIds()
    except (AttributeError, PySparkException):
        known = available_timezones()
    return sorted(z for z in known if "/" in z)


def with_epoch_micros(
    df: DataFrame, value: str, tz_name: str, date_order: str, into: str = "epoch_us", ambiguous: str = "earlier", nonexistent: str = "forward"
) -> DataFrame:
    """``df`` with ``into``: microseconds since 1970 (UTC) of ``value``, null when it is unreadable.

    ``tz_name`` and ``date_order`` (``mdy``/``dmy``) name the columns with the
    defaults of the row's source. Null, empty and blank values are unreadable; so is a local time
    whose source has no (or an unknown) zone, and a date with slashes whose source
    has no order. A stated offset, abbreviation or zone name holds; an unknown zone
    makes the value unreadable.

    The steps are separate projections, so no step is computed twice.
    """
    c = {name: f"__{name}_of_{into}" for name in ("clean", "part", "year", "month", "hour", "wall", "place", "offset", "epoch")}
    col = {name: F.col(full) for name, full in c.items()}
    steps = df.withColumn(c["clean"], F.regexp_replace(F.col(value), r"(?U)^\s+|\s+$", ""))

    clean = col["clean"]
    bare = clean.rlike(r"^\d{1,16}(\.\d{1,9})?$")
    canonical = F.when(bare, F.lit(None).cast("string"))
    for _, pattern, order, need in CASCADE:
        fits = clean.rlike(pattern)
        canonical = canonical.when(fits & (F.col(date_order) == need) if need else fits, F.regexp_replace(clean, F.lit(pattern), F.lit(order)))
    number = F.when(bare, clean.try_cast("decimal(26,9)"))
    steps = steps.withColumns({c["part"]: F.split(canonical, r"\|"), c["epoch"]: number})

    part = col["part"]

    def at(i: int, missing: int | None = None) -> Column:
        read = part[i].try_cast("int")
        return read if missing is None else F.when(part[i] == "", missing).otherwise(read)

    named = F.array_position(F.lit(list(MONTHS)), F.lower(F.substring(part[1], 1, 3))).cast("int")
    hour, half = at(3, 0), F.lower(part[7])
    steps = steps.withColumns({
        c["year"]: F.when(F.length(part[0]) == 2, at(0) + 2000).otherwise(at(0)),
        c["month"]: F.coalesce(at(1), F.when(named > 0, named)),
        c["hour"]: F.when(half == "", F.when(hour <= 23, hour)).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)),
    })

    second = at(5, 0)
    zone = part[8]
    digits = F.regexp_replace(zone, r"\D", "")
    hours = F.substring(digits, 1, 2).try_cast("int")
    minutes = F.when(F.length(digits) >= 4, F.substring(digits, 3, 2).try_cast("int")).otherwise(0)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    fixed = F.element_at(F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair]), zone)
    offset = F.when(zone.rlike("^[+-]"), F.when((hours <= 18) & (minutes <= 59), sign * (hours * 60 + minutes))).when(zone.rlike("^[zZ]"), 0).otherwise(fixed)
    place = F.when(zone == "", F.col(tz_name)).when(zone.contains("/"), zone)
    steps = steps.withColumns({
        c["wall"]: F.try_make_timestamp(col["year"], col["month"], at(2), col["hour"], at(4, 0), F.when(second <= 59, second).cast("decimal(16,6)"), F.lit("UTC")),
        c["offset"]: offset,
        c["place"]: F.when(place.isin("UTC", "GMT", *_zones(df.sparkSession)), place),
    })

    wall, where = col["wall"], col["place"]
    instant = F.to_utc_timestamp(wall, where)
    if nonexistent == "null":
        instant = F.when(F.from_utc_timestamp(instant, where) == wall, instant)
    if ambiguous != "earlier":
        for step in ("30 MINUTES", "1 HOUR"):
            later = instant + F.expr(f"INTERVAL {step}")
            instant = F.when(F.from_utc_timestamp(later, where) == wall, later if ambiguous == "later" else F.lit(None)).otherwise(instant)
    zoned = F.when(col["offset"].isNotNull(), F.unix_micros(wall) - col["offset"].cast("bigint") * 60_000_000).otherwise(F.unix_micros(instant))
    fraction = F.when(part[6] == "", 0).otherwise(F.rpad(F.substring(part[6], 1, 6), 6, "0").try_cast("bigint"))
    epoch = F.coalesce(*[
        F.when((col["epoch"] >= _EPOCH_LOW * scale) & (col["epoch"] < _EPOCH_HIGH * scale), F.floor(col["epoch"] * (1_000_000 // scale)).cast("bigint"))
        for scale in (1, 1_000, 1_000_000)
    ])
    # The generator keeps later filters on the result from being pushed below it, which would copy the whole cascade into them.
    result = F.explode_outer(F.array(F.coalesce(epoch, zoned + fraction)))
    return steps.withColumn(into, result).drop(*c.values())


def normalise(values: DataFrame, sources: DataFrame, source_key: str, value: str, tz_name: str = "tz_name", date_order: str = "date_order", **policy: str) -> DataFrame:
    """``values`` with a column ``epoch_us``; zone and date order come from ``sources`` by ``source_key``.

    Rows whose source is null or unknown stay: values with a zone of their own
    are still read. The lookup side is left to the planner, which broadcasts it
    only below its size threshold. Repeated rows give repeated results.
    """
    lookup = sources.select(F.col(source_key).alias("__source"), F.col(tz_name).alias("__tz"), F.col(date_order).alias("__order")).dropDuplicates(["__source"])
    joined = values.join(lookup, values[source_key] == F.col("__source"), "left")
    return with_epoch_micros(joined, value, "__tz", "__order", **policy).drop("__source", "__tz", "__order")


def normalised_instants(candidates: DataFrame, parsed: DataFrame, openings: DataFrame, **policy: str) -> DataFrame:
    """(src, id, field, epoch_us): distinct readable instants of both record tables."""

    def unpivot(df: DataFrame, src: str, fields: dict[str, Column]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(name).alias("field"), column.alias("value")) for name, column in fields.items()])
        return df.select(F.lit(src).alias("src"), "id", "opening_id", F.explode(pairs).alias("f")).select("src", "id", "opening_id", "f.field", "f.value")

    rows = unpivot(candidates, "candidates", {"created_date": F.col("created_date"), "updated_date": F.col("updated_date")}).unionByName(
        unpivot(parsed, "parsed", {"created": F.col("meta.created"), "modified": F.col("meta.modified")})
    )
    found = normalise(rows.filter(F.col("value").isNotNull()), openings, "opening_id", "value", **policy)
    return found.filter(F.col("epoch_us").isNotNull() & F.col("id").isNotNull()).select("src", "id", "field", "epoch_us").distinct()

"""Checking untrusted JSON against a rubric, quotes against their text.

The JSON is parsed once into a VARIANT, whose parts are tested one by one: an entry of the wrong type spoils no other. Every rule
is an expression, and a record's errors come as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolcraft.functions import text as T

def check(raw: DataFrame, rubric: dict[str, float], bonus_max: float = 5.0, key: str = "id") -> DataFrame:
    """(key, errors, warnings, scores, flags, bonus, years, confidence) of ``raw`` (key, raw, text).

    Errors: no object; a criterion of the rubric missing or unknown; a score that is no number, NaN, negative or above its
    maximum; a bonus likewise, or without a reason; a flag that is no object, whose tier is not 1, 2 or 3 or that has no quote. A criterion whose entry is no object has no score
    and is no error. Positive scores whose quote isn't in the text count 0, flags whose quote isn't are dropped; both give a warning. A record with errors has null scores.
    Null or unreadable JSON has the error "not an object". ``confidence`` in the years is ``low`` where it isn't stated.
    """
    criteria = sorted(rubric)
    maxima = F.create_map(*[F.lit(x) for k in criteria for x in (k, float(rubric[k]))])
    parsed = raw.select(key, "text", F.try_parse_json("raw").alias("v"))
    part = {"red": "$.redflag", "fit": "$.fit"}
    shaped = parsed.select("*", *[F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")).startswith("OBJECT"), F.lit(False)).alias(name) for name, path in part.items()])
    rows = shaped.select(
        key, "text", "red", "fit", F.try_variant_get("v", "$.fit.scores", "map<string,variant>").alias("entries"), F.try_variant_get("v", "$.redflag.flags", "array<variant>").alias("listed"),
        F.try_variant_get("v", "$.fit.bonus.points", "string").alias("points"), F.try_variant_get("v", "$.fit.bonus.justification", "string").alias("reason"),
        F.try_variant_get("v", "$.redflag.years_experience_estimate.value", "string").alias("years"), F.try_variant_get("v", "$.redflag.years_experience_estimate.confidence", "string").alias("confidence"),
    )
    rows = rows.withColumn("given", F.coalesce(F.map_keys("entries"), F.array().cast("array<string>")))
    wanted = F.array(*[F.lit(k) for k in criteria])
    # A variant's parts by path; null where it is no object.
    scored = F.transform(wanted, lambda k: F.struct(
        k.alias("key"), F.try_variant_get(F.element_at("entries", k), "$.score", "string").try_cast("double").alias("score"),
        F.coalesce(F.try_variant_get(F.element_at("entries", k), "$.quote", "string"), F.lit("")).alias("quote"),
        F.coalesce(F.schema_of_variant(F.element_at("entries", k)).startswith("OBJECT"), F.lit(False)).alias("there"), F.element_at(maxima, k).alias("top")))
    flagged = F.transform(F.coalesce("listed", F.array().cast("array<variant>")), lambda f: F.struct(
        F.coalesce(F.schema_of_variant(f).startswith("OBJECT"), F.lit(False)).alias("object"), F.try_variant_get(f, "$.tier", "string").try_cast("double").cast("int").alias("tier"),
        F.coalesce(F.nullif(F.try_variant_get(f, "$.kind", "string"), F.lit("")), F.lit("unspecified")).alias("kind"), F.coalesce(F.try_variant_get(f, "$.quote", "string"), F.lit("")).alias("quote")))
    # The generator keeps both lists from being computed again wherever they are used.
    rows = rows.select("*", F.inline(F.array(F.struct(scored.alias("n"), flagged.alias("f")))))
    points = F.col("points").try_cast("double")
    shape = ~F.col("red") | ~F.col("fit") | F.col("entries").isNull()
    bad_score = F.filter("n", lambda x: x["there"] & (x["score"].isNull() | F.isnan(x["score"]) | (x["score"] < 0) | (x["score"] > x["top"])))
    errors = F.when(shape, F.array(F.lit("not an object"))).otherwise(F.concat(
        F.transform(F.array_except(wanted, F.col("given")), lambda k: F.concat(F.lit("missing: "), k)),
        F.transform(F.array_sort(F.array_except(F.col("given"), wanted)), lambda k: F.concat(F.lit("unknown: "), k)),
        F.transform(bad_score, lambda x: F.concat(F.lit("score: "), x["key"])),
        F.when(F.col("points").isNotNull() & (points.isNull() | F.isnan(points) | (points < 0) | (points > bonus_max)), F.array(F.lit("bonus")))
        .when((points > 0) & (F.coalesce(F.trim("reason"), F.lit("")) == ""), F.array(F.lit("bonus: no reason"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter("f", lambda f: ~f["object"] | f["tier"].isNull() | ~f["tier"].isin(1, 2, 3) | (F.trim(f["quote"]) == "")), lambda f: F.concat(F.lit("flag: "), F.when(f["object"], f["kind"]).otherwise("not an object"))),
    ))
    rows = rows.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)

    def quoted(quote: Column) -> Column:
        return T.contains_quote(F.col("text"), quote)

    rows = rows.withColumns({
        "s": F.transform(F.filter("n", lambda x: x["there"]), lambda x: F.struct(x["key"].alias("key"), x["score"].alias("score"), (x["score"] > 0).alias("positive"), quoted(x["quote"]).alias("found"))),
        "g": F.transform("f", lambda f: F.struct(f["tier"].alias("tier"), f["kind"].alias("kind"), f["quote"].alias("quote"), quoted(f["quote"]).alias("found"))),
    })
    scores = F.map_from_entries(F.transform("s", lambda x: F.struct(x["key"], F.when(x["positive"] & ~x["found"], 0.0).otherwise(x["score"]))))
    warnings = F.concat(
        F.transform(F.filter("s", lambda x: x["positive"] & ~x["found"]), lambda x: F.concat(F.lit("score: "), x["key"])),
        F.transform(F.filter("g", lambda f: ~f["found"]), lambda f: F.concat(F.lit("flag: "), f["kind"])),
    )
    return rows.select(
        key, "errors", F.when(F.col("ok"), warnings).alias("warnings"), F.when(F.col("ok"), scores).alias("scores"),
        F.when(F.col("ok"), F.filter("g", lambda f: f["found"])).alias("flags"), F.when(F.col("ok"), F.coalesce(points, F.lit(0.0))).alias("bonus"),
        F.when(F.col("ok"), F.col("years").try_cast("double")).alias("years"),
        F.when(F.col("ok"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit("low"))).alias("confidence"),
    )


def total(scores: Column) -> Column:
    """Sum of a map of scores to two places, half to even."""
    return F.bround(F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x), 2)


def digest(*parts: Column, by: str = "\n") -> Column:
    """SHA-256 of parts joined by ``by``; a null part counts as an empty one."""
    joined = F.lit("")
    for i, part in enumerate(parts):
        joined = F.concat(joined, F.lit(by if i else ""), F.coalesce(part.cast("string"), F.lit("")))
    return F.sha2(joined, 256)

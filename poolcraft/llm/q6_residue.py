"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolcraft.llm import residue
from poolcraft.session import load


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_records(load(spark, d, "parsed", "id", "markdown"), load(spark, d, "prechecks", "candidate_id", "placeholders"))


def p6_clean_share(spark: SparkSession, d: str) -> DataFrame:
    """Per opening: CVs with a text, and how many of them are clean."""
    rows = load(spark, d, "parsed", "opening_id", "markdown").filter("markdown IS NOT NULL")
    judged = rows.select("opening_id", residue.residue(F.col("markdown")).alias("bad"))
    return judged.groupBy("opening_id").agg(F.count(F.lit(1)).alias("texts"), F.count_if(~F.col("bad")).alias("clean"))


QUERIES = {"p6_found": p6_found, "p6_clean_share": p6_clean_share}
SQL: dict[str, str] = {}

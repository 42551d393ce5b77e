"""Keyed state as a stream: each micro-batch of arrivals is one run.

The cut of a pool needs the whole pool, so state per key alone isn't enough; a batch therefore joins the arrivals with the last version of
the state table and writes the next one. A batch that is run again after a failure writes the same version again, so the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from poolcraft.operators import state
from poolcraft.sources.files import read_snapshot, write_snapshot

STATUSES = ("accepted", "waitlist", "gated", "needs_review", "withdrawn")
STATE = "id bigint, status string, value double, first_seen string, changed string"


def merge_stream(arrivals: DataFrame, root: str, checkpoint: str, frozen: tuple[str, ...] = ("accepted",)) -> StreamingQuery:
    """Start merging a stream of (id, status, value, seq) into versioned state under ``root``; it ends when what is there now is read.

    Of several arrivals of an id in one batch the one with the greatest ``seq`` counts.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # Only the first run starts from nothing; a version missing in between, or a status nobody knows, stops the stream.
        before = checked(read_snapshot(spark, root, STATE, str(number - 1)))
        newest = state.latest(batch.select("id", "status", "value", "seq"), "id", "seq").select("id", "status", "value")
        write_snapshot(state.merge(before, newest, f"run {number:06d}", frozen=frozen), root, str(number))

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked(state_rows: DataFrame) -> DataFrame:
    """The rows, with an error where a status isn't one of STATUSES."""
    told = F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null")), F.lit(" of id "), F.col("id").cast("string"))
    fine = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    return state_rows.withColumn("status", F.when(fine, F.col("status")).otherwise(F.raise_error(told)))


def latest_state(spark: SparkSession, root: str, version: int) -> DataFrame:
    return read_snapshot(spark, root, STATE, str(version))


def rate_stream(events: DataFrame, at: str = "ts", key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Events per key in windows of 300 seconds every 60, as a stream with a watermark: later events than ``late`` are dropped from closed windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, "300 seconds", "60 seconds"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


__all__ = ["STATE", "latest_state", "merge_stream", "rate_stream"]

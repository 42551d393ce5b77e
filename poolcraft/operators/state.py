"""Keyed state carried between runs, and finding what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(state: DataFrame, arrivals: DataFrame, run_id: str, frozen: tuple[str, ...] = (), present: DataFrame | None = None, gone: str = "withdrawn") -> DataFrame:
    """Next state (id, status, value, first_seen, changed) from ``state`` and ``arrivals`` (id, status, value).

    New ids are inserted; known ones take status and value, unless their status is ``frozen``; ``changed`` moves only when the status does.
    With ``present`` (id), ids of the state in neither get the status ``gone``, frozen or not. One full outer join by id; ids are distinct in each input.
    """
    new = arrivals.select("id", F.col("status").alias("new_status"), F.col("value").alias("new_value"), F.lit(True).alias("arrived"))
    joined = state.withColumn("known", F.lit(True)).join(new, "id", "full")
    if present is not None:
        joined = joined.join(present.select("id").distinct().withColumn("here", F.lit(True)), "id", "left")
    else:
        joined = joined.withColumn("here", F.lit(True))
    known, arrived = F.col("known").isNotNull(), F.col("arrived").isNotNull()
    fixed = F.coalesce(F.col("status").isin(*frozen), F.lit(False)) if frozen else F.lit(False)
    absent = known & ~arrived & F.col("here").isNull()
    status = F.when(~known, F.col("new_status")).when(absent, F.lit(gone)).when(arrived & ~fixed, F.col("new_status")).otherwise(F.col("status"))
    value = F.when(~known | (arrived & ~fixed), F.col("new_value")).otherwise(F.col("value"))
    moved = ~known | ~status.eqNullSafe(F.col("status"))
    return joined.select(
        "id", status.alias("status"), value.alias("value"), F.coalesce("first_seen", F.lit(run_id)).alias("first_seen"),
        F.when(moved, F.lit(run_id)).otherwise(F.col("changed")).alias("changed"),
    )


def merge_all(rows: DataFrame, run: str, frozen: tuple[str, ...] = (), gone: str = "withdrawn") -> DataFrame:
    """The state after :func:`merge` of every run of ``rows`` (run, id, status, value), in order of ``run``, ids that a run lacks being gone.

    An id's rows, at most one per run, are folded where they are grouped; the list of runs is a row per run, joined to each id as one array.
    """
    order = rows.select(run).distinct().agg(F.array_sort(F.collect_set(run)).alias("__runs"))
    seen = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(run, F.struct("status", "value")))).alias("__seen"))
    kind = rows.select(F.lit(None).cast(rows.schema[run].dataType).alias("r"), "status", "value").schema
    start = F.struct(*[F.lit(None).cast(kind[c].dataType).alias(n) for n, c in (("status", "status"), ("value", "value"), ("first_seen", "r"), ("changed", "r"))])

    def step(s: Column, r: Column) -> Column:
        now = F.element_at("__seen", r)
        known, here = s["first_seen"].isNotNull(), now.isNotNull()
        fixed = known & F.coalesce(s["status"].isin(*frozen), F.lit(False)) if frozen else F.lit(False)
        status = F.when(~here, F.when(known, F.lit(gone))).when(fixed, s["status"]).otherwise(now["status"])
        value = F.when(~here | fixed, s["value"]).otherwise(now["value"])
        first = F.coalesce(s["first_seen"], F.when(here, r))
        moved = (known | here) & (~known | ~status.eqNullSafe(s["status"]))
        return F.struct(status.alias("status"), value.alias("value"), first.alias("first_seen"), F.when(moved, r).otherwise(s["changed"]).alias("changed"))

    return seen.crossJoin(F.broadcast(order)).select("id", F.aggregate("__runs", start, step).alias("s")).select("id", "s.*")


def changes(remote: DataFrame, cached: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """(key, change): new, updated or unchanged rows of ``remote`` against ``cached``, by their version; gone ones of ``cached``.

    A null version equals a null version. Keys are distinct in each input.
    """
    r = remote.select(key, F.col(version).alias("__r"), F.lit(True).alias("__in_r"))
    c = cached.select(key, F.col(version).alias("__c"), F.lit(True).alias("__in_c"))
    change = F.when(F.col("__in_r").isNull(), "gone").when(F.col("__in_c").isNull(), "new").when(F.col("__r").eqNullSafe(F.col("__c")), "unchanged").otherwise("updated")
    return r.join(c, key, "full").select(key, change.alias("change"))


def pending(wanted: DataFrame, stored: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """(key, digest) of ``wanted`` without a stored result for the same digest; a null digest never counts as stored."""
    have = stored.select(key, digest).distinct()
    return wanted.select(key, digest).join(have, [key, digest], "left_anti")


def latest(rows: DataFrame, key: str | tuple[str, ...], by: str) -> DataFrame:
    """One row per key: the greatest by ``by``, nulls lowest; of equals the greatest row. Partial maxima are taken before the shuffle."""
    key = [key] if isinstance(key, str) else [*key]
    ordered = [by, *[c for c in rows.columns if c not in (by, *key)]]
    return rows.groupBy(*key).agg(F.max(F.struct(*ordered)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in ordered])


def burst(events: DataFrame, key: str, at: str, seconds: int = 300, slice_seconds: int = 3600) -> DataFrame:
    """``events`` with the number of the key's events in the ``seconds`` up to each, itself and ties included; rows with a null time have null.

    A key's events are counted in slices of time, each with a copy of the last ``seconds`` of the slices before it, so a key that has a third of all events is
    spread over as many tasks as it has slices.
    """
    copies = -(-seconds // slice_seconds)
    moment = F.unix_seconds(F.col(at).cast("timestamp"))
    own = F.floor(F.col("__t") / slice_seconds)
    # Slice own + i needs the event if the slice begins no more than ``seconds`` after it.
    ahead = F.filter(F.sequence(F.lit(0), F.lit(copies)), lambda i: (i == 0) | ((own + i) * slice_seconds - F.col("__t") <= seconds))
    spread = events.withColumn("__t", moment).withColumn("__ahead", F.explode(ahead)).withColumn("__slice", own + F.col("__ahead"))
    w = Window.partitionBy(key, "__slice").orderBy("__t").rangeBetween(-seconds, 0)
    counted = spread.withColumn("in_window", F.when(F.col("__t").isNotNull(), F.count(F.lit(1)).over(w)))
    return counted.filter("__ahead = 0").drop("__t", "__ahead", "__slice")


def looked_up(rows: DataFrame, cache: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    """``rows`` with ``value`` from a table of earlier answers; ``default`` where there is none or the key is null. The cache has one row per key."""
    return rows.join(cache.select(key, F.col(value).alias("__v")), key, "left").withColumn(value, F.coalesce("__v", F.lit(default))).drop("__v")


def in_scope(rows: DataFrame, column: str, wanted: str) -> tuple[DataFrame, DataFrame]:
    """The rows of one scope, and one row (kept, dropped) that counts what a source sent beside them; null counts as dropped."""
    hit = F.coalesce(F.col(column) == wanted, F.lit(False))
    return rows.filter(hit), rows.agg(F.count_if(hit).alias("kept"), F.count_if(~hit).alias("dropped"))

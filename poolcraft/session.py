"""Session defaults, table loading and lineage control.

Nothing here assumes local mode: the checkpoint folder comes from the
session's ``spark.checkpoint.dir``; only a local session (tests, a
laptop) gets a temporary folder where that is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a new session gets; an existing session keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "poolcraft", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one with :data:`DEFAULTS`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a data folder; ``columns`` narrows the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="poolcraft-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its plan.

    Used where a result is read more than once or a loop would make the plan
    grow. The copy lies in reliable storage, so a lost executor costs only the
    tasks it was running.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_clear(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for a result whose shuffle is much larger than itself: Spark removes the shuffle files when the job ends, not when the driver collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return cut_lineage(df.select("*"))  # a plan of its own, as the setting is read when a plan is made
    finally:
        conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """The same as :func:`cut_lineage` for wide rows with texts: a compressed table in the shared checkpoint folder."""
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, for Python workers that lack it on their path.

    The archive is put into the shared checkpoint folder where that is a plain path, and served from there.
    """
    context = spark.sparkContext
    if getattr(context, "_poolcraft_shipped", False):
        return
    root = Path(__file__).resolve().parent
    shared = (context.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    try:
        if shared.startswith("/"):
            os.makedirs(shared, exist_ok=True)
        folder = tempfile.mkdtemp(prefix="poolcraft-", dir=shared if shared.startswith("/") else None)
    except OSError:  # the driver can't write there; its own folder serves as well
        folder = tempfile.mkdtemp(prefix="poolcraft-")
    target = os.path.join(folder, "poolcraft.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    context._poolcraft_shipped = True

"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "quirework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator is tested under; conf names write "__" for "."."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder all executors share, as the cluster names it, or None."""
    return spark.conf.get(CHECKPOINT_KEY, None) or None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and return it without its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``.  Where the session names
    none, a local session (a test) gets a temporary folder; on a cluster, where a
    machine's own folder would not survive a lost executor, that is an error.  The
    files go when the frame is no longer used, if the session has
    spark.cleaner.referenceTracking.cleanCheckpoints set.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = shared_folder(df.sparkSession)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quirework-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder; only the columns a query uses are read."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))

"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes the shuffle files of an execution at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app_name: str = "riskpanel", **conf: str) -> SparkSession:
    """Return a session with UTC time, ANSI semantics and adaptive execution.

    On a cluster ``master`` stays unset so that spark-submit decides.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # files of a checkpoint go once nothing refers to it
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all hosts share.

    Only a local master may go without one: it gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        shared = tempfile.mkdtemp(prefix="riskpanel-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table of its own in the shared folder.

    For frames that many passes read: each pass then reads the columns that it
    needs, and a lost executor costs no earlier step.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_clean(df: DataFrame, name: str) -> DataFrame:
    """:func:`write_once` that deletes the shuffle files behind the table as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return write_once(df, name)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` for several passes over it, spilling to disk.

    Blocks lost with an executor are computed again. A frame that its caller
    keeps already is left as it is.
    """
    held = df.storageLevel.useMemory or df.storageLevel.useDisk
    stored = df if held else df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield stored
    finally:
        if not held:
            stored.unpersist()

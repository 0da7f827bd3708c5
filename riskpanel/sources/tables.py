"""Typed reads, file fingerprints and the run-scoped parquet sink."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.definitions import RUN_ID_PATTERN, WIDE_PERIODS
from riskpanel.functions.frames import GuardError

#: Files below this many bytes are hashed whole; longer ones are streamed in chunks.
WHOLE_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20
FINGERPRINTS = "file_path string, file_bytes long, file_sha256 string"

WIDE_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("id", "limit_bal", "sex", "education", "marriage", "age")]
    + [T.StructField(p.status, T.IntegerType()) for p in WIDE_PERIODS]
    + [T.StructField(p.bill, T.IntegerType()) for p in WIDE_PERIODS]
    + [T.StructField(p.payment, T.IntegerType()) for p in WIDE_PERIODS]
    + [T.StructField("default_payment_next_month", T.IntegerType())]
    + [
        T.StructField("source_id", T.StringType()),
        T.StructField("source_file_sha256", T.StringType()),
        T.StructField("source_row_number", T.IntegerType()),
        T.StructField("ingestion_run_id", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read ``path`` with a declared schema; nothing is inferred.

    Parquet readers fill absent columns with NULL, so the names in the files
    are compared with the declared ones first. CSV headers are enforced by the
    reader. Reading the names touches footers only.
    """
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option(
            "mode", "FAILFAST"
        ).csv(path)
    found = spark.read.format(fmt).load(path).columns
    missing = [name for name in schema.fieldNames() if name not in found]
    if missing:
        raise GuardError(f"{path} lacks the declared columns {missing}")
    return spark.read.format(fmt).schema(schema).load(path)


def require_header(df: DataFrame, expected: list[str]) -> DataFrame:
    """Refuse a frame whose column names or column order differ from ``expected``."""
    if df.columns != list(expected):
        raise GuardError(f"columns are {df.columns}, expected {list(expected)}")
    return df


def fingerprint_files(spark: SparkSession, path: str, glob: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``file_path, file_bytes, file_sha256`` of every file below ``path``, at any depth.

    Paths are relative to ``path``, so equal names in different folders stay
    apart. Files below ``whole_bytes`` are one row each, hashed on an executor.
    Longer ones, of any length, are streamed in chunks: by the executors where
    ``path`` is a file system that all hosts share (``file:``), else one after
    another by the driver's JVM, as Python workers cannot open other stores.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    root = _root(spark, path)
    name = F.ltrim(F.substr("path", F.lit(len(root) + 1)), F.lit("/")).alias("file_path")
    # the reader tests the length before it reads the content
    small = listed.where(F.col("length") < whole_bytes)
    small = small.select(name, F.col("length").alias("file_bytes"), F.sha2("content", 256).alias("file_sha256"))
    large = listed.where(F.col("length") >= whole_bytes).select(name, F.col("length").alias("file_bytes"), "path")
    if root.startswith("file:"):
        hashed = large.mapInArrow(_stream_shared, FINGERPRINTS)
    else:
        hashed = spark.createDataFrame([(*r[:2], _stream_by_driver(spark, r.path)) for r in large.collect()], FINGERPRINTS)
    return small.unionByName(hashed)


def _stream_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("file_bytes").to_pylist()):
            digest, read = hashlib.sha256(), 0
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
                while chunk := file.read(CHUNK_BYTES):
                    digest.update(chunk)
                    read += len(chunk)
            if read != length:
                raise GuardError(f"{path} has {read} bytes, listed were {length}")
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("file_path"), batch.column("file_bytes"), pa.array(digests, pa.string())], ["file_path", "file_bytes", "file_sha256"]
        )


def _stream_by_driver(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _root(spark: SparkSession, path: str) -> str:
    """``path`` as the file system spells it in listings."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def compare_fingerprints(found: DataFrame, registered: DataFrame) -> DataFrame:
    """Status per file path: match, changed, unregistered or absent."""
    known = registered.select("file_path", F.col("file_sha256").alias("registered_sha256"))
    joined = found.join(known, "file_path", "full_outer")
    return joined.withColumn(
        "status",
        F.when(F.col("file_sha256").isNull(), "absent")
        .when(F.col("registered_sha256").isNull(), "unregistered")
        .when(F.col("file_sha256") == F.col("registered_sha256"), "match")
        .otherwise("changed"),
    )


def append_run(df: DataFrame, table: str, run_id: str) -> str:
    """Write one run of ``table``; a run that exists is never overwritten.

    The rows go to a folder of their own, which readers pass over, and one rename
    that refuses an existing target is the commit. Of two writers of one run the
    first to end wins, and the other raises and leaves nothing behind. Where a
    store cannot rename in one step (some object stores), that moment is longer.

    Returns the run's folder. Reading ``table`` gives ``pipeline_run_id`` back
    as a partition column, so a filter on it prunes folders.
    """
    if re.fullmatch(RUN_ID_PATTERN, run_id) is None:
        raise GuardError(f"run id {run_id!r} is not 3-128 safe characters")
    target = f"{table}/pipeline_run_id={run_id}"
    columns = [c for c in df.columns if c != "pipeline_run_id"]
    spark = df.sparkSession
    if _exists(spark, f"{target}/_SUCCESS"):
        raise GuardError(f"run {run_id} of {table} exists already")
    if _exists(spark, target):  # a folder without the marker is what a job left that died half-way
        _delete(spark, target)
    staging = f"{table}/_staging-{run_id}-{uuid.uuid4().hex}"
    try:
        df.select(*columns).write.parquet(staging)
        if not _renamed(spark, staging, target):
            raise GuardError(f"run {run_id} of {table} exists already: another writer ended first")
    finally:
        _delete(spark, staging)
    return target


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder in one step; False where the target is there already."""
    fs = spark._jvm.org.apache.hadoop.fs
    old, new = fs.Path(_root(spark, source)), fs.Path(_root(spark, target))
    context = fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(old, new, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)

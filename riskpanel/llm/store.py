"""Tables in the shared folder of the session, and bit tables of bounded size."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions import key_filter

#: Spark's setting that deletes the shuffle files of an execution at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the largest bit table: 16 MiB, whatever the input.
MOST_BITS = 27
#: Bits of a table that tasks make whole, 64 KB.
SMALL_BITS = 19
#: Rows and bytes of texts that a task holds as one Arrow batch.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only for a local session without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="riskpanel-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold a bounded number of rows and bytes, unless the session asks for smaller ones."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


class Scratch:
    """Written tables of one run of an operator.

    What a result still reads stays until the folder is cleared; `drop` removes
    tables that later steps no longer need. The shuffle files behind a table go
    as soon as it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.sent: list[Broadcast] = []

    def store(self, frame: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            frame.write.parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
            while self.sent:
                self.sent.pop().destroy()
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def counted(self, frame: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The stored table and how many rows it has, counted as they are written."""
        seen = Observation()
        stored = self.store(frame.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        return stored, seen.get["rows"]

    def broadcast(self, value: object) -> Broadcast:
        """`value` at every executor until the next table is stored, which is the one that needs it."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def drop(self, *names: str) -> None:
        """Delete tables that are no longer read."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bit_table(values: DataFrame, column: Column, n: int, least_bits: int = 15) -> np.ndarray:
    """A table of bits with the low bits of every 64-bit value set.

    About sixteen bits a value, 2**MOST_BITS at most. It only thins out rows in
    front of a join that decides: beyond that size it lets more rows through,
    and results stay the same.
    """
    bits = min(MOST_BITS, max(least_bits, math.ceil(math.log2(16 * max(n, 1)))))
    if bits <= SMALL_BITS:
        # a task makes a table of its rows, and these few KB of each meet in one
        found = values.select(column.cast("long").alias("value")).mapInArrow(_set_bits(bits), "bits binary").repartition(1).mapInArrow(_united, "bits binary").collect()
        return np.frombuffer(found[0].bits, np.uint8) if found else np.zeros(1 << (bits - 3), np.uint8)
    place = (column.bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("place")
    parts = (
        values.select(place)
        .groupBy(F.bitmap_bucket_number("place").alias("part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts:
        table[(row.part - 1) * 4096 : row.part * 4096] = np.frombuffer(row.bits, np.uint8)
    return table


def _set_bits(bits: int):
    """The bit table of a task's values, unless there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = np.asarray(batch.column("value")).view(np.uint64) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table with the bits of all."""
    table = None
    for batch in batches:
        for data in batch.column("bits"):
            part = np.frombuffer(data.as_py(), np.uint8)
            table = part if table is None else table | part
    if table is not None:
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])


def in_bit_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values the table may hold."""
    at = values.astype(np.uint64) & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def without(docs: DataFrame, scratch: Scratch, dropped: DataFrame, *own: Column) -> DataFrame:
    """The rows of docs whose key `own` is not among the rows of `dropped`, with all their columns.

    `dropped` has a column for each of `own`. Rows that no dropped key can meet are
    passed on where they are read; only the others are shuffled with their texts.
    A key with NULL is never dropped.
    """
    names = [f"key_{i}" for i in range(len(own))]
    keys, n = scratch.counted(dropped.toDF(*names).dropna().distinct(), "dropped")
    bits = key_filter.bits_for(n)
    parts = scratch.store(key_filter.bit_parts(keys, names, bits), "dropped-bits")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[k.alias(name) for k, name in zip(own, names)])
    marked = key_filter.with_may_match(whole, parts, names, bits)
    touched = marked.where("_may_match").join(keys, names, "left_anti")
    return marked.where("NOT _may_match").select("row.*").union(touched.select("row.*"))

"""Blocks of all labelled rows and sums over them, and bounded samples by language with fits in one task."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm import arrays
from riskpanel.llm.store import SHUFFLE_CLEANUP, Scratch

#: Rows of a block on average, and bytes of the texts that are dealt to it.
BLOCK_ROWS, BLOCK_BYTES = 1000, 16 << 20
#: Numbers that are added up together.
SLICE = 1 << 13

#: What a fit gets: texts in a fixed order, with their language and label.
ROWS = pa.schema([("place", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("label", pa.int32())])


def held_out(modulus: int, remainder: int) -> Column:
    """Is crc32 of doc_id as text the given remainder? A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def labelled_blocks(scratch: Scratch, docs: DataFrame, labels: DataFrame, label: str, apart: Column, pack: Callable[[pa.Table], bytes]) -> tuple[DataFrame, dict[int, int]]:
    """(block, data) with every labelled row in one block of about BLOCK_ROWS rows and BLOCK_BYTES bytes, and the class counts of all labels.

    `pack` makes the data from the block's ROWS, in a fixed order whatever the
    partitions. Rows that are held apart never enter. Repeated ids count once,
    with the larger label and text.
    """
    known = labels.where(~apart & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = scratch.store(known.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "label"), "known")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    counts = {0: counts.get(0, 0), 1: counts.get(1, 0)}
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(~apart & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    blocks = max(1, math.ceil(sum(counts.values()) / BLOCK_ROWS), math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")

    def run(key: tuple, own: pa.Table, marked: pa.Table) -> pa.Table:
        classes = dict(zip(marked.column("doc_id").to_pylist(), marked.column("label").to_pylist()))
        rows: dict[object, list] = {}
        for doc, place, text, lang in zip(*(own.column(c).to_pylist() for c in ("doc_id", "place", "text", "lang"))):
            if doc in classes:
                held = rows.setdefault(doc, [place, text, lang, classes[doc]])
                held[1] = max(held[1], text)
                held[2] = max((x for x in (held[2], lang) if x is not None), default=None)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows.values()), ROWS)] if rows else [pa.array([], f.type) for f in ROWS]
        table = pa.Table.from_arrays(columns, schema=ROWS).sort_by([("place", "ascending"), ("text", "ascending")])
        data = [pack(table.combine_chunks())] if rows else []
        return pa.table({"block": pa.array([key[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    texts = texts.select(block.alias("block"), "doc_id", F.xxhash64("doc_id", F.lit(1)).alias("place"), "text", "lang")
    known = known.where(F.col("doc_id").isNotNull()).select(block.alias("block"), "doc_id", "label")
    found = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "block int, data binary")
    return scratch.store(found, "blocks"), counts


def slices_summed(blocks: DataFrame, sums: Callable[[bytes], np.ndarray], size: int, width: int = SLICE, finish: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, bytes]]:
    """(first place, bytes) of the slices, not all 0, of the sum over all blocks of the `size` numbers that `sums` makes of a block's data.

    A task adds up its blocks, and slices of `width` numbers are added up by Spark in
    a fixed order, so that the driver gets `size` numbers however many tasks there
    are, or what `finish` leaves of a slice that begins at a place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for data in batch.column("data"):
                total += sums(data.as_py())
        for at in range(0, size, width):
            part = total[at : at + width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "sums"])

    def added(at: int, parts: list[bytes]) -> bytes:
        parts = sorted(parts)
        total = np.frombuffer(parts[0]).copy()
        for part in parts[1:]:
            total += np.frombuffer(part)
        return (finish(at, total) if finish else total).tobytes()

    def add(table: pa.Table) -> pa.Table:
        parts = table.column("sums").to_pylist()
        return pa.table({"at": table.column("at")[:1], "sums": pa.array([added(table.column("at")[0].as_py(), parts)], pa.binary())})

    def add_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [part for batch in batches for part in batch.column("sums").to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([added(0, parts)], pa.binary())], ["at", "sums"])

    session = blocks.sparkSession
    before = session.conf.get(SHUFFLE_CLEANUP, "false")
    session.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        parts = blocks.select("data").mapInArrow(run, "at int, sums binary")
        # the parts of a single slice meet in one task in any case, so no others are started
        found = parts.repartition(1).mapInArrow(add_only, "at int, sums binary") if size <= width else parts.groupBy("at").applyInArrow(add, "at int, sums binary")
        return [(r.at, r.sums) for r in found.collect()]
    finally:
        session.conf.set(SHUFFLE_CLEANUP, before)


def summed(blocks: DataFrame, sums: Callable[[bytes], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of the `size` numbers that `sums` makes of a block's data."""
    total = np.zeros(size)
    for at, data in slices_summed(blocks, sums, size):
        part = np.frombuffer(data)
        total[at : at + len(part)] = part
    return total


def language_rows(docs: DataFrame, apart: Column, per_language: int, most_languages: int = 1000) -> DataFrame:
    """(place, text, lang, label) of about per_language rows of each language, chosen by hash; the label is NULL.

    The most_languages languages with the most rows are learned, in ties the first
    by name; rarer ones, such as misspelt tags, are never predicted.
    """
    known = docs.where(~apart & F.col("lang").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(most_languages)
    share = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1)) < F.lit(float(per_language)) / F.col("rows") * F.lit(float(1 << 40))
    chosen = known.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(counts), "lang").where(share)
    return chosen.select(F.xxhash64("doc_id", F.lit(1)).alias("place"), "text", "lang", F.lit(None).cast("int").alias("label"))


def fitted(rows: DataFrame, make: Callable[[pa.Table], object]):
    """The broadcast result of make on the sampled rows.

    The sample is bounded, so one task takes it whole; the driver only gets the
    model. A fit that is lost with its executor is repeated there by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(ROWS) for b in batches], ROWS).sort_by([("place", "ascending"), ("text", "ascending")])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(table.combine_chunks()))], pa.binary())], ["model"])

    # shuffled, so that the scan stays with all tasks and only the sample meets in one
    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    model = pickle.loads(found[0].model) if found else make(ROWS.empty_table())
    return rows.sparkSession.sparkContext.broadcast(model)


def scored(model, threshold: float):
    """(doc_id, held_out, score, predicted) by the score of a broadcast model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                score = model.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run

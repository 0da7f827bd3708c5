"""Removal of passages that an earlier document has, by difference-cover anchors.

A difference cover D modulo P holds, for any two positions i and j, an offset d
below P with i + d and j + d both in D modulo P. So hashing the windows that
begin at cover positions alone, six in thirty-one, is enough: two equal runs of
`window` words share an aligned anchor of `window - P + 1` words in each.

1.  Anchors are grouped by hash; those of one document only are dropped.
2.  Anchors of the texts that a bit table lets through are joined with the
    shared ones, which leaves the shared anchors of each document.
3.  Around these, anchors are extended: every window of `window` words that
    contains an aligned shared anchor is hashed to 128 bits. The smallest
    document of each hash is taken, and windows of larger documents are marked.
4.  Words that marked windows cover are removed.

Texts are read again rather than shuffled; only texts with shared anchors move.

Rules: a null text has no words; windows are judged on the input; repeats inside
one document stay; rows with the same doc_id are not earlier than each other; a
null doc_id is earlier than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays
from riskpanel.llm.store import Scratch, bit_table, in_bit_table

WINDOW = 50
PERIOD = 31
#: A perfect difference set: every distance modulo 31 is between two of them.
COVER = (1, 5, 11, 24, 25, 27)
NO_ID = -(2**63)


def _cover_windows(found: arrays.Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash) of the windows that begin at cover positions."""
    first, value = arrays.windows(found.hashes(), found.bounds, width)
    text = np.repeat(np.arange(len(found.bounds) - 1), np.maximum(found.counts - width + 1, 0))
    at = first - found.bounds[text]
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    chosen = cover[at % PERIOD]
    return text[chosen], at[chosen], value[chosen].view(np.int64)


def _anchors(width: int):
    """(hash, id) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                text, _, value = _cover_windows(arrays.words(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([pa.array(value), part.column("id").take(pa.array(text))], ["anchor", "id"])

    return run


def _placed_anchors(width: int, table):
    """(anchor, id, text_hash, at) of the anchors that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                text, at, value = _cover_windows(arrays.words(part.column("text")), width)
                held = in_bit_table(table.value, value.view(np.uint64))
                row = pa.array(text[held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[held]), part.column("id").take(row), part.column("text_hash").take(row), pa.array(at[held].astype(np.int32))],
                    ["anchor", "id", "text_hash", "at"],
                )

    return run


def _marks(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in [start, end) of any of the intervals."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(ends, 0, n), -1)
    return np.cumsum(change[:-1]) > 0


def _extended(window: int, anchor: int, name: str):
    """(high, low, id, text_hash, at) of the windows around the shared anchors in column `name`.

    `earlier` has the places of anchors that a smaller document shares, `later`
    of those that a larger one does; a window is asked for on the first side and
    offered on the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - anchor
        for batch in batches:
            for part in arrays.slices(batch):
                found = arrays.words(part.column("text"))
                hashes = found.hashes()
                first, high = arrays.windows(hashes, found.bounds, window)
                _, low = arrays.windows(hashes, found.bounds, window, second=True)
                counts = np.maximum(found.counts - window + 1, 0)
                text = np.repeat(np.arange(len(counts)), counts)
                before = np.concatenate(([0], np.cumsum(counts)))
                lists = part.column(name)
                places = np.asarray(lists.flatten()).astype(np.int64)
                of = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64))
                # windows from place - reach to place of the same text
                begin = before[of] + np.minimum(np.maximum(places - reach, 0), counts[of])
                end = before[of] + np.minimum(places + 1, counts[of])
                chosen = np.flatnonzero(_marks(begin, end, len(first)))
                row = pa.array(text[chosen])
                at = first[chosen] - found.bounds[text[chosen]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high[chosen].view(np.int64)), pa.array(low[chosen].view(np.int64)), part.column("id").take(row), part.column("text_hash").take(row), pa.array(at.astype(np.int32))],
                    ["high", "low", "id", "text_hash", "at"],
                )

    return run


def _untouched(table):
    """(id, n_words, n_removed, kept_text) of the texts whose id the bit table excludes: nothing is removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_id(table, False)(batches):
            for part in arrays.slices(batch):
                found = arrays.words(part.column("text"))
                kept = [b" ".join(found.raw[a:b].tobytes().split()) for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(found.counts), pa.array(np.zeros(len(part), np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "n_removed", "kept_text"],
                )

    return run


def _without(window: int):
    """(id, n_words, n_removed, kept_text) after the removal of marked windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                found = arrays.words(part.column("text"))
                lists = part.column("starts")
                of = np.repeat(np.arange(len(part)), np.asarray(pc.list_value_length(lists).fill_null(0)).astype(np.int64))
                begin = found.bounds[of] + np.asarray(lists.flatten()).astype(np.int64)
                gone = _marks(begin, np.minimum(begin + window, found.bounds[of + 1]), len(found.starts))
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[found.bounds])
                kept = []
                for i in range(len(part)):
                    low, high = found.bounds[i], found.bounds[i + 1]
                    whole = found.data[found.offsets[i] : found.offsets[i + 1]].tobytes().split()
                    if removed[i]:
                        whole = [whole[j] for j in np.flatnonzero(~gone[low:high])]
                    kept.append(b" ".join(whole))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(found.counts), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "n_removed", "kept_text"],
                )

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text."""
    if window < PERIOD + 4:
        raise ValueError(f"a window needs {PERIOD + 4} words at least, so that anchors have five")
    width = window - PERIOD + 1
    scratch = Scratch(spark, "repeats")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", F.xxhash64("text").alias("text_hash"))
    spread = texts.select("id", "text").mapInArrow(_anchors(width), "anchor long, id long").groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    shared = scratch.store(spread.where("low < high"), "shared")
    held = spark.sparkContext.broadcast(bit_table(shared, F.col("anchor"), shared.count()))
    placed = texts.mapInArrow(_placed_anchors(width, held), "anchor long, id long, text_hash long, at int").join(shared, "anchor")
    places = placed.groupBy("id", "text_hash").agg(
        F.collect_list(F.when(F.col("low") < F.col("id"), F.col("at"))).alias("earlier"),
        F.collect_list(F.when(F.col("high") > F.col("id"), F.col("at"))).alias("later"),
    )
    places = scratch.store(places, "places")
    scratch.drop("shared")
    joined, _ = _of_texts(spark, texts, places, "inner")
    joined = scratch.store(joined, "texts")
    scratch.drop("places")
    schema = "high long, low long, id long, text_hash long, at int"
    offered = joined.mapInArrow(_extended(window, width, "later"), schema)
    sources = scratch.store(offered.groupBy("high", "low").agg(F.min("id").alias("source")), "sources")
    asked = joined.mapInArrow(_extended(window, width, "earlier"), schema)
    marked = asked.join(sources, ["high", "low"]).where(F.col("source") < F.col("id"))
    marked = scratch.store(marked.groupBy("id", "text_hash").agg(F.collect_set("at").alias("starts")), "marked")
    scratch.drop("texts", "sources")
    joined, held = _of_texts(spark, texts, marked, "left")
    schema = "id long, n_words long, n_removed long, kept_text string"
    cleaned = joined.mapInArrow(_without(window), schema).unionByName(texts.select("id", "text").mapInArrow(_untouched(held), schema))
    return cleaned.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_text")


def _of_texts(spark: SparkSession, texts: DataFrame, found: DataFrame, how: str):
    """The texts that found may concern, with its columns by id and text, and the bit table of its ids."""
    held = spark.sparkContext.broadcast(bit_table(found, F.col("id"), found.count()))
    return texts.mapInArrow(_by_id(held, True), "id long, text string, text_hash long").join(found, ["id", "text_hash"], how), held


def _by_id(table, inside: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = in_bit_table(table.value, np.asarray(batch.column("id")).view(np.uint64))
            yield batch.filter(pa.array(held == inside))

    return run

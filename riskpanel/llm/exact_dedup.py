"""Exact deduplication with heavy hitters split off.

Misra-Gries counters in every partition find the few digests that may be
frequent. Their exact counts and winners are then taken, and this table, which
has at most `counters + 1` rows whatever the input, goes to every task: copies of
a heavy text are settled where they are read. All other digests are shuffled;
none of them holds more than 2 / (counters + 1) of the rows.

Rules: a null text counts as empty, a null doc_id is smaller than any other. Of
equal texts the row with the largest doc_id stays. If that row is repeated in
full, one of the repeated rows stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.functions import key_filter
from riskpanel.llm.store import Scratch

COUNTERS = 1023


def digest_of_text() -> F.Column:
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def _misra_gries(counters: int):
    """One summary per partition: (digest, lower bound of its count)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: n - cut for k, n in held.items() if n > cut})
        yield pa.RecordBatch.from_pydict({"digest": list(held), "least": list(held.values())}, pa.schema([("digest", pa.string()), ("least", pa.int64())]))

    return summarise


def heavy_digests(rows: DataFrame, winner: F.Column, counters: int = COUNTERS, total: int | None = None) -> DataFrame:
    """(digest, group_size, winner) of the frequent digests: exact, at most counters + 1 rows.

    Each partition undercounts a digest by n / (counters + 1) at most, so the sums
    reach N / (counters + 1) for every digest with 2 N / (counters + 1) rows, and
    no more than counters + 1 sums can reach it.
    """
    total = rows.count() if total is None else total
    candidates = (
        rows.select("digest")
        .mapInArrow(_misra_gries(counters), "digest string, least long")
        .groupBy("digest")
        .agg(F.sum("least").alias("least"))
        .where(F.col("least") * (counters + 1) >= total)
        .select("digest")
    )
    return rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("group_size"), F.max(winner).alias("winner"))


def duplicate_groups(spark: SparkSession, docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(spark, "exact")
    digests, total = scratch.counted(docs.select("doc_id", digest_of_text().alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    winner = F.struct("doc_id", "row")
    heavy = scratch.store(heavy_digests(digests, winner, counters, total), "heavy")
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    light = marked.where(F.col("group_size").isNull()).select("digest", "doc_id", "row")
    groups = light.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(winner).alias("winner"))
    columns = [
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    ]
    return marked.where(F.col("group_size").isNotNull()).select(*columns).unionByName(light.join(groups, "digest").select(*columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    scratch = Scratch(spark, "exact")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept_row"), "doc_id", digest_of_text().alias("digest"))
    digests, total = scratch.counted(rows.select("doc_id", "digest"), "digests")
    heavy = scratch.store(heavy_digests(digests, F.struct("doc_id"), counters, total), "heavy")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    repeated, n = scratch.counted(light.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest").union(heavy.select("digest")), "repeated")
    bits = key_filter.bits_for(n)
    parts = scratch.store(key_filter.bit_parts(repeated, ["digest"], bits), "bits")
    scratch.drop("digests", "repeated")
    # texts without a copy stay where they are read; of the others the heavy ones are settled there
    marked = key_filter.with_may_match(rows, parts, ["digest"], bits)
    copies = (
        marked.where("_may_match")
        .join(F.broadcast(heavy), "digest", "left")
        .where(F.col("winner").isNull() | F.col("doc_id").eqNullSafe(F.col("winner.doc_id")))
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "kept_row")).alias("last"))
    )
    return marked.where("NOT _may_match").select("kept_row.*").union(copies.select("last.kept_row.*"))

"""Mix sources to target weights by hash thresholds.

Every row has a fixed 48-bit hash. Words are summed by source and the leading
12 bits, the bucket in which a source's budget ends is found, and only the rows
of this boundary bucket are summed again by the next 12 bits, four times in all.
That gives one hash threshold per source, and rows are taken by comparing with
it; nothing is sorted, and raising a target only adds rows.

A source whose target is r times its size takes every row floor(r) times and
the rows below the threshold once more. Rules: a null text has size 0, a null
source is a source of its own and comes last, rows that repeat in full share
their hash and are taken alike, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm.store import Scratch

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS


def size_of_text() -> Column:
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash() -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source.

    Sources share all words by weight. A target stops at `most` times its source's
    size and what it leaves is shared again by weight, so each target is
    min(most * size, level * weight) for one common level. Sources are few, so
    their order and running sums are taken over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        sources.withColumn("ratio", most * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_weight"))
        # levels fall after the first source that its share does not fill, which sets the level of all
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    target = F.least((most * F.col("source_size")).cast("double"), F.col("common") * F.col("weight"))
    return levels.select("source", "source_size", F.coalesce(target, (most * F.col("source_size")).cast("double")).alias("target"))


def thresholds(scratch: Scratch, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, rounds, threshold): a row is taken rounds times, and once more if its hash is below."""
    ratio = F.col("target") / F.col("source_size")
    rounds = F.when(F.col("source_size") > 0, F.floor(ratio)).otherwise(0).cast("long")
    open_sources = targets.withColumn("rounds", rounds).select(
        "source", "source_size", "target", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix")
    )
    state = scratch.store(open_sources, "level-0")
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        bucket = F.shiftright("hash", shift)
        within = rows.select(F.col("source").alias("of"), "size", "hash")
        boundary = state.select(F.col("source"), "budget", "prefix")
        sums = (
            within.join(boundary, F.col("of").eqNullSafe(F.col("source")) & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
            .groupBy("source", "budget", bucket.alias("bucket"))
            .agg(F.sum("size").alias("size"))
        )
        running = Window.partitionBy("source").orderBy("bucket")
        # the bucket in which the budget ends; what lies below it is spent
        ends = (
            sums.withColumn("upto", F.sum("size").over(running))
            .withColumn("below", F.col("upto") - F.col("size"))
            .where((F.col("below") <= F.col("budget")) & (F.col("upto") > F.col("budget")))
            .select(F.col("source").alias("of"), F.col("bucket"), F.col("below"), F.col("size").alias("bucket_size"))
        )
        spent = F.coalesce(F.col("below"), F.lit(0))
        closed = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)
        last = level == LEVELS
        # at the last level the bucket is one hash: take it if that comes nearer
        nearer = F.when(F.lit(last) & (F.col("bucket_size") < 2 * (F.col("budget") - F.col("below"))), 1).otherwise(0)
        state = scratch.store(
            state.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").select(
                "source",
                "source_size",
                "target",
                "rounds",
                (F.col("budget") - spent).alias("budget"),
                (F.coalesce("bucket", closed) + nearer).alias("prefix"),
            ),
            f"level-{level}",
        )
    # whole rounds fill a target of whole multiples; rows without words then stay out of the last one too
    threshold = F.when(F.col("target") > F.col("rounds") * F.col("source_size"), F.col("prefix")).otherwise(0)
    return state.select("source", "source_size", "target", "rounds", threshold.cast("long").alias("threshold"))


def source_limits(scratch: Scratch, docs: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, size, hash) of docs, and (of, source_size, target, rounds, threshold) by source."""
    rows = scratch.store(docs.select("doc_id", "source", size_of_text().alias("size"), row_hash().alias("hash")), "rows")
    targets = scratch.store(source_targets(rows, weights, most), "targets")
    return rows, thresholds(scratch, rows, targets).withColumnRenamed("source", "of")


def copies_of(hashed: str) -> Column:
    return (F.col("rounds") + F.when(F.col(hashed) < F.col("threshold"), 1).otherwise(0)).cast("long")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    rows, limits = source_limits(Scratch(spark, "mixing"), docs, weights, most)
    return rows.join(limits, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", copies_of("hash").alias("copies"), (F.col("size") * copies_of("hash")).alias("taken")
    )


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, and mix_copies, how often it takes each.

    A column of that name in docs is replaced.
    """
    docs = docs.drop("mix_copies")
    _, limits = source_limits(Scratch(spark, "mixing"), docs, weights, most)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mixed_row"), docs["source"].alias("mixed_source"), row_hash().alias("mixed_hash"))
    taken = whole.join(limits, F.col("mixed_source").eqNullSafe(F.col("of"))).withColumn("mixed_copies", copies_of("mixed_hash"))
    return taken.where("mixed_copies > 0").select("mixed_row.*", F.col("mixed_copies").alias("mix_copies"))

"""Frame helpers: one-row evidence, exact global order, exact medians."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A check that must hold before the next step did not hold."""


def single_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row aggregates with distinct columns into one row.

    Each input is already aggregated to a single row, so the union below holds
    one row per input; no join is needed to bring the numbers side by side.
    """
    merged = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)
    return merged.agg(*[F.expr(f"max(`{c}`) AS `{c}`") for c in merged.columns])


def as_rows(df: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Emit one output row per struct for every input row."""
    return df.select(F.explode(F.array(*structs)).alias("_row")).select("_row.*")


def fixed_rows(spark: SparkSession, columns: dict[str, str], rows: Sequence[tuple]) -> DataFrame:
    """A small frame of constants with the given column types, made in the JVM."""
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns.items())]) for row in rows
    ]
    return as_rows(spark.range(1), structs)


def count_where(condition: Column) -> Column:
    """Rows for which ``condition`` is true; false and NULL both count as no."""
    return F.count_if(condition)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient of two integers, NULL for a zero or NULL denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def shuffle_parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, which are set by the size of the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def default_buckets(df: DataFrame) -> int:
    """Buckets for a global order: about four per shuffle partition, so that they grow with the job."""
    return max(16, 4 * shuffle_parts(df))


def range_bucket(df: DataFrame, order: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Add ``_bucket``: the position of ``order`` among approximate quantile edges.

    Edges come from the data, so a score range that holds most of the rows is
    cut finely. A row is compared with every ``side``-th edge and then with the
    edges of that stretch, ``2 * side`` comparisons for ``side ** 2`` buckets.

    The edges hold one number per bucket and ``by`` group, and ``by`` is a
    fixed list (models, features), so the broadcast below is bounded by the
    parameters and does not grow with the rows.
    """
    side = max(2, math.isqrt((buckets or default_buckets(df)) - 1) + 1)
    steps = ", ".join(f"{i / side**2!r}D" for i in range(1, side**2))
    edges = F.expr(f"percentile_approx(`{order}`, array({steps}), {max(10000, 10 * side**2)})").alias("_edges")
    if by:
        keyed = df.join(F.broadcast(df.groupBy(*by).agg(edges)), list(by))
    else:
        keyed = df.withColumn("_edges", df.agg(edges).scalar())
    marks = ", ".join(f"_edges[{side * i - 1}]" for i in range(1, side))
    stretch = keyed.withColumn("_stretch", F.expr(f"size(filter(array({marks}), e -> e < `{order}`))"))
    fine = f"slice(_edges, _stretch * {side} + 1, {side - 1})"
    bucket = F.expr(f"_stretch * {side} + size(filter({fine}, e -> e < `{order}`))")
    return stretch.withColumn("_bucket", bucket).drop("_edges", "_stretch")


def ordered_running_sum(
    df: DataFrame,
    order: Sequence[str],
    values: Sequence[str],
    by: Sequence[str] = (),
    bucket: Column | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Running sums in global order without moving all rows to one task.

    Rows fall into order-preserving buckets; each bucket is summed on its own,
    the few bucket totals are accumulated, and every row adds its bucket's
    starting value to a sum kept inside the bucket. Adds ``cum_<v>`` (inclusive)
    and ``total_<v>`` for each value. ``order`` must be unique within ``by``, so
    aggregate ties first; then no single value can fill a bucket.

    Only the bucket totals (``buckets`` rows per group) meet in one task.
    """
    by = list(by)
    if bucket is not None:
        keyed = df.withColumn("_bucket", bucket)
    else:
        keyed = range_bucket(df, order[0], by, buckets)
    totals = keyed.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    starts = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_start_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = keyed.select("*", *[F.sum(v).over(inside).alias(f"_inside_{v}") for v in values])
    joined = summed.join(starts, [*by, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_start_{v}") + F.col(f"_inside_{v}")).alias(f"cum_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values],
    )


def exact_medians(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """One row per column: ``(feature, median, n)``, exact, ignoring NULLs.

    Values are counted first, so equal values travel once; the middle position
    is then found on the running counts. No task ever holds all values.
    """
    cells = as_rows(
        df, [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    ).where("value IS NOT NULL")
    counts = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = ordered_running_sum(counts, ["value"], ["n"], by=["feature"], buckets=buckets)
    low = F.expr("(total_n - 1) div 2")
    high = F.expr("total_n div 2")
    first = F.col("cum_n") - F.col("n")

    def at(position: Column) -> Column:
        return F.max(F.when((first <= position) & (position < F.col("cum_n")), F.col("value")))

    middle = ranked.groupBy("feature").agg(
        at(low).alias("_low"), at(high).alias("_high"), F.max("total_n").alias("n")
    )
    return middle.select(
        "feature", (F.col("_low") + F.lit(0.5) * (F.col("_high") - F.col("_low"))).alias("median"), "n"
    )


def part_share(df: DataFrame) -> float:
    """Share of all rows that one part of a key may hold: a quarter of an even shuffle partition."""
    return 1 / (4 * shuffle_parts(df))


def hot_keys(df: DataFrame, on: Sequence[str], share: float | None = None) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, and ``_parts``, how many parts each is cut into.

    A key gets as many parts as it holds shares, so no part is larger than one
    share, whatever the size. At most ``1 / share`` keys can be hot, which is
    what makes this frame safe to broadcast.
    """
    return hot_of_counts(df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on, share)


def hot_of_counts(counts: DataFrame, on: Sequence[str], share: float | None = None) -> DataFrame:
    """:func:`hot_keys` where the rows per key (``_n``) are at hand already."""
    part = counts.agg(F.sum("_n")).scalar() * F.lit(share or part_share(counts))
    hot = counts.where(F.col("_n") > F.greatest(part, F.lit(1)))
    return hot.select(*on, F.ceil(F.col("_n") / F.greatest(part, F.lit(1))).cast("int").alias("_parts"))


def salt_many(many: DataFrame, hot: DataFrame, on: Sequence[str], spread: Column) -> DataFrame:
    """Add ``_salt``: 0 for most keys, spread over the parts of the key for hot ones."""
    marked = many.join(F.broadcast(hot), list(on), "left")
    part = F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")
    return marked.withColumn("_salt", F.when(F.col("_parts").isNotNull(), part).otherwise(F.lit(0))).drop("_parts")


def salt_few(few: DataFrame, hot: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``_salt``: one row for most keys, one per part for hot ones."""
    marked = few.join(F.broadcast(hot), list(on), "left")
    last = F.coalesce(F.col("_parts") - 1, F.lit(0))
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_parts")


def salted_join(
    many: DataFrame, few: DataFrame, on: Sequence[str], spread: Column, hot: DataFrame | None = None
) -> DataFrame:
    """Inner join in which hot keys of ``many`` are cut into parts.

    The rows of a hot key go to different tasks by a hash of ``spread``, and
    only the matching rows of ``few`` are repeated. All other keys join as usual.
    """
    hot = hot_keys(many, on) if hot is None else hot
    left = salt_many(many, hot, on, spread)
    right = salt_few(few, hot, on)
    return left.join(right, [*on, "_salt"]).drop("_salt")


def one_per_key(df: DataFrame, key: Sequence[str], fields: Sequence[str], side: str) -> DataFrame:
    """One row per key: ``<side>_rows`` and the smallest and largest record as ``<side>_low`` and ``<side>_high``."""
    record = F.struct(*fields)
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"), F.min(record).alias(f"{side}_low"), F.max(record).alias(f"{side}_high")
    )


def require(df: DataFrame, conditions: dict[str, str]) -> None:
    """Raise :class:`GuardError` naming each condition the one-row frame breaks."""
    row = df.select(*[F.expr(f"coalesce({sql}, false)").alias(name) for name, sql in conditions.items()]).first()
    broken = [name for name in conditions if not row[name]]
    if broken:
        raise GuardError("failed: " + ", ".join(broken))

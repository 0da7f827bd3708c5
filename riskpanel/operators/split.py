"""Deterministic hash-rank split into train, calibration and test."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import SPLIT_VERSION, SPLITS
from riskpanel.functions.frames import count_where, default_buckets, ordered_running_sum, require

c = F.col


#: The parts of a split in rank order. All but the last have a fixed share; the last takes the rest.
SHARES = ((SPLITS[0], Fraction(6, 10)), (SPLITS[1], Fraction(2, 10)))


def cuts(shares: Sequence[tuple[str, Fraction]] = SHARES) -> list[tuple[str, Fraction]]:
    """The shares, once it is sure that each is positive and that a rest is left."""
    taken = sum(share for _, share in shares)
    if any(share <= 0 for _, share in shares) or taken >= 1:
        raise ValueError(f"shares {[str(share) for _, share in shares]} must be positive and leave a rest")
    return list(shares)


def split_digest(key: Column, version: str = SPLIT_VERSION) -> Column:
    """SHA-256 of ``"<version>:<id>"``; the id must be positive."""
    text = F.concat(F.lit(version + ":"), key.cast("string"))
    return F.when(key > 0, F.sha2(text.cast("binary"), 256)).otherwise(
        F.raise_error(F.lit("split ids must be positive")).cast("string")
    )


def ranked(df: DataFrame, key: str = "customer_id", version: str = SPLIT_VERSION) -> DataFrame:
    """Add ``digest``, the exact global ``split_rank`` (from 0) and ``population_size``.

    The leading digest digits are uniform, so they cut the ids into equal
    ordered buckets, at least four per shuffle partition.
    """
    digits = 1
    while 16**digits < default_buckets(df):
        digits += 1
    hashed = df.withColumn("digest", split_digest(c(key), version)).withColumn("_one", F.lit(1).cast("bigint"))
    counted = ordered_running_sum(hashed, ["digest", key], ["_one"], bucket=F.substring("digest", 1, digits))
    return counted.select(
        *df.columns, "digest", (c("cum__one") - 1).alias("split_rank"), c("total__one").alias("population_size")
    )


def cut(rank: Column, size: Column, shares: Sequence[tuple[str, Fraction]] = SHARES) -> Column:
    """Name of the part that a rank falls into; every cut is rounded down by itself, in whole numbers."""
    end, name = F.lit(0), F
    for part, share in cuts(shares):
        end = end + F.floor(size * share.numerator / share.denominator)
        name = name.when(rank < end, part)
    return name.otherwise(SPLITS[-1])


def require_population(df: DataFrame, key: str = "customer_id", shares: Sequence[tuple[str, Fraction]] = SHARES) -> None:
    """Raise unless every id has one row and every part gets some row."""
    per_id = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), count_where(c("n") > 1).alias("repeated_ids"))
    parts = [F.floor(c("size") * share.numerator / share.denominator) for _, share in cuts(shares)]
    rest = c("size") - sum(parts, F.lit(0))
    require(
        counts.select("repeated_ids", F.least(*parts, rest).alias("smallest_part")),
        {"ids_are_unique": "repeated_ids = 0", "every_part_has_rows": "smallest_part > 0"},
    )


def rank_split(
    df: DataFrame, key: str = "customer_id", version: str = SPLIT_VERSION, shares: Sequence[tuple[str, Fraction]] = SHARES
) -> DataFrame:
    """Add ``split`` to every row.

    Ids are positive (the digest raises otherwise) and unique;
    :func:`require_population` tests that, and that no part stays empty.
    """
    placed = ranked(df, key, version)
    return placed.select(*df.columns, cut(c("split_rank"), c("population_size"), shares).alias("split"))


def split_check(df: DataFrame, outcome: str = "next_month_default") -> DataFrame:
    """One row per split: rows, outcomes and whether both classes are there.

    A row whose split has no known name is listed under its own name.
    """
    per = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        count_where(c(outcome) == 1).alias("positives"),
        count_where(c(outcome) == 0).alias("negatives"),
    )
    return per.select(
        "split", "rows", "positives", "negatives",
        c("split").isin(*SPLITS).alias("known_split"),
        ((c("positives") > 0) & (c("negatives") > 0)).alias("both_classes"),
    )


def split_overlap(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row: ids in all, ids with more than one row, ids in more than one split."""
    per_id = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("split").alias("low"), F.max("split").alias("high")
    )
    return per_id.agg(
        F.count(F.lit(1)).alias("ids"),
        count_where(c("n") > 1).alias("repeated_ids"),
        count_where(c("low") != c("high")).alias("ids_in_two_splits"),
    )


def require_split(df: DataFrame, outcome: str = "next_month_default") -> None:
    """Raise unless the three splits are known, non-empty and hold both classes."""
    totals = split_check(df, outcome).agg(
        F.count(F.lit(1)).alias("splits"), count_where(c("known_split") & c("both_classes")).alias("good")
    )
    require(totals, {"three_splits_with_both_classes": f"splits = {len(SPLITS)} AND good = {len(SPLITS)}"})


def recompute_split(df: DataFrame, key: str = "customer_id", version: str = SPLIT_VERSION) -> DataFrame:
    """Stored against recomputed split: rows and mismatches per stored split."""
    again = rank_split(df.select(key, c("split").alias("_stored")), key, version)
    return again.groupBy(c("_stored").alias("stored_split")).agg(
        F.count(F.lit(1)).alias("rows"), count_where(~c("_stored").eqNullSafe(c("split"))).alias("mismatches")
    )

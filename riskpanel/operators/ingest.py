"""Ingest: lossless cell checks, duplicate ids, insert-only load, registry, ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import INT32_MAX, INT32_MIN
from riskpanel.functions.frames import (
    GuardError, count_where, hot_of_counts, ordered_running_sum, require, salted_join,
)

# Reject reasons and the text form of a number.
MISSING = "missing value"
NON_NUMERIC = "non-numeric"
NON_INTEGRAL = "non-integral"
OUT_OF_RANGE = "outside int32"
DUPLICATE = "duplicate id"
#: Whole numbers that int32 holds for certain.
PLAIN = r"^[+-]?[0-9]{1,9}$"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def check_row_count(df: DataFrame, expected: int) -> None:
    """Raise unless ``df`` has exactly ``expected`` rows."""
    observed = df.count()
    if observed != expected:
        raise GuardError(f"row count is {observed}, expected {expected}")


def is_whole(number: Column) -> Column:
    """Is the text of a number a whole one? Its digits are tested, not its value.

    Digits after the point, without the zeros at their end, must not outnumber
    the exponent; a negative exponent needs as many zeros before the point.
    """
    fraction = F.length(F.rtrim(F.regexp_extract(number, r"\.([0-9]*)", 1), F.lit("0")))
    exponent = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?[0-9]+)", 1).try_cast("double"), F.lit(0.0))
    zeros = F.length(F.regexp_extract(number, r"(0*)(\.0*)?[eE]", 1))
    zero = number.rlike(r"^[^1-9eE]*([eE]|$)")
    return zero | F.when(exponent >= 0, fraction <= exponent).otherwise((fraction == 0) & (zeros >= -exponent))


def reject_reason(cell: Column) -> Column:
    """Why a text cell cannot become an int32 without loss; NULL when it can.

    A number is plain or scientific decimal notation, blanks around it allowed
    (`' 7 '`, `'1e3'`). NaN, infinities and type suffixes are not numbers. A
    fraction too fine for a double is still a fraction, so
    `'1.00000000000000001'` is rejected; what is whole is exact as a double up
    to 2**53, far beyond the range that is tested last.
    """
    number = cell.try_cast("double")
    return (
        # most cells are plain short numbers, and need no further test
        F.when(cell.rlike(PLAIN), F.lit(None).cast("string"))
        .when(cell.isNull() | (cell == ""), MISSING)
        .when(~cell.rlike(NUMBER), NON_NUMERIC)
        .when(~is_whole(cell), NON_INTEGRAL)
        .when((number < INT32_MIN) | (number > INT32_MAX), OUT_OF_RANGE)
    )


def reject_cells(df: DataFrame, fields: Sequence[str], row_no: str = "row_no") -> DataFrame:
    """One row per rejected cell ``(row_no, col_no, field, reason, raw_value)``.

    Rows without any reject are filtered before the cells are laid out.
    """
    any_reason = F.coalesce(*[reject_reason(F.col(f)) for f in fields]).isNotNull()
    cells = [
        F.struct(
            F.lit(i).cast("bigint").alias("col_no"),
            F.lit(f).alias("field"),
            reject_reason(F.col(f)).alias("reason"),
            F.col(f).alias("raw_value"),
        )
        for i, f in enumerate(fields, start=1)
    ]
    rows = df.where(any_reason).select(F.col(row_no).alias("row_no"), F.explode(F.array(*cells)).alias("cell"))
    return rows.select("row_no", "cell.*").where("reason IS NOT NULL")


def parsed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows whose cells all parse, with the cells as integers."""
    clean = df.where(F.coalesce(*[reject_reason(F.col(f)) for f in fields]).isNull())
    keep = [c for c in df.columns if c not in fields]
    return clean.select(*keep, *[F.col(f).try_cast("double").cast("bigint").alias(f) for f in fields])


def reject_duplicates(df: DataFrame, key: str, row_no: str = "row_no", share: float | None = None) -> DataFrame:
    """Later rows of a repeated id; the first row of each id is not listed.

    Only repeated ids take part in the join, and hot ids are salted: one id may
    be repeated in a large share of all rows.
    """
    counts = df.groupBy(key).agg(F.min(row_no).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = counts.where("_n > 1").drop("_n")
    hot = hot_of_counts(counts, [key], share)
    later = salted_join(df, repeated, [key], F.col(row_no), hot=hot).where(F.col(row_no) > F.col("_first"))
    return later.select(
        F.col(row_no).alias("row_no"),
        F.lit(1).cast("bigint").alias("col_no"),
        F.lit(key).alias("field"),
        F.lit(DUPLICATE).alias("reason"),
        F.col(key).cast("string").alias("raw_value"),
    )


def all_rejects(df: DataFrame, fields: Sequence[str], key: str, row_no: str = "row_no") -> DataFrame:
    """Rejected cells plus duplicate ids among the rows that parse."""
    return reject_cells(df, fields, row_no).unionByName(reject_duplicates(parsed(df, fields), key, row_no))


def accepted_rows(df: DataFrame, fields: Sequence[str], key: str, row_no: str = "row_no") -> DataFrame:
    """Parsed rows, first row per id. One aggregate with map-side combine, no join."""
    clean = parsed(df, fields)
    others = [c for c in clean.columns if c != key]
    first = clean.groupBy(key).agg(F.min_by(F.struct(*others), F.col(row_no)).alias("_row"))
    return first.select(key, "_row.*").select(*clean.columns)


def reject_summary(df: DataFrame, fields: Sequence[str], key: str, row_no: str = "row_no") -> DataFrame:
    """One row: source, parsed and rejected rows, rejected cells.

    Per id: how many rows parse. Every row after the first is one rejected row
    and one rejected cell.
    """
    reasons = [F.when(reject_reason(F.col(f)).isNotNull(), 1).otherwise(0) for f in fields]
    bad = sum(reasons[1:], reasons[0])
    per_key = (
        df.select(F.col(key).alias("_key"), bad.alias("_bad"))
        .withColumn("_key", F.when(F.col("_bad") == 0, F.col("_key").try_cast("double").cast("bigint")))
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("cells"), count_where(F.col("_bad") == 0).alias("clean"))
    )
    repeats = F.greatest(F.col("clean") - 1, F.lit(0))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum(F.col("clean") - repeats), F.lit(0)).alias("parsed_rows"),
        F.coalesce(F.sum(F.col("n") - F.col("clean") + repeats), F.lit(0)).alias("rejected_rows"),
        F.coalesce(F.sum(F.col("cells") + repeats), F.lit(0)).alias("rejected_cells"),
    )


def require_no_rejects(df: DataFrame, fields: Sequence[str], key: str, row_no: str = "row_no") -> DataFrame:
    """Return the parsed rows; raise when any cell or id is rejected."""
    require(reject_summary(df, fields, key, row_no), {"no_rejected_cells": "rejected_cells = 0"})
    return accepted_rows(df, fields, key, row_no)


def with_row_number(df: DataFrame, order: str, start: int = 1) -> DataFrame:
    """Add ``source_row_number`` along a unique ``order`` column, gap-free.

    Where the source carries its row number, keep that one instead.
    """
    counted = ordered_running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), [order], ["_one"])
    return counted.select(*df.columns, (F.col("cum__one") + (start - 1)).alias("source_row_number"))


def _same(left: str, right: str, fields: Sequence[str]) -> Column:
    """Null-safe equality of all fields."""
    return F.struct(*[F.col(f"{left}.{f}") for f in fields]).eqNullSafe(
        F.struct(*[F.col(f"{right}.{f}") for f in fields])
    )


def find_conflicts(batch: DataFrame, target: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Keys present on both sides with any differing field."""
    joined = batch.alias("b").join(target.alias("t"), F.col(f"b.{key}") == F.col(f"t.{key}"))
    return joined.where(~_same("b", "t", fields)).select(F.col(f"b.{key}").alias(key))


def new_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the target does not hold."""
    return batch.join(target.select(key), key, "left_anti")


def matching_rows(batch: DataFrame, target: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: how many batch rows the target holds with equal fields."""
    joined = batch.alias("b").join(target.alias("t"), F.col(f"b.{key}") == F.col(f"t.{key}"))
    return joined.agg(count_where(_same("b", "t", fields)).alias("matching_rows"))


def load_summary(batch: DataFrame, target: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Counts of an insert-only load of ``batch`` into ``target``, in one join.

    ``target`` is the state before the load. Existing matches are counted
    directly; a repeated load inserts 0.
    """
    joined = batch.alias("b").join(target.alias("t"), F.col(f"b.{key}") == F.col(f"t.{key}"), "full_outer")
    in_batch, in_target = F.col(f"b.{key}").isNotNull(), F.col(f"t.{key}").isNotNull()
    same = _same("b", "t", fields)
    return joined.agg(
        count_where(in_batch).alias("staged_rows"),
        count_where(in_batch & ~in_target).alias("inserted_rows"),
        count_where(in_batch & in_target & same).alias("existing_matching_rows"),
        count_where(in_batch & in_target & ~same).alias("conflicting_rows"),
        F.count(F.lit(1)).alias("target_rows_after"),
    )


def load_insert_only(batch: DataFrame, target: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows to append; raise when a present key carries other values."""
    require(load_summary(batch, target, key, fields), {"no_conflicting_rows": "conflicting_rows = 0"})
    return new_rows(batch, target, key)


def source_identity(df: DataFrame) -> DataFrame:
    """One row: the smallest id and hash and how many pairs there are.

    Pairs are reduced before they are counted, and a pair with a NULL part
    counts as a pair.
    """
    pairs = df.groupBy("source_id", "source_file_sha256").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.min("source_id").alias("source_id"),
        F.min("source_file_sha256").alias("source_file_sha256"),
        F.count(F.lit(1)).alias("identities"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"),
    )


def require_one_source(df: DataFrame) -> DataFrame:
    """Identity row; raise unless there is exactly one complete pair."""
    identity = source_identity(df)
    require(
        identity,
        {"one_source_identity": "identities = 1 AND source_id IS NOT NULL AND source_file_sha256 IS NOT NULL"},
    )
    return identity.select("source_id", "source_file_sha256")


def registration(batch: DataFrame, target: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Action per identity: ``insert``, ``noop`` or ``conflict``.

    Repeats inside the batch are collapsed first; repeats that disagree are a
    conflict. The same rule serves sources, graph nodes and graph edges.
    """
    record = F.struct(*fields)
    batch_keys = batch.groupBy(*key).agg(F.min(record).alias("_low"), F.max(record).alias("_high"))
    held = target.select(*key, F.struct(*fields).alias("_held"), F.lit(True).alias("_found"))
    joined = batch_keys.join(held, list(key), "left")
    action = (
        F.when(~F.col("_low").eqNullSafe(F.col("_high")), "conflict")
        .when(F.col("_found").isNull(), "insert")
        .when(F.col("_held").eqNullSafe(F.col("_low")), "noop")
        .otherwise("conflict")
    )
    return joined.select(*key, "_low.*", action.alias("action"))


def register(batch: DataFrame, target: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows to append to the registry; raise on any conflict."""
    actions = registration(batch, target, key, fields)
    conflicts = actions.where("action = 'conflict'").agg(F.count(F.lit(1)).alias("n"))
    require(conflicts, {"no_conflicting_registration": "n = 0"})
    return actions.where("action = 'insert'").drop("action")


def register_source(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """Action per (source, hash) of a registration batch."""
    return registration(batch, registry, ["source_id", "file_sha256"], ["data_row_count", "column_count"])


def run_state(ledger: DataFrame) -> DataFrame:
    """Current state per run from append-only status events."""
    order = F.struct("event_time", "sequence")
    done = F.col("status").isin("succeeded", "failed")
    return ledger.groupBy("run_id").agg(
        F.max_by("status", order).alias("status"),
        F.min("event_time").alias("started_at"),
        F.max(F.when(done, F.col("event_time"))).alias("completed_at"),
        F.count(F.lit(1)).alias("events"),
    )


def latest_registered(registry: DataFrame, source: str = "source_id") -> DataFrame:
    """Newest registry row per source; no sort."""
    rest = [c for c in registry.columns if c != source]
    newest = registry.groupBy(source).agg(
        F.max_by(F.struct(*rest), F.struct("registered_at", "file_sha256")).alias("_row")
    )
    return newest.select(source, "_row.*")

"""Population snapshot, integrity counts and the model input contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import AGE_BOUNDS, ENFORCED_TESTS, SEX_CODES, SHA256_PATTERN, SIGNALS
from riskpanel.functions.expressions import age_band
from riskpanel.functions.frames import count_where, require, single_row
from riskpanel.operators.signals import KEYS

c = F.col
METADATA = ("source_id", "source_file_sha256", "definition_version", "observation_date")


def input_reconciliation(borrowers: DataFrame, signals: DataFrame) -> DataFrame:
    """One row of eleven counts that tie borrowers to signals.

    Each side is counted per key first; one full outer join of the keys then
    gives rows, joined rows, orphans and outcomes without repeating a hot key.
    Metadata values are few and reduced on the map side.
    """
    left = borrowers.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("b"), F.sum("next_month_default").alias("d")
    )
    right = signals.groupBy("customer_id").agg(F.count(F.lit(1)).alias("s"))
    both = left.join(right, "customer_id", "full_outer")

    def total(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    counts = both.select(
        "*", (c("b") * c("s")).alias("_joined"), (c("d") * c("s")).alias("_defaults"),
        F.when(c("s").isNull(), c("b")).alias("_b_only"), F.when(c("b").isNull(), c("s")).alias("_s_only"),
    ).agg(
        total("b").alias("borrower_rows"),
        total("s").alias("signal_rows"),
        total("_joined").alias("joined_rows"),
        count_where(c("_joined").isNotNull()).alias("distinct_joined_borrowers"),
        total("_b_only").alias("borrower_without_signal"),
        total("_s_only").alias("signal_without_borrower"),
        F.sum("_defaults").alias("observed_defaults"),
    )
    kinds = borrowers.select("customer_id", *METADATA).distinct()
    values = kinds.join(right.select("customer_id"), "customer_id", "left_semi").select(*METADATA).distinct()
    metadata = values.agg(
        F.count_distinct("source_id").alias("source_id_count"),
        F.count_distinct("source_file_sha256").alias("source_hash_count"),
        F.count_distinct("definition_version").alias("definition_version_count"),
        F.count_distinct("observation_date").alias("observation_date_count"),
    )
    return single_row(counts, metadata)


def core_counts(borrowers: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: borrower rows, panel rows, distinct offsets."""
    offsets = panel.groupBy("month_offset").agg(F.count(F.lit(1)).alias("n"))
    return single_row(
        borrowers.agg(F.count(F.lit(1)).alias("borrower_rows")),
        offsets.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("panel_rows"),
            count_where(c("month_offset").isNotNull()).alias("periods"),
        ),
    )


def integrity(borrowers: DataFrame, panel: DataFrame) -> DataFrame:
    """One row: duplicate, null and orphan keys, invalid codes, missing history.

    The panel is counted per (key, offset), those counts per key; the parent
    lookup then sees one row per key.
    """
    invalid = (
        ~c("next_month_default").isin(0, 1)
        | ~c("sex_code").isin(*SEX_CODES)
        | (c("credit_limit_ntd") <= 0)
        | ~c("age_years").between(*AGE_BOUNDS)
    )
    empty = c("repayment_status").isNull() | c("bill_amount_ntd").isNull() | c("payment_amount_ntd").isNull()
    per_borrower = borrowers.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("b"), count_where(invalid).alias("invalid")
    )
    per_cell = panel.groupBy(*KEYS, "month_offset").agg(
        F.count(F.lit(1)).alias("n"), count_where(empty).alias("empty")
    )
    per_key = per_cell.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("empty").alias("empty"), count_where(c("n") > 1).alias("repeated")
    )
    orphans = per_key.join(per_borrower.select(*KEYS, "b"), list(KEYS), "left")
    return single_row(
        per_borrower.agg(
            count_where(c("b") > 1).alias("duplicate_borrower_keys"),
            F.coalesce(F.sum(F.when(c("customer_id").isNull(), c("b"))), F.lit(0)).alias("null_borrower_keys"),
            F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid_code_rows"),
        ),
        orphans.agg(
            F.coalesce(F.sum("repeated"), F.lit(0)).alias("duplicate_panel_keys"),
            F.coalesce(F.sum("empty"), F.lit(0)).alias("missing_history_rows"),
            F.coalesce(F.sum(F.when(c("b").isNull(), c("n"))), F.lit(0)).alias("orphan_panel_rows"),
        ),
    )


def rejected_rows(runs: DataFrame) -> DataFrame:
    """One row: the most rows any succeeded load rejected, 0 without such a load."""
    return runs.where("status = 'succeeded'").agg(
        F.coalesce(F.max("rejected_rows"), F.lit(0)).cast("bigint").alias("logged_rejects")
    )


def unlogged_rejects(source_rows: DataFrame, raw_rows: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: source rows that are neither loaded nor logged as rejected."""
    row = single_row(source_rows, raw_rows, rejected_rows(runs))
    gap = c("source_rows") - c("raw_rows") - c("logged_rejects")
    return row.select("*", F.greatest(gap, F.lit(0)).alias("unlogged_rejects"))


def split_tests(tests: DataFrame, enforced: Sequence[str] = ENFORCED_TESTS) -> DataFrame:
    """Tests by use: the enforced list, and every warning."""
    listed = F.filter(
        F.array(
            F.when(c("test_id").isin(*enforced), F.lit("enforced")),
            F.when(c("status") == "warn", F.lit("warning")),
        ),
        lambda x: x.isNotNull(),
    )
    return tests.select(
        F.explode(listed).alias("use"), "test_id", "status", "tested_rows", "failed_rows", "severity", "affected_object"
    )


def frame_contract(df: DataFrame) -> DataFrame:
    """One row of counts that a model frame must satisfy.

    Keys are counted per key first; metadata is constant when its smallest and
    largest value agree, so no distinct count is needed.
    """
    smallest = [F.min(m).alias(f"_min_{m}") for m in METADATA]
    largest = [F.max(m).alias(f"_max_{m}") for m in METADATA]
    nulls = sum([F.when(c(m).isNull(), 1).otherwise(0) for m in METADATA], F.lit(0))
    per_key = df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(c("next_month_default") == 0).alias("negatives"),
        count_where(c("next_month_default") == 1).alias("positives"),
        count_where(~c("source_file_sha256").rlike(SHA256_PATTERN)).alias("bad_hash"),
        count_where(c("credit_limit_ntd") <= 0).alias("bad_limit"),
        F.sum(nulls).alias("null_metadata"),
        *smallest,
        *largest,
    )
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(c("customer_id").isNull(), c("n"))), F.lit(0)).alias("null_keys"),
        count_where(c("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("negatives"), F.lit(0)).alias("negatives"),
        F.coalesce(F.sum("bad_hash"), F.lit(0)).alias("bad_hash"),
        F.coalesce(F.sum("bad_limit"), F.lit(0)).alias("bad_limit"),
        F.coalesce(F.sum("null_metadata"), F.lit(0)).alias("null_metadata"),
        *[F.min(f"_min_{m}").alias(f"_min_{m}") for m in METADATA],
        *[F.max(f"_max_{m}").alias(f"_max_{m}") for m in METADATA],
    )
    varying = sum(
        [F.when(c(f"_min_{m}") == c(f"_max_{m}"), 0).otherwise(1) for m in METADATA], F.lit(0)
    ).cast("bigint")
    return totals.select(
        "rows", "null_keys", "duplicate_keys", "positives", "negatives", "bad_hash", "bad_limit", "null_metadata",
        (c("rows") - c("positives") - c("negatives")).alias("bad_outcome"),
        varying.alias("varying_metadata"),
    )


CONTRACT_COLUMNS = (
    "customer_id", "next_month_default", "observation_date", "credit_limit_ntd", "sex_code", "education_code",
    "marriage_code", "age_years", *SIGNALS, "risk_band", "source_id", "source_file_sha256", "definition_version",
)


def require_frame_contract(df: DataFrame) -> None:
    """Raise unless ``df`` can be a model frame; names are checked before any job."""
    missing = sorted(set(CONTRACT_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"model frame lacks {missing}")
    require(
        frame_contract(df),
        {
            "not_empty": "rows > 0",
            "keys_not_null": "null_keys = 0",
            "keys_unique": "duplicate_keys = 0",
            "both_outcomes": "positives > 0 AND negatives > 0",
            "binary_outcome": "bad_outcome = 0",
            "metadata_not_null": "null_metadata = 0",
            "metadata_constant": "varying_metadata = 0",
            "hash_is_sha256": "bad_hash = 0",
            "limit_positive": "bad_limit = 0",
        },
    )


def prepare_features(df: DataFrame) -> DataFrame:
    """Add the log of the limit and the age band."""
    return df.withColumn("log_credit_limit", F.log1p(c("credit_limit_ntd").cast("double"))).withColumn(
        "age_band", age_band(c("age_years"))
    )

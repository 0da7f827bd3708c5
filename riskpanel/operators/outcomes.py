"""Observed outcome rate per signal bucket and per band, and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import DEFAULT, DIRECTION_BUCKETS, EXPECTED_SIGNS, SIGNALS, PanelParams
from riskpanel.functions.expressions import band_order, percent_text, signal_buckets
from riskpanel.functions.frames import as_rows, count_where, fixed_rows, ratio, single_row

c = F.col


def _counts(df: DataFrame, keys: Sequence[str], p: PanelParams) -> DataFrame:
    summed = df.groupBy(*keys).agg(F.sum("n").alias("sample_size"), F.sum("defaults").alias("default_count"))
    return summed.select(
        F.lit(p.run_id).alias("pipeline_run_id"),
        *keys,
        "sample_size",
        "default_count",
        ratio(c("default_count"), c("sample_size")).alias("observed_default_rate"),
        F.lit(p.definition_version).alias("definition_version"),
    )


def bucket_profile(signals: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """Borrowers and outcomes per combination of buckets.

    All buckets of all signals give a few thousand combinations at most, so
    the map side reduces the mart to those before anything is multiplied.
    """
    buckets = signal_buckets()
    labelled = signals.select("next_month_default", *[buckets[n].alias(n) for n in names])
    return labelled.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.sum("next_month_default").alias("defaults")
    )


def signal_summary(signals: DataFrame, p: PanelParams = DEFAULT, names: Sequence[str] = SIGNALS) -> DataFrame:
    """Sample size, outcomes and rate per signal and bucket: one scan for all signals."""
    profile = bucket_profile(signals, names)
    rows = as_rows(
        profile,
        [
            F.struct(
                F.lit(n).alias("signal_name"),
                c(f"{n}.signal_bucket").alias("signal_bucket"),
                c(f"{n}.bucket_order").alias("bucket_order"),
                c("n"),
                c("defaults"),
            )
            for n in names
        ],
    )
    return _counts(rows, ["signal_name", "signal_bucket", "bucket_order"], p)


def band_summary(signals: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Sample size, outcomes and rate per band."""
    per_band = signals.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("next_month_default").alias("defaults")
    )
    ordered = per_band.withColumn("band_order", band_order(c("risk_band")))
    return _counts(ordered, ["risk_band", "band_order"], p)


def _groups(summary: DataFrame, bands: DataFrame) -> DataFrame:
    """Signal and band rows in one layout; bands form a group of their own."""
    columns = ("sample_size", "default_count", "observed_default_rate")
    return summary.select("signal_name", c("signal_bucket").alias("bucket"), *columns).unionByName(
        bands.select(F.lit("risk_band").alias("signal_name"), c("risk_band").alias("bucket"), *columns)
    )


def rate_consistency(summary: DataFrame, bands: DataFrame, tolerance: float = 1e-15) -> DataFrame:
    """Faults per signal: size, outcome count, rate, repeated bucket, blank bucket."""
    per_bucket = _groups(summary, bands).groupBy("signal_name", "bucket").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(~(c("sample_size") > 0) | c("sample_size").isNull()).alias("bad_size"),
        count_where(
            ~c("default_count").between(0, c("sample_size")) | c("default_count").isNull()
        ).alias("bad_defaults"),
        count_where(
            ~(F.abs(c("observed_default_rate") - ratio(c("default_count"), c("sample_size"))) <= tolerance)
            | c("observed_default_rate").isNull()
        ).alias("bad_rate"),
    )
    return per_bucket.groupBy("signal_name").agg(
        F.sum("n").alias("rows"),
        F.sum("bad_size").alias("bad_size"),
        F.sum("bad_defaults").alias("bad_defaults"),
        F.sum("bad_rate").alias("bad_rate"),
        count_where(c("n") > 1).alias("duplicate_buckets"),
        count_where(F.trim("bucket") == "").alias("blank_buckets"),
    )


def population_tie_out(summary: DataFrame, bands: DataFrame, borrowers: DataFrame) -> DataFrame:
    """Per signal and for the bands: totals against the population."""
    totals = _groups(summary, bands).groupBy("signal_name").agg(
        F.sum("sample_size").alias("sample_total"), F.sum("default_count").alias("default_total")
    )
    population = borrowers.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.sum("next_month_default").alias("defaults")).alias("population")
    )
    tied = totals.withColumn("_population", population.scalar())
    return tied.select(
        "signal_name",
        "sample_total",
        "default_total",
        c("_population.rows").alias("borrower_rows"),
        c("_population.defaults").alias("borrower_defaults"),
        (
            c("sample_total").eqNullSafe(c("_population.rows"))
            & c("default_total").eqNullSafe(c("_population.defaults"))
        ).alias("ties_out"),
    )


def direction(summary: DataFrame) -> DataFrame:
    """Observed direction of the outcome rate over three named buckets per signal."""
    def rate(position: int) -> Column:
        wanted = F.lit(None).cast("string")
        for name, labels in DIRECTION_BUCKETS.items():
            wanted = F.when(c("signal_name") == name, labels[position]).otherwise(wanted)
        return F.max(F.when(c("signal_bucket") == wanted, c("observed_default_rate")))

    rates = summary.groupBy("signal_name").agg(
        rate(0).alias("rate_low"), rate(1).alias("rate_middle"), rate(2).alias("rate_high")
    )
    low, middle, high = c("rate_low"), c("rate_middle"), c("rate_high")
    return rates.withColumn(
        "direction",
        F.when(low.isNull() | middle.isNull() | high.isNull(), "missing")
        .when((low < middle) & (middle < high), "positive")
        .when((low > middle) & (middle > high), "negative")
        .when((low < high) & (high < middle), "mixed")
        .otherwise("unordered"),
    )


def association(summary: DataFrame) -> DataFrame:
    """Observed against expected direction: supported, mixed, contradicted or absent."""
    expected = F.lit(None).cast("string")
    for name, sign in EXPECTED_SIGNS.items():
        expected = F.when(c("signal_name") == name, sign).otherwise(expected)
    seen = direction(summary).withColumn("expected_sign", expected)
    return seen.withColumn(
        "association",
        F.when(c("direction") == "missing", "missing")
        .when(c("direction") == c("expected_sign"), "supported_association")
        .when(c("direction").isin("positive", "negative"), "contradicted_hypothesis")
        .otherwise("mixed_association"),
    )


def missing_signals(summary: DataFrame, names: Sequence[str] = SIGNALS) -> DataFrame:
    """Defined signals without an outcome row."""
    defined = fixed_rows(summary.sparkSession, {"signal_name": "string"}, [(n,) for n in names])
    return defined.join(summary.select("signal_name").distinct(), "signal_name", "left_anti")


def rate_text(summary: DataFrame) -> DataFrame:
    """Add the rate as percent text, half-up at two decimals, from the exact counts."""
    return summary.withColumn("rate_text", percent_text(c("default_count"), c("sample_size")))


def _control(ident: str, severity: str, observed: Column, output: str) -> Column:
    return F.struct(
        F.lit(ident).alias("control_id"),
        F.lit(severity).alias("severity"),
        F.when(observed == 0, "PASS").otherwise("FAIL").alias("status"),
        observed.cast("bigint").alias("observed"),
        F.lit(0).cast("bigint").alias("expectation"),
        F.lit(output).alias("affected_output"),
    )


def dq_summary(integrity: DataFrame, enforced: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Control rows from the integrity counts, the enforced tests and the signal review."""
    suite = enforced.agg(
        count_where((c("status") != "pass") | (c("failed_rows") != 0)).alias("failed_count"),
    )
    row = single_row(integrity, suite, reviewed)
    # Control ids, severities and names of outputs.
    return as_rows(
        row,
        [
            _control("DQ-PK-BORROWER", "Critical", c("duplicate_borrower_keys"), "core.borrower"),
            _control("DQ-PK-ACCOUNT-MONTH", "Critical", c("duplicate_panel_keys"), "core.panel"),
            _control("DQ-NULL-BORROWER-KEY", "Critical", c("null_borrower_keys"), "core.borrower"),
            _control("DQ-FK-ACCOUNT-MONTH", "Critical", c("orphan_panel_rows"), "core.panel"),
            _control("DQ-CODE-DOMAIN", "High", c("invalid_code_rows"), "core tables"),
            _control("DQ-MISSING-HISTORY", "High", c("missing_history_rows"), "core.panel"),
            _control("DQ-SQL-FAILURES", "Critical", c("failed_count"), "all marts"),
            _control("DQ-TIMING", "Critical", c("timing_violations"), "risk signals"),
            _control("DQ-LEAKAGE", "Critical", c("leakage_violations"), "risk signals"),
        ],
    )


def reconciliation_summary(totals: DataFrame, periods: int) -> DataFrame:
    """Five tie-outs from one row of counts and totals."""
    def tie(metric: str, source: Column, derived: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            source.cast("bigint").alias("source"),
            derived.cast("bigint").alias("derived"),
            (derived - source).cast("bigint").alias("difference"),
            F.when(derived == source, "PASS").otherwise("FAIL").alias("status"),
        )

    return as_rows(
        totals,
        [
            tie("source rows to raw rows", c("source_rows"), c("raw_rows")),
            tie("raw rows to borrowers", c("raw_rows"), c("borrower_rows")),
            tie("borrowers x periods to panel rows", c("borrower_rows") * periods, c("panel_rows")),
            tie("wide bills to long bills", c("wide_bill"), c("long_bill")),
            tie("wide payments to long payments", c("wide_payment"), c("long_payment")),
        ],
    )

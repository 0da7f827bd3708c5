"""Borrower and borrower-period tables built from wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import DEFAULT, SIGNALS, PanelParams
from riskpanel.functions.expressions import period_end
from riskpanel.functions.frames import require, single_row


def borrower(raw: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """One borrower per wide row; values are copied, never recoded."""
    return raw.select(
        F.lit(p.run_id).alias("pipeline_run_id"),
        F.col(p.wide_key).alias("customer_id"),
        *[F.col(wide).alias(name) for wide, name in p.attributes],
        F.col(p.wide_outcome).alias("next_month_default"),
        F.lit(p.observation_date).cast("date").alias("observation_date"),
        "source_id",
        "source_file_sha256",
        F.lit(p.definition_version).alias("definition_version"),
    )


def unpivot_periods(raw: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Three measures x periods as rows; a narrow step without a shuffle."""
    periods = [
        F.expr(
            f"named_struct('month_offset', CAST({x.offset} AS BIGINT), 'repayment_status', {x.status}, "
            f"'bill_amount_ntd', {x.bill}, 'payment_amount_ntd', {x.payment}, 'repayment_source_field', '{x.status.upper()}', "
            f"'bill_source_field', '{x.bill.upper()}', 'payment_source_field', '{x.payment.upper()}')"
        )
        for x in p.periods
    ]
    rows = raw.select(F.col(p.wide_key).alias("customer_id"), F.explode(F.array(*periods)).alias("h"))
    return rows.select(
        F.lit(p.run_id).alias("pipeline_run_id"),
        "customer_id",
        "h.month_offset",
        period_end(F.col("h.month_offset"), p.observation_date).alias("statement_month_end"),
        "h.repayment_status",
        "h.bill_amount_ntd",
        "h.payment_amount_ntd",
        "h.repayment_source_field",
        "h.bill_source_field",
        "h.payment_source_field",
        F.lit(p.definition_version).alias("definition_version"),
    )


def panel_parity(raw: DataFrame, borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """One row: row counts and whether borrower = raw and panel = periods x borrower."""

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    counts = single_row(rows(raw, "raw_rows"), rows(borrowers, "borrower_rows"), rows(panel, "panel_rows"))
    return counts.select(
        "*",
        (F.col("borrower_rows") == F.col("raw_rows")).alias("borrowers_match"),
        (F.col("panel_rows") == F.col("borrower_rows") * p.n_periods).alias("panel_matches"),
    )


def require_parity(raw: DataFrame, borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT) -> None:
    require(
        panel_parity(raw, borrowers, panel, p),
        {"borrower_rows_equal_raw_rows": "borrowers_match", "panel_rows_equal_periods": "panel_matches"},
    )


def run_filter(df: DataFrame, run_id: str) -> DataFrame:
    """Rows of one run; prunes folders when ``df`` is partitioned by run."""
    return df.where(F.col("pipeline_run_id") == run_id)


def model_extract(borrowers: DataFrame, signals: DataFrame) -> DataFrame:
    """Model input: borrower attributes, signals, outcome and run metadata."""
    ours = signals.select("pipeline_run_id", "customer_id", *SIGNALS, "risk_band")
    return borrowers.join(ours, ["pipeline_run_id", "customer_id"]).select(
        "customer_id",
        "next_month_default",
        "observation_date",
        "credit_limit_ntd",
        "sex_code",
        "education_code",
        "marriage_code",
        "age_years",
        *SIGNALS,
        "risk_band",
        "source_id",
        "source_file_sha256",
        "definition_version",
    )


def period_ends(panel: DataFrame, anchor: str) -> DataFrame:
    """Offset, expected month end and rows per stored month end."""
    return (
        panel.groupBy("month_offset", "statement_month_end")
        .agg(F.count(F.lit(1)).alias("panel_rows"))
        .withColumn("expected_month_end", period_end(F.col("month_offset"), anchor))
    )



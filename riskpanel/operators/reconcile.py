"""Exact reconciliation of wide rows against the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import AMOUNT_TOLERANCE, DEFAULT, PanelParams
from riskpanel.functions.frames import as_rows, single_row

CURRENCY = "NTD"


def _tag(offset: int) -> str:
    return str(-offset)


def wide_totals(raw: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """One row over the wide table: row count and a sum per amount column."""
    sums = [f"sum({x.bill}) AS wide_bill_{_tag(x.offset)}" for x in p.periods]
    sums += [f"sum({x.payment}) AS wide_payment_{_tag(x.offset)}" for x in p.periods]
    return raw.agg(F.count(F.lit(1)).alias("raw_rows"), *[F.expr(x) for x in sums])


def panel_totals(panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """One row over the panel: row count, totals and a sum per period and measure."""
    sums = []
    for x in p.periods:
        here = f"CASE WHEN month_offset = {x.offset} THEN"
        sums.append(f"sum({here} bill_amount_ntd END) AS long_bill_{_tag(x.offset)}")
        sums.append(f"sum({here} payment_amount_ntd END) AS long_payment_{_tag(x.offset)}")
    return panel.agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.sum("bill_amount_ntd").alias("long_bill"),
        F.sum("payment_amount_ntd").alias("long_payment"),
        *[F.expr(x) for x in sums],
    )


def _metric(ident: str, name: str, source: Column, derived: Column, details: Column) -> Column:
    return F.struct(
        F.lit(ident).alias("reconciliation_id"),
        F.lit(name).alias("metric_name"),
        source.cast("bigint").alias("source_value"),
        derived.cast("bigint").alias("derived_value"),
        F.to_json(details).alias("details"),
    )


def reconciliation_metrics(
    raw: DataFrame, borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT
) -> DataFrame:
    """Source and derived value of every reconciliation.

    Three aggregates in all, one per table; the rows are laid out from their
    merged single row.
    """
    borrower_rows = borrowers.agg(F.count(F.lit(1)).alias("borrower_rows"))
    totals = single_row(wide_totals(raw, p), borrower_rows, panel_totals(panel, p))
    c = F.col

    def wide(measure: str) -> Column:
        parts = [c(f"wide_{measure}_{_tag(x.offset)}") for x in p.periods]
        return sum(parts[1:], parts[0])

    currency = F.lit(CURRENCY).alias("currency")
    amount_details = F.struct(currency, F.lit(0).alias("tolerance"))
    rows = [
        _metric(
            "REC-001", "raw_to_core_borrower_rows", c("raw_rows"), c("borrower_rows"),
            F.struct(F.lit("customer").alias("grain")),
        ),
        _metric(
            "REC-002", "expected_to_actual_account_month_rows", c("borrower_rows") * p.n_periods, c("panel_rows"),
            F.struct(F.lit(p.n_periods).alias("months_per_borrower")),
        ),
        _metric("REC-003", "wide_to_long_bill_total_ntd", wide("bill"), c("long_bill"), amount_details),
        _metric("REC-004", "wide_to_long_payment_total_ntd", wide("payment"), c("long_payment"), amount_details),
    ]
    for measure, label in (("bill", "BILL"), ("payment", "PAYMENT")):
        for x in p.periods:
            field = x.bill if measure == "bill" else x.payment
            rows.append(
                _metric(
                    f"REC-{label}-{x.offset}",
                    f"{measure}_total_month_offset_{x.offset}",
                    c(f"wide_{measure}_{_tag(x.offset)}"),
                    c(f"long_{measure}_{_tag(x.offset)}"),
                    F.struct(
                        F.lit(x.offset).alias("month_offset"), F.lit(field.upper()).alias("source_field"), currency
                    ),
                )
            )
    return as_rows(totals, rows)


def evidence(metrics: DataFrame, run_id: str, tolerance: int = 0) -> DataFrame:
    """Difference, tolerance and pass or fail; a missing value is a fail."""
    source, derived = F.col("source_value"), F.col("derived_value")
    return metrics.select(
        F.lit(run_id).alias("pipeline_run_id"),
        "reconciliation_id",
        "metric_name",
        "source_value",
        "derived_value",
        (derived - source).alias("difference"),
        F.lit(tolerance).cast("bigint").alias("tolerance"),
        F.when(F.abs(derived - source) <= tolerance, "pass").otherwise("fail").alias("status"),
        "details",
    )


def reconciliation(raw: DataFrame, borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    return evidence(reconciliation_metrics(raw, borrowers, panel, p), p.run_id)


def row_count_metric(source: DataFrame, derived: DataFrame, ident: str, name: str, factor: int = 1) -> DataFrame:
    """One reconciliation of two row counts, source times ``factor``."""
    counts = single_row(
        source.agg(F.count(F.lit(1)).alias("source_rows")), derived.agg(F.count(F.lit(1)).alias("derived_rows"))
    )
    details = F.struct(F.lit(factor).alias("factor"))
    return as_rows(
        counts, [_metric(ident, name, F.col("source_rows") * factor, F.col("derived_rows"), details)]
    )


def amount_metric(raw: DataFrame, panel: DataFrame, measure: str, p: PanelParams = DEFAULT) -> DataFrame:
    """One reconciliation of a measure's total, wide against long."""
    fields = [x.bill if measure == "bill" else x.payment for x in p.periods]
    wide = sum([F.col(f) for f in fields[1:]], F.col(fields[0]))
    column = "bill_amount_ntd" if measure == "bill" else "payment_amount_ntd"
    totals = single_row(raw.agg(F.sum(wide).alias("wide")), panel.agg(F.sum(column).alias("long")))
    ident = "REC-003" if measure == "bill" else "REC-004"
    details = F.struct(F.lit(CURRENCY).alias("currency"), F.lit(0).alias("tolerance"))
    return as_rows(
        totals, [_metric(ident, f"wide_to_long_{measure}_total_ntd", F.col("wide"), F.col("long"), details)]
    )


def period_metrics(raw: DataFrame, panel: DataFrame, measure: str, p: PanelParams = DEFAULT) -> DataFrame:
    """One reconciliation per period of a measure: one aggregate per table."""
    totals = single_row(wide_totals(raw, p), panel_totals(panel, p))
    rows = []
    for x in p.periods:
        field = x.bill if measure == "bill" else x.payment
        details = F.struct(
            F.lit(x.offset).alias("month_offset"),
            F.lit(field.upper()).alias("source_field"),
            F.lit(CURRENCY).alias("currency"),
        )
        rows.append(
            _metric(
                f"REC-{measure.upper()}-{x.offset}",
                f"{measure}_total_month_offset_{x.offset}",
                F.col(f"wide_{measure}_{_tag(x.offset)}"),
                F.col(f"long_{measure}_{_tag(x.offset)}"),
                details,
            )
        )
    return as_rows(totals, rows)


def amount_tolerance(
    df: DataFrame,
    source: str = "source_value",
    derived: str = "derived_value",
    reported: str = "difference",
    tolerance: float = AMOUNT_TOLERANCE,
) -> DataFrame:
    """Add ``amount_status``: the reported difference must be the recomputed
    one, and that one must lie within the tolerance."""
    recomputed = F.col(derived) - F.col(source)
    return df.withColumn(
        "amount_status",
        F.when(recomputed.isNull() | F.col(reported).isNull(), "missing")
        .when(recomputed != F.col(reported), "difference_altered")
        .when(F.abs(recomputed) > tolerance, "outside_tolerance")
        .otherwise("pass"),
    )

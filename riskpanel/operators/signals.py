"""Behavioural signals, points and bands.

A borrower's history is first brought to one row with a column per period and
measure. From a panel that takes one aggregate on the key, made only of
max/count, so it combines on the map side and never collects a key's rows. From
a wide row the columns are already there and nothing is shuffled. All signals
are then expressions over that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import DEFAULT, PanelParams
from riskpanel.functions import expressions as X
from riskpanel.functions.frames import count_where

KEYS = ("pipeline_run_id", "customer_id")
ATTRIBUTES = ("observation_date", "next_month_default", "credit_limit_ntd")


def _name(measure: str, offset: int) -> str:
    return f"_{measure}_{-offset}"


def history_from_panel(panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """One row per key: severity, bill and payment per period.

    A period without a row stays NULL; a row with a NULL status has severity 0.
    (run, customer, offset) is the panel's key, so each max reads one value.
    """
    measures = []
    for o in p.offsets:
        here = f"CASE WHEN month_offset = {o} THEN"
        measures += [
            f"max({here} greatest(repayment_status, 0) END) AS {_name('severity', o)}",
            f"max({here} bill_amount_ntd END) AS {_name('bill', o)}",
            f"max({here} payment_amount_ntd END) AS {_name('payment', o)}",
        ]
    return panel.groupBy(*KEYS).agg(*[F.expr(m) for m in measures])


def history_from_wide(raw: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """The same row straight from the wide columns, with the attributes; no shuffle."""
    limit = next(wide for wide, name in p.attributes if name == "credit_limit_ntd")
    measures = []
    for x in p.periods:
        measures += [
            f"greatest({x.status}, 0) AS {_name('severity', x.offset)}",
            f"{x.bill} AS {_name('bill', x.offset)}",
            f"{x.payment} AS {_name('payment', x.offset)}",
        ]
    return raw.select(
        F.lit(p.run_id).alias("pipeline_run_id"),
        F.col(p.wide_key).alias("customer_id"),
        F.lit(p.observation_date).cast("date").alias("observation_date"),
        F.col(p.wide_outcome).alias("next_month_default"),
        F.col(limit).alias("credit_limit_ntd"),
        *[F.expr(m) for m in measures],
    )


def history(borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Panel history with borrower attributes.

    The panel is reduced to one row per key before it meets the borrowers, and
    both sides are then partitioned by the same key.
    """
    return borrowers.select(*KEYS, *ATTRIBUTES).join(history_from_panel(panel, p), list(KEYS))


def _over(measure: str, p: PanelParams, low: int | None = None, high: int | None = None) -> list[Column]:
    return [
        F.col(_name(measure, o)) for o in p.offsets if (low is None or o >= low) and (high is None or o <= high)
    ]


def recent_max(p: PanelParams) -> Column:
    return F.greatest(*_over("severity", p, *p.recent)).cast("bigint")


def earlier_max(p: PanelParams) -> Column:
    return F.greatest(*_over("severity", p, *p.earlier)).cast("bigint")


def signal_expressions(p: PanelParams = DEFAULT) -> dict[str, Column]:
    """Each signal over the one-row history."""
    bill = {o: F.col(_name("bill", o)) for o in p.offsets}
    paid_now = F.col(_name("payment", 0))
    return {
        "recent_max_delinquency": recent_max(p),
        "delinquent_months_6m": X.true_count([s > 0 for s in _over("severity", p)]),
        "delinquency_deterioration": recent_max(p) - earlier_max(p),
        "latest_utilization_ratio": X.utilization(bill[0], F.col("credit_limit_ntd")),
        "payment_coverage_ratio": X.coverage_of_positive_bill(paid_now, bill[-1]),
        "zero_payment_streak": X.longest_run([q == 0 for q in _over("payment", p)]),
        "recent_bill_growth": X.bill_growth(bill[0], bill[-3]),
    }


def signal_inputs(p: PanelParams = DEFAULT) -> dict[str, tuple[tuple[str, ...], tuple[int, ...]]]:
    """Columns and month offsets that each signal reads."""
    status, bill, paid = "repayment_status", "bill_amount_ntd", "payment_amount_ntd"

    def months(low: int, high: int) -> tuple[int, ...]:
        return tuple(o for o in p.offsets if low <= o <= high)

    return {
        "recent_max_delinquency": ((status,), months(*p.recent)),
        "delinquent_months_6m": ((status,), p.offsets),
        "delinquency_deterioration": ((status,), (*months(*p.recent), *months(*p.earlier))),
        "latest_utilization_ratio": ((bill, "credit_limit_ntd"), (0,)),
        "payment_coverage_ratio": ((paid, bill), (0, -1)),
        "zero_payment_streak": ((paid,), p.offsets),
        "recent_bill_growth": ((bill,), (0, -3)),
    }


def signals_of(hist: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Signal mart: one row per borrower with signals, points and band."""
    values = hist.select(
        *KEYS,
        "observation_date",
        "next_month_default",
        *[e.alias(name) for name, e in signal_expressions(p).items()],
    )
    scored = values.withColumn("risk_points", X.risk_points())
    return scored.select(
        "*",
        X.risk_band(F.col("risk_points")).alias("risk_band"),
        F.lit(p.definition_version).alias("definition_version"),
    )


def signal_table(borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Signals of a stored panel: one aggregate on the key and one join on it."""
    return signals_of(history(borrowers, panel, p), p)


def signal_table_wide(raw: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Signals straight from wide rows, without any shuffle of their own."""
    return signals_of(history_from_wide(raw, p), p)


def signal(borrowers: DataFrame, panel: DataFrame, name: str, p: PanelParams = DEFAULT) -> DataFrame:
    """One signal; the aggregates other signals need are pruned away."""
    return history(borrowers, panel, p).select("customer_id", signal_expressions(p)[name].alias(name))


def zero_streaks(panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Longest zero-payment run per key, only for keys that have one."""
    streak = X.longest_run([q == 0 for q in _over("payment", p)])
    return (
        history_from_panel(panel.where("payment_amount_ntd = 0"), p)
        .select(*KEYS, streak.alias("zero_payment_streak"))
    )


def join_streak(borrowers: DataFrame, streaks: DataFrame) -> DataFrame:
    """Every borrower with its streak; no streak is 0."""
    joined = borrowers.select(*KEYS).join(streaks, list(KEYS), "left")
    return joined.select(*KEYS, F.coalesce("zero_payment_streak", F.lit(0)).cast("bigint").alias("zero_payment_streak"))


def signal_domain_checks(signals: DataFrame) -> DataFrame:
    """One row: how many mart rows break each domain rule. A NULL breaks none."""
    c = F.col
    return signals.agg(
        F.count(F.lit(1)).alias("tested_rows"),
        count_where(~c("next_month_default").isin(0, 1)).alias("outcome_domain"),
        count_where(~c("delinquent_months_6m").between(0, 6)).alias("delinquent_months_domain"),
        count_where(~c("zero_payment_streak").between(0, 6)).alias("streak_domain"),
        count_where(~c("risk_points").between(0, 10)).alias("points_domain"),
        count_where(~c("risk_band").isin("Low", "Medium", "High")).alias("band_domain"),
    )



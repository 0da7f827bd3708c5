"""Column expressions of the risk definitions; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskpanel.functions.frames import ratio


def period_end(offset: Column, anchor: str) -> Column:
    """Month end that lies ``offset`` months from the anchor month."""
    return F.last_day(F.add_months(F.lit(anchor).cast("date"), offset.cast("int")))


def longest_run(flags: Sequence[Column]) -> Column:
    """Longest run of true flags, in the order given; NULL breaks a run."""
    run: Column = F.lit(0)
    runs = []
    for flag in flags:
        run = F.when(flag, run + F.lit(1)).otherwise(F.lit(0))
        runs.append(run)
    return F.greatest(F.lit(0), *runs).cast("bigint")


def true_count(flags: Sequence[Column]) -> Column:
    """How many flags are true."""
    total: Column = F.lit(0)
    for flag in flags:
        total = total + F.when(flag, F.lit(1)).otherwise(F.lit(0))
    return total.cast("bigint")


def utilization(bill: Column, limit: Column) -> Column:
    return ratio(bill, limit)


def coverage_of_positive_bill(payment: Column, prior_bill: Column) -> Column:
    """Signal definition: NULL unless the prior bill is above zero."""
    return F.when(prior_bill > 0, ratio(payment, prior_bill))


def coverage_of_nonzero_bill(payment: Column, prior_bill: Column) -> Column:
    """Behaviour-rule definition: only a zero prior bill gives NULL."""
    return ratio(payment, prior_bill)


def bill_growth(latest: Column, base: Column) -> Column:
    return F.when(base != 0, ratio(latest - base, F.abs(base)))


def step(value: Column, two_at: float, one_at: float) -> Column:
    """2, 1 or 0 points; a NULL value scores 0."""
    return F.when(value >= two_at, 2).when(value >= one_at, 1).otherwise(0)


def one_if(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def risk_points() -> Column:
    """Additive score 0..10 over the seven signals."""
    coverage = F.col("payment_coverage_ratio")
    return (
        F.when(F.col("recent_max_delinquency") >= 2, 2)
        .when(F.col("recent_max_delinquency") == 1, 1)
        .otherwise(0)
        + step(F.col("delinquent_months_6m"), 2, 1)
        + one_if(F.col("delinquency_deterioration") >= 2)
        + one_if(F.col("latest_utilization_ratio") >= 1)
        + one_if((coverage >= 0) & (coverage < 0.10))
        + one_if(F.col("zero_payment_streak") >= 2)
        + one_if(F.col("recent_bill_growth") >= 0.25)
    ).cast("bigint")


def risk_band(points: Column) -> Column:
    return F.when(points <= 1, "Low").when(points <= 3, "Medium").otherwise("High")


def band_order(band: Column) -> Column:
    return F.when(band == "Low", 1).when(band == "Medium", 2).otherwise(3).cast("bigint")


def _bucket(arms: Sequence[tuple[Column, str]], other: str) -> Column:
    """Struct (label, order) of the first arm that holds; order counts from 1."""
    labels, orders = F, F
    for position, (condition, label) in enumerate(arms, start=1):
        labels = labels.when(condition, label)
        orders = orders.when(condition, position)
    return F.struct(
        labels.otherwise(other).alias("signal_bucket"),
        orders.otherwise(len(arms) + 1).cast("bigint").alias("bucket_order"),
    )


def signal_buckets() -> dict[str, Column]:
    """Bucket struct per signal.

    A NULL utilisation falls into the last bucket, while coverage and growth
    have a bucket of their own for NULL.
    """
    c = F.col
    return {
        "recent_max_delinquency": _bucket(
            [(c("recent_max_delinquency") == 0, "0"), (c("recent_max_delinquency") == 1, "1")], "2+"
        ),
        "delinquent_months_6m": _bucket(
            [(c("delinquent_months_6m") == 0, "0"), (c("delinquent_months_6m") == 1, "1")], "2+"
        ),
        "delinquency_deterioration": _bucket(
            [(c("delinquency_deterioration") <= 0, "<=0"), (c("delinquency_deterioration") == 1, "1")], "2+"
        ),
        "latest_utilization_ratio": _bucket(
            [(c("latest_utilization_ratio") < 0.80, "<0.80"), (c("latest_utilization_ratio") < 1, "0.80-<1.00")],
            ">=1.00",
        ),
        "payment_coverage_ratio": _bucket(
            [
                (c("payment_coverage_ratio").isNull(), "not_applicable"),
                (c("payment_coverage_ratio") < 0.10, "<0.10"),
                (c("payment_coverage_ratio") < 0.50, "0.10-<0.50"),
            ],
            ">=0.50",
        ),
        "zero_payment_streak": _bucket(
            [(c("zero_payment_streak") == 0, "0"), (c("zero_payment_streak") == 1, "1")], "2+"
        ),
        "recent_bill_growth": _bucket(
            [
                (c("recent_bill_growth").isNull(), "not_applicable"),
                (c("recent_bill_growth") <= 0, "<=0"),
                (c("recent_bill_growth") < 0.25, "0-<0.25"),
            ],
            ">=0.25",
        ),
    }


def age_band(age: Column) -> Column:
    return (
        F.when(age < 30, "<30").when(age < 40, "30-39").when(age < 50, "40-49").when(age < 60, "50-59").otherwise("60+")
    )


def percent_text(part: Column, whole: Column) -> Column:
    """``part / whole`` as percent text, half-up at two decimals, by integer arithmetic."""
    scaled = part.cast("decimal(38,0)") * F.lit(20000) + whole
    points = F.floor(scaled / (whole.cast("decimal(38,0)") * 2)).cast("bigint")
    return F.concat(
        F.floor(points / 100).cast("string"), F.lit("."), F.lpad(F.pmod(points, F.lit(100)).cast("string"), 2, "0"), F.lit("%")
    )


def clipped(probability: Column, epsilon: float) -> Column:
    return F.least(F.greatest(probability, F.lit(epsilon)), F.lit(1 - epsilon))


def logit(probability: Column, epsilon: float) -> Column:
    p = clipped(probability, epsilon)
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))

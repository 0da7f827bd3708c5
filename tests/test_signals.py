"""Signals, points, bands and behaviour on hand-made histories."""

import pytest
from pyspark.sql import functions as F

from riskpanel.definitions import WIDE_PERIODS
from riskpanel.functions import expressions as X
from riskpanel.operators import outcomes, panel, quality, signals


def wide(spark, rows):
    """Rows of (id, limit, statuses, bills, payments), newest period first."""
    data = [
        (i, limit, 1, 2, 1, 30, *status, *bill, *paid, i % 2, "s", "a" * 64)
        for i, limit, status, bill, paid in rows
    ]
    names = (
        ["id", "limit_bal", "sex", "education", "marriage", "age"] + [p.status for p in WIDE_PERIODS]
        + [p.bill for p in WIDE_PERIODS] + [p.payment for p in WIDE_PERIODS] + ["default_payment_next_month"]
    )
    schema = ", ".join(f"{n} bigint" for n in names) + ", source_id string, source_file_sha256 string"
    return spark.createDataFrame(data, schema)


HISTORIES = [
    (1, 100, (0, 0, 0, 0, 0, 0), (80, 50, 0, 40, 0, 0), (5, 1, 1, 1, 1, 1)),
    (2, 100, (2, 0, -1, 0, 0, 1), (100, 100, 0, 50, 0, 0), (0, 0, 1, 0, 0, 0)),
    (3, 0, (1, 1, 1, 1, 1, 1), (10, -10, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)),
    (4, 100, (-2, -2, -2, 3, 0, 0), (79, 0, 0, -10, 0, 0), (7, 7, 7, 7, 7, 7)),
]


@pytest.fixture(scope="module")
def raw(spark):
    return wide(spark, HISTORIES)


def test_signals_by_hand(raw):
    got = {r.customer_id: r for r in signals.signal_table(panel.borrower(raw), panel.unpivot_periods(raw)).collect()}
    one, two, three, four = got[1], got[2], got[3], got[4]
    assert (one.recent_max_delinquency, one.delinquent_months_6m, one.delinquency_deterioration) == (0, 0, 0)
    assert (one.latest_utilization_ratio, one.payment_coverage_ratio, one.recent_bill_growth) == (0.8, 0.1, 1.0)
    assert (one.zero_payment_streak, one.risk_points, one.risk_band) == (0, 1, "Low")
    assert (two.recent_max_delinquency, two.delinquent_months_6m, two.delinquency_deterioration) == (2, 2, 1)
    assert two.zero_payment_streak == 3
    # 2 severity, 2 months, 1 utilisation, 1 coverage of 0, 1 streak, 1 growth
    assert (two.risk_points, two.risk_band) == (8, "High")
    assert three.latest_utilization_ratio is None and three.payment_coverage_ratio is None
    assert three.recent_bill_growth is None and three.zero_payment_streak == 6
    assert three.risk_points == 1 + 2 + 1
    assert (four.delinquency_deterioration, four.recent_max_delinquency) == (-3, 0)
    assert four.recent_bill_growth == 8.9 and four.payment_coverage_ratio is None


def test_wide_and_long_paths_agree(raw, workspace):
    for table in (raw, workspace.raw):
        long = signals.signal_table(panel.borrower(table), panel.unpivot_periods(table))
        short = signals.signal_table_wide(table)
        assert long.columns == short.columns
        assert long.exceptAll(short).count() == 0 and short.exceptAll(long).count() == 0


@pytest.mark.parametrize(
    "flags, longest",
    [((1, 1, 0, 1, 0, 0), 2), ((1,) * 6, 6), ((0,) * 6, 0), ((0, 1, 1, 1, 0, 1), 3), ((1, None, 1, 1, None, 0), 2)],
)
def test_longest_run(spark, flags, longest):
    columns = [F.lit(None if f is None else bool(f)).cast("boolean") for f in flags]
    assert spark.range(1).select(X.longest_run(columns).alias("n")).first().n == longest


def test_missing_periods_stay_unknown(spark, raw):
    cells = panel.unpivot_periods(raw).where("month_offset >= -2 OR customer_id <> 2")
    row = signals.signal_table(panel.borrower(raw), cells).where("customer_id = 2").first()
    assert row.delinquency_deterioration is None and row.recent_max_delinquency == 2
    assert row.delinquent_months_6m == 1 and row.zero_payment_streak == 2
    gone = panel.unpivot_periods(raw).where("customer_id <> 4")
    assert signals.signal_table(panel.borrower(raw), gone).count() == 3


def test_two_definitions_of_coverage(raw):
    rules = {r.customer_id: r.payment_coverage for r in quality.customer_behaviour(
        panel.borrower(raw), panel.unpivot_periods(raw)).collect()}
    assert rules[3] == 0.0 and rules[4] is None  # a negative bill counts for the rule, a zero bill does not
    sample = {r.customer_id: r.payment_coverage_ratio for r in signals.signal_table_wide(raw).collect()}
    assert sample[3] is None and sample[4] is None


def test_null_ratios_in_buckets(raw):
    rows = outcomes.signal_summary(signals.signal_table_wide(raw).where("customer_id = 3")).collect()
    got = {r.signal_name: r.signal_bucket for r in rows}
    assert got["latest_utilization_ratio"] == ">=1.00"
    assert got["payment_coverage_ratio"] == "not_applicable" and got["recent_bill_growth"] == "not_applicable"


def test_summary_totals_tie_to_the_population(workspace):
    rows = outcomes.population_tie_out(workspace.summary, workspace.bands, workspace.borrowers).collect()
    assert len(rows) == 8 and all(r.ties_out for r in rows)
    faults = outcomes.rate_consistency(workspace.damaged_summary, workspace.bands).collect()
    hit = {r.signal_name for r in faults if r.bad_rate or r.bad_defaults or r.duplicate_buckets}
    assert hit == {"zero_payment_streak", "latest_utilization_ratio", "delinquent_months_6m"}
    assert [r.signal_name for r in outcomes.missing_signals(workspace.damaged_summary).collect()] == ["recent_bill_growth"]


@pytest.mark.parametrize(
    "rates, expected",
    [((0.1, 0.2, 0.3), "positive"), ((0.3, 0.2, 0.1), "negative"), ((0.1, 0.3, 0.2), "mixed"),
     ((0.2, 0.1, 0.3), "unordered"), ((0.1, 0.1, 0.3), "unordered"), ((0.1, None, 0.3), "missing")],
)
def test_direction(spark, rates, expected):
    rows = [("zero_payment_streak", b, r) for b, r in zip(("0", "1", "2+"), rates) if r is not None]
    summary = spark.createDataFrame(rows, "signal_name string, signal_bucket string, observed_default_rate double")
    assert outcomes.direction(summary).first().direction == expected
    wanted = {"positive": "supported_association", "negative": "contradicted_hypothesis", "missing": "missing"}
    assert outcomes.association(summary).first().association == wanted.get(expected, "mixed_association")


@pytest.mark.parametrize("part, whole, text", [(1748, 14952, "11.69%"), (1339, 8138, "16.45%"), (3549, 6910, "51.36%"),
                                               (1, 8, "12.50%"), (5, 100000, "0.01%"), (0, 3, "0.00%"), (3, 3, "100.00%")])
def test_percent_text_is_half_up(spark, part, whole, text):
    df = spark.createDataFrame([(part, whole)], "default_count bigint, sample_size bigint")
    assert outcomes.rate_text(df).first().rate_text == text


def test_period_ends_follow_the_calendar(spark):
    df = spark.createDataFrame([(o,) for o in range(0, -6, -1)], "o int")
    ends = [str(r.d) for r in df.select(X.period_end(F.col("o"), "2005-09-30").alias("d")).collect()]
    assert ends == ["2005-09-30", "2005-08-31", "2005-07-31", "2005-06-30", "2005-05-31", "2005-04-30"]

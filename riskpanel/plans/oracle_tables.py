"""SQL of the same run tables, written plainly: one named block per table.

Blocks are combined with :func:`build`, which puts the needed blocks in order
in front of a final SELECT. The SQL uses scalar subqueries, unions and ranks
over whole tables on purpose: it shares no shape with the Spark plans.
"""

from __future__ import annotations

import re

from riskpanel.definitions import SIGNALS, WIDE_PERIODS

SOURCE = "orders_by_customer"
FIELDS = (
    ["limit_bal", "sex", "education", "marriage", "age"]
    + [p.status for p in WIDE_PERIODS] + [p.bill for p in WIDE_PERIODS] + [p.payment for p in WIDE_PERIODS]
    + ["default_payment_next_month", "source_id", "source_file_sha256", "source_row_number"]
)
BLOCKS: dict[str, str] = {}


def _hist(offset: int) -> str:
    return f"year(o_orderdate) - 2000 = {offset}"


BLOCKS["history"] = "SELECT o_custkey, " + ", ".join(
    f"count(*) FILTER (WHERE {_hist(p.offset)} AND o_orderstatus = 'P') AS {p.status}, "
    f"CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE {_hist(p.offset)}) AS BIGINT) AS {p.bill}, "
    f"CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE {_hist(p.offset)} AND o_orderstatus = 'F') AS BIGINT) AS {p.payment}"
    for p in WIDE_PERIODS
) + f", count(*) FILTER (WHERE {_hist(1)} AND o_orderstatus = 'P') AS outcome FROM orders GROUP BY o_custkey"

BLOCKS["raw"] = (
    "SELECT c_custkey + 1 AS id, CAST(floor(abs(c_acctbal) * 100) AS BIGINT) + 10000 AS limit_bal, "
    "c_custkey % 2 + 1 AS sex, CAST(c_nationkey % 7 AS BIGINT) AS education, "
    "CAST(c_nationkey % 4 AS BIGINT) AS marriage, c_custkey % 60 + 21 AS age, "
    + ", ".join(f"coalesce({p.status}, 0) - 1 AS {p.status}" for p in WIDE_PERIODS) + ", "
    + ", ".join(f"coalesce({p.bill}, 0) AS {p.bill}" for p in WIDE_PERIODS) + ", "
    + ", ".join(f"coalesce({p.payment}, 0) AS {p.payment}" for p in WIDE_PERIODS)
    + ", CAST(CASE WHEN outcome > 0 THEN 1 ELSE 0 END AS BIGINT) AS default_payment_next_month, "
    f"'{SOURCE}' AS source_id, sha256('{SOURCE}') AS source_file_sha256, c_custkey + 3 AS source_row_number "
    "FROM customer LEFT JOIN history ON o_custkey = c_custkey"
)


def borrower_sql(raw: str) -> str:
    return (
        "SELECT 'RUN-001' AS pipeline_run_id, id AS customer_id, limit_bal AS credit_limit_ntd, sex AS sex_code, "
        "education AS education_code, marriage AS marriage_code, age AS age_years, "
        "default_payment_next_month AS next_month_default, DATE '2005-09-30' AS observation_date, source_id, "
        f"source_file_sha256, '0.1.0' AS definition_version FROM {raw}"
    )


BLOCKS["borrower"] = borrower_sql("raw")
# Month ends of the six periods.
MONTH_ENDS = {0: "2005-09-30", -1: "2005-08-31", -2: "2005-07-31", -3: "2005-06-30", -4: "2005-05-31", -5: "2005-04-30"}
BLOCKS["panel"] = " UNION ALL ".join(
    f"SELECT 'RUN-001' AS pipeline_run_id, id AS customer_id, CAST({p.offset} AS BIGINT) AS month_offset, "
    f"DATE '{MONTH_ENDS[p.offset]}' AS statement_month_end, {p.status} AS repayment_status, {p.bill} AS bill_amount_ntd, "
    f"{p.payment} AS payment_amount_ntd, '{p.status.upper()}' AS repayment_source_field, "
    f"'{p.bill.upper()}' AS bill_source_field, '{p.payment.upper()}' AS payment_source_field, "
    "'0.1.0' AS definition_version FROM raw"
    for p in WIDE_PERIODS
)
BLOCKS["registry"] = (
    f"SELECT '{SOURCE}' AS source_id, sha256('{SOURCE}') AS file_sha256, count(*) FILTER (WHERE c_acctbal >= 0) AS data_row_count, "
    "CAST(25 AS BIGINT) AS column_count, TIMESTAMP '2005-10-01' AS registered_at FROM customer "
    f"UNION ALL SELECT '{SOURCE}', sha256('{SOURCE}'), count(*), CAST(25 AS BIGINT), TIMESTAMP '2005-10-02' FROM customer"
)

# --- damaged core ---------------------------------------------------------------
BLOCKS["raw_d"] = "SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE age = 30"
BLOCKS["borrower_d"] = (
    "SELECT * REPLACE (CASE WHEN marriage_code = 3 AND sex_code = 2 THEN 0 ELSE credit_limit_ntd END AS credit_limit_ntd, "
    "CASE WHEN age_years = 21 THEN 17 ELSE age_years END AS age_years, "
    "CASE WHEN education_code = 5 THEN 3 ELSE sex_code END AS sex_code, "
    "CASE WHEN education_code = 4 AND sex_code = 1 THEN 2 ELSE next_month_default END AS next_month_default) "
    "FROM borrower WHERE education_code <> 6"
)
BLOCKS["panel_d"] = (
    "SELECT * REPLACE (CASE WHEN month_offset = -5 AND bill_amount_ntd = 0 THEN CAST(statement_month_end + 1 AS DATE) "
    "ELSE statement_month_end END AS statement_month_end, "
    "CASE WHEN repayment_status = 2 THEN NULL ELSE payment_amount_ntd END AS payment_amount_ntd) "
    "FROM panel WHERE NOT (repayment_status = 0 AND month_offset = -3)"
)


def reconciliation_sql(raw: str, borrower: str, panel: str) -> str:
    wide = lambda x: " + ".join(getattr(p, x) for p in WIDE_PERIODS)
    rows = [
        f"SELECT 'REC-001' AS reconciliation_id, 'raw_to_core_borrower_rows' AS metric_name, (SELECT count(*) FROM {raw}) AS source_value, "
        f"(SELECT count(*) FROM {borrower}) AS derived_value, CAST(json_object('grain', 'customer') AS VARCHAR) AS details",
        f"SELECT 'REC-002', 'expected_to_actual_account_month_rows', (SELECT count(*) * 6 FROM {borrower}), "
        f"(SELECT count(*) FROM {panel}), CAST(json_object('months_per_borrower', 6) AS VARCHAR)",
        f"SELECT 'REC-003', 'wide_to_long_bill_total_ntd', (SELECT sum({wide('bill')}) FROM {raw}), "
        f"(SELECT sum(bill_amount_ntd) FROM {panel}), CAST(json_object('currency', 'NTD', 'tolerance', 0) AS VARCHAR)",
        f"SELECT 'REC-004', 'wide_to_long_payment_total_ntd', (SELECT sum({wide('payment')}) FROM {raw}), "
        f"(SELECT sum(payment_amount_ntd) FROM {panel}), CAST(json_object('currency', 'NTD', 'tolerance', 0) AS VARCHAR)",
    ]
    for measure in ("bill", "payment"):
        for p in WIDE_PERIODS:
            field = getattr(p, measure)
            rows.append(
                f"SELECT 'REC-{measure.upper()}-{p.offset}', '{measure}_total_month_offset_{p.offset}', "
                f"(SELECT sum({field}) FROM {raw}), (SELECT sum({measure}_amount_ntd) FROM {panel} WHERE month_offset = {p.offset}), "
                f"CAST(json_object('month_offset', {p.offset}, 'source_field', '{field.upper()}', 'currency', 'NTD') AS VARCHAR)"
            )
    return (
        "SELECT 'RUN-001' AS pipeline_run_id, reconciliation_id, metric_name, CAST(source_value AS BIGINT) AS source_value, "
        "CAST(derived_value AS BIGINT) AS derived_value, CAST(derived_value - source_value AS BIGINT) AS difference, "
        "CAST(0 AS BIGINT) AS tolerance, CASE WHEN derived_value = source_value THEN 'pass' ELSE 'fail' END AS status, details "
        "FROM (" + " UNION ALL ".join(rows) + ") m"
    )


BLOCKS["rec"] = reconciliation_sql("raw", "borrower", "panel")
BLOCKS["rec_d"] = reconciliation_sql("raw_d", "borrower_d", "panel_d")


def tests_sql(raw: str, borrower: str, panel: str, rec: str) -> str:
    b = lambda where: f"(SELECT count(*) FROM {borrower} WHERE {where})"
    a = lambda where: f"(SELECT count(*) FROM {panel} WHERE {where})"
    every_b, every_a, every_r = b("true"), a("true"), f"(SELECT count(*) FROM {raw})"
    month_end = " ".join(f"WHEN {k} THEN DATE '{v}'" for k, v in MONTH_ENDS.items())
    rec_status = lambda i: f"CASE WHEN (SELECT status FROM {rec} WHERE reconciliation_id = '{i}') = 'pass' THEN 0 ELSE 1 END"
    attributes = ("credit_limit_ntd", "sex_code", "education_code", "marriage_code", "age_years")
    raws = ("limit_bal", "sex", "education", "marriage", "age")
    differs = " OR ".join(f"r.{x} IS DISTINCT FROM b.{y}" for x, y in zip(raws, attributes))
    pair = f"FROM {raw} r JOIN {borrower} b ON b.customer_id = r.id"
    rows = [
        ("DQ-001", "raw customer ID uniqueness", "critical", every_r,
         f"(SELECT count(*) FROM (SELECT id FROM {raw} GROUP BY id HAVING count(*) > 1) x)", "raw.wide"),
        ("DQ-002", "raw rows equal registered source rows", "critical", "1",
         f"CASE WHEN {every_r} = (SELECT data_row_count FROM registry ORDER BY registered_at DESC LIMIT 1) THEN 0 ELSE 1 END",
         "audit.source -> raw.wide"),
        ("DQ-003", "each borrower has six account months", "critical", every_b,
         f"(SELECT count(*) FROM (SELECT customer_id FROM {panel} GROUP BY customer_id HAVING count(*) <> 6) x)", "core.panel"),
        ("DQ-004", "account-month rows equal borrower rows times six", "critical", "1",
         f"CASE WHEN {every_a} = 6 * {every_b} THEN 0 ELSE 1 END", "core.borrower -> core.panel"),
        ("DQ-005", "wide and long bill totals reconcile", "critical", "1", rec_status("REC-003"), "audit.reconciliation.REC-003"),
        ("DQ-006", "wide and long payment totals reconcile", "critical", "1", rec_status("REC-004"), "audit.reconciliation.REC-004"),
        ("DQ-007", "outcome is binary", "critical", every_b, b("next_month_default NOT IN (0, 1)"), "core.borrower.next_month_default"),
        ("DQ-008", "credit limit is positive", "high", every_b, b("credit_limit_ntd <= 0"), "core.borrower.credit_limit_ntd"),
        ("DQ-009", "age is within plausible reviewed bounds 18-120", "high", every_b, b("age_years NOT BETWEEN 18 AND 120"), "core.borrower.age_years"),
        ("DQ-010", "required history fields are populated", "critical", every_a,
         a("repayment_status IS NULL OR bill_amount_ntd IS NULL OR payment_amount_ntd IS NULL"), "core.panel"),
        ("DQ-011", "account months have a borrower parent", "critical", every_a,
         f"(SELECT count(*) FROM {panel} a LEFT JOIN {borrower} b ON b.customer_id = a.customer_id WHERE b.customer_id IS NULL)",
         "core.panel -> core.borrower"),
        ("DQ-012", "month offsets map to approved month ends", "critical", every_a,
         a(f"statement_month_end <> CASE month_offset {month_end} END"), "core.panel.statement_month_end"),
        ("DQ-013", "sex uses documented codes 1-2", "high", every_b, b("sex_code NOT IN (1, 2)"), "core.borrower.sex_code"),
        ("DQ-014", "raw and core borrower attributes match exactly", "critical", every_r,
         f"(SELECT count(*) {pair} WHERE {differs})", "raw.wide -> core.borrower"),
        ("DQ-015", "raw and core outcomes match exactly", "critical", every_r,
         f"(SELECT count(*) {pair} WHERE r.default_payment_next_month IS DISTINCT FROM b.next_month_default)",
         "raw.wide -> core.borrower.next_month_default"),
        ("DQ-016", "education code is documented", "medium", every_b, b("education_code NOT IN (1, 2, 3, 4)"), "core.borrower.education_code"),
        ("DQ-017", "marriage code is documented", "medium", every_b, b("marriage_code NOT IN (1, 2, 3)"), "core.borrower.marriage_code"),
        ("DQ-018", "repayment code is documented", "medium", every_a,
         a("repayment_status NOT IN (-1, 1, 2, 3, 4, 5, 6, 7, 8, 9)"), "core.panel.repayment_status"),
    ]
    union = " UNION ALL ".join(
        f"SELECT '{i}' AS test_id, '{n}' AS test_name, '{s}' AS severity, CAST({t} AS BIGINT) AS tested_rows, "
        f"CAST({f} AS BIGINT) AS failed_rows, '{o}' AS affected_object"
        for i, n, s, t, f, o in rows
    )
    return (
        "SELECT 'RUN-001' AS pipeline_run_id, test_id, test_name, 'data_quality' AS test_type, "
        "CASE WHEN failed_rows = 0 THEN 'pass' WHEN severity IN ('medium', 'low') THEN 'warn' ELSE 'fail' END AS status, "
        "severity, tested_rows, failed_rows, CASE WHEN tested_rows = 0 THEN 0.0::DOUBLE "
        f"ELSE failed_rows::DOUBLE / tested_rows::DOUBLE END AS failure_rate, affected_object FROM ({union}) c"
    )


BLOCKS["tests"] = tests_sql("raw", "borrower", "panel", "rec")
BLOCKS["tests_d"] = tests_sql("raw_d", "borrower_d", "panel_d", "rec_d")


# --- behaviour, signals: one row of lists per borrower, latest month first ----------
def history_sql(panel: str) -> str:
    def months(field: str) -> str:
        return "[" + ", ".join(f"max({field}) FILTER (WHERE month_offset = {-k})" for k in range(6)) + "]"

    return (
        f"SELECT customer_id, {months('repayment_status')} AS status, {months('bill_amount_ntd')} AS bill, "
        f"{months('payment_amount_ntd')} AS paid FROM {panel} GROUP BY customer_id"
    )


def _worst(months: str) -> str:
    return f"list_max(list_transform(list_filter(status[{months}], lambda x: x IS NOT NULL), lambda x: CASE WHEN x > 0 THEN x ELSE 0 END))"


_LATE = "CAST(len(list_filter(status, lambda x: x > 0)) AS BIGINT)"


def _quotient(over: str, under: str) -> str:
    return f"CASE WHEN {under} <> 0 THEN ({over})::DOUBLE / ({under})::DOUBLE END"


def behaviour_sql(borrower: str, panel: str) -> str:
    return (
        "SELECT h.customer_id, CAST(len(list_filter(paid, lambda x: x = 0)) AS BIGINT) AS zero_payment_months, "
        f"{_LATE} AS delinquent_months, {_worst('1:3')} AS recent_max_status, {_worst('4:6')} AS earlier_max_status, "
        f"{_quotient('bill[1]', 'credit_limit_ntd')} AS latest_utilization, {_quotient('paid[1]', 'bill[2]')} AS payment_coverage "
        f"FROM ({history_sql(panel)}) h JOIN {borrower} b ON b.customer_id = h.customer_id"
    )


BLOCKS["behaviour"] = behaviour_sql("borrower", "panel")
_FLAGS = (
    ("BR-001", "at least two zero-payment months", "zero_payment_months >= 2"),
    ("BR-002", "at least two delinquent months", "delinquent_months >= 2"),
    ("BR-003", "recent delinquency deterioration", "recent_max_status > earlier_max_status"),
    ("BR-004", "latest bill at or above credit limit", "latest_utilization >= 1"),
    ("BR-005", "latest payment below 10 percent of prior positive bill",
     "payment_coverage >= 0 AND payment_coverage < 0.10::DOUBLE"),
)
BLOCKS["flags"] = (
    "SELECT 'RUN-001' AS pipeline_run_id, test_id, test_name, 'business_rule' AS test_type, "
    "CASE WHEN failed_rows = 0 THEN 'pass' ELSE 'warn' END AS status, 'analytical_flag' AS severity, tested_rows, failed_rows, "
    "CASE WHEN tested_rows = 0 THEN 0.0::DOUBLE ELSE failed_rows::DOUBLE / tested_rows::DOUBLE END AS failure_rate, "
    "'core.panel' AS affected_object FROM (" + " UNION ALL ".join(
        f"SELECT '{i}' AS test_id, '{n}' AS test_name, count(*) AS tested_rows, count(*) FILTER (WHERE {w}) AS failed_rows FROM behaviour"
        for i, n, w in _FLAGS
    ) + ") f"
)
# Runs of months without payment: the longest piece of z in a word of six letters.
BLOCKS["zero_streak"] = (
    "SELECT customer_id, CAST(list_max(list_transform(string_split(word, '.'), lambda x: length(x))) AS BIGINT) AS zero_payment_streak FROM ("
    "SELECT customer_id, array_to_string(list_transform(paid, lambda x: CASE WHEN x = 0 THEN 'z' ELSE '.' END), '') AS word "
    f"FROM ({history_sql('panel')}) h) w WHERE contains(word, 'z')"
)
BLOCKS["features"] = (
    f"SELECT b.customer_id, b.observation_date, b.next_month_default, {_worst('1:3')} AS recent_max_delinquency, {_LATE} AS delinquent_months_6m, "
    f"{_worst('1:3')} - {_worst('4:6')} AS delinquency_deterioration, {_quotient('bill[1]', 'credit_limit_ntd')} AS latest_utilization_ratio, "
    "CASE WHEN bill[2] > 0 THEN paid[1]::DOUBLE / bill[2]::DOUBLE END AS payment_coverage_ratio, "
    "coalesce(z.zero_payment_streak, 0) AS zero_payment_streak, "
    f"{_quotient('bill[1] - bill[4]', 'abs(bill[4])')} AS recent_bill_growth "
    f"FROM borrower b JOIN ({history_sql('panel')}) h ON h.customer_id = b.customer_id LEFT JOIN zero_streak z ON z.customer_id = b.customer_id"
)
BLOCKS["signals"] = (
    "SELECT 'RUN-001' AS pipeline_run_id, f.*, CASE WHEN risk_points <= 1 THEN 'Low' WHEN risk_points <= 3 THEN 'Medium' ELSE 'High' END "
    "AS risk_band, '0.1.0' AS definition_version FROM (SELECT *, CAST("
    "CASE WHEN recent_max_delinquency >= 2 THEN 2 WHEN recent_max_delinquency = 1 THEN 1 ELSE 0 END "
    "+ CASE WHEN delinquent_months_6m >= 2 THEN 2 WHEN delinquent_months_6m = 1 THEN 1 ELSE 0 END "
    "+ CASE WHEN delinquency_deterioration >= 2 THEN 1 ELSE 0 END + CASE WHEN latest_utilization_ratio >= 1 THEN 1 ELSE 0 END "
    "+ CASE WHEN payment_coverage_ratio >= 0 AND payment_coverage_ratio < 0.10::DOUBLE THEN 1 ELSE 0 END "
    "+ CASE WHEN zero_payment_streak >= 2 THEN 1 ELSE 0 END + CASE WHEN recent_bill_growth >= 0.25 THEN 1 ELSE 0 END "
    "AS BIGINT) AS risk_points FROM features) f"
)

# --- outcomes -------------------------------------------------------------------------
# Bucket arms per signal, in order.
_ARMS = {
    "recent_max_delinquency": (("{s} = 0", "0"), ("{s} = 1", "1"), ("true", "2+")),
    "delinquent_months_6m": (("{s} = 0", "0"), ("{s} = 1", "1"), ("true", "2+")),
    "delinquency_deterioration": (("{s} <= 0", "<=0"), ("{s} = 1", "1"), ("true", "2+")),
    "latest_utilization_ratio": (("{s} < 0.80::DOUBLE", "<0.80"), ("{s} < 1", "0.80-<1.00"), ("true", ">=1.00")),
    "payment_coverage_ratio": (
        ("{s} IS NULL", "not_applicable"), ("{s} < 0.10::DOUBLE", "<0.10"), ("{s} < 0.50", "0.10-<0.50"), ("true", ">=0.50"),
    ),
    "zero_payment_streak": (("{s} = 0", "0"), ("{s} = 1", "1"), ("true", "2+")),
    "recent_bill_growth": (
        ("{s} IS NULL", "not_applicable"), ("{s} <= 0", "<=0"), ("{s} < 0.25", "0-<0.25"), ("true", ">=0.25"),
    ),
}


def _bucketed(name: str) -> str:
    label = " ".join(f"WHEN {w.format(s=name)} THEN '{t}'" for w, t in _ARMS[name])
    order = " ".join(f"WHEN {w.format(s=name)} THEN {i}" for i, (w, _) in enumerate(_ARMS[name], 1))
    return (
        f"SELECT '{name}' AS signal_name, CASE {label} END AS signal_bucket, CAST(CASE {order} END AS BIGINT) AS bucket_order, "
        "next_month_default FROM signals"
    )


BLOCKS["bucketed"] = " UNION ALL ".join(_bucketed(s) for s in SIGNALS)
BLOCKS["summary"] = (
    "SELECT 'RUN-001' AS pipeline_run_id, signal_name, signal_bucket, bucket_order, count(*) AS sample_size, "
    "CAST(sum(next_month_default) AS BIGINT) AS default_count, sum(next_month_default)::DOUBLE / count(*)::DOUBLE AS observed_default_rate, "
    "'0.1.0' AS definition_version FROM bucketed GROUP BY signal_name, signal_bucket, bucket_order"
)
BLOCKS["bands"] = (
    "SELECT 'RUN-001' AS pipeline_run_id, risk_band, CAST(CASE risk_band WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS BIGINT) AS band_order, "
    "count(*) AS sample_size, CAST(sum(next_month_default) AS BIGINT) AS default_count, "
    "sum(next_month_default)::DOUBLE / count(*)::DOUBLE AS observed_default_rate, '0.1.0' AS definition_version FROM signals GROUP BY risk_band"
)
BLOCKS["summary_d0"] = (
    "SELECT * REPLACE (CASE WHEN signal_name = 'zero_payment_streak' THEN observed_default_rate + 0.01::DOUBLE ELSE observed_default_rate END "
    "AS observed_default_rate, CASE WHEN signal_name = 'latest_utilization_ratio' AND bucket_order = 3 THEN sample_size + 1 ELSE default_count END "
    "AS default_count) FROM summary WHERE signal_name <> 'recent_bill_growth'"
)
BLOCKS["summary_d"] = (
    "SELECT * FROM summary_d0 UNION ALL SELECT * FROM summary_d0 WHERE signal_name = 'delinquent_months_6m' AND bucket_order = 1"
)


def groups_sql(summary: str) -> str:
    return (
        f"SELECT signal_name, signal_bucket AS bucket, sample_size, default_count, observed_default_rate FROM {summary} "
        "UNION ALL SELECT 'risk_band', risk_band, sample_size, default_count, observed_default_rate FROM bands"
    )


# Expected sign of each signal and the three buckets compared, lowest exposure first.
_DIRECTIONS = {
    "recent_max_delinquency": ("positive", "0", "1", "2+"),
    "delinquent_months_6m": ("positive", "0", "1", "2+"),
    "delinquency_deterioration": ("positive", "<=0", "1", "2+"),
    "latest_utilization_ratio": ("positive", "<0.80", "0.80-<1.00", ">=1.00"),
    "payment_coverage_ratio": ("negative", "<0.10", "0.10-<0.50", ">=0.50"),
    "zero_payment_streak": ("positive", "0", "1", "2+"),
    "recent_bill_growth": ("positive", "<=0", "0-<0.25", ">=0.25"),
}


def rate(summary: str, name: str, position: int) -> str:
    bucket = _DIRECTIONS[name][position + 1]
    return f"(SELECT max(observed_default_rate) FROM {summary} WHERE signal_name = '{name}' AND signal_bucket = '{bucket}')"


def direction_sql(summary: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{s}' AS signal_name, '{_DIRECTIONS[s][0]}' AS expected_sign, {rate(summary, s, 0)} AS rate_low, "
        f"{rate(summary, s, 1)} AS rate_middle, {rate(summary, s, 2)} AS rate_high WHERE EXISTS (SELECT 1 FROM {summary} WHERE signal_name = '{s}')"
        for s in SIGNALS
    )
    return (
        "SELECT *, CASE WHEN rate_low IS NULL OR rate_middle IS NULL OR rate_high IS NULL THEN 'missing' "
        "WHEN rate_low < rate_middle AND rate_middle < rate_high THEN 'positive' "
        "WHEN rate_low > rate_middle AND rate_middle > rate_high THEN 'negative' "
        f"WHEN rate_low < rate_high AND rate_high < rate_middle THEN 'mixed' ELSE 'unordered' END AS direction FROM ({rows}) r"
    )


BLOCKS["direction"] = direction_sql("summary")
BLOCKS["association"] = (
    "SELECT *, CASE WHEN direction = 'missing' THEN 'missing' WHEN direction = expected_sign THEN 'supported_association' "
    "WHEN direction IN ('positive', 'negative') THEN 'contradicted_hypothesis' ELSE 'mixed_association' END AS association FROM direction"
)

# --- population, split, predictions ------------------------------------------------------
BLOCKS["extract"] = (
    "SELECT b.customer_id, b.next_month_default, b.observation_date, credit_limit_ntd, sex_code, education_code, marriage_code, age_years, "
    + ", ".join(SIGNALS) + ", risk_band, source_id, source_file_sha256, b.definition_version "
    "FROM borrower b JOIN signals s ON s.customer_id = b.customer_id"
)
BLOCKS["ranked"] = (
    "SELECT customer_id, next_month_default, sha256('customer_sha256_v1:' || customer_id::VARCHAR) AS digest, "
    "row_number() OVER (ORDER BY sha256('customer_sha256_v1:' || customer_id::VARCHAR), customer_id) - 1 AS split_rank, "
    "count(*) OVER () AS population_size FROM borrower"
)
BLOCKS["split"] = (
    "SELECT *, CASE WHEN split_rank < floor(population_size * 0.6::DOUBLE) THEN 'train' "
    "WHEN split_rank < floor(population_size * 0.6::DOUBLE) + floor(population_size * 0.2::DOUBLE) THEN 'calibration' ELSE 'test' END AS split FROM ranked"
)
BLOCKS["population"] = (
    "SELECT b.customer_id AS borrower_id, b.next_month_default AS actual_default, split, sex_code, education_code, marriage_code, age_years, "
    "CASE WHEN age_years < 30 THEN '<30' WHEN age_years < 40 THEN '30-39' WHEN age_years < 50 THEN '40-49' WHEN age_years < 60 THEN '50-59' "
    "ELSE '60+' END AS age_band, risk_band, risk_points FROM borrower b JOIN signals s ON s.customer_id = b.customer_id "
    "JOIN split x ON x.customer_id = b.customer_id"
)
BLOCKS["pred"] = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {p} AS predicted_pd, borrower_id, actual_default, split, education_code, marriage_code "
    "FROM population WHERE split = 'test'"
    for m, p in (
        ("static", "((age_years * 13 + sex_code * 7 + education_code * 29 + marriage_code * 3) % 100)::DOUBLE / 100.0::DOUBLE"),
        ("behavioral", "risk_points::DOUBLE / 10.0::DOUBLE"),
        ("combined", "CAST('0x' || substr(sha256(borrower_id::VARCHAR), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE"),
    )
)
BLOCKS["pred_d0"] = (
    "SELECT * REPLACE (CASE WHEN education_code = 4 AND model = 'static' THEN predicted_pd + 1.0::DOUBLE ELSE predicted_pd END AS predicted_pd, "
    "CASE WHEN marriage_code = 3 AND model = 'combined' THEN 1 - actual_default ELSE actual_default END AS actual_default, "
    "CASE WHEN education_code = 2 AND marriage_code = 2 THEN 'train' ELSE split END AS split, "
    "CASE WHEN education_code = 3 AND model = 'behavioral' THEN -borrower_id ELSE borrower_id END AS borrower_id) "
    "FROM pred WHERE NOT (education_code = 6 AND model = 'combined')"
)
BLOCKS["pred_d"] = "SELECT * FROM pred_d0 UNION ALL SELECT * FROM pred_d0 WHERE education_code = 5 AND model = 'static'"
BLOCKS["population_d0"] = (
    "SELECT * REPLACE (CASE WHEN education_code = 5 THEN 'holdout' ELSE split END AS split, "
    "CASE WHEN marriage_code = 0 THEN ' ' ELSE age_band END AS age_band, "
    "CASE WHEN education_code = 1 THEN 3 ELSE actual_default END AS actual_default) FROM population"
)
BLOCKS["population_d"] = "SELECT * FROM population_d0 UNION ALL SELECT * FROM population_d0 WHERE age_band = '60+'"

# --- metrics ---------------------------------------------------------------------------------
_CLIP = "least(greatest({x}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"
BLOCKS["base"] = (
    "SELECT model, count(*) AS sample_count, CAST(sum(actual_default) AS BIGINT) AS default_count, "
    "sum(actual_default)::DOUBLE / count(*)::DOUBLE AS default_rate, avg(predicted_pd) AS average_pd, "
    "avg((predicted_pd - actual_default) * (predicted_pd - actual_default)) AS brier_score, "
    f"-avg(CASE WHEN actual_default = 1 THEN ln({_CLIP.format(x='predicted_pd')}) ELSE ln({_CLIP.format(x='1 - predicted_pd')}) END) AS log_loss "
    "FROM pred GROUP BY model"
)
BLOCKS["auc"] = (
    "SELECT model, (sum(CASE WHEN actual_default = 1 THEN mid_rank END) - pos * (pos + 1) / 2.0::DOUBLE) / (pos::DOUBLE * neg::DOUBLE) AS roc_auc FROM ("
    "SELECT model, actual_default, rank() OVER (PARTITION BY model ORDER BY predicted_pd) + "
    "(count(*) OVER (PARTITION BY model, predicted_pd) - 1) / 2.0::DOUBLE AS mid_rank, "
    "sum(actual_default) OVER (PARTITION BY model) AS pos, sum(1 - actual_default) OVER (PARTITION BY model) AS neg FROM pred) r "
    "GROUP BY model, pos, neg"
)
BLOCKS["pr"] = (
    "SELECT model, sum(pos::DOUBLE / total::DOUBLE * tp::DOUBLE / n::DOUBLE) AS pr_auc FROM (SELECT model, pos, "
    "sum(pos) OVER w AS tp, sum(cnt) OVER w AS n, sum(pos) OVER (PARTITION BY model) AS total FROM ("
    "SELECT model, predicted_pd, sum(actual_default) AS pos, count(*) AS cnt FROM pred GROUP BY model, predicted_pd) g "
    "WINDOW w AS (PARTITION BY model ORDER BY predicted_pd DESC)) s GROUP BY model"
)
BLOCKS["bins"] = (
    "SELECT model, CAST(least(floor(predicted_pd * 10), 9) AS BIGINT) + 1 AS bin, "
    "CAST(least(floor(predicted_pd * 10), 9) AS BIGINT)::DOUBLE / 10::DOUBLE AS lower_bound, "
    "(CAST(least(floor(predicted_pd * 10), 9) AS BIGINT) + 1)::DOUBLE / 10::DOUBLE AS upper_bound, count(*) AS sample_count, "
    "CAST(sum(actual_default) AS BIGINT) AS default_count, avg(predicted_pd) AS average_pd, "
    "sum(actual_default)::DOUBLE / count(*)::DOUBLE AS observed_default_rate FROM pred GROUP BY ALL"
)
BLOCKS["ece"] = (
    "SELECT model, sum(sample_count * abs(average_pd - observed_default_rate)) / sum(sample_count) AS expected_calibration_error_10_bin FROM bins GROUP BY model"
)
BLOCKS["metric"] = (
    " UNION ALL ".join(
        f"SELECT model, '{m}' AS metric, {m}::DOUBLE AS value FROM base"
        for m in ("sample_count", "default_count", "default_rate", "average_pd", "brier_score", "log_loss")
    )
    + " UNION ALL SELECT model, 'roc_auc', roc_auc FROM auc UNION ALL SELECT model, 'pr_auc', pr_auc FROM pr "
    "UNION ALL SELECT model, 'expected_calibration_error_10_bin', expected_calibration_error_10_bin FROM ece"
)
BLOCKS["seg"] = " UNION ALL ".join(
    f"SELECT model, '{f}' AS segment_field, p.{f}::VARCHAR AS segment_value, count(*) AS sample_count, "
    "CAST(sum(d.actual_default) AS BIGINT) AS default_count, sum(d.actual_default)::DOUBLE / count(*)::DOUBLE AS default_rate, "
    "avg(predicted_pd) AS average_pd, avg((predicted_pd - d.actual_default) * (predicted_pd - d.actual_default)) AS brier_score "
    f"FROM pred d JOIN population p ON p.borrower_id = d.borrower_id GROUP BY model, p.{f}"
    for f in ("sex_code", "education_code", "marriage_code", "age_band", "risk_band")
)
_DELTAS = (
    ("roc_auc", "roc_auc_difference"), ("pr_auc", "pr_auc_difference"), ("brier_score", "brier_score_difference"),
    ("log_loss", "log_loss_difference"), ("expected_calibration_error_10_bin", "ece_difference"),
)
BLOCKS["deltas"] = (
    "SELECT l.model || '_minus_' || r.model AS comparison, CASE l.metric "
    + " ".join(f"WHEN '{m}' THEN '{d}'" for m, d in _DELTAS)
    + " END AS metric, l.value - r.value AS difference FROM metric l JOIN metric r ON r.metric = l.metric "
    "AND (l.model, r.model) IN (('behavioral', 'static'), ('combined', 'static'), ('combined', 'behavioral')) WHERE l.metric IN ("
    + ", ".join(f"'{m}'" for m, _ in _DELTAS) + ")"
)

# --- graph ------------------------------------------------------------------------------------
BLOCKS["node"] = (
    "SELECT 'data_lineage' AS graph_scope, node_type, canonical_name, '1' AS version, 'validated' AS status, 'Data' AS owner, "
    "'table/' || canonical_name AS path_or_object, sha256('data_lineage|' || canonical_name || '|1') AS node_id FROM ("
    "SELECT 'o' || o_orderkey AS canonical_name, 'Result' AS node_type FROM orders UNION ALL SELECT 'c' || c_custkey, 'Table' FROM customer "
    "UNION ALL SELECT 'n' || n_nationkey, 'Transformation' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Source' FROM region) x"
)
BLOCKS["named_edge"] = (
    "SELECT 'data_lineage' AS graph_scope, *, CAST(NULL AS VARCHAR) AS expected_sign, CAST(NULL AS INTEGER) AS lag_months, "
    "'evidence/' || from_name AS evidence_reference, DATE '2005-09-30' AS valid_from, CAST(NULL AS DATE) AS valid_to, 'validated' AS status FROM ("
    "SELECT 'o' || o_orderkey AS from_name, 'c' || o_custkey AS to_name, 'computed_from' AS edge_type FROM orders "
    "UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'validated_by' FROM customer "
    "UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'computed_from' FROM nation) x"
)


def edge_sql(named: str) -> str:
    return (
        "SELECT graph_scope, sha256(graph_scope || '|' || from_name || '|1') AS from_node_id, sha256(graph_scope || '|' || to_name || '|1') AS to_node_id, "
        f"edge_type, valid_from, expected_sign, lag_months, evidence_reference, valid_to, status FROM {named}"
    )


BLOCKS["edge"] = edge_sql("named_edge")
_m = "regexp_matches({}, '{}')".format
BLOCKS["node_d"] = (
    "SELECT * REPLACE (CASE WHEN node_type = 'Source' THEN 'elsewhere' ELSE graph_scope END AS graph_scope, "
    "CASE WHEN node_type = 'Transformation' THEN '  ' ELSE status END AS status, "
    f"CASE WHEN {_m('canonical_name', '^c[0-9]*7$')} THEN '' WHEN {_m('canonical_name', '^c[0-9]*8$')} THEN NULL ELSE owner END AS owner, "
    f"CASE WHEN {_m('canonical_name', '^o[0-9]*99$')} THEN ' ' ELSE version END AS version, "
    f"CASE WHEN {_m('canonical_name', '^o[0-9]*55$')} THEN '' ELSE path_or_object END AS path_or_object, "
    f"CASE WHEN {_m('canonical_name', '^c[0-9]*3$')} THEN 'Thing' ELSE node_type END AS node_type, "
    f"CASE WHEN {_m('canonical_name', '^n[0-9]*4$')} THEN '   ' ELSE canonical_name END AS canonical_name) FROM node"
)
BLOCKS["named_edge_d"] = (
    f"SELECT * REPLACE (CASE WHEN {_m('from_name', '^o[0-9]*77$')} THEN from_name WHEN {_m('from_name', '^o[0-9]*88$')} THEN 'absent' ELSE to_name END AS to_name, "
    f"CASE WHEN {_m('from_name', '^c[0-9]*5$')} THEN 'touches' ELSE edge_type END AS edge_type, "
    f"CASE WHEN {_m('from_name', '^c[0-9]*6$')} THEN 'positive' WHEN {_m('from_name', '^c[0-9]*1$')} THEN 'up' END AS expected_sign, "
    f"CASE WHEN {_m('from_name', '^c[0-9]*2$')} THEN -1 END AS lag_months, "
    f"CASE WHEN {_m('from_name', '^o[0-9]*33$')} THEN NULL WHEN {_m('from_name', '^o[0-9]*44$')} THEN ' ' ELSE evidence_reference END AS evidence_reference, "
    f"CASE WHEN {_m('from_name', '^o[0-9]*3$')} THEN 'approved' WHEN {_m('from_name', '^n')} THEN '' ELSE status END AS status, "
    f"CASE WHEN {_m('from_name', '^c[0-9]*9$')} THEN CAST(valid_from - 1 AS DATE) WHEN {_m('from_name', '^c[0-9]*0$')} THEN valid_from END AS valid_to, "
    f"CASE WHEN {_m('from_name', '^n[0-9]*2$')} THEN 'elsewhere' ELSE graph_scope END AS graph_scope) FROM named_edge"
)
BLOCKS["edge_d"] = edge_sql("named_edge_d")
BLOCKS["edge_x"] = (
    "SELECT * REPLACE (CASE WHEN regexp_matches(evidence_reference, '(c[0-9]*3|n[0-9]*)$') THEN 'economic_transmission' ELSE graph_scope END AS graph_scope) FROM edge"
)


# The graph of one run, written out: type, name, version (D definition, R run, S source digest), owner, judged.
_GRAPH_NODES = """
    ('Source', 'orders_by_customer', 'S', 'ingest', false), ('Run', 'run', 'R', 'ingest', false),
    ('Transformation', 'ingest.load_insert_only', 'D', 'ingest', false), ('Table', 'raw', 'R', 'ingest', false),
    ('Transformation', 'panel.borrower', 'D', 'panel', false), ('Table', 'borrower', 'R', 'panel', false),
    ('Transformation', 'panel.unpivot_periods', 'D', 'panel', false), ('Table', 'panel', 'R', 'panel', false),
    ('Transformation', 'signals.signal_table', 'D', 'signals', false), ('Table', 'signals', 'R', 'signals', false),
    ('Transformation', 'outcomes.signal_summary', 'D', 'outcomes', false), ('Table', 'outcomes', 'R', 'outcomes', false),
    ('Test', 'quality.quality_suite', 'D', 'quality', true), ('Result', 'evidence', 'R', 'quality', true)
"""
# What each operator reads and writes.
_GRAPH_READS = """
    ('ingest.load_insert_only', 'orders_by_customer'), ('panel.borrower', 'raw'), ('panel.unpivot_periods', 'raw'),
    ('signals.signal_table', 'borrower'), ('signals.signal_table', 'panel'), ('outcomes.signal_summary', 'borrower'),
    ('outcomes.signal_summary', 'signals'), ('quality.quality_suite', 'raw'), ('quality.quality_suite', 'borrower'), ('quality.quality_suite', 'panel')
"""
_GRAPH_WRITES = """
    ('ingest.load_insert_only', 'raw'), ('panel.borrower', 'borrower'), ('panel.unpivot_periods', 'panel'),
    ('signals.signal_table', 'signals'), ('outcomes.signal_summary', 'outcomes'), ('quality.quality_suite', 'evidence')
"""
BLOCKS["pipeline_node"] = (
    "SELECT 'data_lineage' AS graph_scope, node_type, name AS canonical_name, "
    f"CASE v WHEN 'S' THEN sha256('{SOURCE}') WHEN 'R' THEN 'RUN-001' ELSE '0.1.0' END AS version, "
    "CASE WHEN judged AND (SELECT count(*) FROM tests WHERE status = 'fail') > 0 THEN 'failed' ELSE 'validated' END AS status, owner, name AS path_or_object "
    f"FROM (VALUES {_GRAPH_NODES}) t(node_type, name, v, owner, judged) UNION ALL "
    "SELECT DISTINCT 'data_lineage', 'Feature', 'signals.' || signal_name, 'RUN-001', 'validated', 'signals', 'signals.' || signal_name FROM summary"
)
BLOCKS["pipeline_edge"] = (
    f"WITH rd AS (SELECT * FROM (VALUES {_GRAPH_READS}) t(op, tab)), wr AS (SELECT * FROM (VALUES {_GRAPH_WRITES}) t(op, tab)), "
    "sg AS (SELECT DISTINCT 'signals.' || signal_name AS name FROM summary), named AS ("
    "SELECT tab AS a, 'transformed_by' AS kind, op AS b, op AS proof FROM rd UNION ALL SELECT op, 'supports', tab, op FROM wr "
    "UNION ALL SELECT op, 'computed_from', tab, op FROM rd UNION ALL SELECT tab, 'computed_from', op, op FROM wr "
    "UNION ALL SELECT tab, 'validated_by', op, op FROM rd WHERE op = 'quality.quality_suite' "
    "UNION ALL SELECT 'run', 'supports', op, op FROM wr "
    "UNION ALL SELECT 'signals.signal_table', 'supports', name, 'signals.signal_table' FROM sg "
    "UNION ALL SELECT name, 'computed_from', 'signals.signal_table', 'signals.signal_table' FROM sg "
    "UNION ALL SELECT name, 'reported_in', 'outcomes', 'outcomes.signal_summary' FROM sg), "
    "ids AS (SELECT canonical_name, sha256('data_lineage|' || canonical_name || '|' || version) AS node_id FROM pipeline_node) "
    "SELECT 'data_lineage' AS graph_scope, x.node_id AS from_node_id, y.node_id AS to_node_id, kind AS edge_type, '2005-09-30' AS valid_from, "
    "proof AS evidence_reference, 'approved' AS status FROM named JOIN ids x ON x.canonical_name = a JOIN ids y ON y.canonical_name = b"
)

# --- cells, registry, ledger --------------------------------------------------------------------
BLOCKS["cells"] = (
    "SELECT event_id AS row_no, CASE WHEN k = '13' THEN '' WHEN k = '23' THEN (event_id // 2)::VARCHAR ELSE event_id::VARCHAR END AS id, "
    "CASE WHEN k = '17' THEN '9999999999' WHEN k = '29' THEN '2147483647.0000000001' WHEN k = '31' THEN ' ' || user_id || '.50e3 ' ELSE user_id::VARCHAR END AS \"user\", "
    "CASE WHEN k = '19' THEN 'n/a' WHEN k = '37' THEN '1.00000000000000001' WHEN k = '41' THEN '+120e-1' WHEN k = '43' THEN '15e-1' WHEN event_type = 'error' THEN printf('%.2f', value) ELSE CAST(floor(value) AS BIGINT)::VARCHAR END AS amount, k "
    "FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) e"
)
_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _exact(cell: str) -> str:
    """The number as an exact decimal; the planted cells have 19 digits before and 18 after the point at most."""
    mantissa = f"regexp_extract(trim({cell}), '^[^eE]*')"
    power = f"coalesce(TRY_CAST(nullif(regexp_extract(lower(trim({cell})), 'e([+-]?[0-9]+)$', 1), '') AS INTEGER), 0)"
    return (
        f"CASE {power} WHEN 0 THEN TRY_CAST({mantissa} AS DECIMAL(38, 18)) WHEN 3 THEN CAST(TRY_CAST({mantissa} AS DECIMAL(14, 6)) * 1000 AS DECIMAL(38, 18)) "
        f"WHEN -1 THEN CAST(TRY_CAST({mantissa} AS DECIMAL(14, 6)) * CAST(0.1 AS DECIMAL(2, 1)) AS DECIMAL(38, 18)) END"
    )


def _reason(cell: str) -> str:
    number = _exact(cell)
    return (
        f"CASE WHEN {cell} IS NULL OR {cell} = '' THEN 'missing value' WHEN NOT regexp_matches({cell}, '{_NUM}') THEN 'non-numeric' "
        f"WHEN regexp_matches(CAST({number} AS VARCHAR), '[.]0*[1-9]') THEN 'non-integral' WHEN {number} < -2147483648 OR {number} > 2147483647 THEN 'outside int32' END"
    )


BLOCKS["cell_rejects"] = " UNION ALL ".join(
    f"SELECT row_no, CAST({i} AS BIGINT) AS col_no, '{f}' AS field, {_reason(q)} AS reason, {q} AS raw_value FROM cells WHERE {_reason(q)} IS NOT NULL"
    for i, (f, q) in enumerate((("id", "id"), ("user", '"user"'), ("amount", "amount")), 1)
)
BLOCKS["parsed"] = (
    "SELECT row_no, k, CAST(" + _exact("id") + " AS BIGINT) AS id, CAST(" + _exact('"user"') + " AS BIGINT) AS \"user\", "
    "CAST(" + _exact("amount") + " AS BIGINT) AS amount FROM cells WHERE row_no NOT IN (SELECT row_no FROM cell_rejects)"
)
BLOCKS["numbered"] = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS copy FROM parsed"
BLOCKS["registered"] = (
    "SELECT s_name AS source_id, sha256(s_name) AS file_sha256, count(l_suppkey) AS data_row_count, CAST(s_nationkey AS BIGINT) AS column_count "
    "FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name, s_nationkey"
)
BLOCKS["ledger"] = (
    "SELECT user_id::VARCHAR AS run_id, CASE event_type WHEN 'signup' THEN 'building' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, "
    "ts AS event_time, event_id AS sequence, CAST(floor(value) AS BIGINT) AS rejected_rows FROM events"
)

# --- gates ------------------------------------------------------------------------------------------
_B = "(SELECT count(*) FROM borrower"
_EVIDENCE = {
    "source_rows": "(SELECT data_row_count FROM registry ORDER BY registered_at DESC LIMIT 1)",
    "source_columns": "(SELECT column_count FROM registry ORDER BY registered_at DESC LIMIT 1)",
    "registered_sources": "(SELECT count(*) FROM registry)",
    "sha256_valid": "(SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM registry WHERE regexp_matches(file_sha256, '^[0-9a-f]{64}$'))",
    "raw_rows": "(SELECT count(*) FROM raw)",
    "unlogged_rejects": "greatest((SELECT data_row_count FROM registry ORDER BY registered_at DESC LIMIT 1) - (SELECT count(*) FROM raw) "
    "- (SELECT coalesce(max(rejected_rows), 0) FROM ledger WHERE status = 'succeeded'), 0)",
    "borrower_rows": f"{_B})",
    "expected_panel_rows": f"6 * {_B})",
    "panel_rows": "(SELECT count(*) FROM panel)",
    "periods": "(SELECT count(DISTINCT month_offset) FROM panel)",
    "bill_difference": "(SELECT difference FROM rec WHERE reconciliation_id = 'REC-003')",
    "payment_difference": "(SELECT difference FROM rec WHERE reconciliation_id = 'REC-004')",
    "duplicate_borrower_keys": "(SELECT count(*) FROM (SELECT customer_id FROM borrower GROUP BY customer_id HAVING count(*) > 1) x)",
    "duplicate_panel_keys": "(SELECT count(*) FROM (SELECT customer_id, month_offset FROM panel GROUP BY customer_id, month_offset HAVING count(*) > 1) x)",
    "null_borrower_keys": f"{_B} WHERE customer_id IS NULL)",
    "orphan_panel_rows": "(SELECT count(*) FROM panel WHERE customer_id NOT IN (SELECT customer_id FROM borrower))",
    "invalid_code_rows": f"{_B} WHERE next_month_default NOT IN (0, 1) OR sex_code NOT IN (1, 2) OR credit_limit_ntd <= 0 OR age_years NOT BETWEEN 18 AND 120)",
    "missing_history_rows": "(SELECT count(*) FROM panel WHERE repayment_status IS NULL OR bill_amount_ntd IS NULL OR payment_amount_ntd IS NULL)",
    "executed_tests": "(SELECT count(*) FROM tests WHERE test_id <= 'DQ-015')",
    "failed_tests": "(SELECT count(*) FROM tests WHERE test_id <= 'DQ-015' AND (status <> 'pass' OR failed_rows <> 0))",
    "signals": str(len(SIGNALS)),
    "version_present": "1",
    "timing_reviewed": "(SELECT count(DISTINCT signal_name) FROM summary)",
    "timing_violations": "0",
    "leakage_reviewed": "(SELECT count(DISTINCT signal_name) FROM summary)",
    "leakage_violations": "0",
    "summary_rows": "(SELECT count(*) FROM summary)",
    "signals_with_summary": "(SELECT count(DISTINCT signal_name) FROM summary)",
    "reproducible_signals": "(SELECT count(DISTINCT signal_name) FROM summary)",
    "invalid_summaries": "(SELECT count(*) FROM summary WHERE NOT default_count BETWEEN 0 AND sample_size)",
    "band_rows": "(SELECT count(*) FROM bands)",
    "signal_default_total": "(SELECT sum(default_count) FROM summary WHERE signal_name = 'zero_payment_streak')",
    "band_default_total": "(SELECT sum(default_count) FROM bands)",
    "missing_labels": "(SELECT count(*) FROM signals WHERE risk_band IS NULL)",
    "unresolved_claims": "(SELECT count(*) FROM (VALUES " + ", ".join(f"('{s}')" for s in SIGNALS) + ") v(s) WHERE s NOT IN (SELECT signal_name FROM summary))",
    "calibration_completed": "(SELECT CASE WHEN count(DISTINCT model) = 3 THEN 1 ELSE 0 END FROM bins)",
    "segment_stability_completed": "(SELECT CASE WHEN count(DISTINCT segment_field) = 5 THEN 1 ELSE 0 END FROM seg)",
    "distinct_run_ids": "(SELECT count(DISTINCT pipeline_run_id) FROM (SELECT pipeline_run_id FROM borrower UNION ALL SELECT pipeline_run_id FROM panel UNION ALL SELECT pipeline_run_id FROM signals) x)",
    "mismatches": "(SELECT count(*) FROM (SELECT signal_name, sum(sample_size) AS n, sum(default_count) AS d FROM summary GROUP BY signal_name "
    "UNION ALL SELECT 'risk_band', sum(sample_size), sum(default_count) FROM bands) t "
    "WHERE n <> (SELECT count(*) FROM borrower) OR d <> (SELECT sum(next_month_default) FROM borrower))",
}
BLOCKS["evidence"] = " UNION ALL ".join(f"SELECT '{k}' AS metric, ({v})::DOUBLE AS value" for k, v in _EVIDENCE.items())
# What each gate asks for, written out here so that a wrong rule cannot hide.
_RULES = """
    (1, 'source_registered', 'registered_sources', 'ge', 1.0, NULL),
    (1, 'sha256_recorded', 'sha256_valid', 'eq', 1.0, NULL),
    (1, 'source_shape_recorded', 'source_rows', 'gt', 0.0, NULL),
    (1, 'source_shape_recorded', 'source_columns', 'gt', 0.0, NULL),
    (1, 'raw_rows_reconciled', 'raw_rows', 'eq', 0.0, 'source_rows'),
    (1, 'raw_rows_reconciled', 'unlogged_rejects', 'eq', 0.0, NULL),
    (2, 'primary_key', 'duplicate_borrower_keys', 'eq', 0.0, NULL),
    (2, 'primary_key', 'null_borrower_keys', 'eq', 0.0, NULL),
    (2, 'primary_key', 'duplicate_panel_keys', 'eq', 0.0, NULL),
    (2, 'foreign_key', 'orphan_panel_rows', 'eq', 0.0, NULL),
    (2, 'wide_to_long_rows', 'borrower_rows', 'gt', 0.0, NULL),
    (2, 'wide_to_long_rows', 'borrower_rows', 'eq', 0.0, 'raw_rows'),
    (2, 'wide_to_long_rows', 'periods', 'eq', 6.0, NULL),
    (2, 'wide_to_long_rows', 'panel_rows', 'eq', 0.0, 'expected_panel_rows'),
    (2, 'bill_amounts', 'bill_difference', 'abs_le', 0.01, NULL),
    (2, 'payment_amounts', 'payment_difference', 'abs_le', 0.01, NULL),
    (2, 'code_domains', 'invalid_code_rows', 'eq', 0.0, NULL),
    (2, 'code_domains', 'missing_history_rows', 'eq', 0.0, NULL),
    (2, 'sql_test_suite', 'executed_tests', 'ge', 12.0, NULL),
    (2, 'sql_test_suite', 'failed_tests', 'eq', 0.0, NULL),
    (3, 'signal_count', 'signals', 'ge', 5.0, NULL),
    (3, 'definition_version', 'version_present', 'eq', 1.0, NULL),
    (3, 'observation_timing', 'timing_reviewed', 'eq', 0.0, 'signals'),
    (3, 'observation_timing', 'timing_violations', 'eq', 0.0, NULL),
    (3, 'leakage', 'leakage_reviewed', 'eq', 0.0, 'signals'),
    (3, 'leakage', 'leakage_violations', 'eq', 0.0, NULL),
    (3, 'outcome_summary', 'summary_rows', 'gt', 0.0, NULL),
    (3, 'outcome_summary', 'signals_with_summary', 'eq', 0.0, 'signals'),
    (3, 'outcome_summary', 'invalid_summaries', 'eq', 0.0, NULL),
    (3, 'outcome_summary', 'band_rows', 'gt', 0.0, NULL),
    (3, 'outcome_summary', 'signal_default_total', 'eq', 0.0, 'band_default_total'),
    (3, 'sql_reproducibility', 'reproducible_signals', 'eq', 0.0, 'signals'),
    (4, 'time_validation', 'time_validation_completed', 'eq', 1.0, NULL),
    (4, 'calibration', 'calibration_completed', 'eq', 1.0, NULL),
    (4, 'segment_stability', 'segment_stability_completed', 'eq', 1.0, NULL),
    (4, 'sensitivity_direction', 'sensitivity_completed', 'eq', 1.0, NULL),
    (4, 'proxy_labels', 'missing_labels', 'eq', 0.0, NULL),
    (5, 'shared_run_id', 'distinct_run_ids', 'eq', 1.0, NULL),
    (5, 'cross_artifact_values', 'mismatches', 'eq', 0.0, NULL),
    (5, 'limitations', 'limitations_documented', 'eq', 1.0, NULL),
    (5, 'evidence_map', 'unresolved_claims', 'eq', 0.0, NULL)
"""
BLOCKS["rules"] = (
    "SELECT gate, check_id, metric, comparison, bound::DOUBLE AS bound, other_metric "
    f"FROM (VALUES {_RULES}) v(gate, check_id, metric, comparison, bound, other_metric)"
)
BLOCKS["ruled"] = (
    "SELECT gate, check_id, metric, comparison, observed, allowed, CASE WHEN (comparison = 'eq' AND observed = allowed) OR "
    "(comparison = 'ge' AND observed >= allowed) OR (comparison = 'gt' AND observed > allowed) OR (comparison = 'abs_le' AND abs(observed) <= allowed) "
    "THEN 'pass' ELSE 'fail' END AS status FROM (SELECT r.*, e.value AS observed, CASE WHEN r.other_metric IS NULL THEN r.bound ELSE o.value END AS allowed "
    "FROM rules r LEFT JOIN evidence e ON e.metric = r.metric LEFT JOIN evidence o ON o.metric = r.other_metric) x"
)
BLOCKS["checks"] = (
    "SELECT gate, check_id, CASE WHEN bool_and(status = 'pass') THEN 'pass' ELSE 'fail' END AS status FROM ruled GROUP BY gate, check_id"
)


def build(select: str, **extra: str) -> str:
    """Final SELECT with the named blocks it needs, in dependency order."""
    blocks = {**BLOCKS, **extra}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in blocks:
            if name not in order and re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
                visit(blocks[name])
                if name not in order:
                    order.append(name)

    visit(select)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({blocks[name]})" for name in order) + "\n" + select

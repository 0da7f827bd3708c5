"""Data-quality tests and behaviour rules as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import (
    AGE_BOUNDS,
    DEFAULT,
    EDUCATION_CODES,
    MARRIAGE_CODES,
    MINIMUM_TESTS,
    SEX_CODES,
    STATUS_CODES,
    PanelParams,
)
from riskpanel.functions import expressions as X
from riskpanel.functions.expressions import period_end
from riskpanel.functions.frames import as_rows, count_where, hot_of_counts, ratio, require, salted_join, single_row
from riskpanel.operators.signals import KEYS, _over, earlier_max, history, recent_max

c = F.col


@dataclass(frozen=True)
class Rule:
    """One test: the passes it needs and its counts over their merged row."""

    test_id: str
    name: str
    severity: str
    affected: str
    passes: tuple[str, ...]
    tested: str
    failed: str


# Test ids, names, severities and objects. Counts are SQL over the merged row.
RULES = (
    Rule("DQ-001", "raw customer ID uniqueness", "critical", "raw.wide", ("raw",), "raw_rows", "duplicate_ids"),
    Rule("DQ-002", "raw rows equal registered source rows", "critical", "audit.source -> raw.wide",
         ("raw", "registry"), "1", "if(raw_rows <=> registered_rows, 0, 1)"),
    Rule("DQ-003", "each borrower has six account months", "critical", "core.panel",
         ("borrower", "panel_keys"), "borrower_rows", "keys_off_periods"),
    Rule("DQ-004", "account-month rows equal borrower rows times six", "critical", "core.borrower -> core.panel",
         ("borrower", "panel_keys"), "1", "if(panel_rows = borrower_rows * {periods}, 0, 1)"),
    Rule("DQ-005", "wide and long bill totals reconcile", "critical", "audit.reconciliation.REC-003",
         ("reconciliation",), "1", "if(bill_status <=> 'pass', 0, 1)"),
    Rule("DQ-006", "wide and long payment totals reconcile", "critical", "audit.reconciliation.REC-004",
         ("reconciliation",), "1", "if(payment_status <=> 'pass', 0, 1)"),
    Rule("DQ-007", "outcome is binary", "critical", "core.borrower.next_month_default",
         ("borrower",), "borrower_rows", "bad_outcome"),
    Rule("DQ-008", "credit limit is positive", "high", "core.borrower.credit_limit_ntd",
         ("borrower",), "borrower_rows", "bad_limit"),
    Rule("DQ-009", "age is within plausible reviewed bounds 18-120", "high", "core.borrower.age_years",
         ("borrower",), "borrower_rows", "bad_age"),
    Rule("DQ-010", "required history fields are populated", "critical", "core.panel",
         ("panel",), "panel_tested", "null_history"),
    Rule("DQ-011", "account months have a borrower parent", "critical", "core.panel -> core.borrower",
         ("panel_keys",), "panel_rows", "orphan_rows"),
    Rule("DQ-012", "month offsets map to approved month ends", "critical", "core.panel.statement_month_end",
         ("panel",), "panel_tested", "bad_month_end"),
    Rule("DQ-013", "sex uses documented codes 1-2", "high", "core.borrower.sex_code",
         ("borrower",), "borrower_rows", "bad_sex"),
    Rule("DQ-014", "raw and core borrower attributes match exactly", "critical", "raw.wide -> core.borrower",
         ("raw", "copies"), "raw_rows", "attribute_differences"),
    Rule("DQ-015", "raw and core outcomes match exactly", "critical", "raw.wide -> core.borrower.next_month_default",
         ("raw", "copies"), "raw_rows", "outcome_differences"),
    Rule("DQ-016", "education code is documented", "medium", "core.borrower.education_code",
         ("borrower",), "borrower_rows", "bad_education"),
    Rule("DQ-017", "marriage code is documented", "medium", "core.borrower.marriage_code",
         ("borrower",), "borrower_rows", "bad_marriage"),
    Rule("DQ-018", "repayment code is documented", "medium", "core.panel.repayment_status",
         ("panel",), "panel_tested", "bad_status"),
)


@dataclass(frozen=True)
class Tables:
    """The tables a quality run reads. ``registry`` holds the source's registrations."""

    raw: DataFrame
    borrowers: DataFrame
    panel: DataFrame
    registry: DataFrame
    reconciliation: DataFrame


def undocumented(column: str, codes: Sequence[int]) -> Column:
    return ~c(column).isin(*codes)


def _raw_pass(t: Tables, p: PanelParams) -> DataFrame:
    per_id = t.raw.groupBy(p.wide_key).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"), count_where(c("n") > 1).alias("duplicate_ids")
    )


def _registry_pass(t: Tables, p: PanelParams) -> DataFrame:
    newest = F.max_by("data_row_count", F.struct("registered_at", "file_sha256"))
    return t.registry.agg(newest.alias("registered_rows"))


def _borrower_pass(t: Tables, p: PanelParams) -> DataFrame:
    return t.borrowers.agg(
        F.count(F.lit(1)).alias("borrower_rows"),
        count_where(~c("next_month_default").isin(0, 1)).alias("bad_outcome"),
        count_where(c("credit_limit_ntd") <= 0).alias("bad_limit"),
        count_where(~c("age_years").between(*AGE_BOUNDS)).alias("bad_age"),
        count_where(undocumented("sex_code", SEX_CODES)).alias("bad_sex"),
        count_where(undocumented("education_code", EDUCATION_CODES)).alias("bad_education"),
        count_where(undocumented("marriage_code", MARRIAGE_CODES)).alias("bad_marriage"),
    )


def _panel_pass(t: Tables, p: PanelParams) -> DataFrame:
    empty = c("repayment_status").isNull() | c("bill_amount_ntd").isNull() | c("payment_amount_ntd").isNull()
    return t.panel.agg(
        F.count(F.lit(1)).alias("panel_tested"),
        count_where(empty).alias("null_history"),
        count_where(
            c("statement_month_end") != period_end(c("month_offset"), p.observation_date)
        ).alias("bad_month_end"),
        count_where(undocumented("repayment_status", STATUS_CODES)).alias("bad_status"),
    )


def _panel_keys_pass(t: Tables, p: PanelParams) -> DataFrame:
    """Rows per key first, then the parent lookup: a key with very many rows
    reaches the join as one row."""
    per_key = t.panel.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    parents = t.borrowers.select(*KEYS).distinct().withColumn("_parent", F.lit(True))
    checked = per_key.join(parents, list(KEYS), "left")
    return checked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("panel_rows"),
        count_where(c("n") != p.n_periods).alias("keys_off_periods"),
        F.coalesce(F.sum(F.when(c("_parent").isNull(), c("n"))), F.lit(0)).alias("orphan_rows"),
    )


def _copies_pass(t: Tables, p: PanelParams) -> DataFrame:
    """Raw rows beside their borrower. An id that raw repeats very often is
    spread, from the same counts per id that the raw pass needs."""
    names = [name for _, name in p.attributes]
    raw = t.raw.select(
        c(p.wide_key).alias("customer_id"),
        F.struct(*[c(wide).alias(name) for wide, name in p.attributes]).alias("_raw"),
        c(p.wide_outcome).alias("_raw_outcome"),
        c("source_row_number").alias("_spread"),
    )
    core = t.borrowers.select("customer_id", F.struct(*names).alias("_core"), "next_month_default")
    per_id = t.raw.groupBy(c(p.wide_key).alias("customer_id")).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_of_counts(per_id, ["customer_id"])
    return salted_join(raw, core, ["customer_id"], c("_spread"), hot=hot).agg(
        count_where(~c("_raw").eqNullSafe(c("_core"))).alias("attribute_differences"),
        count_where(~c("_raw_outcome").eqNullSafe(c("next_month_default"))).alias("outcome_differences"),
    )


def _reconciliation_pass(t: Tables, p: PanelParams) -> DataFrame:
    def status(ident: str) -> Column:
        return F.max(F.when(c("reconciliation_id") == ident, c("status")))

    return t.reconciliation.agg(status("REC-003").alias("bill_status"), status("REC-004").alias("payment_status"))


PASSES = {
    "raw": _raw_pass,
    "registry": _registry_pass,
    "borrower": _borrower_pass,
    "panel": _panel_pass,
    "panel_keys": _panel_keys_pass,
    "copies": _copies_pass,
    "reconciliation": _reconciliation_pass,
}


def grade(df: DataFrame) -> DataFrame:
    """Add status and failure rate to rows with failed, tested and severity."""
    failed, tested = c("failed_rows"), c("tested_rows")
    return df.withColumn(
        "status",
        F.when(failed == 0, "pass").when(c("severity").isin("medium", "low"), "warn").otherwise("fail"),
    ).withColumn("failure_rate", F.when(tested == 0, F.lit(0.0)).otherwise(ratio(failed, tested)))


EVIDENCE = (
    "pipeline_run_id", "test_id", "test_name", "test_type", "status", "severity",
    "tested_rows", "failed_rows", "failure_rate", "affected_object",
)


def quality_suite(t: Tables, p: PanelParams = DEFAULT, only: Iterable[str] | None = None) -> DataFrame:
    """Evidence row per test. Each table is aggregated once for all its tests;
    with ``only``, passes that no chosen test needs are not run."""
    wanted = None if only is None else set(only)
    rules = [r for r in RULES if wanted is None or r.test_id in wanted]
    needed = [name for name in PASSES if any(name in r.passes for r in rules)]
    merged = single_row(*[PASSES[name](t, p) for name in needed])
    rows = as_rows(
        merged,
        [
            F.expr(
                f"named_struct('test_id', '{r.test_id}', 'test_name', '{r.name}', 'severity', '{r.severity}', "
                f"'tested_rows', CAST({r.tested} AS BIGINT), "
                f"'failed_rows', CAST({r.failed.format(periods=p.n_periods)} AS BIGINT), 'affected_object', '{r.affected}')"
            )
            for r in rules
        ],
    ).select(F.lit(p.run_id).alias("pipeline_run_id"), F.lit("data_quality").alias("test_type"), "*")
    return grade(rows).select(*EVIDENCE)


def bounded_sample(df: DataFrame, offence: Column, fields: Sequence[str], order: Sequence[str], size: int = 10) -> DataFrame:
    """One row ``sample_json``: the first ``size`` offenders by key as JSON.

    The limit is taken per task before the few survivors meet.
    """
    first = df.where(offence).select(*fields).orderBy(*order).limit(size)
    listed = F.collect_list(F.struct(*[*order, *[f for f in fields if f not in order]]))
    return first.agg(F.to_json(F.sort_array(listed)).alias("sample_json"))


def suite_samples(t: Tables, size: int = 10) -> DataFrame:
    """``(test_id, sample_json)`` for the three documented-code tests."""
    specs = (
        ("DQ-016", t.borrowers, undocumented("education_code", EDUCATION_CODES),
         ["customer_id", "education_code"], ["customer_id"]),
        ("DQ-017", t.borrowers, undocumented("marriage_code", MARRIAGE_CODES),
         ["customer_id", "marriage_code"], ["customer_id"]),
        ("DQ-018", t.panel, undocumented("repayment_status", STATUS_CODES),
         ["customer_id", "month_offset", "repayment_status"], ["customer_id", "month_offset"]),
    )
    samples = None
    for test_id, df, offence, fields, order in specs:
        one = bounded_sample(df, offence, fields, order, size).select(F.lit(test_id).alias("test_id"), "sample_json")
        samples = one if samples is None else samples.unionByName(one)
    return samples


def evidence_counts(tests: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """One row: executed and failed tests, failed reconciliations."""
    quality = c("test_type") == "data_quality"
    return single_row(
        tests.agg(
            count_where(quality).alias("executed_tests"),
            count_where(quality & (c("status") == "fail")).alias("failed_tests"),
        ),
        reconciliations.agg(count_where(c("status") == "fail").alias("failed_reconciliations")),
    )


def require_minimum(tests: DataFrame, reconciliations: DataFrame, minimum: int = MINIMUM_TESTS) -> None:
    """Block signals unless enough tests ran and nothing failed."""
    require(
        evidence_counts(tests, reconciliations),
        {
            "no_failed_test": "failed_tests = 0",
            "no_failed_reconciliation": "failed_reconciliations = 0",
            "enough_tests": f"executed_tests >= {minimum}",
        },
    )


# --- behaviour rules --------------------------------------------------------
# Rule ids, names and conditions.
BEHAVIOUR_RULES = (
    ("BR-001", "at least two zero-payment months", "zero_payment_months >= 2"),
    ("BR-002", "at least two delinquent months", "delinquent_months >= 2"),
    ("BR-003", "recent delinquency deterioration", "recent_max_status > earlier_max_status"),
    ("BR-004", "latest bill at or above credit limit", "latest_utilization >= 1"),
    ("BR-005", "latest payment below 10 percent of prior positive bill",
     "payment_coverage >= 0 AND payment_coverage < 0.10D"),
)


def customer_behaviour(borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT) -> DataFrame:
    """Per-key behaviour from the one-row history.

    Coverage here keeps negative prior bills; the signal of the same name does not.
    """
    hist = history(borrowers, panel, p)
    return hist.select(
        "customer_id",
        X.true_count([q == 0 for q in _over("payment", p)]).alias("zero_payment_months"),
        X.true_count([s > 0 for s in _over("severity", p)]).alias("delinquent_months"),
        recent_max(p).alias("recent_max_status"),
        earlier_max(p).alias("earlier_max_status"),
        X.utilization(_over("bill", p, 0, 0)[0], c("credit_limit_ntd")).alias("latest_utilization"),
        X.coverage_of_nonzero_bill(_over("payment", p, 0, 0)[0], _over("bill", p, -1, -1)[0]).alias("payment_coverage"),
    )


def behaviour_flags(
    borrowers: DataFrame, panel: DataFrame, p: PanelParams = DEFAULT, only: Iterable[str] | None = None
) -> DataFrame:
    """Evidence row per behaviour rule; flagged rows warn and never fail."""
    wanted = None if only is None else set(only)
    rules = [r for r in BEHAVIOUR_RULES if wanted is None or r[0] in wanted]
    flagged = customer_behaviour(borrowers, panel, p).agg(
        F.count(F.lit(1)).alias("tested"),
        *[count_where(F.expr(sql)).alias(ident) for ident, _, sql in rules],
    )
    rows = as_rows(
        flagged,
        [
            F.struct(
                F.lit(p.run_id).alias("pipeline_run_id"),
                F.lit(ident).alias("test_id"),
                F.lit(name).alias("test_name"),
                F.lit("business_rule").alias("test_type"),
                F.when(c(f"`{ident}`") == 0, "pass").otherwise("warn").alias("status"),
                F.lit("analytical_flag").alias("severity"),
                c("tested").alias("tested_rows"),
                c(f"`{ident}`").alias("failed_rows"),
                F.when(c("tested") == 0, F.lit(0.0)).otherwise(ratio(c(f"`{ident}`"), c("tested"))).alias("failure_rate"),
                F.lit("core.panel").alias("affected_object"),
            )
            for ident, name, _ in rules
        ],
    )
    return rows.select(*EVIDENCE)

"""Quality tests fire on damage, pass on clean tables, and guard what follows."""

import pytest
from pyspark.sql import functions as F

from riskpanel.functions.frames import GuardError
from riskpanel.operators import panel, population, quality, reconcile


def statuses(df):
    return {r.test_id: r.status for r in df.collect()}


def test_clean_tables(workspace):
    got = statuses(workspace.tests)
    assert len(got) == 18
    assert {t for t, s in got.items() if s != "pass"} <= {"DQ-016", "DQ-017", "DQ-018"}
    quality.require_minimum(workspace.tests, workspace.reconciliation)
    panel.require_parity(workspace.raw, workspace.borrowers, workspace.panel)


def change(workspace, raw=None, borrowers=None, cells=None):
    raw = workspace.raw if raw is None else raw
    borrowers = workspace.borrowers if borrowers is None else borrowers
    cells = workspace.panel if cells is None else cells
    rec = reconcile.reconciliation(raw, borrowers, cells)
    return quality.Tables(raw, borrowers, cells, workspace.registry, rec)


FIRST = "customer_id = 1"


@pytest.mark.parametrize(
    "which, damage, expected",
    [
        ("raw", lambda d: d.union(d.where("id = 1")), {"DQ-001", "DQ-002", "DQ-005", "DQ-006"}),
        ("cells", lambda d: d.where(f"NOT ({FIRST} AND month_offset = -2)"), {"DQ-003", "DQ-004", "DQ-005"}),
        ("cells", lambda d: d.withColumn("bill_amount_ntd", F.col("bill_amount_ntd") + 1), {"DQ-005"}),
        ("cells", lambda d: d.withColumn("payment_amount_ntd", F.col("payment_amount_ntd") + 1), {"DQ-006"}),
        ("borrowers", lambda d: d.withColumn("next_month_default", F.lit(2).cast("bigint")), {"DQ-007", "DQ-015"}),
        ("borrowers", lambda d: d.withColumn("credit_limit_ntd", F.lit(0).cast("bigint")), {"DQ-008", "DQ-014"}),
        ("borrowers", lambda d: d.withColumn("age_years", F.lit(17).cast("bigint")), {"DQ-009", "DQ-014"}),
        ("cells", lambda d: d.withColumn("repayment_status", F.lit(None).cast("bigint")), {"DQ-010"}),
        ("borrowers", lambda d: d.where(f"NOT ({FIRST})"), {"DQ-004", "DQ-011"}),
        ("cells", lambda d: d.withColumn("statement_month_end", F.date_sub("statement_month_end", 1)), {"DQ-012"}),
        ("borrowers", lambda d: d.withColumn("sex_code", F.lit(3).cast("bigint")), {"DQ-013", "DQ-014"}),
    ],
)
def test_damage_is_found(workspace, which, damage, expected):
    tables = change(workspace, **{which: damage({"raw": workspace.raw, "borrowers": workspace.borrowers, "cells": workspace.panel}[which])})
    got = statuses(quality.quality_suite(tables))
    assert expected <= {t for t, s in got.items() if s == "fail"}


def test_subset_runs_only_the_named_tests(workspace):
    one = quality.quality_suite(workspace.clean, only=["DQ-008"])
    assert list(statuses(one)) == ["DQ-008"]
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "repayment_status" not in plan and "pay_amt1" not in plan


def test_guards_block(workspace):
    damaged = quality.quality_suite(workspace.damaged)
    with pytest.raises(GuardError, match="no_failed_test"):
        quality.require_minimum(damaged, workspace.reconciliation)
    with pytest.raises(GuardError, match="enough_tests"):
        quality.require_minimum(workspace.tests.where("test_id < 'DQ-005'"), workspace.reconciliation)
    with pytest.raises(GuardError, match="no_failed_reconciliation"):
        quality.require_minimum(workspace.tests, workspace.damaged.reconciliation)
    with pytest.raises(GuardError):
        panel.require_parity(workspace.raw, workspace.borrowers, workspace.damaged.panel)


def test_behaviour_rules_never_fail(workspace):
    rows = quality.behaviour_flags(workspace.borrowers, workspace.panel).collect()
    assert len(rows) == 5 and {r.status for r in rows} <= {"pass", "warn"}
    assert all(r.severity == "analytical_flag" for r in rows)


def test_reconciliation_is_exact(workspace):
    rows = workspace.reconciliation.collect()
    assert len(rows) == 16 and all(r.difference == 0 and r.status == "pass" for r in rows)
    gone = reconcile.reconciliation(workspace.raw, workspace.borrowers, workspace.panel.where("month_offset <> -4"))
    failed = {r.reconciliation_id for r in gone.collect() if r.status == "fail"}
    assert failed == {"REC-002", "REC-003", "REC-004", "REC-BILL--4", "REC-PAYMENT--4"}


def test_frame_contract(workspace):
    population.require_frame_contract(workspace.extract)
    c = F.col
    bad = {
        "keys_unique": lambda d: d.union(d.where("customer_id = 1")),
        "binary_outcome": lambda d: d.withColumn("next_month_default", F.lit(2)),
        "both_outcomes": lambda d: d.where("next_month_default = 0"),
        "limit_positive": lambda d: d.withColumn("credit_limit_ntd", c("credit_limit_ntd") * 0),
        "metadata_constant": lambda d: d.withColumn("source_id", c("customer_id").cast("string")),
        "hash_is_sha256": lambda d: d.withColumn("source_file_sha256", F.upper("source_file_sha256")),
        "metadata_not_null": lambda d: d.withColumn("definition_version", F.lit(None).cast("string")),
        "not_empty": lambda d: d.where("false"),
    }
    for name, damage in bad.items():
        with pytest.raises(GuardError, match=name):
            population.require_frame_contract(damage(workspace.extract))
    with pytest.raises(ValueError, match="risk_band"):
        population.require_frame_contract(workspace.extract.drop("risk_band"))

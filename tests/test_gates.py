"""Gates fail closed; comparisons name every difference."""

import pytest
from pyspark.sql import functions as F

from riskpanel.definitions import REQUIRED_CHECKS
from riskpanel.functions.frames import fixed_rows
from riskpanel.operators import gates

CHECKS = [(g, check, "pass") for g, checks in REQUIRED_CHECKS.items() for check in checks]
SCHEMA = "gate int, check_id string, status string"


def rollup(spark, rows):
    return {r.gate: (r.own_status, r.status) for r in gates.gate_rollup(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_all_pass(spark):
    assert set(rollup(spark, CHECKS).values()) == {("pass", "pass")}


@pytest.mark.parametrize(
    "damage",
    [
        lambda rows: [r for r in rows if r[1] != "foreign_key"],
        lambda rows: rows + [(2, "foreign_key", "pass")],
        lambda rows: [(g, k, "fail" if k == "foreign_key" else s) for g, k, s in rows],
        lambda rows: [(g, k, "blocked" if k == "foreign_key" else s) for g, k, s in rows],
        lambda rows: [(g, k, None if k == "foreign_key" else s) for g, k, s in rows],
        lambda rows: rows + [(2, "extra", "fail")],
    ],
)
def test_one_fault_fails_its_gate_and_all_later_ones(spark, damage):
    assert rollup(spark, damage(CHECKS)) == {
        1: ("pass", "pass"), 2: ("fail", "fail"), 3: ("pass", "fail"), 4: ("pass", "fail"), 5: ("pass", "fail"),
    }


def rules_of(spark, gate, **metrics):
    row = fixed_rows(spark, {k: "bigint" for k in metrics}, [tuple(metrics.values())])
    return {r.metric: r.status for r in gates.gate(gates.metric_evidence(row), gate).collect()}


GOOD = {"registered_sources": 1, "sha256_valid": 1, "source_rows": 9, "source_columns": 25, "raw_rows": 9, "unlogged_rejects": 0}


def test_rules_fail_closed(spark):
    assert set(rules_of(spark, 1, **GOOD).values()) == {"pass"}
    for name, value in (("raw_rows", 8), ("unlogged_rejects", 1), ("sha256_valid", 0), ("source_columns", 0), ("source_rows", None)):
        assert rules_of(spark, 1, **{**GOOD, name: value})[name] == "fail"
    without = {k: v for k, v in GOOD.items() if k != "source_rows"}
    got = rules_of(spark, 1, **without)
    assert got["source_rows"] == "fail" and got["raw_rows"] == "fail"


def test_metric_given_twice_fails(spark):
    row = fixed_rows(spark, {k: "bigint" for k in GOOD}, [tuple(GOOD.values())])
    again = gates.metric_evidence(row, row.select("sha256_valid"))
    assert {r.metric for r in gates.gate(again, 1).where("status = 'fail'").collect()} == {"sha256_valid"}


def test_gates_of_the_run(workspace):
    got = {r.gate: r.status for r in gates.gate_rollup(workspace.gate_checks()).collect()}
    assert got == {1: "pass", 2: "pass", 3: "pass", 4: "fail", 5: "fail"}


def test_suite_checks(spark):
    names = "test_id string, status string, tested_rows bigint, failed_rows bigint, severity string, affected_object string"
    rows = [("t1", "pass", 5, 0, "high", "x"), ("t2", "warn", 5, 1, "high", "x"), ("t3", "pass", 5, 2, "high", "x"),
            ("t3", "pass", 5, 0, "high", "x"), ("t4", "pass", None, None, "", "x"), (" ", "pass", 1, 0, "high", "x")]
    r = gates.suite_checks(spark.createDataFrame(rows, names), minimum=4).first()
    assert (r.executed_tests, r.repeated_tests, r.not_passed, r.with_failed_rows, r.failed_tests) == (4, 1, 1, 2, 2)
    assert (r.without_failed_rows, r.incomplete, r.enough_tests) == (1, 1, True)


def test_compare_tables(spark):
    left = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.5), (3, "c", None), (4, "d", 1.0)], "k int, s string, x double")
    right = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.6), (3, "z", None), (5, "e", 1.0)], "k int, s string, x double")
    got = {tuple(r) for r in gates.compare_tables(left, right, ["k"], ["s"], ["x"]).collect()}
    assert got == {(2, "x", "differs"), (3, "s", "differs"), (4, "*", "left_only"), (5, "*", "right_only")}
    assert gates.compare_tables(left, left, ["k"], ["s"], ["x"]).count() == 0
    near = left.withColumn("x", F.col("x") + 1e-6)
    assert gates.compare_tables(left, near, ["k"], [], ["x"], tolerance=1e-5).count() == 0
    lost = left.withColumn("x", F.lit(None).cast("double"))
    assert gates.compare_tables(left, lost, ["k"], [], ["x"]).count() == 3
    changes = {tuple(r) for r in gates.compare_runs(left, right, ["k"], ["s"]).collect()}
    assert changes == {(3, "changed", "s"), (4, "removed", None), (5, "added", None)}


def test_shared_identity(spark):
    names = "pipeline_run_id string, definition_version string, source_file_sha256 string"
    a = spark.createDataFrame([("r", "1", "h")] * 2, names)
    both = gates.shared_identity({"a": a, "b": a}).collect()
    assert len(both) == 6 and all(r.shared for r in both)
    for other, field in (
        (a.withColumn("definition_version", F.lit("2")), "definition_version"),
        (a.withColumn("pipeline_run_id", F.lit(None).cast("string")), "pipeline_run_id"),
        (a.drop("source_file_sha256"), "source_file_sha256"),
    ):
        got = gates.shared_identity({"a": a, "b": other}).collect()
        assert {r.field for r in got if not r.shared} == {field}


def test_claim_cover(spark):
    identity = fixed_rows(spark, {"run_id": "string", "evidence_sha256": "string"}, [("r", "h")])
    required = spark.createDataFrame([(x,) for x in "abcd"], "claim_id string")
    rows = [("a", "r", "h"), ("b", "old", "h"), ("c", "r", "h"), ("c", "r", None), ("z", "r", "h")]
    r = gates.claim_cover(spark.createDataFrame(rows, "claim_id string, run_id string, evidence_sha256 string"), required, identity).first()
    assert (r.claims, r.repeated_claims, r.unneeded_claims, r.mismatched_claims) == (5, 1, 1, 2)
    assert (r.missing_claims, r.unresolved_claims) == (1, 2)


def test_repeated_keys_are_named_and_multiply_nothing(spark):
    left = spark.createDataFrame([(1, "a")] * 3 + [(2, "x")], "k int, v string")
    right = spark.createDataFrame([(1, "b")] * 4 + [(2, "y")], "k int, v string")
    found = sorted((r.k, r.field, r.problem) for r in gates.compare_tables(left, right, ["k"], exact=["v"]).collect())
    assert found == [(1, "*", "left_repeated"), (1, "*", "right_repeated"), (2, "v", "differs")]


def test_mixed_runs_do_not_share_an_identity(spark):
    two = spark.createDataFrame([("RUN-001",), ("RUN-002",)], "pipeline_run_id string")
    one, none = two.limit(1), spark.createDataFrame([(None,)], "pipeline_run_id string")
    assert gates.run_identity({"a": one, "b": one}).first()[0] == 1
    assert gates.run_identity({"a": two, "b": two}).first()[0] == 2
    assert gates.run_identity({"a": one, "b": none.union(one)}).first()[0] is None

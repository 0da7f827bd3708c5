"""Gate roll-up that fails closed, and comparisons of tables and runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.definitions import AMOUNT_TOLERANCE, MINIMUM_SIGNALS, MINIMUM_TESTS, REQUIRED_CHECKS
from riskpanel.functions.frames import count_where, fixed_rows, one_per_key

c = F.col

# Fixed values: (gate, check, metric, comparison, bound, other metric). A rule
# compares with the other metric when one is named, else with the bound.
RULES = (
    (1, "source_registered", "registered_sources", "ge", 1.0, None),
    (1, "sha256_recorded", "sha256_valid", "eq", 1.0, None),
    (1, "source_shape_recorded", "source_rows", "gt", 0.0, None),
    (1, "source_shape_recorded", "source_columns", "gt", 0.0, None),
    (1, "raw_rows_reconciled", "raw_rows", "eq", 0.0, "source_rows"),
    (1, "raw_rows_reconciled", "unlogged_rejects", "eq", 0.0, None),
    (2, "primary_key", "duplicate_borrower_keys", "eq", 0.0, None),
    (2, "primary_key", "null_borrower_keys", "eq", 0.0, None),
    (2, "primary_key", "duplicate_panel_keys", "eq", 0.0, None),
    (2, "foreign_key", "orphan_panel_rows", "eq", 0.0, None),
    (2, "wide_to_long_rows", "borrower_rows", "gt", 0.0, None),
    (2, "wide_to_long_rows", "borrower_rows", "eq", 0.0, "raw_rows"),
    (2, "wide_to_long_rows", "periods", "eq", 6.0, None),
    (2, "wide_to_long_rows", "panel_rows", "eq", 0.0, "expected_panel_rows"),
    (2, "bill_amounts", "bill_difference", "abs_le", AMOUNT_TOLERANCE, None),
    (2, "payment_amounts", "payment_difference", "abs_le", AMOUNT_TOLERANCE, None),
    (2, "code_domains", "invalid_code_rows", "eq", 0.0, None),
    (2, "code_domains", "missing_history_rows", "eq", 0.0, None),
    (2, "sql_test_suite", "executed_tests", "ge", float(MINIMUM_TESTS), None),
    (2, "sql_test_suite", "failed_tests", "eq", 0.0, None),
    (3, "signal_count", "signals", "ge", float(MINIMUM_SIGNALS), None),
    (3, "definition_version", "version_present", "eq", 1.0, None),
    (3, "observation_timing", "timing_reviewed", "eq", 0.0, "signals"),
    (3, "observation_timing", "timing_violations", "eq", 0.0, None),
    (3, "leakage", "leakage_reviewed", "eq", 0.0, "signals"),
    (3, "leakage", "leakage_violations", "eq", 0.0, None),
    (3, "outcome_summary", "summary_rows", "gt", 0.0, None),
    (3, "outcome_summary", "signals_with_summary", "eq", 0.0, "signals"),
    (3, "outcome_summary", "invalid_summaries", "eq", 0.0, None),
    (3, "outcome_summary", "band_rows", "gt", 0.0, None),
    (3, "outcome_summary", "signal_default_total", "eq", 0.0, "band_default_total"),
    (3, "sql_reproducibility", "reproducible_signals", "eq", 0.0, "signals"),
    (4, "time_validation", "time_validation_completed", "eq", 1.0, None),
    (4, "calibration", "calibration_completed", "eq", 1.0, None),
    (4, "segment_stability", "segment_stability_completed", "eq", 1.0, None),
    (4, "sensitivity_direction", "sensitivity_completed", "eq", 1.0, None),
    (4, "proxy_labels", "missing_labels", "eq", 0.0, None),
    (5, "shared_run_id", "distinct_run_ids", "eq", 1.0, None),
    (5, "cross_artifact_values", "mismatches", "eq", 0.0, None),
    (5, "limitations", "limitations_documented", "eq", 1.0, None),
    (5, "evidence_map", "unresolved_claims", "eq", 0.0, None),
)


def rule_table(spark: SparkSession, gates: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    columns = {
        "gate": "int", "check_id": "string", "metric": "string",
        "comparison": "string", "bound": "double", "other_metric": "string",
    }
    return fixed_rows(spark, columns, [r for r in RULES if r[0] in gates])


def required_checks(spark: SparkSession) -> DataFrame:
    rows = [(gate, check) for gate, checks in REQUIRED_CHECKS.items() for check in checks]
    return fixed_rows(spark, {"gate": "int", "check_id": "string"}, rows)


def metric_evidence(*one_row: DataFrame) -> DataFrame:
    """``(metric, value)`` from one-row aggregates; numbers become exact decimals."""
    parts = []
    for df in one_row:
        cells = [
            F.struct(F.lit(n).alias("metric"), c(n).cast("decimal(38,4)").alias("value")) for n in df.columns
        ]
        parts.append(df.select(F.explode(F.array(*cells)).alias("m")).select("m.*"))
    return reduce(DataFrame.unionByName, parts)


def apply_rules(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Evaluate every rule; absent or NULL evidence is a fail.

    Evidence has one row per metric name, so it fits one map value, computed
    once for all rules. A metric given twice fails its rules.
    """
    per_metric = evidence.groupBy("metric").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))
    entries = F.collect_list(F.struct("metric", F.when(c("n") == 1, c("value")).alias("value")))
    joined = rules.withColumn("_known", per_metric.agg(F.map_from_entries(entries)).scalar())
    joined = joined.withColumn("value", F.try_element_at("_known", c("metric")))
    other = F.try_element_at("_known", c("other_metric"))
    limit = F.when(c("other_metric").isNull(), c("bound").cast("decimal(38,4)")).otherwise(other)
    holds = (
        F.when(c("comparison") == "eq", c("value") == limit)
        .when(c("comparison") == "ge", c("value") >= limit)
        .when(c("comparison") == "gt", c("value") > limit)
        .when(c("comparison") == "abs_le", F.abs("value") <= limit)
    )
    return joined.select(
        "gate",
        "check_id",
        "metric",
        "comparison",
        c("value").cast("double").alias("observed"),
        limit.cast("double").alias("allowed"),
        F.when(F.coalesce(holds, F.lit(False)), "pass").otherwise("fail").alias("status"),
    )


def gate(evidence: DataFrame, number: int) -> DataFrame:
    """Rule results of one gate."""
    return apply_rules(evidence, rule_table(evidence.sparkSession, (number,)))


def check_results(rules: DataFrame) -> DataFrame:
    """One row per check: pass only when all its rules pass."""
    return rules.groupBy("gate", "check_id").agg(
        F.when(count_where(c("status") != "pass") == 0, "pass").otherwise("fail").alias("status")
    )


def gate_rollup(checks: DataFrame) -> DataFrame:
    """Status per gate from recorded checks.

    A required check that is missing, recorded twice or not passed fails its
    gate, so does any other recorded check that is not passed; a failed gate
    fails every later one.
    """
    spark = checks.sparkSession
    recorded = checks.groupBy("gate", "check_id").agg(
        F.count(F.lit(1)).alias("n"), count_where(~c("status").eqNullSafe(F.lit("pass"))).alias("not_passed")
    )
    needed = required_checks(spark).withColumn("_required", F.lit(True))
    both = needed.join(recorded, ["gate", "check_id"], "full_outer")
    own = both.groupBy("gate").agg(
        count_where(c("_required").isNotNull()).alias("required"),
        count_where(c("n").isNull()).alias("missing"),
        count_where(c("n") > 1).alias("duplicated"),
        count_where(c("not_passed") > 0).alias("not_passed"),
    )
    faults = c("missing") + c("duplicated") + c("not_passed")
    reach = own.select(
        F.explode(F.sequence(c("gate"), F.lit(max(REQUIRED_CHECKS)))).alias("gate"), faults.alias("faults")
    )
    inherited = reach.groupBy("gate").agg(F.sum("faults").alias("faults_so_far"))
    return own.join(inherited, "gate").select(
        "gate",
        "required",
        "missing",
        "duplicated",
        "not_passed",
        F.when(faults == 0, "pass").otherwise("fail").alias("own_status"),
        F.when(c("faults_so_far") == 0, "pass").otherwise("fail").alias("status"),
    )


def suite_checks(tests: DataFrame, minimum: int = MINIMUM_TESTS) -> DataFrame:
    """One row of faults over test evidence: repeats, status, failed rows, fields.

    ``failed_tests`` counts a test once, whether by status or by failed rows.
    """
    blank = F.trim("test_id") == ""
    incomplete = c("tested_rows").isNull() | c("severity").isNull() | (c("severity") == "") | c(
        "affected_object"
    ).isNull() | (c("affected_object") == "")
    not_pass = ~c("status").eqNullSafe(F.lit("pass"))
    has_failed = c("failed_rows").isNotNull() & (c("failed_rows") != 0)
    per_test = tests.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(not_pass).alias("not_pass"),
        count_where(has_failed).alias("nonzero"),
        count_where(not_pass | has_failed).alias("failed"),
        count_where(c("failed_rows").isNull()).alias("invalid"),
        count_where(incomplete).alias("incomplete"),
        F.max(F.coalesce(blank, F.lit(True))).alias("blank"),
    )
    named = per_test.where(~c("blank"))
    result = named.agg(
        F.count(F.lit(1)).alias("executed_tests"),
        count_where(c("n") > 1).alias("repeated_tests"),
        count_where(c("not_pass") > 0).alias("not_passed"),
        count_where(c("nonzero") > 0).alias("with_failed_rows"),
        count_where(c("failed") > 0).alias("failed_tests"),
        count_where(c("invalid") > 0).alias("without_failed_rows"),
        count_where(c("incomplete") > 0).alias("incomplete"),
    )
    return result.withColumn("enough_tests", c("executed_tests") >= minimum)


def compare_tables(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    exact: Sequence[str] = (),
    floats: Sequence[str] = (),
    tolerance: float = 1e-15,
) -> DataFrame:
    """Mismatches ``(keys, field, problem)``: rows on one side only, keys that a
    side repeats, exact fields that differ (NULL equals NULL), numbers further
    apart than the tolerance.

    Each side is reduced to one row per key before they meet, so a key that is
    repeated gives one ``left_repeated`` or ``right_repeated`` and no product.
    """
    fields = [*exact, *floats]
    joined = one_per_key(left, keys, fields, "left").join(one_per_key(right, keys, fields, "right"), list(keys), "full_outer")
    l_only, r_only = c("right_rows").isNull(), c("left_rows").isNull()
    repeated = (c("left_rows") > 1) | (c("right_rows") > 1)

    def problem(condition: Column, field: str, name: str) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(name).alias("problem")))

    def apart(f: str) -> Column:
        a, b = c(f"left_low.{f}"), c(f"right_low.{f}")
        return ~(a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))

    differs = {f: ~c(f"left_low.{f}").eqNullSafe(c(f"right_low.{f}")) for f in exact} | {f: apart(f) for f in floats}
    problems = [
        problem(l_only, "*", "left_only"),
        problem(r_only, "*", "right_only"),
        problem(c("left_rows") > 1, "*", "left_repeated"),
        problem(c("right_rows") > 1, "*", "right_repeated"),
        *[problem(~l_only & ~r_only & ~repeated & d, f, "differs") for f, d in differs.items()],
    ]
    any_problem = reduce(lambda a, b: a | b, [p.isNotNull() for p in problems])
    listed = joined.where(any_problem).select(*keys, F.explode(F.array(*problems)).alias("p"))
    return listed.where("p IS NOT NULL").select(*keys, "p.*")


IDENTITY = ("pipeline_run_id", "definition_version", "source_file_sha256")


def identity_ends(tables: dict[str, DataFrame], fields: Sequence[str] = IDENTITY) -> DataFrame:
    """Per table and field: smallest and largest value, and whether every row has one."""
    parts = []
    for name, df in tables.items():
        held = [f for f in fields if f in df.columns]
        summed = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.min(f).alias(f"low_{f}") for f in held],
            *[F.max(f).alias(f"high_{f}") for f in held],
            *[F.count(f).alias(f"n_{f}") for f in held],
        )
        cells = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(f).alias("field"),
                (c(f"low_{f}") if f in held else F.lit(None)).cast("string").alias("low"),
                (c(f"high_{f}") if f in held else F.lit(None)).cast("string").alias("high"),
                ((c(f"n_{f}") == c("rows")) & (c("rows") > 0) if f in held else F.lit(False)).alias("complete"),
            )
            for f in fields
        ]
        parts.append(summed.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def shared_identity(tables: dict[str, DataFrame], fields: Sequence[str] = IDENTITY) -> DataFrame:
    """Per table and field: smallest and largest value, and whether all tables share one.

    A table without the field, or with NULL in it, does not share it.
    """
    every = identity_ends(tables, fields)
    overall = every.groupBy("field").agg(
        F.min("low").alias("_low"), F.max("high").alias("_high"), F.min("complete").alias("_complete")
    )
    return every.join(overall, "field").select(
        "table_name",
        "field",
        "low",
        "high",
        (c("_complete") & (c("_low") == c("_high"))).eqNullSafe(F.lit(True)).alias("shared"),
    )


def run_identity(tables: dict[str, DataFrame], field: str = "pipeline_run_id") -> DataFrame:
    """One row: ``distinct_run_ids`` over all tables, NULL where a table lacks one in some row.

    Smallest and largest value of every table count, so tables that hold the
    same two runs give two.
    """
    ends = identity_ends(tables, (field,)).select("complete", F.explode(F.array("low", "high")).alias("run"))
    return ends.agg(F.when(F.min("complete"), F.count_distinct("run")).alias("distinct_run_ids"))


def reproduced_signals(left: DataFrame, right: DataFrame, signals: Sequence[str], key: str = "customer_id") -> DataFrame:
    """One row: ``reproducible_signals``, how many signals two computations agree on for every key."""
    names = list(signals)
    both = one_per_key(left, [key], names, "left").join(one_per_key(right, [key], names, "right"), key, "full_outer")
    whole = (c("left_rows") == 1) & (c("right_rows") == 1)
    apart = [
        count_where(~(whole & c(f"left_low.{s}").eqNullSafe(c(f"right_low.{s}"))).eqNullSafe(F.lit(True))).alias(f"apart_{i}")
        for i, s in enumerate(names)
    ]
    counts = both.agg(F.count(F.lit(1)).alias("keys"), *apart)
    agreed = sum((F.when((c(f"apart_{i}") == 0) & (c("keys") > 0), 1).otherwise(0) for i in range(len(names))), F.lit(0))
    return counts.select(agreed.cast("bigint").alias("reproducible_signals"))


def signal_review(summary: DataFrame, inputs: dict[str, tuple[Sequence[str], Sequence[int]]], forbidden: Sequence[str]) -> DataFrame:
    """One row: timing and leakage of the signals that have outcome rows.

    ``inputs`` declares the columns and month offsets that each signal reads.
    A signal without a declaration is not reviewed. Timing is broken by a month
    after the observation (an offset above 0), leakage by a forbidden column.
    """
    spark = summary.sparkSession
    columns = {"signal_name": "string", "late": "int", "leaks": "int"}
    rows = [(n, int(max(offsets) > 0), int(bool(set(cols) & set(forbidden)))) for n, (cols, offsets) in inputs.items()]
    declared = fixed_rows(spark, columns, rows)
    seen = summary.select("signal_name").distinct().join(F.broadcast(declared), "signal_name", "left")
    return seen.agg(
        F.count("late").alias("timing_reviewed"),
        F.count("leaks").alias("leakage_reviewed"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("timing_violations"),
        F.coalesce(F.sum("leaks"), F.lit(0)).alias("leakage_violations"),
    )


def claim_cover(claims: DataFrame, required: DataFrame, identity: DataFrame) -> DataFrame:
    """One row: repeated, unneeded, mismatched, missing and unresolved claims.

    A claim carries ``claim_id, run_id, evidence_sha256``; ``identity`` is one
    row with the run and digest that all claims must name. A required claim is
    unresolved when it is absent or none of its records names that evidence.
    """
    expected = identity.select(F.struct("run_id", "evidence_sha256").alias("e"))
    marked = claims.withColumn("_e", expected.scalar())
    good = c("run_id").eqNullSafe(c("_e.run_id")) & c("evidence_sha256").eqNullSafe(c("_e.evidence_sha256"))
    per_claim = marked.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), count_where(good).alias("good"))
    needed = required.select("claim_id").distinct().withColumn("_required", F.lit(True))
    both = per_claim.join(needed, "claim_id", "full_outer")
    is_required = c("_required").isNotNull()
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("claims"),
        count_where(c("n") > 1).alias("repeated_claims"),
        count_where(~is_required).alias("unneeded_claims"),
        F.coalesce(F.sum(c("n") - c("good")), F.lit(0)).alias("mismatched_claims"),
        count_where(is_required & c("n").isNull()).alias("missing_claims"),
        count_where(is_required & (F.coalesce("good", F.lit(0)) == 0)).alias("unresolved_claims"),
    )


def compare_runs(previous: DataFrame, latest: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Changes between two runs: ``added``, ``removed``, repeated keys, or the changed fields by name."""
    found = compare_tables(previous, latest, keys, exact=fields)
    change = (
        F.when(c("problem") == "left_only", "removed")
        .when(c("problem") == "right_only", "added")
        .when(c("problem").endswith("_repeated"), c("problem"))
        .otherwise("changed")
    )
    return found.select(*keys, change.alias("change"), F.when(c("field") != "*", c("field")).alias("field"))


def run_change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change", "field").agg(F.count(F.lit(1)).alias("rows"))

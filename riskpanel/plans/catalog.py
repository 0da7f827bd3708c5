"""Every query of the repository with its SQL counterpart.

A query takes a session and a data folder and returns a frame; the SQL runs on
the same tables elsewhere. Dates are given as text, and sums of fractions are
rounded to nine decimals on both sides, because their last bits depend on the
order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.definitions import SIGNALS
from riskpanel.operators import gates, ingest, lineage, metrics, model, outcomes, panel, population, quality, reconcile
from riskpanel.operators import signals as sig
from riskpanel.operators import split, walks
from riskpanel.functions.frames import exact_medians, fixed_rows
from riskpanel.plans import oracle_fits as fits
from riskpanel.plans import oracle_tables as O
from riskpanel.plans.workspace import Workspace
from riskpanel.session import cut_lineage
from riskpanel.sources import adapter, tables

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(key: str, build: Callable[[Workspace], DataFrame], sql: str | None = None, **blocks: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Workspace(spark, sf_dir))

    run.__name__ = key
    QUERIES[key] = run
    if sql is not None:
        ORACLE[key] = O.build(sql, **blocks)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(c(n), 9) for n in names})


def dates_as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: c(n).cast("string") for n in names})


def R(*names: str) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


# --- A: sources, ingest, sinks -------------------------------------------------
ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)
CELLS = ("id", "user", "amount")
STATES = ("empty", "replay", "partial", "conflict")


def _cells(w: Workspace) -> DataFrame:
    return adapter.text_cells(w.spark, w.sf_dir)


add(
    "a01_read_table",
    lambda w: tables.read_table(w.spark, f"{w.sf_dir}/orders.parquet", ORDERS),
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders",
)
add(
    "a04_reject_cells",
    lambda w: ingest.reject_cells(_cells(w), CELLS),
    "SELECT row_no, col_no, field, reason, raw_value FROM cell_rejects",
)
add(
    "a05_reject_duplicates",
    lambda w: ingest.reject_duplicates(ingest.parsed(_cells(w), CELLS), "id"),
    "SELECT row_no, CAST(1 AS BIGINT) AS col_no, 'id' AS field, 'duplicate id' AS reason, id::VARCHAR AS raw_value FROM numbered WHERE copy > 1",
)
add(
    "a06_accepted_rows",
    lambda w: ingest.accepted_rows(_cells(w), CELLS, "id"),
    "SELECT row_no, k, id, \"user\", amount FROM numbered WHERE copy = 1",
)
add(
    "a06_reject_summary",
    lambda w: ingest.reject_summary(_cells(w), CELLS, "id"),
    "SELECT (SELECT count(*) FROM cells) AS source_rows, (SELECT count(*) FROM numbered WHERE copy = 1) AS parsed_rows, "
    "(SELECT count(DISTINCT row_no) FROM cell_rejects) + (SELECT count(*) FROM numbered WHERE copy > 1) AS rejected_rows, "
    "(SELECT count(*) FROM cell_rejects) + (SELECT count(*) FROM numbered WHERE copy > 1) AS rejected_cells",
)
add(
    "a07_row_number",
    lambda w: ingest.with_row_number(w.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey", start=3),
    "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) + 2 AS source_row_number FROM orders",
)
O.BLOCKS["target_partial"] = "SELECT * FROM raw WHERE education <> 6"
O.BLOCKS["target_conflict"] = "SELECT * REPLACE (CASE WHEN marriage = 0 THEN limit_bal + 1 ELSE limit_bal END AS limit_bal) FROM raw"
O.BLOCKS["target_replay"] = "SELECT * FROM raw"
O.BLOCKS["target_empty"] = "SELECT * FROM raw WHERE false"
_EQUAL = " AND ".join(f"b.{f} IS NOT DISTINCT FROM t.{f}" for f in O.FIELDS)
add(
    "a08_find_conflicts",
    lambda w: ingest.find_conflicts(w.raw, w.target("conflict"), "id", w.fields),
    f"SELECT b.id FROM raw b JOIN target_conflict t ON t.id = b.id WHERE NOT ({_EQUAL})",
)
add(
    "a09_new_rows",
    lambda w: ingest.new_rows(w.raw, w.target("partial"), "id"),
    "SELECT id, " + ", ".join(O.FIELDS) + " FROM raw WHERE id NOT IN (SELECT id FROM target_partial)",
)
add(
    "a10_matching_rows",
    lambda w: ingest.matching_rows(w.raw, w.target("conflict"), "id", w.fields),
    f"SELECT count(*) AS matching_rows FROM raw b JOIN target_conflict t ON t.id = b.id WHERE {_EQUAL}",
)
add(
    "a11_load_summary",
    lambda w: reduce(
        DataFrame.unionByName,
        [ingest.load_summary(w.raw, w.target(s), "id", w.fields).select(F.lit(s).alias("state"), "*") for s in STATES],
    ),
    " UNION ALL ".join(
        f"SELECT '{s}' AS state, (SELECT count(*) FROM raw) AS staged_rows, "
        f"(SELECT count(*) FROM raw WHERE id NOT IN (SELECT id FROM target_{s})) AS inserted_rows, "
        f"(SELECT count(*) FROM raw b JOIN target_{s} t ON t.id = b.id WHERE {_EQUAL}) AS existing_matching_rows, "
        f"(SELECT count(*) FROM raw b JOIN target_{s} t ON t.id = b.id WHERE NOT ({_EQUAL})) AS conflicting_rows, "
        f"(SELECT count(*) FROM target_{s}) + (SELECT count(*) FROM raw WHERE id NOT IN (SELECT id FROM target_{s})) AS target_rows_after"
        for s in STATES
    ),
)
add(
    "a12_source_identity",
    lambda w: ingest.source_identity(w.raw),
    "SELECT min(source_id) AS source_id, min(source_file_sha256) AS source_file_sha256, "
    "count(DISTINCT (source_id, source_file_sha256)) AS identities, count(*) AS raw_rows FROM raw",
)
add(
    "a13_fingerprint_files",
    lambda w: tables.compare_fingerprints(
        tables.fingerprint_files(w.spark, w.sf_dir, "*.parquet"),
        tables.fingerprint_files(w.spark, w.sf_dir, "[c-z]*.parquet").select("file_path", "file_sha256"),
    ),
)


def _held_sources(w: Workspace) -> DataFrame:
    """Registry that lacks sources with few columns and differs where they have ten."""
    held = adapter.registry(w.spark, w.sf_dir).where("column_count >= 5")
    return held.withColumn("data_row_count", c("data_row_count") + F.when(c("column_count") == 10, 1).otherwise(0))


add(
    "a14_register_source",
    lambda w: ingest.register_source(adapter.registry(w.spark, w.sf_dir), _held_sources(w)),
    "SELECT source_id, file_sha256, data_row_count, column_count, CASE WHEN column_count < 5 THEN 'insert' "
    "WHEN column_count = 10 THEN 'conflict' ELSE 'noop' END AS action FROM registered",
)
add(
    "a16_run_ledger",
    lambda w: dates_as_text(
        ingest.run_state(adapter.ledger_events(w.spark, w.sf_dir)).withColumns(
            {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in ("started_at", "completed_at")}
        )
    ),
    "SELECT run_id, (SELECT l.status FROM ledger l WHERE l.run_id = g.run_id ORDER BY l.event_time DESC, l.sequence DESC LIMIT 1) AS status, "
    "strftime(min(event_time), '%Y-%m-%d %H:%M:%S') AS started_at, "
    "strftime(max(event_time) FILTER (WHERE status IN ('succeeded', 'failed')), '%Y-%m-%d %H:%M:%S') AS completed_at, count(*) AS events "
    "FROM ledger g GROUP BY run_id",
)
add(
    "a17_latest_registered",
    lambda w: ingest.latest_registered(
        w.table("orders").select(
            c("o_orderpriority").alias("source_id"),
            c("o_orderdate").alias("registered_at"),
            F.lpad(c("o_orderkey").cast("string"), 20, "0").alias("file_sha256"),
            c("o_custkey").alias("data_row_count"),
        )
    ).select("source_id", "file_sha256", "data_row_count"),
    "SELECT source_id, file_sha256, data_row_count FROM (SELECT o_orderpriority AS source_id, lpad(o_orderkey::VARCHAR, 20, '0') AS file_sha256, "
    "o_custkey AS data_row_count, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x WHERE n = 1",
)

# --- B: projections, wide to long ----------------------------------------------
add(
    "b01_borrower",
    lambda w: dates_as_text(w.borrowers, "observation_date"),
    "SELECT * REPLACE (observation_date::VARCHAR AS observation_date) FROM borrower",
)
add(
    "b02_unpivot_periods",
    lambda w: dates_as_text(w.panel, "statement_month_end"),
    "SELECT * REPLACE (statement_month_end::VARCHAR AS statement_month_end) FROM panel",
)
add(
    "b03_panel_parity",
    lambda w: panel.panel_parity(w.damaged.raw, w.damaged.borrowers, w.damaged.panel).unionByName(
        panel.panel_parity(w.raw, w.borrowers, w.panel)
    ),
    " UNION ALL ".join(
        "SELECT raw_rows, borrower_rows, panel_rows, borrower_rows = raw_rows AS borrowers_match, panel_rows = 6 * borrower_rows AS panel_matches "
        f"FROM (SELECT (SELECT count(*) FROM raw{s}) AS raw_rows, (SELECT count(*) FROM borrower{s}) AS borrower_rows, "
        f"(SELECT count(*) FROM panel{s}) AS panel_rows) x"
        for s in ("_d", "")
    ),
)
add(
    "b04_run_filter",
    lambda w: panel.run_filter(
        w.signals.unionByName(w.signals.withColumn("pipeline_run_id", F.lit("RUN-002"))), "RUN-002"
    ).select("pipeline_run_id", "customer_id", "risk_points", "risk_band"),
    "SELECT 'RUN-002' AS pipeline_run_id, customer_id, risk_points, risk_band FROM signals",
)
_EXTRACT = [
    "customer_id", "next_month_default", "observation_date", "credit_limit_ntd", "sex_code", "education_code", "marriage_code",
    "age_years", *SIGNALS, "risk_band", "source_id", "source_file_sha256", "definition_version",
]
add(
    "b05_model_extract",
    lambda w: dates_as_text(w.extract, "observation_date"),
    "SELECT " + ", ".join(f"{x}::VARCHAR AS {x}" if x == "observation_date" else x for x in _EXTRACT) + " FROM extract",
)
add(
    "b06_period_end",
    lambda w: dates_as_text(
        panel.period_ends(w.panel, w.p.observation_date), "statement_month_end", "expected_month_end"
    ),
    "SELECT month_offset, statement_month_end::VARCHAR AS statement_month_end, count(*) AS panel_rows, "
    "statement_month_end::VARCHAR AS expected_month_end FROM panel GROUP BY month_offset, statement_month_end",
)

# --- R: reconciliations ------------------------------------------------------------
_METRIC = "SELECT reconciliation_id, metric_name, source_value, derived_value FROM {} WHERE {}"


def _metric_columns(df: DataFrame) -> DataFrame:
    return df.select("reconciliation_id", "metric_name", "source_value", "derived_value")


add(
    "r01_raw_to_borrower_rows",
    lambda w: _metric_columns(
        reconcile.row_count_metric(w.damaged.raw, w.damaged.borrowers, "REC-001", "raw_to_core_borrower_rows")
    ),
    _METRIC.format("rec_d", "reconciliation_id = 'REC-001'"),
)
add(
    "r02_borrower_to_panel_rows",
    lambda w: _metric_columns(
        reconcile.row_count_metric(
            w.damaged.borrowers, w.damaged.panel, "REC-002", "expected_to_actual_account_month_rows", w.p.n_periods
        )
    ),
    _METRIC.format("rec_d", "reconciliation_id = 'REC-002'"),
)
add(
    "r03_bill_total",
    lambda w: _metric_columns(reconcile.amount_metric(w.damaged.raw, w.damaged.panel, "bill")),
    _METRIC.format("rec_d", "reconciliation_id = 'REC-003'"),
)
add(
    "r04_payment_total",
    lambda w: _metric_columns(reconcile.amount_metric(w.damaged.raw, w.damaged.panel, "payment")),
    _METRIC.format("rec_d", "reconciliation_id = 'REC-004'"),
)
add(
    "r05_bill_by_period",
    lambda w: _metric_columns(reconcile.period_metrics(w.damaged.raw, w.damaged.panel, "bill")),
    _METRIC.format("rec_d", "reconciliation_id LIKE 'REC-BILL%'"),
)
add(
    "r06_payment_by_period",
    lambda w: _metric_columns(reconcile.period_metrics(w.damaged.raw, w.damaged.panel, "payment")),
    _METRIC.format("rec_d", "reconciliation_id LIKE 'REC-PAYMENT%'"),
)
add("r07_reconciliation_evidence", lambda w: w.reconciliation, "SELECT * FROM rec")
add("r07_reconciliation_evidence_damaged", lambda w: w.damaged.reconciliation, "SELECT * FROM rec_d")


def _altered_differences(w: Workspace) -> DataFrame:
    rec = w.damaged.reconciliation
    changed = rec.withColumn(
        "difference", F.when(c("reconciliation_id").endswith("-2"), c("difference") + 1).otherwise(c("difference"))
    )
    return reconcile.amount_tolerance(changed).select("reconciliation_id", "difference", "amount_status")


add(
    "r08_amount_tolerance",
    _altered_differences,
    "SELECT reconciliation_id, difference + (CASE WHEN reconciliation_id LIKE '%-2' THEN 1 ELSE 0 END) AS difference, "
    "CASE WHEN derived_value IS NULL THEN 'missing' WHEN reconciliation_id LIKE '%-2' THEN 'difference_altered' "
    "WHEN abs(difference) > 0.01 THEN 'outside_tolerance' ELSE 'pass' END AS amount_status FROM rec_d",
)

# --- C, D: quality and behaviour ------------------------------------------------------
_NAMES = (
    "key_unique", "registered_rows", "six_periods", "panel_rows", "bill_reconciles", "payment_reconciles", "outcome_binary",
    "limit_positive", "age_bounds", "required_fields", "panel_parent", "month_ends", "sex_codes", "attributes_equal",
    "outcomes_equal", "education_codes", "marriage_codes", "status_codes",
)
for _n, _name in enumerate(_NAMES, start=1):
    add(
        f"c{_n:02d}_{_name}",
        lambda w, test=f"DQ-{_n:03d}": quality.quality_suite(w.damaged, w.p, only=[test]),
        f"SELECT * FROM tests_d WHERE test_id = 'DQ-{_n:03d}'",
    )
add(
    "c19_grade",
    lambda w: quality.grade(
        w.damaged.borrowers.groupBy("education_code").agg(
            F.count(F.lit(1)).alias("tested_rows"), F.count_if(c("credit_limit_ntd") <= 0).alias("failed_rows")
        ).withColumn("severity", F.when(c("education_code") < 3, "medium").otherwise("high"))
    ),
    "SELECT education_code, tested_rows, failed_rows, severity, CASE WHEN failed_rows = 0 THEN 'pass' WHEN severity = 'medium' THEN 'warn' ELSE 'fail' END AS status, "
    "failed_rows::DOUBLE / tested_rows::DOUBLE AS failure_rate FROM (SELECT education_code, count(*) AS tested_rows, "
    "count(*) FILTER (WHERE credit_limit_ntd <= 0) AS failed_rows, CASE WHEN education_code < 3 THEN 'medium' ELSE 'high' END AS severity "
    "FROM borrower_d GROUP BY education_code) x",
)
_SAMPLE = (
    "SELECT '{0}' AS test_id, CAST(to_json(list(s ORDER BY {2})) AS VARCHAR) AS sample_json FROM "
    "(SELECT {{{3}}} AS s, {2} FROM {1} WHERE {4} ORDER BY {2} LIMIT 10) x"
)
add(
    "c20_bounded_sample",
    lambda w: quality.suite_samples(w.clean),
    " UNION ALL ".join(
        [
            _SAMPLE.format("DQ-016", "borrower", "customer_id", "'customer_id': customer_id, 'education_code': education_code",
                           "education_code NOT IN (1, 2, 3, 4)"),
            _SAMPLE.format("DQ-017", "borrower", "customer_id", "'customer_id': customer_id, 'marriage_code': marriage_code",
                           "marriage_code NOT IN (1, 2, 3)"),
            _SAMPLE.format("DQ-018", "panel", "customer_id, month_offset",
                           "'customer_id': customer_id, 'month_offset': month_offset, 'repayment_status': repayment_status",
                           "repayment_status NOT IN (-1, 1, 2, 3, 4, 5, 6, 7, 8, 9)"),
        ]
    ),
)
add(
    "c21_minimum_evidence",
    lambda w: quality.evidence_counts(
        quality.quality_suite(w.damaged, w.p), w.damaged.reconciliation
    ),
    "SELECT (SELECT count(*) FROM tests_d) AS executed_tests, (SELECT count(*) FROM tests_d WHERE status = 'fail') AS failed_tests, "
    "(SELECT count(*) FROM rec_d WHERE status = 'fail') AS failed_reconciliations",
)
add("c22_quality_suite", lambda w: w.stored().tests, "SELECT * FROM tests")
add("c22_quality_suite_damaged", lambda w: quality.quality_suite(w.damaged, w.p), "SELECT * FROM tests_d")

add("d01_customer_behaviour", lambda w: quality.customer_behaviour(w.borrowers, w.panel), "SELECT * FROM behaviour")
for _n, _name in enumerate(
    ("zero_payment_months", "delinquent_months", "deterioration", "utilisation", "low_coverage"), start=1
):
    add(
        f"d{_n + 1:02d}_{_name}",
        lambda w, rule=f"BR-{_n:03d}": quality.behaviour_flags(w.borrowers, w.panel, only=[rule]),
        f"SELECT * FROM flags WHERE test_id = 'BR-{_n:03d}'",
    )
add("d07_behaviour_flags", lambda w: quality.behaviour_flags(w.borrowers, w.panel), "SELECT * FROM flags")

# --- E: signals ---------------------------------------------------------------------
for _key, _name in (
    ("e01_recent_max", "recent_max_delinquency"),
    ("e02_delinquent_months", "delinquent_months_6m"),
    ("e03_deterioration", "delinquency_deterioration"),
    ("e04_utilisation", "latest_utilization_ratio"),
    ("e05_coverage", "payment_coverage_ratio"),
    ("e07_bill_growth", "recent_bill_growth"),
):
    add(
        _key,
        lambda w, name=_name: sig.signal(w.borrowers, w.panel, name),
        f"SELECT customer_id, {_name} FROM features",
    )
add(
    "e06_zero_streak",
    lambda w: sig.zero_streaks(w.panel).select("customer_id", "zero_payment_streak"),
    "SELECT customer_id, zero_payment_streak FROM zero_streak",
)
add(
    "e08_join_streak",
    lambda w: sig.join_streak(w.borrowers, sig.zero_streaks(w.panel)).select("customer_id", "zero_payment_streak"),
    "SELECT customer_id, zero_payment_streak FROM features",
)
add(
    "e09_risk_points",
    lambda w: sig.signal_table(w.borrowers, w.panel).select("customer_id", "risk_points"),
    "SELECT customer_id, risk_points FROM signals",
)
add(
    "e10_risk_band",
    lambda w: sig.signal_table(w.borrowers, w.panel).select("customer_id", "risk_band"),
    "SELECT customer_id, risk_band FROM signals",
)
_SIGNALS_SQL = "SELECT * REPLACE (observation_date::VARCHAR AS observation_date) FROM signals"
add(
    "e11_signal_table",
    lambda w: dates_as_text(sig.signal_table(w.borrowers, w.panel), "observation_date"),
    _SIGNALS_SQL,
)
add("e11_signal_table_wide", lambda w: dates_as_text(sig.signal_table_wide(w.raw), "observation_date"), _SIGNALS_SQL)
add(
    "e12_signal_domains",
    lambda w: sig.signal_domain_checks(
        w.signals.withColumns(
            {
                "risk_points": F.when(c("zero_payment_streak") == 6, 11).otherwise(c("risk_points")),
                "risk_band": F.when(c("delinquent_months_6m") == 4, "Severe").otherwise(c("risk_band")),
                "next_month_default": F.when(c("recent_max_delinquency") == 3, 2).otherwise(c("next_month_default")),
            }
        )
    ),
    "SELECT count(*) AS tested_rows, count(*) FILTER (WHERE recent_max_delinquency = 3) AS outcome_domain, "
    "count(*) FILTER (WHERE delinquent_months_6m NOT BETWEEN 0 AND 6) AS delinquent_months_domain, "
    "count(*) FILTER (WHERE zero_payment_streak NOT BETWEEN 0 AND 6) AS streak_domain, "
    "count(*) FILTER (WHERE zero_payment_streak = 6) AS points_domain, count(*) FILTER (WHERE delinquent_months_6m = 4) AS band_domain FROM signals",
)

# --- F: outcome tables -----------------------------------------------------------------
for _n, _name in enumerate(SIGNALS, start=1):
    add(
        f"f{_n:02d}_{_name}",
        lambda w, name=_name: outcomes.signal_summary(w.signals, w.p, [name]),
        f"SELECT * FROM summary WHERE signal_name = '{_name}'",
    )
add("f08_signal_summary", lambda w: w.summary, "SELECT * FROM summary")
add("f09_band_summary", lambda w: outcomes.band_summary(sig.signal_table(w.borrowers, w.panel)), "SELECT * FROM bands")
add(
    "f10_rate_consistency",
    lambda w: outcomes.rate_consistency(w.damaged_summary, w.bands),
    "SELECT signal_name, count(*) AS rows, count(*) FILTER (WHERE NOT sample_size > 0) AS bad_size, "
    "count(*) FILTER (WHERE default_count NOT BETWEEN 0 AND sample_size) AS bad_defaults, "
    "count(*) FILTER (WHERE abs(observed_default_rate - default_count::DOUBLE / sample_size::DOUBLE) > 1e-15::DOUBLE) AS bad_rate, "
    "count(*) - count(DISTINCT bucket) AS duplicate_buckets, count(*) FILTER (WHERE trim(bucket) = '') AS blank_buckets "
    "FROM groups_d GROUP BY signal_name",
    groups_d=O.groups_sql("summary_d"),
)
add(
    "f11_population_tie_out",
    lambda w: outcomes.population_tie_out(w.damaged_summary, w.bands, w.borrowers),
    "SELECT signal_name, CAST(sum(sample_size) AS BIGINT) AS sample_total, CAST(sum(default_count) AS BIGINT) AS default_total, "
    "(SELECT count(*) FROM borrower) AS borrower_rows, (SELECT CAST(sum(next_month_default) AS BIGINT) FROM borrower) AS borrower_defaults, "
    "sum(sample_size) = (SELECT count(*) FROM borrower) AND sum(default_count) = (SELECT sum(next_month_default) FROM borrower) AS ties_out "
    "FROM groups_d GROUP BY signal_name",
    groups_d=O.groups_sql("summary_d"),
)
add(
    "f12_direction",
    lambda w: outcomes.direction(w.summary),
    "SELECT signal_name, rate_low, rate_middle, rate_high, direction FROM direction",
)
add(
    "f13_missing_signals",
    lambda w: outcomes.missing_signals(w.damaged_summary),
    "SELECT signal_name FROM (VALUES " + ", ".join(f"('{s}')" for s in SIGNALS)
    + ") v(signal_name) WHERE signal_name NOT IN (SELECT signal_name FROM summary_d)",
)
add(
    "f14_percent_text",
    lambda w: outcomes.rate_text(w.summary).select("signal_name", "signal_bucket", "rate_text"),
    "SELECT signal_name, signal_bucket, (bp // 100)::VARCHAR || '.' || lpad((bp % 100)::VARCHAR, 2, '0') || '%' AS rate_text FROM ("
    "SELECT *, (20000 * default_count + sample_size) // (2 * sample_size) AS bp FROM summary) x",
)


def _damaged_integrity(w: Workspace) -> DataFrame:
    return population.integrity(
        w.damaged.borrowers.unionByName(w.damaged.borrowers.where("age_years = 17")), w.damaged.panel
    )


_INTEGRITY = (
    "SELECT (SELECT count(*) FROM (SELECT customer_id FROM borrower_i GROUP BY customer_id HAVING count(*) > 1) x) AS duplicate_borrower_keys, "
    "(SELECT count(*) FROM (SELECT customer_id, month_offset FROM panel_d GROUP BY customer_id, month_offset HAVING count(*) > 1) x) AS duplicate_panel_keys, "
    "(SELECT count(*) FROM borrower_i WHERE customer_id IS NULL) AS null_borrower_keys, "
    "(SELECT count(*) FROM panel_d WHERE customer_id NOT IN (SELECT customer_id FROM borrower_i)) AS orphan_panel_rows, "
    "(SELECT count(*) FROM borrower_i WHERE next_month_default NOT IN (0, 1) OR sex_code NOT IN (1, 2) OR credit_limit_ntd <= 0 "
    "OR age_years NOT BETWEEN 18 AND 120) AS invalid_code_rows, "
    "(SELECT count(*) FROM panel_d WHERE repayment_status IS NULL OR bill_amount_ntd IS NULL OR payment_amount_ntd IS NULL) AS missing_history_rows"
)
O.BLOCKS["borrower_i"] = "SELECT * FROM borrower_d UNION ALL SELECT * FROM borrower_d WHERE age_years = 17"
O.BLOCKS["integrity_d"] = _INTEGRITY
# Control ids, severities and names that results carry, written out apart from the operator.
_CONTROLS = (
    ("DQ-PK-BORROWER", "Critical", "(SELECT duplicate_borrower_keys FROM integrity_d)", "core.borrower"),
    ("DQ-PK-ACCOUNT-MONTH", "Critical", "(SELECT duplicate_panel_keys FROM integrity_d)", "core.panel"),
    ("DQ-NULL-BORROWER-KEY", "Critical", "(SELECT null_borrower_keys FROM integrity_d)", "core.borrower"),
    ("DQ-FK-ACCOUNT-MONTH", "Critical", "(SELECT orphan_panel_rows FROM integrity_d)", "core.panel"),
    ("DQ-CODE-DOMAIN", "High", "(SELECT invalid_code_rows FROM integrity_d)", "core tables"),
    ("DQ-MISSING-HISTORY", "High", "(SELECT missing_history_rows FROM integrity_d)", "core.panel"),
    ("DQ-SQL-FAILURES", "Critical", "(SELECT count(*) FROM tests WHERE test_id <= 'DQ-015' AND (status <> 'pass' OR failed_rows <> 0))", "all marts"),
    ("DQ-TIMING", "Critical", "0", "risk signals"),
    ("DQ-LEAKAGE", "Critical", "0", "risk signals"),
)


def _dq_summary(w: Workspace) -> DataFrame:
    return outcomes.dq_summary(
        _damaged_integrity(w),
        population.split_tests(w.tests).where("use = 'enforced'"),
        w.review.select("timing_violations", "leakage_violations"),
    )


add(
    "f15_dq_summary",
    lambda w: _dq_summary(w.stored()),
    "SELECT control_id, severity, CASE WHEN observed = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(observed AS BIGINT) AS observed, "
    "CAST(0 AS BIGINT) AS expectation, affected_output FROM ("
    + " UNION ALL ".join(
        f"SELECT '{i}' AS control_id, '{s}' AS severity, {v} AS observed, '{o}' AS affected_output" for i, s, v, o in _CONTROLS
    )
    + ") x",
)
_TIES = (
    ("source rows to raw rows", "(SELECT max(data_row_count) FROM registry)", "(SELECT count(*) FROM raw)"),
    ("raw rows to borrowers", "(SELECT count(*) FROM raw)", "(SELECT count(*) FROM borrower)"),
    ("borrowers x periods to panel rows", "6 * (SELECT count(*) FROM borrower)", "(SELECT count(*) FROM panel)"),
    ("wide bills to long bills", "(SELECT source_value FROM rec WHERE reconciliation_id = 'REC-003')", "(SELECT sum(bill_amount_ntd) FROM panel)"),
    ("wide payments to long payments", "(SELECT source_value FROM rec WHERE reconciliation_id = 'REC-004')", "(SELECT sum(payment_amount_ntd) FROM panel)"),
)
add(
    "f16_reconciliation_summary",
    lambda w: outcomes.reconciliation_summary(w.totals, w.p.n_periods),
    "SELECT metric, CAST(source AS BIGINT) AS source, CAST(derived AS BIGINT) AS derived, CAST(derived - source AS BIGINT) AS difference, "
    "CASE WHEN derived = source THEN 'PASS' ELSE 'FAIL' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {s} AS source, {d} AS derived" for m, s, d in _TIES)
    + ") x",
)

# --- G: population snapshot ---------------------------------------------------------------
_JOINED = "FROM borrower b JOIN signals_g s ON s.customer_id = b.customer_id"
O.BLOCKS["signals_g"] = (
    "SELECT customer_id FROM signals WHERE risk_points <> 5 UNION ALL SELECT -customer_id FROM signals WHERE zero_payment_streak = 6"
)
add(
    "g01_input_reconciliation",
    lambda w: population.input_reconciliation(
        w.borrowers,
        w.signals.where("risk_points <> 5").select("customer_id").unionByName(
            w.signals.where("zero_payment_streak = 6").select((-c("customer_id")).alias("customer_id"))
        ),
    ),
    f"SELECT (SELECT count(*) FROM borrower) AS borrower_rows, (SELECT count(*) FROM signals_g) AS signal_rows, (SELECT count(*) {_JOINED}) AS joined_rows, "
    f"(SELECT count(DISTINCT b.customer_id) {_JOINED}) AS distinct_joined_borrowers, "
    "(SELECT count(*) FROM borrower WHERE customer_id NOT IN (SELECT customer_id FROM signals_g)) AS borrower_without_signal, "
    "(SELECT count(*) FROM signals_g WHERE customer_id NOT IN (SELECT customer_id FROM borrower)) AS signal_without_borrower, "
    f"(SELECT CAST(sum(b.next_month_default) AS BIGINT) {_JOINED}) AS observed_defaults, (SELECT count(DISTINCT source_id) {_JOINED}) AS source_id_count, "
    f"(SELECT count(DISTINCT source_file_sha256) {_JOINED}) AS source_hash_count, (SELECT count(DISTINCT definition_version) {_JOINED}) AS definition_version_count, "
    f"(SELECT count(DISTINCT observation_date) {_JOINED}) AS observation_date_count",
)
add(
    "g02_core_counts",
    lambda w: population.core_counts(w.damaged.borrowers, w.damaged.panel),
    "SELECT (SELECT count(*) FROM borrower_d) AS borrower_rows, (SELECT count(*) FROM panel_d) AS panel_rows, "
    "(SELECT count(DISTINCT month_offset) FROM panel_d) AS periods",
)
add("g03_integrity", _damaged_integrity, "SELECT * FROM integrity_d")
add(
    "g04_unlogged_rejects",
    lambda w: population.unlogged_rejects(
        w.table("events").agg(F.count(F.lit(1)).alias("source_rows")),
        ingest.reject_summary(_cells(w), CELLS, "id").select(c("parsed_rows").alias("raw_rows")),
        adapter.ledger_events(w.spark, w.sf_dir),
    ),
    "SELECT source_rows, raw_rows, logged_rejects, greatest(source_rows - raw_rows - logged_rejects, 0) AS unlogged_rejects FROM ("
    "SELECT (SELECT count(*) FROM events) AS source_rows, (SELECT count(*) FROM numbered WHERE copy = 1) AS raw_rows, "
    "(SELECT coalesce(max(rejected_rows), 0) FROM ledger WHERE status = 'succeeded') AS logged_rejects) x",
)
add(
    "g05_split_tests",
    lambda w: population.split_tests(quality.quality_suite(w.damaged, w.p)),
    " UNION ALL ".join(
        f"SELECT '{u}' AS use, test_id, status, tested_rows, failed_rows, severity, affected_object FROM tests_d WHERE {x}"
        for u, x in (("enforced", "test_id <= 'DQ-015'"), ("warning", "status = 'warn'"))
    ),
)
add(
    "g06_frame_contract",
    lambda w: population.frame_contract(
        w.extract.withColumns(
            {
                "credit_limit_ntd": F.when(c("education_code") == 5, 0).otherwise(c("credit_limit_ntd")),
                "next_month_default": F.when(c("education_code") == 6, 2).otherwise(c("next_month_default")),
                "source_file_sha256": F.when(c("marriage_code") == 0, "ABC").otherwise(c("source_file_sha256")),
                "definition_version": F.when(c("marriage_code") == 2, None).otherwise(c("definition_version")),
            }
        ).unionByName(w.extract.where("age_years = 40"))
    ),
    "SELECT count(*) AS rows, count(*) FILTER (WHERE customer_id IS NULL) AS null_keys, "
    "(SELECT count(*) FROM (SELECT customer_id FROM extract_g GROUP BY customer_id HAVING count(*) > 1) x) AS duplicate_keys, "
    "count(*) FILTER (WHERE next_month_default = 1) AS positives, count(*) FILTER (WHERE next_month_default = 0) AS negatives, "
    "count(*) FILTER (WHERE NOT regexp_matches(source_file_sha256, '^[0-9a-f]{64}$')) AS bad_hash, count(*) FILTER (WHERE credit_limit_ntd <= 0) AS bad_limit, "
    "CAST(sum((source_id IS NULL)::INT + (source_file_sha256 IS NULL)::INT + (definition_version IS NULL)::INT + (observation_date IS NULL)::INT) AS BIGINT) AS null_metadata, "
    "count(*) FILTER (WHERE next_month_default NOT IN (0, 1)) AS bad_outcome, "
    "CAST((count(DISTINCT source_id) <> 1)::INT + (count(DISTINCT source_file_sha256) <> 1)::INT + (count(DISTINCT definition_version) <> 1)::INT "
    "+ (count(DISTINCT observation_date) <> 1)::INT AS BIGINT) AS varying_metadata FROM extract_g",
    extract_g="SELECT * REPLACE (CASE WHEN education_code = 5 THEN 0 ELSE credit_limit_ntd END AS credit_limit_ntd, "
    "CASE WHEN education_code = 6 THEN 2 ELSE next_month_default END AS next_month_default, "
    "CASE WHEN marriage_code = 0 THEN 'ABC' ELSE source_file_sha256 END AS source_file_sha256, "
    "CASE WHEN marriage_code = 2 THEN NULL ELSE definition_version END AS definition_version) FROM extract "
    "UNION ALL SELECT * FROM extract WHERE age_years = 40",
)
add(
    "g07_prepare_features",
    lambda w: rounded(
        population.prepare_features(w.borrowers).select("customer_id", "log_credit_limit", "age_band"), "log_credit_limit"
    ),
    "SELECT customer_id, round(ln(1 + credit_limit_ntd::DOUBLE), 9) AS log_credit_limit, CASE WHEN age_years < 30 THEN '<30' WHEN age_years < 40 THEN '30-39' "
    "WHEN age_years < 50 THEN '40-49' WHEN age_years < 60 THEN '50-59' ELSE '60+' END AS age_band FROM borrower",
)

# --- H: split, preprocessing, fit ------------------------------------------------------------
add(
    "h01_split_digest",
    lambda w: w.borrowers.select("customer_id", split.split_digest(c("customer_id")).alias("digest")),
    "SELECT customer_id, sha256('customer_sha256_v1:' || customer_id::VARCHAR) AS digest FROM borrower",
)
add(
    "h02_rank_split",
    lambda w: split.ranked(w.borrowers.select("customer_id")).select(
        "customer_id", "split_rank", split.cut(c("split_rank"), c("population_size")).alias("split")
    ),
    "SELECT customer_id, split_rank, split FROM split",
)
add(
    "h03_split_check",
    lambda w: split.split_check(split.rank_split(w.borrowers.select("customer_id", "next_month_default"))),
    "SELECT split, count(*) AS rows, count(*) FILTER (WHERE next_month_default = 1) AS positives, count(*) FILTER (WHERE next_month_default = 0) AS negatives, "
    "true AS known_split, count(DISTINCT next_month_default) = 2 AS both_classes FROM split GROUP BY split",
)
add(
    "h03_split_overlap",
    lambda w: split.split_overlap(
        w.damaged_population.withColumn("split", F.when(c("sex_code") == 1, c("split")).otherwise(F.lit("train"))), "borrower_id"
    ),
    "SELECT count(*) AS ids, count(*) FILTER (WHERE n > 1) AS repeated_ids, count(*) FILTER (WHERE k > 1) AS ids_in_two_splits FROM ("
    "SELECT borrower_id, count(*) AS n, count(DISTINCT CASE WHEN sex_code = 1 THEN split ELSE 'train' END) AS k FROM population_d GROUP BY borrower_id) x",
)
add(
    "h04_recompute_split",
    lambda w: split.recompute_split(
        split.rank_split(w.borrowers.select("customer_id", "age_years")).withColumn(
            "split", F.when(c("age_years") == 30, "test").otherwise(c("split"))
        )
    ),
    "SELECT CASE WHEN age_years = 30 THEN 'test' ELSE split END AS stored_split, count(*) AS rows, "
    "count(*) FILTER (WHERE age_years = 30 AND split <> 'test') AS mismatches FROM split s JOIN borrower b ON b.customer_id = s.customer_id GROUP BY 1",
)
_NUMERIC = ("log_credit_limit", "age_years", *SIGNALS)
O.BLOCKS["train"] = (
    "SELECT e.*, ln(1 + credit_limit_ntd::DOUBLE) AS log_credit_limit FROM extract e JOIN split s ON s.customer_id = e.customer_id WHERE s.split = 'train'"
)


def _train(w: Workspace) -> DataFrame:
    return w.frame.where("split = 'train'")


add(
    "h07_impute_median",
    lambda w: rounded(model.median_table(_train(w), _NUMERIC), "median"),
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) - count({f}) AS missing_in_train, round(median({f}::DOUBLE), 9) AS median FROM train" for f in _NUMERIC
    ),
)
add(
    "h07_exact_median_all",
    lambda w: exact_medians(w.signals, SIGNALS),
    " UNION ALL ".join(f"SELECT '{f}' AS feature, median({f}::DOUBLE) AS median, count({f}) AS n FROM signals" for f in SIGNALS),
)
add(
    "h08_standardise",
    lambda w: rounded(model.moments(_train(w), _NUMERIC), "mean", "sd"),
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({f}::DOUBLE), 9) AS mean, round(stddev_pop({f}::DOUBLE), 9) AS sd FROM train" for f in _NUMERIC
    ),
)


def _one_hot(w: Workspace) -> DataFrame:
    fitted = model.one_hot(_train(w), model.STATIC_CATEGORICAL)
    coded = fitted.apply(w.frame.select("customer_id", *model.STATIC_CATEGORICAL))
    return coded.select(
        "customer_id", *[F.array_join(model.vector_to_array(f"hot_{f}").cast("array<string>"), ",").alias(f) for f in model.STATIC_CATEGORICAL]
    )


def _hot_sql(field: str) -> str:
    """One place per text that train rows have, in text order."""
    known = f"(SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {field}::VARCHAR AS v FROM borrower b JOIN split x ON x.customer_id = b.customer_id WHERE x.split = 'train') k)"
    return f"array_to_string(list_transform({known}, lambda v: CASE WHEN v = {field}::VARCHAR THEN '1.0' ELSE '0.0' END), ',') AS {field}"


add(
    "h09_one_hot",
    _one_hot,
    "SELECT customer_id, " + ", ".join(map(_hot_sql, ("sex_code", "education_code", "marriage_code"))) + " FROM borrower",
)


def _newton(points: str) -> tuple[str, dict[str, str]]:
    """The last of twelve Newton steps of a logistic fit of y on x per model, and the blocks of all steps.

    The slope carries the nearly free penalty of the calibration fit.
    """
    blocks = {"fit_points": points, "newton_0": "SELECT DISTINCT model, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM fit_points"}
    for n in range(1, 13):
        blocks[f"newton_{n}"] = (
            "SELECT model, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM ("
            "SELECT model, a, b, sum(p - y) AS g0, sum((p - y) * x) + b / 1e6::DOUBLE AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, "
            "sum(p * (1 - p) * x * x) + 1 / 1e6::DOUBLE AS h11 FROM (SELECT d.model, x, y, a, b, 1 / (1 + exp(-(a + b * x))) AS p "
            f"FROM fit_points d JOIN newton_{n - 1} n ON n.model = d.model) q GROUP BY model, a, b) s"
        )
    return "newton_12", blocks


def _fit_points(rows: str) -> str:
    clipped = "least(greatest(predicted_pd, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"
    return f"SELECT model, ln({clipped} / (1 - {clipped})) AS x, actual_default::DOUBLE AS y FROM {rows}"


def _logistic(w: Workspace) -> DataFrame:
    """Penalised gradient of the fitted combined model at its solution: near 0 everywhere."""
    train = w.stored_frame.where("split = 'train'")
    pre = model.fit_preprocessing(train, *model.FEATURES["combined"])
    ready = pre.apply(train)
    fitted = model.fit_logistic(ready, model.OUTCOME)
    residual = model.score(ready, fitted).select(
        (c("raw_pd") - c(model.OUTCOME)).alias("e"), F.posexplode(model.vector_to_array("features")).alias("position", "x")
    )
    gradient = residual.groupBy("position").agg(F.sum(c("e") * c("x")).alias("g"))
    names = fixed_rows(
        w.spark,
        {"position": "int", "feature": "string", "coefficient": "double"},
        [(i, n, float(v)) for i, (n, v) in enumerate(zip(pre.names(), fitted.coefficients))],
    )
    # adding 0 turns -0 into 0
    return gradient.join(names, "position").select(
        "feature", F.round("coefficient", 6).alias("coefficient"), (F.round(c("g") + c("coefficient"), 6) + 0.0).alias("gradient")
    )


add("h10_fit_logistic", _logistic, fits.gradient("combined"), **fits.model_blocks("combined"))


def _fitted(w: Workspace, name: str = "combined") -> model.FittedModel:
    return model.fit_one(w.stored_frame, name)


add(
    "h11_score",
    lambda w: model.predictions([_fitted(w, "static")], w.stored_frame).select("model", "borrower_id", F.round("raw_pd", 7).alias("raw_pd")),
    "SELECT 'static' AS model, customer_id AS borrower_id, round(raw_pd, 7) AS raw_pd FROM static_raw WHERE split = 'test'",
    **fits.model_blocks("static"),
)


def _platt(w: Workspace) -> DataFrame:
    calibration = w.scored.where("split = 'calibration'")
    fitted = model.fit_platt(calibration, "p_combined", "next_month_default")
    return fixed_rows(w.spark, {"slope": "double", "intercept": "double"}, [(round(fitted.slope, 4), round(fitted.intercept, 4))])


_last, _steps = _newton(
    "SELECT 'combined' AS model, ln(p / (1 - p)) AS x, actual_default::DOUBLE AS y FROM (SELECT actual_default, least(greatest("
    "CAST('0x' || substr(sha256(borrower_id::VARCHAR), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p "
    "FROM population WHERE split = 'calibration') c"
)
add("h12_fit_platt", _platt, f"SELECT round(b, 4) AS slope, round(a, 4) AS intercept FROM {_last}", **_steps)
_RAW_P = "least(greatest(predicted_pd, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"
_PLATT = f"1.0::DOUBLE / (1 + exp(-(-0.2::DOUBLE + 0.9::DOUBLE * ln({_RAW_P} / (1 - {_RAW_P})))))"
add(
    "h13_apply_platt",
    lambda w: rounded(
        w.pred.select("model", "borrower_id", model.apply_platt(c("predicted_pd"), 0.9, -0.2).alias("calibrated_pd")), "calibrated_pd"
    ),
    f"SELECT model, borrower_id, round({_PLATT}, 9) AS calibrated_pd FROM pred",
)
add(
    "h14_check_platt",
    lambda w: model.check_platt(
        w.pred.withColumnRenamed("predicted_pd", "raw_pd").withColumn(
            "predicted_pd",
            model.apply_platt(c("raw_pd"), 0.9, -0.2) + F.when(c("education_code") == 6, 0.01).otherwise(0.0),
        ),
        0.9,
        -0.2,
    ),
    "SELECT model, count(*) AS rows, count(*) FILTER (WHERE education_code = 6) AS mismatches FROM pred GROUP BY model",
)
add(
    "h15_coefficients",
    lambda w: model.coefficients(_fitted(w, "behavioral")).withColumn("coefficient", F.round("coefficient", 6)),
    "SELECT 'behavioral' AS model, CAST(row_number() OVER (ORDER BY abs(t) DESC, feature) AS INTEGER) AS position, "
    f"feature AS transformed_feature, round(t, 6) AS coefficient FROM behavioral_theta WHERE feature <> '{fits.FREE}'",
    **fits.model_blocks("behavioral"),
)


def _three(w: Workspace) -> DataFrame:
    """Metrics of three fits. Probabilities are taken at nine decimals, so that equal rows tie in any order of addition."""
    fitted = model.fit_three(w.stored_frame)
    pred = model.predictions(fitted, w.stored_frame)
    return metrics.metric_table(pred.withColumn("predicted_pd", F.round("predicted_pd", 9))).withColumn("value", F.round("value", 6))


add("h16_fit_three", _three, "SELECT model, metric, round(value, 6) AS value FROM metric", **fits.fitted_predictions())


def _fit_certificates(w: Workspace) -> DataFrame:
    """Per model and fit: rows, whether the gradient at the returned coefficients is within its bound."""
    rows = [
        (m.name, kind, fit.rows, fit.gradient <= fit.bound)
        for m in model.fit_three(w.stored_frame)
        for kind, fit in (("outcome", m.logistic), ("calibration", m.platt.fit))
    ]
    return fixed_rows(w.spark, {"model": "string", "fit": "string", "rows": "bigint", "converged": "boolean"}, rows)


add(
    "h10_fit_gradient",
    _fit_certificates,
    "SELECT model, CASE split WHEN 'train' THEN 'outcome' ELSE 'calibration' END AS fit, count(*) AS rows, true AS converged "
    "FROM split, (VALUES ('static'), ('behavioral'), ('combined')) m(model) WHERE split <> 'test' GROUP BY model, split",
)

# --- I: metrics -------------------------------------------------------------------------------
add("i01_roc_auc", lambda w: rounded(metrics.roc_auc(w.pred), "roc_auc"), f"SELECT model, {R('roc_auc')} FROM auc")
add("i02_average_precision", lambda w: rounded(metrics.average_precision(w.pred), "pr_auc"), f"SELECT model, {R('pr_auc')} FROM pr")
add("i03_brier", lambda w: rounded(metrics.brier(w.pred), "brier_score"), f"SELECT model, {R('brier_score')} FROM base")
add("i04_log_loss", lambda w: rounded(metrics.log_loss(w.pred), "log_loss"), f"SELECT model, {R('log_loss')} FROM base")
add(
    "i05_calibration_bins",
    lambda w: rounded(metrics.calibration_bins(w.pred), "average_pd"),
    f"SELECT * REPLACE ({R('average_pd')}) FROM bins",
)
add(
    "i06_ece",
    lambda w: rounded(metrics.ece(w.pred), metrics.ECE),
    f"SELECT model, {R('expected_calibration_error_10_bin')} FROM ece",
)
add(
    "i07_base_rates",
    lambda w: rounded(metrics.base_rates(w.pred), "average_pd"),
    f"SELECT model, sample_count, default_count, default_rate, {R('average_pd')} FROM base",
)
_last, _steps = _newton(_fit_points("pred"))
add(
    "i08_calibration_diagnostic",
    lambda w: model.calibration_diagnostic(w.pred).select(
        "model", *[F.round(x, 4).alias(x) for x in ("calibration_intercept", "calibration_slope")]
    ),
    f"SELECT model, round(a, 4) AS calibration_intercept, round(b, 4) AS calibration_slope FROM {_last}",
    **_steps,
)
add(
    "i09_segments",
    lambda w: rounded(metrics.segments(w.pred.drop("education_code", "marriage_code"), w.population), "average_pd", "brier_score"),
    f"SELECT * REPLACE ({R('average_pd', 'brier_score')}) FROM seg",
)
add(
    "i01_merged_profiles",
    lambda w: rounded(
        metrics.profile_metrics(
            metrics.merged_profiles(
                reduce(DataFrame.unionByName, [metrics.rank_profile(w.pred.where(c("borrower_id") % 3 == k)) for k in range(3)])
            )
        ),
        "roc_auc",
        "pr_auc",
    ),
    f"SELECT auc.model, {R('roc_auc', 'pr_auc')} FROM auc JOIN pr ON pr.model = auc.model",
)
add(
    "i09_fitted_segments",
    lambda w: metrics.segments(w.fitted_pred, w.population).withColumns({n: F.round(n, 6) for n in ("average_pd", "brier_score")}),
    "SELECT * REPLACE (round(average_pd, 6) AS average_pd, round(brier_score, 6) AS brier_score) FROM seg",
    **fits.fitted_predictions(),
)
add(
    "i10_model_deltas",
    lambda w: rounded(metrics.model_deltas(w.metrics), "difference"),
    f"SELECT comparison, metric, {R('difference')} FROM deltas",
)
_KNOWN = "LEFT JOIN population p ON p.borrower_id = d.borrower_id WHERE d.model = m.model"
_PRED_ISSUES = {
    "duplicate_prediction_id": "(SELECT count(*) - count(DISTINCT d.borrower_id) FROM pred_d d JOIN population p ON p.borrower_id = d.borrower_id WHERE d.model = m.model)",
    "prediction_not_in_population": f"(SELECT count(*) FROM pred_d d {_KNOWN} AND p.borrower_id IS NULL)",
    "invalid_actual_default": "(SELECT count(*) FROM pred_d d WHERE d.model = m.model AND actual_default NOT IN (0, 1))",
    "invalid_probability": "(SELECT count(*) FROM pred_d d WHERE d.model = m.model AND NOT predicted_pd BETWEEN 0 AND 1)",
    "prediction_not_test": f"(SELECT count(*) FROM pred_d d {_KNOWN} AND (d.split <> 'test' OR p.split <> 'test'))",
    "prediction_outcome_mismatch": f"(SELECT count(*) FROM pred_d d {_KNOWN} AND d.actual_default <> p.actual_default)",
    "missing_prediction": "(SELECT count(*) FROM population p WHERE p.split = 'test' AND p.borrower_id NOT IN (SELECT borrower_id FROM pred_d d WHERE d.model = m.model))",
}
_MODELS = "FROM (VALUES ('static'), ('behavioral'), ('combined')) m(model)"
O.BLOCKS["pred_issues"] = " UNION ALL ".join(
    f"SELECT model, '{k}' AS issue, {v} AS rows {_MODELS}" for k, v in _PRED_ISSUES.items()
)
add(
    "i11_fitted_checks",
    lambda w: metrics.prediction_checks(w.fitted_pred, w.population),
    "SELECT model, issue, rows FROM pred_issues",
    **fits.fitted_predictions() | {"pred_d": "SELECT * FROM pred"},
)


def _damaged_fit(w: Workspace) -> DataFrame:
    """Checks of real predictions of which some are gone, some are repeated and some lie above 1."""
    pred = w.fitted_pred.where("NOT (model = 'combined' AND borrower_id % 7 = 0)")
    pred = pred.withColumn("predicted_pd", F.when((c("model") == "static") & (c("borrower_id") % 5 == 0), c("predicted_pd") + 1).otherwise(c("predicted_pd")))
    return metrics.prediction_checks(pred.unionByName(pred.where("model = 'behavioral' AND borrower_id % 11 = 0")), w.population)


add(
    "i11_damaged_fit_checks",
    _damaged_fit,
    "SELECT model, issue, rows FROM pred_issues",
    **fits.fitted_predictions()
    | {
        "pred_e": "SELECT * REPLACE (CASE WHEN model = 'static' AND borrower_id % 5 = 0 THEN predicted_pd + 1 ELSE predicted_pd END AS predicted_pd) "
        "FROM pred WHERE NOT (model = 'combined' AND borrower_id % 7 = 0)",
        "pred_d": "SELECT * FROM pred_e UNION ALL SELECT * FROM pred_e WHERE model = 'behavioral' AND borrower_id % 11 = 0",
    },
)
add("i11_prediction_checks", lambda w: metrics.prediction_checks(w.damaged_pred, w.population), "SELECT model, issue, rows FROM pred_issues")
_POP_ISSUES = {
    "invalid_population_row": "(SELECT count(*) FROM population_d WHERE borrower_id IS NULL)",
    "duplicate_population_id": "(SELECT count(*) - count(DISTINCT borrower_id) FROM population_d)",
    "invalid_actual_default": "(SELECT count(*) FROM population_d WHERE actual_default NOT IN (0, 1))",
    "invalid_split": "(SELECT count(*) FROM population_d WHERE split NOT IN ('train', 'calibration', 'test'))",
    "segment_field_missing": "(SELECT count(*) FROM population_d WHERE trim(age_band) = '')",
    "population_count_mismatch": "abs((SELECT count(*) FROM population_d) - (SELECT count(*) FROM borrower))",
    "population_default_count_mismatch": "abs((SELECT count(*) FROM population_d WHERE actual_default = 1) - (SELECT sum(next_month_default) FROM borrower))",
}


def _population_checks(w: Workspace) -> DataFrame:
    expected = w.borrowers.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("next_month_default").alias("d")).alias("e")).scalar()
    return metrics.population_checks(w.damaged_population, expected["n"], expected["d"])


add(
    "i12_population_checks",
    _population_checks,
    " UNION ALL ".join(f"SELECT '{k}' AS issue, CAST({v} AS BIGINT) AS rows" for k, v in _POP_ISSUES.items()),
)
add(
    "i13_same_rows_across_models",
    lambda w: metrics.same_rows_across_models(w.damaged_pred),
    "SELECT count(*) AS ids, count(*) FILTER (WHERE k < 3) AS population_mismatch, count(*) FILTER (WHERE v > 1) AS outcome_mismatch FROM ("
    "SELECT borrower_id, count(DISTINCT model) AS k, count(DISTINCT actual_default) AS v FROM pred_d GROUP BY borrower_id) x",
)


def _reported(w: Workspace) -> DataFrame:
    """Reported metrics with an altered, a non-finite and a missing value."""
    value = (
        F.when((c("model") == "static") & (c("metric") == "brier_score"), c("value") + 0.01)
        .when((c("model") == "combined") & (c("metric") == "roc_auc"), F.lit(float("nan")))
        .otherwise(c("value"))
    )
    return w.metrics.withColumn("value", value).where("NOT (model = 'behavioral' AND metric = 'pr_auc')")


add(
    "i14_compare_metrics",
    lambda w: rounded(metrics.compare_metrics(_reported(w), w.metrics).drop("reported"), "recomputed"),
    "SELECT model, metric, round(value, 9) AS recomputed, CASE WHEN model = 'static' AND metric = 'brier_score' THEN 'mismatch' "
    "WHEN (model = 'combined' AND metric = 'roc_auc') OR (model = 'behavioral' AND metric = 'pr_auc') THEN 'invalid_reported' ELSE 'match' END AS status FROM metric",
)


def _segment_comparison(w: Workspace) -> DataFrame:
    mine = metrics.segments(w.pred.drop("education_code", "marriage_code"), w.population)
    theirs = mine.where("NOT (segment_field = 'risk_band' AND segment_value = 'Low')").withColumn(
        "default_count", F.when(c("segment_field") == "sex_code", c("default_count") + 1).otherwise(c("default_count"))
    )
    return metrics.compare_segments(theirs, mine)


add(
    "i15_compare_segments",
    _segment_comparison,
    "SELECT model, segment_field, segment_value, field, CASE WHEN segment_field = 'risk_band' AND segment_value = 'Low' THEN 'segment_not_reported' "
    "WHEN segment_field = 'sex_code' AND field = 'default_count' THEN 'mismatch' ELSE 'match' END AS status FROM seg, "
    "(VALUES ('sample_count'), ('default_count'), ('default_rate'), ('average_pd'), ('brier_score')) f(field)",
)
add(
    "i16_compare_deltas",
    lambda w: rounded(
        metrics.compare_deltas(
            metrics.model_deltas(w.metrics).withColumn(
                "difference", F.when(c("metric") == "ece_difference", c("difference") + 0.001).otherwise(c("difference"))
            ),
            w.metrics,
        ),
        "reported",
        "recomputed",
    ),
    "SELECT comparison, metric, round(difference + CASE WHEN metric = 'ece_difference' THEN 0.001::DOUBLE ELSE 0 END, 9) AS reported, "
    "round(difference, 9) AS recomputed, CASE WHEN metric = 'ece_difference' THEN 'mismatch' ELSE 'match' END AS status FROM deltas",
)


def _statuses(w: Workspace) -> DataFrame:
    """Status of the damaged predictions, of clean ones, and of clean ones with a blocker."""
    def issues(pred: DataFrame) -> DataFrame:
        return metrics.prediction_checks(pred, w.population).select("issue", "rows")

    bands = w.bands.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("time_direction_unavailable").alias("issue"), "rows")
    parts = (
        ("damaged", issues(w.damaged_pred)), ("clean", issues(w.pred)), ("blocked", issues(w.pred).unionByName(bands)),
    )
    return reduce(DataFrame.unionByName, [metrics.model_status(df).select(F.lit(n).alias("packet"), "*") for n, df in parts])


add(
    "i17_model_status",
    _statuses,
    "SELECT 'damaged' AS packet, (SELECT count(*) FROM pred_issues WHERE rows > 0) AS failures, 0 AS blockers, 'fail' AS status, false AS gate_4_eligible "
    "UNION ALL SELECT 'clean', 0, 0, 'pass', true UNION ALL SELECT 'blocked', 0, 1, 'blocked', false",
)



def _all_issues(w: Workspace) -> DataFrame:
    """Issues over damaged predictions and reports: at least one of every kind of comparison."""
    reported = metrics.compare_metrics(_reported(w), w.metrics)
    deltas = metrics.model_deltas(w.metrics).withColumn(
        "difference", F.when(c("metric") == "ece_difference", c("difference") + 0.001).otherwise(c("difference"))
    )
    one_class = w.pred.where("NOT (model = 'static' AND actual_default = 1)")
    return metrics.model_issues(
        one_class, w.population, w.borrowers.agg(F.count(F.lit(1))).scalar(), w.borrowers.agg(F.sum("next_month_default")).scalar(),
        reported, _segment_comparison(w), metrics.compare_deltas(deltas, w.metrics),
    ).where("rows > 0")


add(
    "i17_model_issues",
    _all_issues,
    "SELECT * FROM (WITH d AS (SELECT count(*) AS n FROM pred WHERE model = 'static' AND actual_default = 1), found AS ("
    "SELECT 'missing_prediction' AS issue, n AS rows FROM d UNION ALL SELECT 'population_mismatch_across_models', n FROM d "
    "UNION ALL SELECT 'single_class_test', 1 UNION ALL SELECT 'metric_mismatch', 1 UNION ALL SELECT 'metric_invalid_reported', 2 "
    "UNION ALL SELECT 'segment_segment_not_reported', count(*) * 5 FROM seg WHERE segment_field = 'risk_band' AND segment_value = 'Low' "
    "UNION ALL SELECT 'segment_mismatch', count(*) FROM seg WHERE segment_field = 'sex_code' "
    "UNION ALL SELECT 'difference_mismatch', count(*) FROM deltas WHERE metric = 'ece_difference') SELECT * FROM found WHERE rows > 0) q",
)

# --- J: graph -----------------------------------------------------------------------------------
_NODE_COLUMNS = "graph_scope, canonical_name, version, node_type, status, owner, path_or_object"


def _held_nodes(w: Workspace) -> DataFrame:
    return w.nodes.where("node_type <> 'Transformation'").withColumn(
        "owner", F.when(c("node_type") == "Source", "Other").otherwise(c("owner"))
    )


add(
    "j01_register_nodes",
    lambda w: lineage.node_actions(w.nodes, _held_nodes(w)),
    f"SELECT {_NODE_COLUMNS}, CASE node_type WHEN 'Transformation' THEN 'insert' WHEN 'Source' THEN 'conflict' ELSE 'noop' END AS action FROM node",
)


def _held_edges(w: Workspace) -> DataFrame:
    return w.edges.where("evidence_reference NOT LIKE 'evidence/n%'").withColumn(
        "status", F.when(c("edge_type") == "validated_by", "draft").otherwise(c("status"))
    )


_EDGE_COLUMNS = "graph_scope, from_node_id, to_node_id, edge_type, valid_from::VARCHAR AS valid_from"
add(
    "j02_register_edges",
    lambda w: dates_as_text(
        lineage.edge_actions(w.edges, _held_edges(w)).select(*lineage.EDGE_KEY, "evidence_reference", "status", "action"), "valid_from"
    ),
    f"SELECT {_EDGE_COLUMNS}, evidence_reference, status, CASE WHEN evidence_reference LIKE 'evidence/n%' THEN 'insert' "
    "WHEN edge_type = 'validated_by' THEN 'conflict' ELSE 'noop' END AS action FROM edge",
)
_TYPES = ", ".join(f"'{t}'" for t in lineage.NODE_TYPES)
_EDGE_TYPES = ", ".join(f"'{t}'" for t in lineage.EDGE_TYPES)
_SCOPES = "'economic_transmission', 'data_lineage'"
_NODE_RULES = {
    "scope": f"graph_scope NOT IN ({_SCOPES})",
    "type": f"node_type NOT IN ({_TYPES})",
    "blank_name": "trim(canonical_name) = ''",
    "blank_version": "trim(version) = ''",
    "blank_status": "trim(status) = ''",
    "blank_owner": "trim(owner) = ''",
    "blank_path": "trim(path_or_object) = ''",
}
add(
    "j03_node_violations",
    lambda w: lineage.node_violations(w.damaged_nodes),
    " UNION ALL ".join(f"SELECT graph_scope, canonical_name, version, '{k}' AS rule FROM node_d WHERE {v}" for k, v in _NODE_RULES.items()),
)
_EDGE_RULES = {
    "scope": f"graph_scope NOT IN ({_SCOPES})",
    "type": f"edge_type NOT IN ({_EDGE_TYPES})",
    "self_loop": "from_node_id = to_node_id",
    "sign": "expected_sign NOT IN ('positive', 'negative', 'mixed', 'unknown')",
    "negative_lag": "lag_months < 0",
    "lineage_with_sign_or_lag": "graph_scope = 'data_lineage' AND (expected_sign IS NOT NULL OR lag_months IS NOT NULL)",
    "blank_evidence": "trim(evidence_reference) = ''",
    "approved_without_evidence": "status = 'approved' AND evidence_reference IS NULL",
    "validity_window": "valid_to < valid_from",
    "blank_status": "trim(status) = ''",
}
add(
    "j04_edge_violations",
    lambda w: dates_as_text(lineage.edge_violations(w.damaged_edges), "valid_from"),
    " UNION ALL ".join(f"SELECT {_EDGE_COLUMNS}, '{k}' AS rule FROM edge_d WHERE {v}" for k, v in _EDGE_RULES.items()),
)
_EDGE_ENDS = (("from", "from_node_id"), ("to", "to_node_id"))
add(
    "j05_dangling_edges",
    lambda w: dates_as_text(lineage.dangling_edges(w.damaged_edges, w.nodes), "valid_from"),
    " UNION ALL ".join(
        f"SELECT {_EDGE_COLUMNS}, '{e}' AS \"end\", {i} AS node_id FROM edge_d d WHERE NOT EXISTS "
        f"(SELECT 1 FROM node n WHERE n.graph_scope = d.graph_scope AND n.node_id = d.{i})"
        for e, i in _EDGE_ENDS
    ),
)
add(
    "j06_cross_scope_edges",
    lambda w: dates_as_text(lineage.cross_scope_edges(w.cross_edges, w.nodes), "valid_from"),
    " UNION ALL ".join(
        f"SELECT d.graph_scope, from_node_id, to_node_id, edge_type, valid_from::VARCHAR AS valid_from, '{e}' AS \"end\", {i} AS node_id, "
        f"n.graph_scope AS node_scope FROM edge_x d JOIN node n ON n.node_id = d.{i} WHERE n.graph_scope <> d.graph_scope"
        for e, i in _EDGE_ENDS
    ),
)


def _paths(w: Workspace) -> DataFrame:
    return lineage.lineage_paths(w.edges, w.nodes, w.nodes.where("node_type IN ('Result', 'Table')"))


# A tree without cycles: a path is one to four joins.
O.BLOCKS["walk0"] = "SELECT canonical_name AS start, canonical_name AS node, CAST(0 AS BIGINT) AS depth, canonical_name AS names, '' AS types FROM node WHERE node_type IN ('Result', 'Table')"
for _d in range(1, 4):
    O.BLOCKS[f"walk{_d}"] = (
        f"SELECT w.start, e.to_name AS node, w.depth + 1 AS depth, w.names || '>' || e.to_name AS names, "
        f"CASE WHEN w.types = '' THEN e.edge_type ELSE w.types || '>' || e.edge_type END AS types "
        f"FROM walk{_d - 1} w JOIN named_edge e ON e.from_name = w.node"
    )
O.BLOCKS["walk"] = " UNION ALL ".join(f"SELECT * FROM walk{d}" for d in range(4))
add(
    "j07_lineage_paths",
    lambda w: _paths(w).select(
        F.element_at("name_path", 1).alias("start"),
        F.element_at("name_path", -1).alias("node"),
        "depth",
        F.array_join("name_path", ">").alias("names"),
        F.array_join("type_path", ">").alias("types"),
    ),
    "SELECT * FROM walk",
)


add(
    "j07_path_counts",
    lambda w: lineage.path_counts(w.edges, w.nodes.where("node_type IN ('Result', 'Table')"), nodes=w.nodes)
    .select("start", "node", "depth", c("paths").cast("bigint").alias("paths")),
    "SELECT start, node, depth, count(*) AS paths FROM walk GROUP BY start, node, depth",
)
TRADE_STEPS = 8


def _trade_paths(w: Workspace) -> DataFrame:
    """Ways from nation to nation over some steps, each from an order's customer to a supplier of it.

    A layer per step makes the graph one of many diamonds: with 25 nations that
    all trade there are 25 ** 7 paths between any two ends.
    """
    nation = lambda table, key, name: w.table(table).select(key, c(name).alias(key[0]))
    pairs = (
        w.table("lineitem").select("l_orderkey", "l_suppkey").distinct()
        .join(w.table("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
        .join(nation("customer", "c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
        .join(nation("supplier", "s_suppkey", "s_nationkey"), c("l_suppkey") == c("s_suppkey"))
        .select("c", "s").distinct()
    )
    layers = F.explode(F.sequence(F.lit(0), F.lit(TRADE_STEPS - 1))).alias("layer")
    hops = cut_lineage(pairs.select("c", "s", layers).select((c("layer") * 100 + c("c")).cast("bigint").alias("tail"), (c("layer") * 100 + 100 + c("s")).cast("bigint").alias("head")))
    starts = hops.where("tail < 100").select(c("tail").alias("node_id")).distinct()
    return walks.path_counts(hops, starts).withColumn("paths", c("paths").cast("bigint"))


add(
    "j07_trade_paths",
    _trade_paths,
    "SELECT s AS start_node_id, CAST(d * 100 + n AS BIGINT) AS node_id, d AS depth, p AS paths FROM trade_levels",
    trade="SELECT DISTINCT c_nationkey::BIGINT AS a, s_nationkey::BIGINT AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
    "JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey",
    trade_levels="WITH RECURSIVE l AS (SELECT DISTINCT a AS s, a AS n, 0::BIGINT AS d, 1::BIGINT AS p FROM trade UNION ALL "
    f"SELECT s, b, d + 1, CAST(sum(p) AS BIGINT) FROM l JOIN trade ON a = n WHERE d < {TRADE_STEPS} GROUP BY s, b, d) SELECT * FROM l",
)


def _named(w: Workspace, df: DataFrame) -> DataFrame:
    return df.join(w.nodes.select("node_id", "canonical_name"), "node_id").select("canonical_name", "depth")


add(
    "j08_reachable",
    lambda w: _named(w, lineage.reachable(w.edges, w.nodes.where("node_type = 'Result'"))),
    "SELECT node AS canonical_name, min(depth) AS depth FROM walk WHERE start LIKE 'o%' GROUP BY node",
)
add(
    "j09_impact",
    lambda w: _named(w, lineage.impact(w.edges, w.nodes.where("node_type = 'Source'"))),
    "SELECT canonical_name, CAST(CASE substr(canonical_name, 1, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 WHEN 'c' THEN 2 ELSE 3 END AS BIGINT) AS depth FROM node",
)
_STEPS = "e1.edge_type = 'computed_from' AND e2.edge_type = 'validated_by' AND e3.edge_type = 'computed_from'"
add(
    "j10_missing_paths",
    lambda w: lineage.missing_walks(
        w.damaged_edges,
        w.nodes,
        w.nodes.where("node_type = 'Table'").select(c("canonical_name").alias("feature")),
        2,
        ("^o[0-9]+$", "^c[0-9]+$", "^n[0-9]+$", "^r[0-9]+$"),
        ("computed_from", "validated_by", "computed_from"),
    ),
    "SELECT canonical_name AS feature FROM node WHERE node_type = 'Table' AND canonical_name NOT IN ("
    "SELECT e1.to_name FROM named_edge_d e1 JOIN named_edge_d e2 ON e2.from_name = e1.to_name JOIN named_edge_d e3 ON e3.from_name = e2.to_name "
    f"WHERE {_STEPS} AND e1.graph_scope = 'data_lineage' AND e2.graph_scope = 'data_lineage' AND e3.graph_scope = 'data_lineage')",
)
add(
    "j11_expected_graph_diff",
    lambda w: lineage.expected_graph_diff(
        w.nodes, w.damaged_nodes.drop("node_id"), ("graph_scope", "canonical_name", "version"), lineage.NODE_FIELDS
    ),
    "SELECT n.graph_scope, n.canonical_name, n.version, CASE WHEN d.canonical_name IS NULL THEN 'absent' ELSE 'differs' END AS problem FROM node n "
    "LEFT JOIN node_d d ON d.graph_scope = n.graph_scope AND d.canonical_name = n.canonical_name AND d.version = n.version "
    "WHERE d.canonical_name IS NULL OR n.node_type IS DISTINCT FROM d.node_type OR n.status IS DISTINCT FROM d.status "
    "OR n.owner IS DISTINCT FROM d.owner OR n.path_or_object IS DISTINCT FROM d.path_or_object",
)
add(
    "j11_type_counts",
    lambda w: lineage.type_counts(w.damaged_nodes, "node_type"),
    "SELECT node_type, status, count(*) AS rows FROM node_d GROUP BY node_type, status",
)
add(
    "j12_association_edges",
    lambda w: dates_as_text(lineage.association_edges(w.summary), "valid_from"),
    "SELECT 'economic_transmission' AS graph_scope, 'economic.' || signal_name AS from_name, 'economic.default_prototype' AS to_name, 'explains' AS edge_type, "
    "CASE WHEN association = 'mixed_association' THEN 'mixed' ELSE expected_sign END AS expected_sign, CAST(1 AS BIGINT) AS lag_months, "
    "'mart.signal_summary' AS evidence_reference, '2005-09-30' AS valid_from, association AS status FROM association WHERE association <> 'missing'",
)


def _pipeline(w: Workspace) -> tuple[DataFrame, DataFrame]:
    return lineage.pipeline_lineage(ingest.source_identity(w.raw), w.tests, w.summary, w.p)


add("j13_pipeline_nodes", lambda w: _pipeline(w)[0], "SELECT * FROM pipeline_node")
add(
    "j13_pipeline_edges",
    lambda w: dates_as_text(_pipeline(w)[1].drop("valid_to", "expected_sign", "lag_months"), "valid_from"),
    "SELECT * FROM pipeline_edge",
)


def _second_run(w: Workspace) -> DataFrame:
    """What registering the nodes of a second run does beside those of the first."""
    first, _ = _pipeline(w)
    second, _ = lineage.pipeline_lineage(ingest.source_identity(w.raw), w.tests, w.summary, replace(w.p, run_id="RUN-002"))
    return lineage.node_actions(second, first).select("canonical_name", "version", "action")


add(
    "j13_second_run",
    _second_run,
    "SELECT canonical_name, CASE WHEN version = 'RUN-001' THEN 'RUN-002' ELSE version END AS version, "
    "CASE WHEN version = 'RUN-001' THEN 'insert' ELSE 'noop' END AS action FROM pipeline_node",
)


def _pipeline_missing(w: Workspace) -> DataFrame:
    """Signals without a way back to the source in the run's own graph; one required name is no signal."""
    nodes, edges = _pipeline(w)
    required = fixed_rows(w.spark, {"feature": "string"}, [(f"signals.{s}",) for s in (*SIGNALS, "risk_points")])
    source = ingest.source_identity(w.raw).first().source_id
    return lineage.signals_without_path(nodes, edges, required, source)


add(
    "j10_pipeline_missing_paths",
    _pipeline_missing,
    "SELECT 'signals.risk_points' AS feature UNION ALL SELECT 'signals.' || s FROM (VALUES "
    + ", ".join(f"('{s}')" for s in SIGNALS) + ") v(s) WHERE s NOT IN (SELECT signal_name FROM summary)",
)

# --- K: gates and comparisons ---------------------------------------------------------------------
for _g in range(1, 6):
    add(
        f"k{_g:02d}_gate{_g}",
        lambda w, g=_g: gates.gate(w.stored().gate_evidence(g), g),
        f"SELECT * FROM ruled WHERE gate = {_g}",
        **(fits.fitted_predictions() if _g == 4 else {}),
    )


def _damaged_gates(w: Workspace) -> DataFrame:
    """Gates 4 and 5 of a run in which one model was never fitted and a signal has no outcome rows."""
    run = w.stored()
    run.fitted_pred = run.fitted_pred.where("model <> 'combined'")
    run.summary = run.summary.where("signal_name <> 'recent_bill_growth'")
    return gates.gate(run.gate_evidence(4), 4).unionByName(gates.gate(run.gate_evidence(5), 5))


_clean_summary = O.BLOCKS["summary"]
add(
    "k04_k05_damaged_gates",
    _damaged_gates,
    "SELECT * FROM ruled WHERE gate IN (4, 5)",
    **fits.fitted_predictions()
    | {
        "every_pred": fits.fitted_predictions()["pred"],
        "pred": "SELECT * FROM every_pred WHERE model <> 'combined'",
        "every_summary": _clean_summary,
        "summary": "SELECT * FROM every_summary WHERE signal_name <> 'recent_bill_growth'",
    },
)


def _two_runs(w: Workspace) -> DataFrame:
    """Run ids of tables that each hold the same two runs, and of tables of which one lacks some."""
    def twice(df: DataFrame) -> DataFrame:
        return df.unionByName(df.withColumn("pipeline_run_id", F.lit("RUN-002")))

    mixed = {"borrower": twice(w.borrowers), "panel": twice(w.panel)}
    lacking = w.borrowers.withColumn("pipeline_run_id", F.when(c("customer_id") % 2 == 0, c("pipeline_run_id")))
    parts = {"clean": {"borrower": w.borrowers, "panel": w.panel}, "mixed": mixed, "lacking": {"borrower": lacking, "panel": w.panel}}
    found = [gates.gate(gates.metric_evidence(gates.run_identity(t)), 5).where("check_id = 'shared_run_id'").select(F.lit(n).alias("packet"), "observed", "status") for n, t in parts.items()]
    return reduce(DataFrame.unionByName, found)


add(
    "k05_run_identity_damaged",
    _two_runs,
    "SELECT 'clean' AS packet, count(DISTINCT pipeline_run_id)::DOUBLE AS observed, 'pass' AS status FROM borrower "
    "UNION ALL SELECT 'mixed', count(DISTINCT pipeline_run_id) + 1.0::DOUBLE, 'fail' FROM borrower UNION ALL SELECT 'lacking', NULL, 'fail'",
)


def _other_signals(w: Workspace) -> DataFrame:
    """Signals that a second computation with one altered value agrees on, and a review of bad declarations."""
    again = sig.signal_table_wide(w.raw, w.p).withColumn("recent_bill_growth", F.when(c("risk_points") > 3, F.lit(-9.0)).otherwise(c("recent_bill_growth")))
    inputs = sig.signal_inputs(w.p) | {"zero_payment_streak": (("payment_amount_ntd",), (0, 1)), "recent_max_delinquency": (("next_month_default",), (0,))}
    del inputs["recent_bill_growth"]
    review = gates.signal_review(w.summary, inputs, ("next_month_default",))
    return gates.metric_evidence(gates.reproduced_signals(w.signals, again, SIGNALS), review).select("metric", c("value").cast("double").alias("value"))


add(
    "k03_signal_review_damaged",
    _other_signals,
    "SELECT * FROM (WITH n AS (SELECT count(DISTINCT signal_name) - count(DISTINCT CASE WHEN signal_name = 'recent_bill_growth' THEN 1 END) AS seen FROM summary) "
    "SELECT 'reproducible_signals' AS metric, (SELECT CASE WHEN count(*) > 0 THEN 6 ELSE 7 END FROM signals WHERE risk_points > 3)::DOUBLE AS value "
    "UNION ALL SELECT 'timing_reviewed', seen::DOUBLE FROM n UNION ALL SELECT 'leakage_reviewed', seen::DOUBLE FROM n "
    "UNION ALL SELECT 'timing_violations', count(DISTINCT signal_name)::DOUBLE FROM summary WHERE signal_name = 'zero_payment_streak' "
    "UNION ALL SELECT 'leakage_violations', count(DISTINCT signal_name)::DOUBLE FROM summary WHERE signal_name = 'recent_max_delinquency') q",
)
add(
    "k06_gate_rollup",
    lambda w: gates.gate_rollup(w.gate_checks()),
    "SELECT gate, required, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS duplicated, bad AS not_passed, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS own_status, "
    "CASE WHEN sum(bad) OVER (ORDER BY gate) = 0 THEN 'pass' ELSE 'fail' END AS status FROM ("
    "SELECT gate, count(*) AS required, count(*) FILTER (WHERE status <> 'pass') AS bad FROM checks GROUP BY gate) x",
)
add(
    "k07_suite_checks",
    lambda w: gates.suite_checks(
        quality.quality_suite(w.damaged, w.p).unionByName(w.tests.where("test_id = 'DQ-016'"))
    ),
    "SELECT count(DISTINCT test_id) AS executed_tests, CAST(1 AS BIGINT) AS repeated_tests, count(DISTINCT test_id) FILTER (WHERE status <> 'pass') AS not_passed, "
    "count(DISTINCT test_id) FILTER (WHERE failed_rows <> 0) AS with_failed_rows, count(DISTINCT test_id) FILTER (WHERE status <> 'pass' OR failed_rows <> 0) AS failed_tests, "
    "CAST(0 AS BIGINT) AS without_failed_rows, CAST(0 AS BIGINT) AS incomplete, count(DISTINCT test_id) >= 12 AS enough_tests FROM ("
    "SELECT * FROM tests_d UNION ALL SELECT * FROM tests WHERE test_id = 'DQ-016') x",
)


def _second_run(w: Workspace) -> DataFrame:
    """The next run: points and band change for some, some leave, some join."""
    changed = w.signals.where("delinquent_months_6m <> 5").withColumns(
        {
            "risk_points": F.when(c("zero_payment_streak") == 3, c("risk_points") + 1).otherwise(c("risk_points")),
            "latest_utilization_ratio": F.when(
                c("zero_payment_streak") == 4, c("latest_utilization_ratio") + 0.5
            ).otherwise(c("latest_utilization_ratio")),
            "customer_id": F.when(c("zero_payment_streak") == 6, -c("customer_id")).otherwise(c("customer_id")),
        }
    )
    return changed


O.BLOCKS["second"] = (
    "SELECT * REPLACE (CASE WHEN zero_payment_streak = 3 THEN risk_points + 1 ELSE risk_points END AS risk_points, "
    "CASE WHEN zero_payment_streak = 4 THEN latest_utilization_ratio + 0.5::DOUBLE ELSE latest_utilization_ratio END AS latest_utilization_ratio, "
    "CASE WHEN zero_payment_streak = 6 THEN -customer_id ELSE customer_id END AS customer_id) FROM signals WHERE delinquent_months_6m <> 5"
)
_PAIR = "FROM signals l JOIN second r ON r.customer_id = l.customer_id"
_ONLY = (
    "SELECT customer_id, '*' AS field, 'left_only' AS problem FROM signals WHERE customer_id NOT IN (SELECT customer_id FROM second) "
    "UNION ALL SELECT customer_id, '*', 'right_only' FROM second WHERE customer_id NOT IN (SELECT customer_id FROM signals)"
)
add(
    "k09_compare_tables",
    lambda w: gates.compare_tables(
        w.signals, _second_run(w), ["customer_id"], ["risk_points", "risk_band"], ["latest_utilization_ratio", "payment_coverage_ratio"]
    ),
    f"{_ONLY} UNION ALL SELECT l.customer_id, 'risk_points', 'differs' {_PAIR} WHERE l.risk_points IS DISTINCT FROM r.risk_points "
    f"UNION ALL SELECT l.customer_id, 'latest_utilization_ratio', 'differs' {_PAIR} WHERE abs(l.latest_utilization_ratio - r.latest_utilization_ratio) > 1e-15::DOUBLE",
)
O.BLOCKS["second_identity"] = "SELECT *, 'x' AS source_file_sha256 FROM (SELECT * REPLACE (CASE WHEN risk_band = 'High' THEN '0.2.0' ELSE definition_version END AS definition_version) FROM signals) s"


def _identity(w: Workspace) -> DataFrame:
    marked = w.signals.withColumn(
        "definition_version", F.when(c("risk_band") == "High", "0.2.0").otherwise(c("definition_version"))
    ).withColumn("source_file_sha256", F.lit("x"))
    return gates.shared_identity(
        {"borrower": w.borrowers, "panel": w.panel.withColumn("source_file_sha256", F.lit("x")), "signals": marked}
    )


add(
    "k10_shared_identity",
    _identity,
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{f}' AS field, min({'source_file_sha256' if f == 'source_file_sha256' else f}) AS low, max({f}) AS high, "
        f"{'true' if f == 'pipeline_run_id' else 'false'} AS shared FROM {t}"
        for n, t in (("borrower", "borrower"), ("panel", "panel_identity"), ("signals", "second_identity"))
        for f in ("pipeline_run_id", "definition_version", "source_file_sha256")
    ),
    panel_identity="SELECT *, 'x' AS source_file_sha256 FROM panel",
)


def _claims(w: Workspace) -> DataFrame:
    """One claim per borrower; some name another run, some are repeated, some are gone."""
    claims = w.borrowers.where("education_code <> 6").select(
        c("customer_id").cast("string").alias("claim_id"),
        F.when(c("marriage_code") == 0, "RUN-000").otherwise(c("pipeline_run_id")).alias("run_id"),
        c("source_file_sha256").alias("evidence_sha256"),
        "age_years",
    )
    required = w.borrowers.where("sex_code = 1").select(c("customer_id").cast("string").alias("claim_id"))
    identity = ingest.source_identity(w.raw).select(
        F.lit(w.p.run_id).alias("run_id"), c("source_file_sha256").alias("evidence_sha256")
    )
    return gates.claim_cover(claims.unionByName(claims.where("age_years = 50")), required, identity)


add(
    "k11_claim_cover",
    _claims,
    "SELECT (SELECT count(*) FROM claim) AS claims, (SELECT count(*) FROM (SELECT claim_id FROM claim GROUP BY claim_id HAVING count(*) > 1) x) AS repeated_claims, "
    "(SELECT count(DISTINCT claim_id) FROM claim WHERE claim_id NOT IN (SELECT claim_id FROM needed)) AS unneeded_claims, "
    "(SELECT count(*) FROM claim WHERE run_id <> 'RUN-001') AS mismatched_claims, "
    "(SELECT count(*) FROM needed WHERE claim_id NOT IN (SELECT claim_id FROM claim)) AS missing_claims, "
    "(SELECT count(*) FROM needed WHERE claim_id NOT IN (SELECT claim_id FROM claim WHERE run_id = 'RUN-001')) AS unresolved_claims",
    claim0="SELECT customer_id::VARCHAR AS claim_id, CASE WHEN marriage_code = 0 THEN 'RUN-000' ELSE 'RUN-001' END AS run_id, age_years FROM borrower WHERE education_code <> 6",
    claim="SELECT * FROM claim0 UNION ALL SELECT * FROM claim0 WHERE age_years = 50",
    needed="SELECT customer_id::VARCHAR AS claim_id FROM borrower WHERE sex_code = 1",
)
add(
    "k12_compare_runs",
    lambda w: gates.compare_runs(w.signals, _second_run(w), ["customer_id"], ["risk_points", "risk_band", "latest_utilization_ratio"]),
    "SELECT customer_id, CASE problem WHEN 'left_only' THEN 'removed' ELSE 'added' END AS change, CAST(NULL AS VARCHAR) AS field FROM only_one "
    f"UNION ALL SELECT l.customer_id, 'changed', 'risk_points' {_PAIR} WHERE l.risk_points <> r.risk_points "
    f"UNION ALL SELECT l.customer_id, 'changed', 'latest_utilization_ratio' {_PAIR} WHERE l.latest_utilization_ratio <> r.latest_utilization_ratio",
    only_one=_ONLY,
)
add(
    "k12_run_change_counts",
    lambda w: gates.run_change_counts(
        gates.compare_runs(w.signals, _second_run(w), ["customer_id"], ["risk_points", "risk_band", "latest_utilization_ratio"])
    ),
    "SELECT change, field, count(*) AS rows FROM ("
    "SELECT customer_id, CASE problem WHEN 'left_only' THEN 'removed' ELSE 'added' END AS change, CAST(NULL AS VARCHAR) AS field FROM only_one "
    f"UNION ALL SELECT l.customer_id, 'changed', 'risk_points' {_PAIR} WHERE l.risk_points <> r.risk_points "
    f"UNION ALL SELECT l.customer_id, 'changed', 'latest_utilization_ratio' {_PAIR} WHERE l.latest_utilization_ratio <> r.latest_utilization_ratio) x GROUP BY change, field",
    only_one=_ONLY,
)


def entry_query(w: Workspace) -> DataFrame:
    """Flagship: panel, seven signals, points, bands and the outcome rate per band."""
    return outcomes.band_summary(sig.signal_table(w.borrowers, w.panel, w.p), w.p)


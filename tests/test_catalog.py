"""Catalog coverage, oracle agreement, and properties of the plans."""

import re
from pathlib import Path

import pytest

from compare import compare, duck
from riskpanel.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
LISTED = {
    "a": [1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17], "b": range(1, 7), "r": range(1, 9), "c": range(1, 23),
    "d": range(1, 8), "e": range(1, 13), "f": range(1, 17), "g": range(1, 8),
    "h": [1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16], "i": range(1, 18), "j": range(1, 14),
    "k": [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12],
}
WITHOUT_SQL = {
    "a13_fingerprint_files", "h10_fit_logistic", "h11_score", "h15_coefficients", "h16_fit_three",
}
def test_every_listed_operator_has_a_query():
    have = {key[:3] for key in catalog.QUERIES}
    assert {f"{family}{n:02d}" for family, ids in LISTED.items() for n in ids} <= have
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == WITHOUT_SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, con, sf_dir, key):
    verdict = compare(spark, con, sf_dir, key, catalog.QUERIES[key], catalog.ORACLE[key])
    assert verdict.startswith("ok"), verdict


def plan_of(spark, sf_dir, key):
    return catalog.QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_wide_signals_shuffle_only_for_the_adapter(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "e11_signal_table_wide")
    assert len(re.findall(r"Exchange hashpartitioning\(o_custkey", plan)) == 1
    assert not re.findall(r"Exchange hashpartitioning\((?!o_custkey|c_custkey)", plan)


def test_summary_scans_the_mart_once(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "f08_signal_summary")
    assert len(re.findall(r"FileScan parquet", plan)) == 2  # orders and customer


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "e04_utilisation")
    orders = re.search(r"FileScan parquet \[(o_[^\]]*)\]", plan).group(1)
    assert "o_orderkey" not in orders and "o_orderpriority" not in orders


@pytest.mark.parametrize("key", ["e11_signal_table", "f09_band_summary", "c22_quality_suite", "h02_rank_split", "i01_roc_auc", "k09_compare_tables"])
def test_plans_hold_no_python_and_no_product(spark, sf_dir, key):
    plan = plan_of(spark, sf_dir, key)
    for name in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert name not in plan


def test_sources_hold_no_local_shortcuts():
    own = [p for p in ROOT.glob("riskpanel/**/*.py") if "llm" not in p.parts]
    for path in [*own, ROOT / "__spark_entry__.py"]:
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", "toPandas", ".rdd", "collect_set", ".sample("):
            assert word not in text, (path, word)

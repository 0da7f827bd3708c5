"""Split, preprocessing, fits and metrics."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskpanel.functions.frames import GuardError
from riskpanel.operators import metrics, model, newton, split


def split_by_hand(ids):
    order = sorted(ids, key=lambda i: (hashlib.sha256(f"customer_sha256_v1:{i}".encode()).hexdigest(), i))
    a = int(len(order) * 0.6)
    b = a + int(len(order) * 0.2)
    return {i: "train" if n < a else "calibration" if n < b else "test" for n, i in enumerate(order)}


@pytest.mark.parametrize("n", [5, 17, 1000])
def test_split_is_exact_and_independent_of_order(spark, n):
    ids = list(range(1, n + 1))
    random.Random(n).shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "customer_id bigint").repartition(7)
    got = {r.customer_id: r.split for r in split.rank_split(df).collect()}
    assert got == split_by_hand(ids)
    split.require_population(df)


def test_split_guards(spark):
    for parts in (("1/2", "1/2"), ("1", "-1/5"), ("0", "1/2")):
        with pytest.raises(ValueError):
            split.cuts([("train", Fraction(parts[0])), ("calibration", Fraction(parts[1]))])
    ids = spark.range(1, 9).withColumnRenamed("id", "customer_id")
    with pytest.raises(GuardError, match="ids_are_unique"):
        split.require_population(ids.union(ids.limit(1)))
    with pytest.raises(GuardError, match="every_part_has_rows"):
        split.require_population(ids.limit(2))
    with pytest.raises(Exception, match="positive"):
        split.rank_split(spark.range(0, 5).withColumnRenamed("id", "customer_id")).collect()
    rows = [(i, i % 2, s) for i, s in enumerate(["train", "train", "calibration", "calibration", "test", "test"])]
    good = spark.createDataFrame(rows, "customer_id bigint, next_month_default bigint, split string")
    split.require_split(good)
    for bad in (good.where("split <> 'test'"), good.where("NOT (split = 'test' AND next_month_default = 1)"),
                good.withColumn("split", F.regexp_replace("split", "test", "hold"))):
        with pytest.raises(GuardError):
            split.require_split(bad)


@pytest.fixture(scope="module")
def frame(spark):
    """Seeded population with missing coverage and growth, as a prepared frame."""
    rng = random.Random(11)
    rows = []
    for i in range(1, 1001):
        severity = rng.choice([0, 0, 0, 1, 2, 3])
        use = rng.uniform(0, 1.3)
        risk = -2.0 + 0.8 * severity + 0.9 * use
        rows.append(
            (
                i, int(rng.random() < 1 / (1 + math.exp(-risk))), rng.randint(10_000, 1_000_000), rng.randint(1, 2),
                rng.randint(0, 6), rng.randint(0, 3), rng.randint(21, 74), severity, rng.randint(0, 6), rng.randint(-2, 2),
                use, None if i % 11 == 0 else rng.uniform(0, 2), rng.randint(0, 6), None if i % 17 == 0 else rng.gauss(0, 1),
            )
        )
    names = (
        "customer_id bigint, next_month_default bigint, credit_limit_ntd bigint, sex_code bigint, education_code bigint, "
        "marriage_code bigint, age_years bigint, recent_max_delinquency bigint, delinquent_months_6m bigint, "
        "delinquency_deterioration bigint, latest_utilization_ratio double, payment_coverage_ratio double, "
        "zero_payment_streak bigint, recent_bill_growth double"
    )
    contract = {
        "observation_date": F.lit("2005-09-30").cast("date"), "risk_band": F.lit("Low"), "source_id": F.lit("s"),
        "source_file_sha256": F.lit("0" * 64), "definition_version": F.lit("0.1.0"),
    }
    out = model.model_frame(spark.createDataFrame(rows, names).withColumns(contract)).persist()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def fitted(frame):
    return {m.name: m for m in model.fit_three(frame)}


def test_split_sizes(frame):
    assert {r.split: r["count"] for r in frame.groupBy("split").count().collect()} == {
        "train": 600, "calibration": 200, "test": 200,
    }


def test_preprocessing_learns_from_train_only(frame):
    train = frame.where("split = 'train'")
    pre = model.fit_preprocessing(train, *model.FEATURES["combined"])
    data = train.toPandas()
    for f, median in pre.imputation.medians.items():
        assert median == pytest.approx(float(np.nanmedian(data[f].astype(float))), abs=1e-12)
    assert set(pre.imputation.flagged) == {"payment_coverage_ratio", "recent_bill_growth"}
    ready = pre.prepare(train).toPandas()
    for f in pre.imputation.columns():
        assert abs(ready[f].mean()) < 1e-9 and ready[f].std(ddof=0) == pytest.approx(1.0, abs=1e-9)


def test_constant_and_unseen_values(spark):
    train = spark.createDataFrame([(1.0, "a"), (1.0, "b")], "x double, k string")
    scale = model.standardise(train, ["x"])
    assert [r.x for r in scale.apply(train).collect()] == [0.0, 0.0]
    coder = model.one_hot(train, ["k"])
    other = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    got = [list(r.hot_k.toArray()) for r in coder.apply(other).collect()]
    assert got == [[1, 0], [0, 1], [0, 0], [0, 0]] and coder.names() == ["k_a", "k_b"]
    with pytest.raises(ValueError, match="no train value"):
        model.impute_median(train.withColumn("x", F.lit(None).cast("double")), ["x"])


def test_fit_is_stationary(frame, fitted):
    """Gradient of summed loss plus half the squared weights vanishes at the fit."""
    m = fitted["combined"]
    ready = m.preprocessing.apply(frame.where("split = 'train'")).select("features", model.OUTCOME).collect()
    x = np.array([r.features.toArray() for r in ready])
    y = np.array([r[model.OUTCOME] for r in ready])
    w = np.array(m.logistic.coefficients)
    p = 1 / (1 + np.exp(-(x @ w + m.logistic.intercept)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-6
    assert abs((p - y).sum()) < 1e-6
    assert m.logistic.gradient <= m.logistic.bound == 600 * newton.GRADIENT_PER_ROW and m.logistic.passes <= 12


def test_fit_against_newton_by_hand_and_its_guards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -0.2, 3.0] - 1)))).astype(float)
    df = spark.createDataFrame([(float(t), Vectors.dense(r)) for t, r in zip(y, x)], ["y", "features"])
    for penalty in (0.01, 1.0, 1e6):
        fit = model.newton_fit(df, "y", penalty=penalty)
        design, theta = np.hstack([np.ones((300, 1)), x]), np.zeros(4)
        ridge = np.diag([0, 1, 1, 1]) / penalty
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ theta))
            theta -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (p - y) + ridge @ theta)
        assert np.allclose([fit.intercept, *fit.coefficients], theta, atol=1e-8)
        assert fit.gradient <= fit.bound and fit.rows == 300
    for wrong in (df.where("y = 1"), df.where("false"), df.withColumn("y", F.lit(2.0)), df.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(GuardError, match="both outcomes"):
            model.newton_fit(wrong, "y")
    # outcomes that a feature parts completely
    parted = spark.createDataFrame([(float(i > 5), Vectors.dense([float(i)])) for i in range(10)], ["y", "features"])
    assert model.newton_fit(parted, "y").gradient < 1e-8
    monkeypatch.setattr(newton, "MOST_PASSES", 3)
    with pytest.raises(GuardError, match="not converged after 3 passes: its gradient is"):
        model.newton_fit(parted, "y")


def test_shared_preprocessing_equals_separate_fit(frame, fitted):
    alone = model.fit_one(frame, "behavioral")
    assert np.allclose(alone.logistic.coefficients, fitted["behavioral"].logistic.coefficients, atol=1e-9)
    assert alone.platt.slope == pytest.approx(fitted["behavioral"].platt.slope, abs=1e-5)


def test_predictions_and_platt(frame, fitted):
    pred = model.predictions(list(fitted.values()), frame)
    assert pred.count() == 600
    assert pred.where("NOT predicted_pd BETWEEN 0 AND 1").count() == 0
    m = fitted["static"]
    ours = pred.where("model = 'static'")
    assert model.check_platt(ours, m.platt.slope, m.platt.intercept).first().mismatches == 0
    moved = ours.withColumn("predicted_pd", F.when(F.col("borrower_id") < 500, F.col("predicted_pd") + 1e-4).otherwise(F.col("predicted_pd")))
    found = model.check_platt(moved, m.platt.slope, m.platt.intercept).first().mismatches
    assert found == ours.where("borrower_id < 500").count() > 0
    auc = {r.model: r.roc_auc for r in metrics.roc_auc(pred).collect()}
    assert auc["behavioral"] > 0.6 and auc["combined"] > 0.6


def test_coefficients_are_ordered(fitted):
    rows = model.coefficients(fitted["combined"]).orderBy("position").collect()
    sizes = [abs(r.coefficient) for r in rows]
    assert sizes == sorted(sizes, reverse=True)
    assert "missing_payment_coverage_ratio" in {r.transformed_feature for r in rows}


def test_leakage_guard():
    model.require_no_leakage(model.FEATURES["combined"][0])
    for name in ("customer_id", "next_month_default", "risk_band", "risk_points", "pipeline_run_id"):
        with pytest.raises(ValueError, match=name):
            model.require_no_leakage(["age_years", name])


# --- metrics against brute force ------------------------------------------------
def scored(spark, seed, ties):
    rng = random.Random(seed)
    rows = [("m", i, int(rng.random() < 0.3), round(rng.random(), 2) if ties else rng.random()) for i in range(1, 301)]
    return rows, spark.createDataFrame(rows, "model string, borrower_id bigint, actual_default bigint, predicted_pd double")


@pytest.mark.parametrize("ties", [True, False])
def test_rank_metrics(spark, ties):
    rows, df = scored(spark, 5, ties)
    pos = [p for _, _, y, p in rows if y]
    neg = [p for _, _, y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    area, tp, seen, before = 0.0, 0, 0, 0.0
    for value in sorted({p for *_, p in rows}, reverse=True):
        group = [y for *_, y, p in rows if p == value]
        tp, seen = tp + sum(group), seen + len(group)
        area += (tp / len(pos) - before) * tp / seen
        before = tp / len(pos)
    got = metrics.rank_metrics(df).first()
    assert got.roc_auc == pytest.approx(auc, abs=1e-12) and got.pr_auc == pytest.approx(area, abs=1e-12)
    flipped = metrics.roc_auc(df.withColumn("predicted_pd", 1 - F.col("predicted_pd"))).first().roc_auc
    assert flipped == pytest.approx(1 - auc, abs=1e-12)


def test_base_metrics_and_bins(spark):
    rows, df = scored(spark, 6, False)
    y = np.array([r[2] for r in rows], float)
    p = np.array([r[3] for r in rows])
    got = metrics.base_metrics(df).first()
    assert got.brier_score == pytest.approx(((p - y) ** 2).mean(), abs=1e-12)
    assert got.log_loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), abs=1e-12)
    index = np.minimum((p * 10).astype(int), 9)
    ece = sum((index == b).mean() * abs(p[index == b].mean() - y[index == b].mean()) for b in range(10) if (index == b).any())
    assert metrics.ece(df).first()[metrics.ECE] == pytest.approx(ece, abs=1e-12)


def test_edge_probabilities(spark):
    rows = [("m", 1, 1, 1.0), ("m", 2, 0, 0.0), ("m", 3, 0, 1.0), ("m", 4, 1, 0.95)]
    df = spark.createDataFrame(rows, "model string, borrower_id bigint, actual_default bigint, predicted_pd double")
    bins = {r.bin: r.sample_count for r in metrics.calibration_bins(df).collect()}
    assert bins == {1: 1, 10: 3}
    assert math.isfinite(metrics.log_loss(df).first().log_loss)
    one_class = metrics.rank_metrics(df.where("actual_default = 1")).first()
    assert one_class.roc_auc is None and one_class.pr_auc is None


POPULATION = [(i, i % 2, "test" if i > 4 else "train") for i in range(1, 13)]


def packet(spark):
    population = spark.createDataFrame(POPULATION, "borrower_id bigint, actual_default bigint, split string")
    rows = [(m, i, y, s, i / 20) for m in ("static", "behavioral", "combined") for i, y, s in POPULATION if s == "test"]
    names = "model string, borrower_id bigint, actual_default bigint, split string, predicted_pd double"
    return population, spark.createDataFrame(rows, names)


ONE = "model = 'static' AND borrower_id = 5"


def changed(name, value):
    return lambda d: d.withColumn(name, F.when(F.expr(ONE), F.lit(value).cast(d.schema[name].dataType)).otherwise(F.col(name)))


@pytest.mark.parametrize(
    "damage, issues",
    [
        (lambda d: d, set()),
        (lambda d: d.union(d.where(ONE)), {"duplicate_prediction_id"}),
        (lambda d: d.where(f"NOT ({ONE})"), {"missing_prediction"}),
        (changed("borrower_id", 99), {"prediction_not_in_population", "missing_prediction"}),
        (changed("borrower_id", 1), {"prediction_not_test", "missing_prediction"}),
        (changed("actual_default", 0), {"prediction_outcome_mismatch"}),
        (changed("actual_default", 7), {"invalid_actual_default"}),
        (changed("split", "train"), {"prediction_not_test"}),
        (changed("predicted_pd", 1.01), {"invalid_probability"}),
        (changed("predicted_pd", float("nan")), {"invalid_probability"}),
        (changed("predicted_pd", None), {"invalid_probability"}),
    ],
)
def test_each_fault_of_predictions_is_named(spark, damage, issues):
    population, pred = packet(spark)
    found = metrics.prediction_checks(damage(pred), population)
    live = found.where("rows > 0").collect()
    assert {r.issue for r in live} == issues
    assert all(r.model == "static" and r.rows == 1 for r in live)
    assert metrics.model_status(found).first().status == ("fail" if issues else "pass")


def test_reported_metrics_are_compared_both_ways(workspace):
    mine = workspace.metrics
    mine = mine.persist()
    assert metrics.compare_metrics(mine, mine).where("status <> 'match'").count() == 0
    off = mine.withColumn("value", F.col("value") + F.when(F.col("metric") == "roc_auc", 2e-10).otherwise(0.0))
    assert metrics.compare_metrics(off, mine).where("status = 'mismatch'").count() == 3
    extra = mine.unionByName(mine.limit(1).withColumn("metric", F.lit("made_up")))
    assert metrics.compare_metrics(extra, mine).where("status = 'not_recomputed'").count() == 1

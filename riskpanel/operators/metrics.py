"""Model metrics from row-level predictions, and the checks around them.

Predictions carry ``model, borrower_id, actual_default, predicted_pd``. Metrics
group by model, and models are a short fixed list; the map side therefore
reduces each task's rows to a few before anything moves. Metrics that need an
order first reduce rows to distinct probabilities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.definitions import (
    BLOCKING_ISSUES,
    CALIBRATION_BINS,
    CALIBRATION_TOLERANCE,
    METRIC_TOLERANCE,
    MODELS,
    PROBABILITY_EPSILON,
    SEGMENT_FIELDS,
    SPLITS,
)
from riskpanel.functions.expressions import clipped
from riskpanel.functions.frames import as_rows, count_where, ordered_running_sum, ratio

c = F.col
Y, P = "actual_default", "predicted_pd"
# Metric names, and the names of their pairwise differences.
ECE = "expected_calibration_error_10_bin"
DELTA_METRICS = {
    "roc_auc": "roc_auc_difference",
    "pr_auc": "pr_auc_difference",
    "brier_score": "brier_score_difference",
    "log_loss": "log_loss_difference",
    ECE: "ece_difference",
}
DELTA_PAIRS = (
    ("behavioral_minus_static", "behavioral", "static"),
    ("combined_minus_static", "combined", "static"),
    ("combined_minus_behavioral", "combined", "behavioral"),
)


def _log_loss_term() -> Column:
    p = clipped(c(P), PROBABILITY_EPSILON)
    q = clipped(1 - c(P), PROBABILITY_EPSILON)
    return -(c(Y) * F.ln(p) + (1 - c(Y)) * F.ln(q))


def base_metrics(pred: DataFrame) -> DataFrame:
    """Counts, rates, Brier score and log loss per model in one aggregate."""
    return pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(Y).alias("default_count"),
        ratio(F.sum(Y), F.count(F.lit(1))).alias("default_rate"),
        F.avg(P).alias("average_pd"),
        F.avg(F.pow(c(P) - c(Y), F.lit(2))).alias("brier_score"),
        F.avg(_log_loss_term()).alias("log_loss"),
    )


def base_rates(pred: DataFrame) -> DataFrame:
    return base_metrics(pred).select("model", "sample_count", "default_count", "default_rate", "average_pd")


def brier(pred: DataFrame) -> DataFrame:
    return base_metrics(pred).select("model", "brier_score")


def log_loss(pred: DataFrame) -> DataFrame:
    return base_metrics(pred).select("model", "log_loss")


def rank_profile(pred: DataFrame) -> DataFrame:
    """``(model, predicted_pd, pos, neg)``: positives and negatives per distinct probability.

    All that rank metrics need, in whole numbers. A run stores its profile, and
    profiles of several runs merge exactly; rows are not read again.
    """
    return pred.groupBy("model", P).agg(F.sum(Y).alias("pos"), F.sum(1 - c(Y)).cast("bigint").alias("neg"))


def merged_profiles(profiles: DataFrame) -> DataFrame:
    """One profile of several (their union): counts of equal probabilities added up."""
    return profiles.groupBy("model", P).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def ordered_scores(pred: DataFrame) -> DataFrame:
    """Positives and negatives per distinct probability with running sums."""
    return ordered_running_sum(rank_profile(pred), [P], ["pos", "neg"], by=["model"])


def _pair_terms() -> tuple[Column, Column]:
    """Per distinct probability: twice the ordered pairs won, and the area step.

    Pairs are exact decimals (a tie is 1, a win is 2), so the AUC does not
    depend on the order of addition.
    """
    pairs = c("pos").cast("decimal(19,0)") * (2 * c("cum_neg") - c("neg")).cast("decimal(19,0)")
    true_above = c("total_pos") - c("cum_pos") + c("pos")
    false_above = c("total_neg") - c("cum_neg") + c("neg")
    return pairs, ratio(c("pos"), c("total_pos")) * ratio(true_above, true_above + false_above)


def _rank_values() -> tuple[Column, Column]:
    """ROC AUC and average precision from the summed terms; NULL without both classes."""
    both = (c("total_pos") > 0) & (c("total_neg") > 0)
    all_pairs = F.lit(2.0) * c("total_pos").cast("double") * c("total_neg").cast("double")
    auc = F.when(both, F.try_divide(c("_pairs").cast("double"), all_pairs)).alias("roc_auc")
    return auc, F.when(both, c("_area")).alias("pr_auc")


def rank_metrics(pred: DataFrame) -> DataFrame:
    """ROC AUC and average precision per model."""
    return profile_metrics(rank_profile(pred))


def profile_metrics(profile: DataFrame) -> DataFrame:
    """ROC AUC and average precision per model, from a profile with one row per model and probability."""
    pairs, step = _pair_terms()
    summed = ordered_running_sum(profile, [P], ["pos", "neg"], by=["model"]).groupBy("model").agg(
        F.sum(pairs).alias("_pairs"),
        F.sum(step).alias("_area"),
        F.max("total_pos").alias("total_pos"),
        F.max("total_neg").alias("total_neg"),
    )
    return summed.select("model", *_rank_values())


def roc_auc(pred: DataFrame) -> DataFrame:
    return rank_metrics(pred).select("model", "roc_auc")


def average_precision(pred: DataFrame) -> DataFrame:
    return rank_metrics(pred).select("model", "pr_auc")


def calibration_bins(pred: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Equal-width bins per model; empty bins are absent and 1.0 is in the last."""
    index = F.least(F.floor(c(P) * bins).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    grouped = pred.groupBy("model", index.alias("_index")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum(Y).alias("default_count"), F.avg(P).alias("average_pd")
    )
    return grouped.select(
        "model",
        (c("_index") + 1).alias("bin"),
        ratio(c("_index"), F.lit(bins)).alias("lower_bound"),
        ratio(c("_index") + 1, F.lit(bins)).alias("upper_bound"),
        "sample_count",
        "default_count",
        "average_pd",
        ratio(c("default_count"), c("sample_count")).alias("observed_default_rate"),
    )


def ece(pred: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Expected calibration error per model: weighted gap over the bins."""
    gap = c("sample_count") * F.abs(c("average_pd") - c("observed_default_rate"))
    return calibration_bins(pred, bins).groupBy("model").agg(
        F.try_divide(F.sum(gap), F.sum("sample_count").cast("double")).alias(ECE)
    )


def metric_rows(wide: DataFrame) -> DataFrame:
    """Metric table ``(model, metric, value)`` from a column per metric."""
    names = [n for n in wide.columns if n != "model"]
    cells = [F.struct(F.lit(n).alias("metric"), c(n).cast("double").alias("value")) for n in names]
    return wide.select("model", F.explode(F.array(*cells)).alias("m")).select("model", "m.*")


def metric_table(pred: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """All recomputed metrics of every model, except the fitted diagnostic.

    One pass: rows become counts per distinct probability, from which every
    metric follows; those are summed per calibration bin and then per model.
    """
    n = c("pos") + c("neg")
    pairs, step = _pair_terms()
    squared = c("pos") * F.pow(c(P) - 1, F.lit(2)) + c("neg") * F.pow(c(P), F.lit(2))
    loss = -(
        c("pos") * F.ln(clipped(c(P), PROBABILITY_EPSILON)) + c("neg") * F.ln(clipped(1 - c(P), PROBABILITY_EPSILON))
    )
    per_bin = ordered_scores(pred).groupBy(
        "model", F.least(F.floor(c(P) * bins), F.lit(bins - 1).cast("bigint")).alias("_bin")
    ).agg(
        F.sum(n).alias("n"),
        F.sum("pos").alias("d"),
        F.sum(n * c(P)).alias("pd"),
        F.sum(squared).alias("squared"),
        F.sum(loss).alias("loss"),
        F.sum(pairs).alias("_pairs"),
        F.sum(step).alias("_area"),
        F.max("total_pos").alias("total_pos"),
        F.max("total_neg").alias("total_neg"),
    )
    per_model = per_bin.groupBy("model").agg(
        F.sum("n").alias("sample_count"),
        F.sum("d").alias("default_count"),
        *[F.sum(x).alias(x) for x in ("pd", "squared", "loss", "_pairs", "_area")],
        F.sum(F.abs(c("pd") - c("d"))).alias("_gap"),
        F.max("total_pos").alias("total_pos"),
        F.max("total_neg").alias("total_neg"),
    )
    rows = c("sample_count").cast("double")
    return metric_rows(
        per_model.select(
            "model",
            "sample_count",
            "default_count",
            ratio(c("default_count"), c("sample_count")).alias("default_rate"),
            (c("pd") / rows).alias("average_pd"),
            (c("squared") / rows).alias("brier_score"),
            (c("loss") / rows).alias("log_loss"),
            *_rank_values(),
            (c("_gap") / rows).alias(ECE),
        )
    )


def segments(pred: DataFrame, population: DataFrame, fields: tuple[str, ...] = SEGMENT_FIELDS) -> DataFrame:
    """Counts, rates and Brier score per model, segment field and value.

    Rows are reduced to combinations of all fields (a few thousand at most)
    before those are laid out per field.
    """
    scored = pred.select("model", "borrower_id", Y, P)
    joined = scored.join(population.select("borrower_id", *fields), "borrower_id")
    profile = joined.groupBy("model", *fields).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(Y).alias("defaults"),
        F.sum(P).alias("pd"),
        F.sum(F.pow(c(P) - c(Y), F.lit(2))).alias("squared"),
    )
    cells = [F.struct(F.lit(f).alias("segment_field"), c(f).cast("string").alias("segment_value")) for f in fields]
    rows = profile.select("model", "n", "defaults", "pd", "squared", F.explode(F.array(*cells)).alias("s")).select(
        "model", "s.*", "n", "defaults", "pd", "squared"
    )
    summed = rows.groupBy("model", "segment_field", "segment_value").agg(
        F.sum("n").alias("sample_count"),
        F.sum("defaults").alias("default_count"),
        F.sum("pd").alias("_pd"),
        F.sum("squared").alias("_squared"),
    )
    return summed.select(
        "model",
        "segment_field",
        "segment_value",
        "sample_count",
        "default_count",
        ratio(c("default_count"), c("sample_count")).alias("default_rate"),
        (c("_pd") / c("sample_count")).alias("average_pd"),
        (c("_squared") / c("sample_count")).alias("brier_score"),
    )


def model_deltas(metrics: DataFrame) -> DataFrame:
    """Differences of five metrics for the three model pairs."""
    def value(model: str) -> Column:
        return F.max(F.when(c("model") == model, c("value")))

    per_metric = metrics.where(c("metric").isin(*DELTA_METRICS)).groupBy("metric").agg(
        *[value(m).alias(m) for m in MODELS]
    )
    name = F.lit(None).cast("string")
    for metric, label in DELTA_METRICS.items():
        name = F.when(c("metric") == metric, label).otherwise(name)
    pairs = [
        F.struct(F.lit(label).alias("comparison"), (c(left) - c(right)).alias("difference"))
        for label, left, right in DELTA_PAIRS
    ]
    return per_metric.select(name.alias("metric"), F.explode(F.array(*pairs)).alias("d")).select(
        "d.comparison", "metric", "d.difference"
    )


def _issue_rows(counts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("issue"), c(n).cast("bigint").alias("rows")) for n in names]
    return counts.select(*keys, F.explode(F.array(*cells)).alias("i")).select(*keys, "i.*")


def prediction_checks(pred: DataFrame, population: DataFrame) -> DataFrame:
    """Issue counts per model: ids, outcomes, splits, probabilities, coverage.

    Predictions are reduced to one row per (model, borrower) and laid beside
    the population once. ``missing_prediction`` counts test borrowers a model
    has no row for.
    """
    bad_p = c(P).isNull() | F.isnan(P) | ~c(P).between(0, 1)
    ours = pred.groupBy("borrower_id").agg(
        *[count_where(c("model") == m).alias(f"n_{m}") for m in MODELS],
        *[
            count_where((c("model") == m) & condition).alias(f"{name}_{m}")
            for m in MODELS
            for name, condition in (
                ("p", bad_p),
                ("y", ~F.coalesce(c(Y).isin(0, 1), F.lit(False))),
                ("t", ~c("split").eqNullSafe(F.lit("test"))),
                ("one", c(Y) == 1),
                ("zero", c(Y) == 0),
            )
        ],
    )
    theirs = population.select("borrower_id", c(Y).alias("_y"), c("split").alias("_split"), F.lit(True).alias("_in"))
    both = ours.withColumn("_pred", F.lit(True)).join(theirs, "borrower_id", "full_outer")
    known = c("_in").isNotNull()
    aggregates = []
    names = [
        "duplicate_prediction_id", "prediction_not_in_population", "invalid_actual_default", "invalid_probability",
        "prediction_not_test", "prediction_outcome_mismatch", "missing_prediction",
    ]
    for m in MODELS:
        n = F.coalesce(c(f"n_{m}"), F.lit(0))
        other_split = known & ~c("_split").eqNullSafe(F.lit("test"))
        mismatch = F.when(c("_y") == 1, c(f"zero_{m}")).when(c("_y") == 0, c(f"one_{m}"))
        aggregates += [
            F.sum(F.when(known, F.greatest(n - 1, F.lit(0)))).alias(f"duplicate_prediction_id_{m}"),
            F.sum(F.when(~known, n).otherwise(0)).alias(f"prediction_not_in_population_{m}"),
            F.sum(f"y_{m}").alias(f"invalid_actual_default_{m}"),
            F.sum(f"p_{m}").alias(f"invalid_probability_{m}"),
            F.sum(F.when(other_split, n).otherwise(c(f"t_{m}"))).alias(f"prediction_not_test_{m}"),
            F.sum(F.when(known, mismatch)).alias(f"prediction_outcome_mismatch_{m}"),
            count_where(known & (c("_split") == "test") & (n == 0)).alias(f"missing_prediction_{m}"),
        ]
    row = both.agg(*aggregates)
    cells = [
        F.struct(
            F.lit(m).alias("model"),
            F.lit(name).alias("issue"),
            F.coalesce(c(f"{name}_{m}"), F.lit(0)).cast("bigint").alias("rows"),
        )
        for m in MODELS
        for name in names
    ]
    return as_rows(row, cells)


def population_checks(population: DataFrame, expected_rows: int | Column, expected_defaults: int | Column) -> DataFrame:
    """Issue counts over the population: ids, outcomes, splits, segments, totals."""
    blank = reduce(
        lambda a, b: a | b, [c(f).isNull() | (F.trim(c(f).cast("string")) == "") for f in SEGMENT_FIELDS]
    )
    per_id = population.groupBy("borrower_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_where(c(Y) == 1).alias("defaults"),
        count_where(~F.coalesce(c(Y).isin(0, 1), F.lit(False))).alias("bad_outcome"),
        count_where(~F.coalesce(c("split").isin(*SPLITS), F.lit(False))).alias("bad_split"),
        count_where(blank).alias("blank_segment"),
    )
    row = per_id.agg(
        F.coalesce(F.sum(F.when(c("borrower_id").isNull(), c("n"))), F.lit(0)).alias("invalid_population_row"),
        F.coalesce(F.sum(F.when(c("borrower_id").isNotNull(), c("n") - 1)), F.lit(0)).alias("duplicate_population_id"),
        F.coalesce(F.sum("bad_outcome"), F.lit(0)).alias("invalid_actual_default"),
        F.coalesce(F.sum("bad_split"), F.lit(0)).alias("invalid_split"),
        F.coalesce(F.sum("blank_segment"), F.lit(0)).alias("segment_field_missing"),
        F.abs(F.coalesce(F.sum("n"), F.lit(0)) - expected_rows).alias("population_count_mismatch"),
        F.abs(F.coalesce(F.sum("defaults"), F.lit(0)) - expected_defaults).alias("population_default_count_mismatch"),
    )
    return _issue_rows(row, [], row.columns)


def same_rows_across_models(pred: DataFrame) -> DataFrame:
    """One row: ids not in every model, ids whose outcomes differ between models."""
    per_id = pred.groupBy("borrower_id").agg(
        *[F.max(F.when(c("model") == m, 1).otherwise(0)).alias(m) for m in MODELS],
        F.min(Y).alias("low"),
        F.max(Y).alias("high"),
    )
    present = reduce(lambda a, b: a + b, [c(m) for m in MODELS])
    return per_id.agg(
        F.count(F.lit(1)).alias("ids"),
        count_where(present < len(MODELS)).alias("population_mismatch"),
        count_where(c("low") != c("high")).alias("outcome_mismatch"),
    )


def _differs(reported: Column, recomputed: Column, tolerance: Column | float) -> Column:
    """Status of a reported number; not reported or not finite is an issue of its own."""
    finite = reported.isNotNull() & ~F.isnan(reported) & (F.abs(reported) != float("inf"))
    return (
        F.when(recomputed.isNull(), "not_recomputed")
        .when(~finite, "invalid_reported")
        .when(F.abs(reported - recomputed) > tolerance, "mismatch")
        .otherwise("match")
    )


def compare_metrics(reported: DataFrame, recomputed: DataFrame, tolerance: float = METRIC_TOLERANCE) -> DataFrame:
    """Reported against recomputed ``(model, metric, value)`` with a status per row."""
    loose = c("metric").isin("calibration_intercept", "calibration_slope")
    allowed = F.when(loose, F.lit(CALIBRATION_TOLERANCE)).otherwise(F.lit(tolerance))
    joined = reported.withColumnRenamed("value", "reported").join(
        recomputed.withColumnRenamed("value", "recomputed"), ["model", "metric"], "full_outer"
    )
    return joined.withColumn("status", _differs(c("reported"), c("recomputed"), allowed))


SEGMENT_VALUES = ("sample_count", "default_count", "default_rate", "average_pd", "brier_score")


def compare_segments(reported: DataFrame, recomputed: DataFrame, tolerance: float = METRIC_TOLERANCE) -> DataFrame:
    """Status per model, segment and field: coverage both ways, then five numbers."""
    keys = ["model", "segment_field", "segment_value"]

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c(v).cast("double").alias(v) for v in SEGMENT_VALUES]).alias(name))

    joined = packed(reported, "r").join(packed(recomputed, "x"), keys, "full_outer")
    cells = [
        F.struct(
            F.lit(v).alias("field"),
            F.when(c("r").isNull(), "segment_not_reported")
            .when(c("x").isNull(), "segment_not_recomputed")
            .otherwise(_differs(c(f"r.{v}"), c(f"x.{v}"), tolerance))
            .alias("status"),
        )
        for v in SEGMENT_VALUES
    ]
    return joined.select(*keys, F.explode(F.array(*cells)).alias("f")).select(*keys, "f.*")


def compare_deltas(reported: DataFrame, metrics: DataFrame, tolerance: float = METRIC_TOLERANCE) -> DataFrame:
    """Reported ``(comparison, metric, difference)`` against the recomputed ones."""
    recomputed = model_deltas(metrics).withColumnRenamed("difference", "recomputed")
    joined = reported.withColumnRenamed("difference", "reported").join(
        recomputed, ["comparison", "metric"], "full_outer"
    )
    return joined.withColumn("status", _differs(c("reported"), c("recomputed"), tolerance))


def comparison_issues(found: DataFrame, what: str) -> DataFrame:
    """``(issue, rows)`` of a comparison: one issue per status other than ``match``, named after what was compared."""
    issue = F.concat(F.lit(f"{what}_"), c("status")).alias("issue")
    return found.where("status <> 'match'").groupBy(issue).agg(F.count(F.lit(1)).alias("rows"))


def single_class_issues(pred: DataFrame) -> DataFrame:
    """``(issue, rows)``: models whose test rows hold one outcome only, so that no ranking metric exists."""
    per_model = pred.groupBy("model").agg(F.min(Y).alias("low"), F.max(Y).alias("high"))
    one = count_where(~(c("low") < c("high")).eqNullSafe(F.lit(True)))
    return per_model.agg(one.cast("bigint").alias("rows")).select(F.lit("single_class_test").alias("issue"), "rows")


def model_issues(
    pred: DataFrame,
    population: DataFrame,
    expected_rows: int | Column,
    expected_defaults: int | Column,
    metrics: DataFrame,
    segments: DataFrame,
    deltas: DataFrame,
) -> DataFrame:
    """``(issue, rows)`` over everything that is checked about the models.

    ``metrics``, ``segments`` and ``deltas`` are the comparisons of reported with
    recomputed numbers. :func:`model_status` judges the result.
    """
    same = as_rows(
        same_rows_across_models(pred),
        [
            F.struct(F.lit(f"{n}_across_models").alias("issue"), c(n).cast("bigint").alias("rows"))
            for n in ("population_mismatch", "outcome_mismatch")
        ],
    )
    parts = [
        prediction_checks(pred, population).select("issue", "rows"),
        population_checks(population, expected_rows, expected_defaults),
        same,
        single_class_issues(pred),
        comparison_issues(metrics, "metric"),
        comparison_issues(segments, "segment"),
        comparison_issues(deltas, "difference"),
    ]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("issue").agg(F.sum("rows").alias("rows"))


def model_status(issues: DataFrame) -> DataFrame:
    """One row: fail on any failure, blocked when only blockers exist, else pass.

    ``issues`` has ``issue`` and ``rows``; an issue counts when it has rows.
    """
    live = c("rows") > 0
    blocker = c("issue").isin(*BLOCKING_ISSUES)
    counted = issues.agg(
        count_where(live & ~blocker).alias("failures"), count_where(live & blocker).alias("blockers")
    )
    status = F.when(c("failures") > 0, "fail").when(c("blockers") > 0, "blocked").otherwise("pass")
    return counted.select("failures", "blockers", status.alias("status"), (status == "pass").alias("gate_4_eligible"))

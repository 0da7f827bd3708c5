"""Logistic default models: preprocessing, fit, Platt calibration, coefficients.

Fits are Newton steps over the cluster. What the driver holds are the fitted
numbers: medians, means and deviations per feature, category lists of coded
fields, and coefficients. All are bounded by the feature list, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from riskpanel.definitions import (
    BEHAVIORAL_NUMERIC,
    MODELS,
    NEVER_FEATURES,
    PROBABILITY_EPSILON,
    STATIC_CATEGORICAL,
    STATIC_NUMERIC,
)
from riskpanel.functions.expressions import logit, sigmoid
from riskpanel.functions.frames import as_rows, count_where, exact_medians, fixed_rows
from riskpanel.operators.newton import LogisticFit, newton_fit
from riskpanel.operators.population import prepare_features, require_frame_contract
from riskpanel.operators.split import rank_split, require_population, require_split
from riskpanel.session import cut_lineage, kept

c = F.col
OUTCOME = "next_month_default"
WEAK_PENALTY = 1e6

FEATURES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "static": (STATIC_NUMERIC, STATIC_CATEGORICAL),
    "behavioral": (BEHAVIORAL_NUMERIC, ()),
    "combined": (STATIC_NUMERIC + BEHAVIORAL_NUMERIC, STATIC_CATEGORICAL),
}


def require_no_leakage(features: Iterable[str]) -> None:
    """Raise when an identifier, outcome or run field is asked for as a feature."""
    forbidden = sorted(NEVER_FEATURES.intersection(features))
    if forbidden:
        raise ValueError(f"not allowed as features: {forbidden}")


def model_frame(extract: DataFrame) -> DataFrame:
    """Model extract with derived features and its split; :func:`fit_models` tests what it needs."""
    return rank_split(prepare_features(extract))


# --- numeric preprocessing ---------------------------------------------------
def median_table(train: DataFrame, numeric: Iterable[str]) -> DataFrame:
    """Per numeric feature: exact train median and how many train rows lack it."""
    numeric = list(numeric)
    rows = train.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(f).alias(f) for f in numeric]
    )
    present = as_rows(
        rows,
        [F.struct(F.lit(f).alias("feature"), (c("rows") - c(f)).alias("missing_in_train")) for f in numeric],
    )
    medians = exact_medians(train, numeric).select("feature", "median")
    return present.join(medians, "feature", "left")


@dataclass(frozen=True)
class Imputation:
    """Train medians, and the features that get a missing flag."""

    medians: dict[str, float]
    flagged: tuple[str, ...]

    def columns(self) -> list[str]:
        return [*self.medians, *[f"missing_{f}" for f in self.flagged]]

    def only(self, numeric: Iterable[str]) -> Imputation:
        return Imputation({f: self.medians[f] for f in numeric}, tuple(f for f in numeric if f in self.flagged))

    def apply(self, df: DataFrame) -> DataFrame:
        filled = {f: F.coalesce(c(f).cast("double"), F.lit(m)) for f, m in self.medians.items()}
        flags = {f"missing_{f}": F.when(c(f).isNull(), 1.0).otherwise(0.0) for f in self.flagged}
        return df.withColumns({**flags, **filled})


def impute_median(train: DataFrame, numeric: Iterable[str]) -> Imputation:
    """Fit medians on train rows; only features missing there get a flag."""
    numeric = list(numeric)
    found = {r["feature"]: r for r in median_table(train, numeric).collect()}
    empty = [f for f in numeric if found[f]["median"] is None]
    if empty:
        raise ValueError(f"no train value for {empty}")
    return Imputation(
        {f: found[f]["median"] for f in numeric}, tuple(f for f in numeric if found[f]["missing_in_train"] > 0)
    )


def moments(train: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Mean and population deviation per column, in one aggregate."""
    columns = list(columns)
    row = train.agg(
        *[F.avg(x).alias(f"mean_{x}") for x in columns], *[F.stddev_pop(x).alias(f"sd_{x}") for x in columns]
    )
    return as_rows(
        row,
        [
            F.struct(F.lit(x).alias("feature"), c(f"mean_{x}").alias("mean"), c(f"sd_{x}").alias("sd"))
            for x in columns
        ],
    )


@dataclass(frozen=True)
class Standardisation:
    """Means and deviations; a constant column keeps its unit."""

    moments: dict[str, tuple[float, float]]

    def only(self, columns: Iterable[str]) -> Standardisation:
        return Standardisation({x: self.moments[x] for x in columns})

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {x: (c(x).cast("double") - F.lit(mean)) / F.lit(sd if sd > 0 else 1.0) for x, (mean, sd) in self.moments.items()}
        )


def standardise(train: DataFrame, columns: Iterable[str]) -> Standardisation:
    rows = moments(train, columns).collect()
    return Standardisation({r["feature"]: (r["mean"], r["sd"]) for r in rows})


# --- categories and assembly --------------------------------------------------
@dataclass(frozen=True)
class OneHot:
    """Fitted category lists; a category unseen in train becomes all zeros."""

    fitted: dict[str, tuple[StringIndexerModel, OneHotEncoderModel]]

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(self.fitted)

    def only(self, fields: Iterable[str]) -> OneHot:
        return OneHot({f: self.fitted[f] for f in fields})

    def apply(self, df: DataFrame) -> DataFrame:
        for f, (indexer, encoder) in self.fitted.items():
            text = df.withColumn(f"_text_{f}", c(f).cast("string"))
            df = encoder.transform(indexer.transform(text)).drop(f"_text_{f}", f"_index_{f}")
        return df

    def names(self) -> list[str]:
        return [f"{f}_{v}" for f, (indexer, _) in self.fitted.items() for v in indexer.labelsArray[0]]


def one_hot(train: DataFrame, fields: Iterable[str]) -> OneHot:
    """Fit category lists on train rows, in ascending order; no level is dropped.

    The indexer keeps an extra slot for unseen categories and the encoder drops
    that slot only.
    """
    fitted = {}
    for f in fields:
        text = train.select(c(f).cast("string").alias(f"_text_{f}"))
        indexer = StringIndexer(
            inputCol=f"_text_{f}", outputCol=f"_index_{f}", handleInvalid="keep", stringOrderType="alphabetAsc"
        ).fit(text)
        encoder = OneHotEncoder(inputCol=f"_index_{f}", outputCol=f"hot_{f}", dropLast=True).fit(indexer.transform(text))
        fitted[f] = (indexer, encoder)
    return OneHot(fitted)


@dataclass(frozen=True)
class Preprocessing:
    """Everything fitted on the train rows of one model."""

    imputation: Imputation
    scale: Standardisation
    categories: OneHot

    def vector_inputs(self) -> list[str]:
        return [*self.imputation.columns(), *[f"hot_{f}" for f in self.categories.fields]]

    def names(self) -> list[str]:
        return [*self.imputation.columns(), *self.categories.names()]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Imputed, standardised and coded columns."""
        return self.categories.apply(self.scale.apply(self.imputation.apply(df)))

    def assemble(self, prepared: DataFrame) -> DataFrame:
        """Add the feature vector to prepared columns."""
        return VectorAssembler(inputCols=self.vector_inputs(), outputCol="features").transform(prepared)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.assemble(self.prepare(df))

    def only(self, numeric: Iterable[str], categorical: Iterable[str]) -> Preprocessing:
        """The part for some of the features; every fitted number stays the same."""
        imputation = self.imputation.only(numeric)
        return Preprocessing(imputation, self.scale.only(imputation.columns()), self.categories.only(categorical))


def fit_preprocessing(train: DataFrame, numeric: Iterable[str], categorical: Iterable[str]) -> Preprocessing:
    imputation = impute_median(train, numeric)
    filled = imputation.apply(train)
    return Preprocessing(imputation, standardise(filled, imputation.columns()), one_hot(train, categorical))


# --- fits ----------------------------------------------------------------------
def fit_logistic(train: DataFrame, label: str, penalty: float = 1.0, features: str = "features") -> LogisticFit:
    """L2 logistic fit with strength ``1 / (2 * penalty)`` on the summed loss and a free intercept.

    Labels and vectors are checkpointed first: every step is a pass, and each
    then starts from stored rows instead of the whole preparation.
    """
    return newton_fit(cut_lineage(train.select(c(label).cast("double").alias(label), features)), label, features, penalty)


def score(df: DataFrame, fitted: LogisticFit) -> DataFrame:
    """Add ``raw_pd``, the uncalibrated probability of the outcome."""
    return df.withColumn("raw_pd", fitted.probability())


@dataclass(frozen=True)
class Platt:
    slope: float
    intercept: float
    #: The fit behind the line, with its certificate.
    fit: LogisticFit | None = None


def fit_platt(df: DataFrame, probability: str, label: str) -> Platt:
    """Nearly unpenalised logistic fit of the outcome on the logit of a probability."""
    one = VectorAssembler(inputCols=["_logit"], outputCol="_logit_vector").transform(
        df.select(c(label).cast("double").alias(label), logit(c(probability), PROBABILITY_EPSILON).alias("_logit"))
    )
    model = fit_logistic(one, label, WEAK_PENALTY, "_logit_vector")
    return Platt(model.coefficients[0], model.intercept, model)


def apply_platt(raw: Column, slope: Column | float, intercept: Column | float) -> Column:
    """Calibrated probability."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return sigmoid(lit(intercept) + lit(slope) * logit(raw, PROBABILITY_EPSILON))


def check_platt(pred: DataFrame, slope: float, intercept: float, tolerance: float = 1e-10) -> DataFrame:
    """Per model: rows whose stored probability is not the re-applied one."""
    again = apply_platt(c("raw_pd"), slope, intercept)
    off = c("predicted_pd").isNull() | (F.abs(c("predicted_pd") - again) > tolerance)
    return pred.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), count_where(off).alias("mismatches"))


def calibration_diagnostic(pred: DataFrame) -> DataFrame:
    """Slope and intercept of actual on logit(predicted) per model; nothing is refit from it."""
    rows = []
    with kept(pred.select("model", "predicted_pd", "actual_default")) as stored:
        for m in MODELS:
            fitted = fit_platt(stored.where(c("model") == m), "predicted_pd", "actual_default")
            rows.append((m, fitted.intercept, fitted.slope))
    columns = {"model": "string", "calibration_intercept": "double", "calibration_slope": "double"}
    return fixed_rows(pred.sparkSession, columns, rows)


@dataclass(frozen=True)
class FittedModel:
    name: str
    preprocessing: Preprocessing
    logistic: LogisticFit
    platt: Platt

    def predict(self, df: DataFrame) -> DataFrame:
        """Rows ``model, borrower_id, actual_default, split, raw_pd, predicted_pd``."""
        scored = score(self.preprocessing.apply(df), self.logistic)
        return scored.select(
            F.lit(self.name).alias("model"),
            c("customer_id").alias("borrower_id"),
            c(OUTCOME).alias("actual_default"),
            "split",
            "raw_pd",
            apply_platt(c("raw_pd"), self.platt.slope, self.platt.intercept).alias("predicted_pd"),
        )


def coefficients(model: FittedModel) -> DataFrame:
    """Coefficient per transformed feature, largest magnitude first, then by name."""
    spark = SparkSession.active()
    rows = list(zip(model.preprocessing.names(), model.logistic.coefficients))
    ordered = sorted(rows, key=lambda r: (-abs(r[1]), r[0]))
    columns = {"model": "string", "position": "int", "transformed_feature": "string", "coefficient": "double"}
    return fixed_rows(spark, columns, [(model.name, i, n, v) for i, (n, v) in enumerate(ordered, start=1)])


def _fit(name: str, pre: Preprocessing, prepared: DataFrame) -> FittedModel:
    """Fit on the train rows of a prepared frame, calibrate on its calibration rows."""
    ready = pre.assemble(prepared).select("split", OUTCOME, "features")
    logistic = fit_logistic(ready.where("split = 'train'"), OUTCOME)
    calibration = score(ready.where("split = 'calibration'"), logistic)
    return FittedModel(name, pre, logistic, fit_platt(calibration, "raw_pd", OUTCOME))


def fit_models(frame: DataFrame, names: Iterable[str] = MODELS) -> list[FittedModel]:
    """Fit several models over one prepared frame.

    All models learn from the same train rows, so medians, moments and
    categories are fitted once over all features. The fits themselves are
    independent series of small jobs and are submitted side by side. Raises
    unless the frame keeps its contract, ids are unique and every split holds
    both classes.
    """
    names = list(names)
    numeric = list(dict.fromkeys(f for n in names for f in FEATURES[n][0]))
    categorical = list(dict.fromkeys(f for n in names for f in FEATURES[n][1]))
    require_no_leakage((*numeric, *categorical))
    columns = dict.fromkeys(("split", OUTCOME, *numeric, *categorical))
    with kept(frame) as stored:
        require_frame_contract(stored)
        require_population(stored)
        require_split(stored)
        pre = fit_preprocessing(stored.where("split = 'train'"), numeric, categorical)
        with kept(pre.prepare(stored.where("split <> 'test'").select(*columns))) as prepared:
            fit = inheritable_thread_target(frame.sparkSession)(lambda n: _fit(n, pre.only(*FEATURES[n]), prepared))
            with ThreadPoolExecutor(len(names)) as pool:
                return list(pool.map(fit, names))


def fit_one(frame: DataFrame, name: str) -> FittedModel:
    """Fit one model on the train rows and calibrate it on the calibration rows."""
    return fit_models(frame, [name])[0]


def fit_three(frame: DataFrame) -> list[FittedModel]:
    """Static, behavioural and combined model over one prepared frame."""
    return fit_models(frame, MODELS)


def predictions(models: list[FittedModel], frame: DataFrame, split: str = "test") -> DataFrame:
    """Predictions of all models for one split."""
    rows = frame.where(c("split") == split)
    result = None
    for model in models:
        one = model.predict(rows)
        result = one if result is None else result.unionByName(one)
    return result

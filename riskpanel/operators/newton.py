"""Penalised logistic fits by Newton steps, one aggregate over the cluster each.

A step sums weighted features and weighted products of features over all rows;
the driver gets these sums, about half the square of the number of features,
and solves one small system. Rows are read about eight times, and every fit says
how near it came: the largest entry of its penalised gradient, taken over all
rows at the returned coefficients, must be below a stated bound.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.functions.expressions import sigmoid
from riskpanel.functions.frames import GuardError

c = F.col
#: A fit has converged once no entry of its gradient is above this times the rows.
GRADIENT_PER_ROW = 1e-11
#: Least weight of a row, so that there is something to sum where all probabilities are 0 or 1.
SMALLEST = 1e-300
#: Passes over the rows after which a fit has failed and raises.
MOST_PASSES = 60


@dataclass(frozen=True)
class LogisticFit:
    """A fitted model and its certificate."""

    coefficients: tuple[float, ...]
    intercept: float
    #: Largest absolute entry of the penalised gradient, and what it may be at most.
    gradient: float
    bound: float
    passes: int
    rows: int

    def margin(self, features: str = "features") -> Column:
        return _margin(features, np.array([self.intercept, *self.coefficients]))

    def probability(self, features: str = "features") -> Column:
        return sigmoid(self.margin(features))


def _margin(features: str, theta: np.ndarray) -> Column:
    values = vector_to_array(features)
    terms = [F.get(values, F.lit(i)) * F.lit(float(t)) for i, t in enumerate(theta[1:])]
    return reduce(lambda a, b: a + b, terms, F.lit(float(theta[0])))


@dataclass(frozen=True)
class _Sums:
    """What one pass gives at some coefficients."""

    loss: float
    gradient: np.ndarray
    curvature: np.ndarray


def _symmetric(linear: np.ndarray, products: np.ndarray, weight: float) -> np.ndarray:
    """The matrix of weighted products with a constant in front.

    Products come feature by feature: the feature, then its products with all up to itself.
    """
    size = len(linear)
    out = np.empty((size + 1, size + 1))
    out[0, 0] = weight
    at = 0
    for j in range(size):
        out[0, j + 1] = out[j + 1, 0] = products[at]
        out[j + 1, 1 : j + 2] = out[1 : j + 2, j + 1] = products[at + 1 : at + j + 2]
        at += j + 2
    return out


class _Fit:
    def __init__(self, df: DataFrame, label: str, features: str, penalty: float):
        self.features, self.label, self.penalty = features, label, 1.0 / penalty
        self.rows = PolynomialExpansion(degree=2, inputCol=features, outputCol="_products").transform(df.select(c(label).cast("double").alias(label), features))
        y = c(label)
        known = self.rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(y.isin(0.0, 1.0)).alias("labelled"),
            F.sum(y).alias("ones"),
        ).first()
        if not known.rows or known.labelled != known.rows or not 0 < known.ones < known.rows:
            raise GuardError("a fit needs rows of both outcomes, and no others")
        of_ones = self.rows.where(y == 1.0).agg(Summarizer.metrics("sum").summary(c(features)).alias("of_ones")).first()
        self.n, ones = known.rows, of_ones.of_ones["sum"].toArray()
        self.seen = np.array([known.ones, *ones])
        self.size = len(ones)
        self.passes = 0

    def at(self, theta: np.ndarray) -> _Sums:
        self.passes += 1
        m, y = c("_margin"), c(self.label)
        p = F.greatest(sigmoid(m), F.lit(SMALLEST))
        weight = F.greatest(p * (1 - p), F.lit(SMALLEST))
        loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - y * m
        row = (
            self.rows.withColumn("_margin", _margin(self.features, theta))
            .agg(
                F.sum(loss).alias("loss"),
                F.sum(p).alias("expected"),
                Summarizer.metrics("sum").summary(c(self.features), p).alias("linear"),
                F.sum(weight).alias("weight"),
                Summarizer.metrics("sum").summary(c("_products"), weight).alias("products"),
            )
            .first()
        )
        shrunk = np.concatenate(([0.0], theta[1:]))
        linear = row.linear["sum"].toArray()
        curvature = _symmetric(linear, row.products["sum"].toArray(), row.weight) + self.penalty * np.diag([0.0] + [1.0] * self.size)
        return _Sums(
            row.loss + self.penalty / 2 * float(shrunk @ shrunk), np.concatenate(([row.expected], linear)) - self.seen + self.penalty * shrunk, curvature
        )

    def run(self) -> LogisticFit:
        theta = np.zeros(self.size + 1)
        theta[0] = float(np.log(self.seen[0] / (self.n - self.seen[0])))
        bound, here, step = GRADIENT_PER_ROW * self.n, self.at(theta), None
        while (worst := float(np.abs(here.gradient).max())) > bound:
            step = np.linalg.solve(here.curvature, here.gradient)
            ahead = self.at(theta - step)
            # a step that overshoots is halved until the loss falls
            while not ahead.loss <= here.loss + 1e-12 * self.n and self.passes < MOST_PASSES:
                step = step / 2
                ahead = self.at(theta - step)
            if self.passes >= MOST_PASSES:
                raise GuardError(f"the fit has not converged after {self.passes} passes: its gradient is {worst:.3g}, allowed is {bound:.3g}")
            theta, here = theta - step, ahead
        return LogisticFit(tuple(map(float, theta[1:])), float(theta[0]), worst, bound, self.passes, self.n)


def newton_fit(df: DataFrame, label: str, features: str = "features", penalty: float = 1.0) -> LogisticFit:
    """L2 logistic fit with strength ``1 / (2 * penalty)`` on the summed loss and a free intercept.

    Raises :class:`GuardError` unless every label is 0 or 1, both occur, and the
    gradient falls below its bound. ``df`` is read about eight times, so pass a
    stored frame.
    """
    return _Fit(df, label, features, penalty).run()

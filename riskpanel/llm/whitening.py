"""Whitening of embeddings over weighted distinct vectors.

Vectors are quantised to whole numbers, and equal ones are grouped: a group of
copies is one row with its count, however large it is. The fit weighs each
distinct vector by its count (the covariance of all rows) or by one (that of the
distinct vectors). Sums are exact whole numbers. The covariance is a weighted
product of centred matrices per partition, summed by Spark cell by cell; its
dim * dim cells are all that the driver takes. Every distinct vector is
whitened once, and rows get the result of theirs by a join.

Rules: rows without a vector, or with a null or non-finite entry in it, are left
out, and so are rows whose vector has not the commonest length (of equally
common ones the longest) or none at all. Quantised entries are held within
+-2**40. Repeated rows and ids are rows of their own, and a null id stays null.
A component without variance (all of them, if one vector is left) has null as
its whitened value and takes no part in the identity error. An empty table gives
an empty result; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.store import Scratch

SCALE, SHIFT = 64, 1_000_000
MOST = float(1 << 40)
COMPONENTS = 32
#: Rows that are laid out as a matrix at once.
BLOCK = 1024
#: A component whose share of the variance is not above this has none.
NO_VARIANCE = 1e-13


def finite(vector: str) -> Column:
    """Is the vector there, with entries that are all finite numbers?"""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def quantised(vector: str, scale: int, shift: int, most: float = MOST) -> Column:
    """floor(scale * entry) + shift as whole numbers."""
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-most)), F.lit(most))).cast("long")
    return F.transform(vector, lambda c: whole(c) + F.lit(shift).cast("long"))


def of_common_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the commonest length, and that length; 0 if there is none."""
    lengths = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("length")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max(F.struct("n", "length")).alias("common")).first().common
    length = common.length if common else 0
    return rows.where(F.size(vector) == length), length


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), BLOCK):
            yield batch.slice(begin, BLOCK)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, total) of a partition: exact weighted sums; place -1 is the weight itself."""
    total: dict[int, int] = {}
    for block in blocks(batches):
        x, weight = matrix(block.column("x")), np.asarray(block.column("weight"))
        fits = float(np.abs(x).max(initial=0)) * float(weight.sum()) < 2**62
        sums = weight @ x if fits else weight.astype(object) @ x.astype(object)
        for place, value in enumerate([weight.sum(), *sums], start=-1):
            total[place] = total.get(place, 0) + int(value)
    schema = pa.schema([("place", pa.int32()), ("total", pa.string())])
    yield pa.RecordBatch.from_pydict({"place": list(total), "total": [str(v) for v in total.values()]}, schema)


def _products(centred):
    """(row, cells) of a partition: its part of the weighted product of centred matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in blocks(batches):
            z = centred(block)
            part = z.T @ (z * np.asarray(block.column("weight"), np.float64)[:, None])
            total = part if total is None else total + part
        if total is not None:
            schema = pa.schema([("row", pa.int32()), ("cells", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pydict({"row": range(len(total)), "cells": list(total)}, schema)

    return run


def covariance(rows: DataFrame, centred, dim: int, n: int) -> np.ndarray:
    """Weighted mean of the products of centred entries; dim * dim numbers come to the driver."""
    parts = rows.select("x", "weight", *[c for c in ("whitened",) if c in rows.columns]).mapInArrow(_products(centred), "row int, cells array<double>")
    cells = parts.select("row", F.posexplode("cells").alias("at", "cell")).groupBy("row", "at").agg(F.sum("cell").alias("cell"))
    out = np.zeros((dim, dim))
    for r in cells.collect():
        out[r.row, r["at"]] = r.cell
    return (out + out.T) / (2 * n)


@dataclass(frozen=True)
class Whitening:
    """What is fitted: some numbers per dimension and component."""

    n: int
    sums: list[int]
    axes: np.ndarray  # a column per component
    variances: np.ndarray
    trace: float
    #: Components with a variance.
    alive: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part of the mean taken off exactly."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes[:, self.alive] / np.sqrt(self.variances[self.alive])

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - S) ** 2), exact."""
        off = max(self.n * (int(np.abs(x).max(initial=0)) + 1), max(map(abs, self.sums), default=0))
        exact = (2 * off) ** 2 * max(len(self.sums), 1) < 2**63
        d = x.astype(np.int64 if exact else object) * self.n - np.array(self.sums, np.int64 if exact else object)
        return [int(v) for v in (d * d).sum(axis=1)]


def fit(rows: DataFrame, dim: int, most: int = COMPONENTS) -> Whitening | None:
    """Fit on (x, weight); None where there is no row."""
    totals = rows.select("x", "weight").mapInArrow(_sums, "place int, total string")
    found = {r.place: int(r.total) for r in totals.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    if not found.get(-1):
        return None
    n, sums = found[-1], [found[i] for i in range(dim)]
    centre = Whitening(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0, np.zeros(0, bool))
    spread = covariance(rows, lambda block: centre.centred(matrix(block.column("x"))), dim, n)
    variances, axes = np.linalg.eigh(spread)
    order = np.argsort(-variances, kind="stable")[:most]
    trace = float(np.trace(spread))
    return Whitening(n, sums, axes[:, order], variances[order], trace, variances[order] > NO_VARIANCE * trace)


def _whiten(model: Whitening):
    """The distinct vectors with their whitened values and deviation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            x = matrix(block.column("x"))
            values = model.whitened(x)
            ends = np.arange(len(x) + 1, dtype=np.int32) * values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.ravel()))
            deviation = pa.array([str(d) for d in model.deviations(x)], pa.string())
            yield pa.RecordBatch.from_arrays([block.column("x"), block.column("weight"), lists, deviation], ["x", "weight", "whitened", "deviation"])

    return run


COLUMNS = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, copies long"


def whiten(spark: SparkSession, embeddings: DataFrame, weights: str = "counts", most: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error, copies.

    `weights` is "counts" or "one": what a distinct vector weighs in the fit.
    `deviation` is null where its 38 digits do not hold it.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    scratch = Scratch(spark, "whitening")
    clean = embeddings.where(finite("embedding")).select("vec_id", quantised("embedding", SCALE, SHIFT).alias("x"))
    rows, dim = of_common_length(scratch.store(clean, "rows"), "x")
    weight = F.count("*") if weights == "counts" else F.lit(1).cast("long")
    groups = scratch.store(rows.groupBy("x").agg(weight.alias("weight"), F.count("*").alias("copies")), "groups")
    model = fit(groups, dim, most) if dim else None
    if model is None:
        return spark.createDataFrame([], COLUMNS.format(id=embeddings.schema["vec_id"].dataType.simpleString()))
    distinct = scratch.store(
        groups.select("x", "weight").mapInArrow(_whiten(model), "x array<long>, weight long, whitened array<double>, deviation string"), "whitened"
    )
    alive = int(model.alive.sum())
    # whitened values are centred up to rounding; their covariance is taken anew from the stored values
    again = covariance(distinct, lambda block: matrix(block.column("whitened")), alive, model.n) if alive else np.zeros((0, 0))
    error = float(np.abs(again - np.eye(alive)).max(initial=0))
    share = [float(v / model.trace) if model.trace > 0 else None for v in model.variances]
    place = np.where(model.alive, np.cumsum(model.alive), 0)
    components = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(int(at)).alias("at"), F.lit(e).cast("double").alias("explained")) for i, (at, e) in enumerate(zip(place, share), start=1)])
    joined = rows.join(distinct.join(groups.select("x", "copies"), "x") if weights == "one" else distinct.withColumn("copies", F.col("weight")), "x")
    return joined.select("vec_id", "deviation", "whitened", "copies", F.explode(components).alias("c")).select(
        "vec_id",
        F.col("c.component").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"),
        F.when(F.col("c.at") > 0, F.get("whitened", F.col("c.at") - 1)).alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
        "copies",
    )

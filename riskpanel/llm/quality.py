"""Document quality by Bradley-Terry ranking.

Each pair of a good and a bad document says that the first is preferred. A
document's strength is linear in its features, the chance that one is preferred
is the logistic function of the difference of strengths, and the weights minimise
the logistic loss over feature differences of pairs. The decision threshold
is a quantile of the strengths: the share of bad documents among all labelled
rows. The score is the logistic function of the strength above that quantile,
placed so that it is 0.7 at the threshold.

Features are measured on the whole text: word and line lengths, shares of
capitals, digits, blanks and kinds of marks, and the shares of distinct words,
word pairs and lines.

The ranking is fitted on all labelled rows that are not held out. They are dealt to
blocks of about a thousand rows by a hash of doc_id, and each row is compared with
all rows of the other class in its block, so the work grows with the rows. Means,
deviations and the quantile are those of all these rows.
Rules: a null text is empty; without labelled rows of both classes every score is
the share of good rows (0 if there are none).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays, samples
from riskpanel.llm.store import Scratch, bounded_batches

THRESHOLD = 0.7
#: Bins of a histogram of strengths.
BINS = 1024

_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
#: Kinds of bytes whose shares are features.
KINDS = {
    "capital": range(0x41, 0x5B),
    "small": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "other letters": range(0x80, 0x100),
    "blank": (0x20, 0x09),
    "line end": (0x0A, 0x0D),
    "stop": (0x2E,),
    "comma": (0x2C,),
    "question": (0x3F, 0x21),
    "quote": (0x22, 0x27),
    "bracket": tuple(map(ord, "()[]{}<>")),
    "slash": tuple(map(ord, "/\\|")),
    "symbol": tuple(map(ord, "#$%&*+=@^_~`")),
    "dash": tuple(map(ord, "-:;")),
}


def _repeats(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Share of distinct values in each of n texts; 1 where there are none."""
    total = np.bincount(of, minlength=n)
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return np.where(total > 0, np.bincount(of[new], minlength=n) / np.maximum(total, 1), 1.0)


def features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    found = arrays.words(texts)
    n, data = len(found.bounds) - 1, found.raw
    length = np.diff(found.offsets)
    safe = np.maximum(length, 1)
    share = lambda chosen: np.diff(np.concatenate(([0], np.cumsum(chosen)))[found.offsets]) / safe
    columns = []
    for kind in KINDS.values():
        table = np.zeros(256, bool)
        table[list(kind)] = True
        part = share(table[data])
        columns += [part, np.sqrt(part)]
    of = found.text_of_word()
    spans = (found.ends - found.starts).astype(float)
    words = np.maximum(found.counts, 1)
    total = np.bincount(of, spans, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, spans**2, n) / words - total**2, 0))
    hashes = found.hashes()
    first, pairs = arrays.windows(hashes, found.bounds, 2)
    lines = arrays.words(texts, ~_LINE)
    line_of = lines.text_of_word()
    line_length = np.bincount(line_of, lines.ends - lines.starts, n) / np.maximum(lines.counts, 1)
    capital = (data[found.starts] >= 0x41) & (data[found.starts] <= 0x5A)
    last = data[found.ends - 1] if len(found.ends) else np.zeros(0, np.uint8)
    marked = ~(arrays.LETTER_WORDS[arrays.LOWER[last]])
    columns += [
        np.log1p(length),
        np.log1p(found.counts),
        total,
        np.log1p(total),
        spread,
        np.log1p(line_length),
        np.log1p(lines.counts),
        _repeats(hashes, of, n),
        _repeats(pairs, of[first] if len(first) else first, n),
        _repeats(lines.hashes(), line_of, n),
        np.bincount(of, capital, n) / words,
        np.bincount(of, marked, n) / words,
        (found.counts < 5).astype(float),
    ]
    return np.stack(columns, 1)


class BradleyTerry:
    def __init__(self, counts: dict[int, int]):
        total = sum(counts.values())
        self.constant = counts[1] / total if total else 0.0
        self.fitted = False

    def scaled_by(self, middle: np.ndarray, scale: np.ndarray) -> None:
        self.middle, self.scale = middle, np.where(scale < 1e-9, 1, scale)
        self.weights = np.zeros(2 * len(middle))

    def _laid_out(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.middle) / self.scale, -6, 6)
        return np.concatenate([scaled, scaled**2], 1)

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return self._laid_out(rows) @ self.weights

    def pair_sums(self, rows: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Gradient and second derivatives of the loss over all pairs of a good and a bad row."""
        held = self._laid_out(rows)
        good, bad = held[label == 1], held[label == 0]
        # chance that the worse one is preferred
        p = 1 / (1 + np.exp(np.clip((good @ self.weights)[:, None] - (bad @ self.weights)[None], -40, 40)))
        gradient = p.sum(0) @ bad - p.sum(1) @ good
        w = p * (1 - p)
        cross = good.T @ (w @ bad)
        hessian = (good * w.sum(1)[:, None]).T @ good + (bad * w.sum(0)[:, None]).T @ bad - cross - cross.T
        return np.concatenate([gradient, hessian.ravel()])

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        above = self.strengths(features(texts)) - self.threshold
        return 1 / (1 + np.exp(-np.clip(above + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def packed(rows: pa.Table) -> bytes:
    """Features and labels of a block."""
    parts = [features(part.column("text")) for batch in rows.to_batches() for part in arrays.slices(batch)]
    return pickle.dumps((np.concatenate(parts), np.asarray(rows.column("label")).astype(np.int64)))


def _moments(data: bytes) -> np.ndarray:
    rows, label = pickle.loads(data)
    return np.concatenate([np.bincount(label, minlength=2), rows.sum(0)])


def quantile(strengths: DataFrame, share: np.ndarray, target: float) -> float:
    """The least strength up to which the rows (strength, label), weighted by share[label], weigh `target`; nothing is sorted.

    Histograms narrow down the rows until few or equal ones are left.
    """
    weight = F.when(F.col("label") == 1, float(share[1])).otherwise(float(share[0]))
    rows = strengths.select("strength", weight.alias("weight"))
    low, high = rows.agg(F.min("strength"), F.max("strength")).first()
    below = 0.0
    while low < high:
        inside = rows.where(F.col("strength").between(low, high))
        place = F.least(F.floor((F.col("strength") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy(place.alias("bin")).agg(F.sum("weight").alias("weight"), F.min("strength").alias("low"), F.max("strength").alias("high")).collect()
        bins.sort(key=lambda r: r.bin)
        for r in bins:
            low, high = r.low, r.high
            if below + r.weight >= target - 1e-9 * abs(target):
                break
            below += r.weight
        else:
            return high
    return low


def fit(scratch: Scratch, docs: DataFrame, labels: DataFrame, apart: Column, ridge: float = 1e-4) -> BradleyTerry:
    """Newton's method on the pairs of all blocks, and the threshold on the strengths of all labelled rows."""
    blocks, counts = samples.labelled_blocks(scratch, docs, labels, "quality", apart, packed)
    model = BradleyTerry(counts)
    n = features(pa.array([""])).shape[1]
    sums = samples.summed(blocks, _moments, n + 2)
    held, total = sums[:2], sums[:2].sum()
    if not held.all():
        return model
    middle = sums[2:] / total
    spread = samples.summed(blocks, lambda data: ((pickle.loads(data)[0] - middle) ** 2).sum(0), n)
    model.scaled_by(middle, np.sqrt(spread / total))
    pairs = max(samples.summed(blocks, lambda data: np.array([np.prod(np.bincount(pickle.loads(data)[1], minlength=2))]), 1)[0], 1)
    for _ in range(30):
        sums = samples.summed(blocks, lambda data: model.pair_sums(*pickle.loads(data)), 2 * n * (2 * n + 1))
        gradient = ridge * model.weights + sums[: 2 * n] / pairs
        hessian = sums[2 * n :].reshape(2 * n, 2 * n) / pairs + (ridge + 1e-9) * np.eye(2 * n)
        step = np.linalg.solve(hessian, gradient)
        model.weights = model.weights - step * min(1.0, 5 / max(np.linalg.norm(step), 1e-12))
        if np.abs(step).max() < 1e-8:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                rows, label = pickle.loads(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(model.strengths(rows)), pa.array(label.astype(np.int32))], ["strength", "label"])

    strengths = scratch.store(blocks.select("data").mapInArrow(run, "strength double, label int"), "strengths")
    # labels may lack a document, so each row stands for its class in all labels
    model.threshold = quantile(strengths, np.array([counts[0], counts[1]]) / held, counts[0])
    model.fitted = True
    scratch.drop("known", "blocks", "strengths")
    return model


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    bounded_batches(spark)
    apart = samples.held_out(modulus, remainder)
    model = spark.sparkContext.broadcast(fit(Scratch(spark, "quality"), docs, labels, apart))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", apart.alias("held_out")).mapInArrow(
        samples.scored(model, THRESHOLD), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )

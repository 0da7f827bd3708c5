"""Toxicity by a convolutional text classifier trained in numpy.

Words and their beginnings are hashed to rows of an embedding and added up. Filters over one, two and three words
run along the whole text, the maximum of each filter over all places is kept, and
a linear layer gives a logit. The first coordinate of the embedding starts from
the class log odds of its words, so that the filters soon look at the right places.

The classifier is fitted on all labelled rows that are not held out. They are dealt
to blocks of about a thousand rows by a hash of doc_id. In each of ROUNDS rounds
every block trains the common weights on its rows, EPOCHS times over, and the
changes are averaged: over all rows, or for a word over the blocks that hold it.
Log odds are counted over all blocks. A quarter of all these rows is not trained on
and sets the calibration: a common slope, and per language an intercept that
shrinks to the common one where there are few rows. So each language has a
threshold of its own on the logit where the score is 0.7. The language of a text
is guessed from its words, counted by hash over all labelled rows; the lang column
is never an input.

Rules: a null text is empty, and an empty text gets the score of a text without
any sign; without a labelled row of both classes every score is the share of toxic
rows (0 if there are none).
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays, samples
from riskpanel.llm.store import Scratch, bounded_batches

ROUNDS, EPOCHS = 3, 2
#: Counts of words by language that a model holds, and languages that have a threshold of their own.
WORD_COUNTS, LANGUAGES = 1 << 20, 1000
BUCKET_BITS = 18
DEPTH = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Rows of the embedding whose changes are added up together; other weights are fewer numbers than those of a slice.
SLICE_ROWS = 1 << 10
#: Bytes of the beginnings that longer words are hashed by as well, for inflected and compound words.
BEGINNINGS = (5, 7)
THRESHOLD = 0.7
_PAD = max(WIDTHS) - 1


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def padded_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word and its beginnings, first place of every text); bucket 0 pads each text by two places."""
    found = arrays.words(texts, arrays.LETTER_WORDS, lower=True)
    n = len(found.bounds) - 1
    first = found.bounds[:-1] + _PAD * np.arange(n)
    buckets = np.zeros((len(found.starts) + _PAD * n, 1 + len(BEGINNINGS)), np.int32)
    places = np.arange(len(found.starts)) + _PAD * found.text_of_word()
    whole = found.hashes()
    for i, length in enumerate((None, *BEGINNINGS)):
        if length is None:
            hashed, longer = whole, np.ones(len(places), bool)
        else:
            longer = found.ends - found.starts > length
            hashed = found.beginnings(length)
        bucket = (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        bucket += bucket == 0  # bucket 0 is that of nothing
        buckets[places, i] = np.where(longer, bucket, 0)
    return buckets, first


class Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Update value in place; with rows, only these (distinct) rows of it."""
        seen = self.seen.setdefault(name, np.full_like(value, 1e-2))
        if rows is None:
            seen += gradient**2
            value -= self.rate * gradient / np.sqrt(seen)
        else:
            seen[rows] += gradient**2
            value[rows] -= self.rate * gradient / np.sqrt(seen[rows])


class TextCnn:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embedding = np.zeros((1 << BUCKET_BITS, DEPTH), np.float32)
        self.embedding[1:, 1:] = draw.normal(0, 0.01, ((1 << BUCKET_BITS) - 1, DEPTH - 1))
        self.filters = {k: draw.normal(0, 0.1, (k, DEPTH, FILTERS)).astype(np.float32) for k in WIDTHS}
        for w in self.filters.values():
            w[0, 0] += 0.5
        self.biases = {k: np.full(FILTERS, -0.1, np.float32) for k in WIDTHS}
        self.top = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.bias = np.full(1, -1, np.float32)

    def start_from(self, held: np.ndarray, count: np.ndarray) -> None:
        """First coordinate: log odds of the texts with a bucket, in standard errors; held[label] of count[label] texts have it."""
        count = count[:, None]
        odds = np.log((held + 0.5) / (count - held + 0.5))
        error = np.sqrt((1 / (held + 0.5) + 1 / (count - held + 0.5)).sum(0))
        start = np.clip((odds[1] - odds[0]) / error / 4, -2, 2)
        start[(held.sum(0) == 0)] = 0
        start[0] = 0
        self.embedding[:, 0] = start

    def dense(self) -> list[np.ndarray]:
        """The weights beside the embedding; changing them changes the model."""
        return [*self.filters.values(), *self.biases.values(), self.top, self.bias]

    def convolved(self, vectors: np.ndarray) -> np.ndarray:
        """Response of every filter at every place."""
        out = np.zeros((len(vectors), FILTERS * len(WIDTHS)), np.float32)
        for i, k in enumerate(WIDTHS):
            block = out[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(k):
                block[: len(vectors) - j] += vectors[j:] @ self.filters[k][j]
        return out

    def _pooled(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, responses, maxima by text); padding never wins over a word, and an empty text keeps its padding."""
        vectors = self.embedding[buckets[:, 0]]
        for column in range(1, buckets.shape[1]):
            vectors = vectors + self.embedding[buckets[:, column]]
        responses = self.convolved(vectors)
        lengths = np.diff(np.concatenate((first, [len(buckets)])))
        pads = (first + lengths)[:, None] - np.arange(1, _PAD + 1)
        responses[pads[lengths > _PAD].ravel()] = -np.inf
        responses[pads[lengths == _PAD].ravel()] = 0
        return vectors, responses, np.maximum.reduceat(responses, first, axis=0)

    def logits(self, texts: pa.Array) -> np.ndarray:
        buckets, first = padded_buckets(texts)
        _, _, best = self._pooled(buckets, first)
        shift = np.concatenate([self.biases[k] for k in WIDTHS])
        return np.maximum(best + shift, 0) @ self.top + self.bias[0]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32, decay: float = 1e-4, seed: int = 11) -> None:
        """Logistic loss on padded texts; only the places that win a maximum get a gradient."""
        draw, rule = np.random.default_rng(seed), Adagrad(0.05)
        for _ in range(epochs):
            order = draw.permutation(len(texts))
            for begin in range(0, len(order), batch):
                chosen = order[begin : begin + batch]
                parts = [texts[i] for i in chosen]
                first = np.cumsum([0] + [len(p) for p in parts[:-1]])
                buckets = np.concatenate(parts)
                vectors, responses, best = self._pooled(buckets, first)
                ends = np.append(first[1:], len(buckets))
                place = np.stack([a + responses[a:b].argmax(0) for a, b in zip(first, ends, strict=True)])
                shift = np.concatenate([self.biases[k] for k in WIDTHS])
                active = np.maximum(best + shift, 0)
                error = ((sigmoid(active @ self.top + self.bias[0]) - labels[chosen]) / len(chosen)).astype(np.float32)
                back = error[:, None] * self.top * (best + shift > 0)
                rule.step("top", self.top, active.T @ error + decay * self.top)
                rule.step("bias", self.bias, np.array([error.sum()], np.float32))
                rows, steps = [], []
                for i, k in enumerate(WIDTHS):
                    block = slice(i * FILTERS, (i + 1) * FILTERS)
                    flow, at = back[:, block], place[:, block]
                    gradient = np.zeros_like(self.filters[k])
                    for j in range(k):
                        spot = np.minimum(at + j, len(buckets) - 1)
                        gradient[j] = np.einsum("bfd,bf->df", vectors[spot], flow)
                        moves = (flow[:, :, None] * self.filters[k][j].T[None]).reshape(-1, DEPTH)
                        for column in buckets.T:
                            rows.append(column[spot].ravel()[flow.ravel() != 0])
                            steps.append(moves[flow.ravel() != 0])
                    rule.step(f"filter{k}", self.filters[k], gradient + decay * self.filters[k])
                    rule.step(f"bias{k}", self.biases[k], flow.sum(0))
                every, moves = np.concatenate(rows), np.concatenate(steps)
                every, moves = every[every > 0], moves[every > 0]
                distinct, where = np.unique(every, return_inverse=True)
                total = np.zeros((len(distinct), DEPTH), np.float32)
                np.add.at(total, where, moves)
                rule.step("embedding", self.embedding, total, distinct)


class Languages:
    """Guesses of the language of a text by its words, of which hashes to buckets are counted."""

    def __init__(self, names: list[str]):
        self.names = names
        self.bits = max(4, min(BUCKET_BITS, int(np.log2(WORD_COUNTS / max(len(names), 1)))))
        self.size = len(names) << self.bits
        self.logs = None

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, arrays.Words]:
        found = arrays.words(pc.utf8_lower(texts.fill_null("")), arrays.LETTER_WORDS)
        return (found.hashes() >> np.uint64(64 - self.bits)).astype(np.int64), found

    def counts(self, texts: pa.Array, langs: list[str | None]) -> np.ndarray:
        """Words by language and bucket."""
        number = {x: i for i, x in enumerate(self.names)}
        of = np.array([number.get(x, -1) for x in langs], np.int64)
        bucket, found = self._words(texts)
        language = of[found.text_of_word()]
        known = language >= 0
        return np.bincount((language[known] << self.bits) + bucket[known], minlength=self.size).astype(float)

    def learn(self, counts: np.ndarray, least: int = 2, smooth: float = 0.5) -> None:
        """Log frequencies of the buckets; rarer ones say nothing."""
        counts = counts.reshape(len(self.names), 1 << self.bits).T
        total = counts.sum(0)
        logs = np.log(counts + smooth) - np.log(total + smooth * max(int((counts.sum(1) > 0).sum()), 1))
        logs[counts.sum(1) < least] = 0
        self.logs = logs.astype(np.float32)

    def guess(self, texts: pa.Array) -> np.ndarray:
        """Number of the likeliest language; the number of languages where no word is known."""
        if not self.names:
            return np.zeros(len(texts), np.int64)
        bucket, found = self._words(texts)
        first = found.data[found.starts]
        logs = np.where(((first >= 0x30) & (first <= 0x39))[:, None], 0, self.logs[bucket])
        prefix = np.concatenate((np.zeros((1, len(self.names))), np.cumsum(logs, axis=0, dtype=np.float64)))
        total = prefix[found.bounds[1:]] - prefix[found.bounds[:-1]]
        return np.where(np.ptp(total, axis=1) > 0, total.argmax(1), len(self.names))


def calibration_sums(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, group: np.ndarray, n: int, beta: np.ndarray) -> np.ndarray:
    """Per group the sums of a logistic fit's gradient and second derivatives: 5 of them for each of n groups."""
    p = sigmoid(beta[0] * logit + beta[1] + beta[2:][group])
    error, bend = weight * (p - label), weight * p * (1 - p)
    return np.concatenate([np.bincount(group, v, n) for v in (error, error * logit, bend, bend * logit, bend * logit**2)])


def fit_calibration(sums: Callable[[np.ndarray], np.ndarray], n: int, shrink: float = 4.0) -> tuple[float, float, np.ndarray]:
    """(slope, intercept, offset by group) of a weighted logistic fit; offsets are pulled to 0. Newton's method.

    `sums` gives the calibration_sums over all rows at a point.
    """
    ridge = np.diag([1e-3, 1e-6] + [shrink] * n)
    beta = np.zeros(n + 2)
    beta[0] = 1.0
    pull = np.zeros(n + 2)
    pull[0] = 1.0
    for _ in range(50):
        error, error_logit, bend, bend_logit, bend_square = sums(beta).reshape(5, n)
        gradient = np.concatenate([[error_logit.sum(), error.sum()], error]) + ridge @ (beta - pull)
        hessian = ridge.copy()
        hessian[0, 0] += bend_square.sum()
        hessian[1, 1] += bend.sum()
        hessian[0, 1] += bend_logit.sum()
        hessian[1, 0] += bend_logit.sum()
        hessian[0, 2:] += bend_logit
        hessian[2:, 0] += bend_logit
        hessian[1, 2:] += bend
        hessian[2:, 1] += bend
        hessian[2:, 2:] += np.diag(bend)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(beta[0], 1e-3), beta[1], beta[2:]


class ToxicityModel:
    """The classifier, the language guesser and the calibration."""

    def __init__(self, counts: dict[int, int]):
        total = sum(counts.values())
        self.constant = counts[1] / total if total else 0.0
        self.fitted = False

    def thresholds(self, score: float = THRESHOLD) -> dict[str, float]:
        """The logit at which each language reaches the score."""
        names = [*self.languages.names, "other"]
        return {x: float((np.log(score / (1 - score)) - self.intercept - o) / self.slope) for x, o in zip(names, self.offsets, strict=True)}

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.full(len(texts), self.constant)
        return sigmoid(self.slope * self.cnn.logits(texts) + self.intercept + self.offsets[self.languages.guess(texts)])


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes, part: str | None = None) -> tuple[pa.Table, np.ndarray]:
    """(rows, labels) of a block: all, those to `learn` from or those to `calibrate` by."""
    rows = pa.ipc.open_stream(data).read_all().combine_chunks()
    apart = np.arange(len(rows)) % 4 == 3
    if part:
        rows = rows.filter(pa.array(apart if part == "calibrate" else ~apart))
    return rows, np.asarray(rows.column("label")).astype(np.int64)


def _texts(rows: pa.Table) -> list[np.ndarray]:
    """Padded buckets of every text."""
    texts = []
    for batch in rows.to_batches():
        for part in arrays.slices(batch):
            buckets, first = padded_buckets(part.column("text"))
            texts += np.split(buckets, first[1:])
    return texts


def _class_counts(data: bytes) -> np.ndarray:
    """Rows by class among all, and among those to calibrate by."""
    return np.concatenate([np.bincount(_unpacked(data, part)[1], minlength=2) for part in (None, "calibrate")]).astype(float)


def _held(data: bytes, part: str | None) -> np.ndarray:
    """Texts with each bucket by class, and texts by class."""
    rows, label = _unpacked(data, part)
    held = np.zeros((2, 1 << BUCKET_BITS))
    for words, y in zip(_texts(rows), label, strict=True):
        held[y, np.unique(words)] += 1
    return np.concatenate([held.ravel(), np.bincount(label, minlength=2)])


def _changes(data: bytes, part: str | None, cnn: TextCnn, seed: int) -> np.ndarray:
    """What training on a block changes: each row of the embedding and whether it did, then other weights by rows, and rows."""
    rows, label = _unpacked(data, part)
    own = copy.deepcopy(cnn)
    if len(label):
        own.fit(_texts(rows), label, EPOCHS, seed=seed)
    moved = own.embedding.astype(float) - cnn.embedding
    dense = [len(label) * (a.astype(float) - b).ravel() for a, b in zip(own.dense(), cnn.dense(), strict=True)]
    return np.concatenate([np.column_stack((moved, moved.any(axis=1))).ravel(), *dense, [len(label)]])


def _mean_changes(at: int, total: np.ndarray) -> np.ndarray:
    """Of a slice of added changes the mean by row of the embedding over the blocks that changed it; other sums as they are."""
    if at >= (DEPTH + 1) << BUCKET_BITS:
        return total
    rows = total.reshape(-1, DEPTH + 1)
    return (rows[:, :DEPTH] / np.maximum(rows[:, DEPTH:], 1)).astype(np.float32)


def _language_counts(blocks: DataFrame) -> list[str]:
    """The languages of the labelled rows, the commonest LANGUAGES of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                seen = pc.value_counts(_unpacked(data.as_py())[0].column("lang").drop_null())
                yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts")], ["lang", "rows"])

    found = blocks.select("data").mapInArrow(run, "lang string, rows long").groupBy("lang").agg(F.sum("rows").alias("rows"))
    return sorted(r.lang for r in found.orderBy(F.col("rows").desc(), "lang").limit(LANGUAGES).collect())


def _languages(blocks: DataFrame) -> Languages:
    languages = Languages(_language_counts(blocks))

    def count(data: bytes) -> np.ndarray:
        total = np.zeros(languages.size)
        for batch in _unpacked(data)[0].to_batches():
            for part in arrays.slices(batch):
                total += languages.counts(part.column("text"), part.column("lang").to_pylist())
        return total

    languages.learn(samples.summed(blocks, count, languages.size))
    return languages


def _trained(blocks: DataFrame, part: str | None) -> TextCnn:
    """The classifier after all rounds."""
    context = blocks.sparkSession.sparkContext
    cnn = TextCnn()
    held = samples.summed(blocks, lambda data: _held(data, part), (2 << BUCKET_BITS) + 2)
    cnn.start_from(held[:-2].reshape(2, -1), held[-2:])
    rest, embedded = [w.size for w in cnn.dense()], (DEPTH + 1) << BUCKET_BITS
    for seed in range(ROUNDS):
        sent = context.broadcast(cnn)
        # the driver gets the means only, as single floats
        found = samples.slices_summed(blocks, lambda data: _changes(data, part, sent.value, 11 + seed), embedded + sum(rest) + 1, (DEPTH + 1) * SLICE_ROWS, _mean_changes)
        sent.destroy()
        for at, data in found:
            if at < embedded:
                moved = np.frombuffer(data, np.float32).reshape(-1, DEPTH)
                cnn.embedding[at // (DEPTH + 1) :][: len(moved)] += moved
            else:
                total = np.frombuffer(data)
                for weights, change in zip(cnn.dense(), np.split(total[:-1], np.cumsum(rest)[:-1]), strict=True):
                    weights += (change / total[-1]).reshape(weights.shape).astype(np.float32)
    return cnn


def fit(docs: DataFrame, labels: DataFrame, apart: Column):
    """The broadcast model of all labelled rows that are not held apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    blocks, counts = samples.labelled_blocks(scratch, docs, labels, "toxic", apart, packed)
    model = ToxicityModel(counts)
    held = samples.summed(blocks, _class_counts, 4).reshape(2, 2)
    if not held[0].all():
        return spark.sparkContext.broadcast(model)
    # without both classes among the rows to calibrate by, all rows do both
    learn, calibrate = ("learn", "calibrate") if held[1].all() else (None, None)
    model.languages = _languages(blocks)
    model.cnn = _trained(blocks, learn)
    n = len(model.languages.names) + 1
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                rows, label = _unpacked(data.as_py(), calibrate)
                parts = [part.column("text") for own in rows.to_batches() for part in arrays.slices(own)]
                if parts:
                    logit = np.concatenate([sent.value.cnn.logits(p) for p in parts]).astype(float)
                    group = np.concatenate([sent.value.languages.guess(p) for p in parts])
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((logit, label, group))], pa.binary())], ["data"])

    logits = scratch.store(blocks.select("data").mapInArrow(run, "data binary"), "logits")
    sent.destroy()
    # labels may lack a document, so each row stands for its class in all labels
    rows = held[1] if calibrate else held[0]
    share = np.array([counts[0], counts[1]]) / rows
    share *= rows.sum() / (share * rows).sum()

    def sums(beta: np.ndarray) -> np.ndarray:
        def one(data: bytes) -> np.ndarray:
            logit, label, group = pickle.loads(data)
            return calibration_sums(logit, label, share[label], group, n, beta)

        return samples.summed(logits, one, 5 * n)

    model.slope, model.intercept, model.offsets = fit_calibration(sums, n)
    model.fitted = True
    scratch.drop("known", "blocks", "logits")
    return spark.sparkContext.broadcast(model)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    bounded_batches(spark)
    apart = samples.held_out(modulus, remainder)
    model = fit(docs, labels, apart)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", apart.alias("held_out")).mapInArrow(
        samples.scored(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    bounded_batches(spark)
    apart = samples.held_out(modulus, remainder)
    model = fit(docs, labels, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                yield part.filter(pa.array(model.value.score(part.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)

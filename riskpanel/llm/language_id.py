"""Language identification: words first, then shorter and shorter character n-grams.

A known word adds its log frequency in every language. An unseen word is read
character by character: at each place the longest known n-gram of four to one
characters that begins there is taken, and the mean of their log frequencies is
added. The language with the highest sum is predicted; the score is its share of
the likelihoods, taken per word so that long texts keep comparable scores.

The model is fitted on a bounded sample of rows (`per_language` of each language),
so its size has a bound too. Rules: a text that is null or has no letter is `und`
with score 0; a text with letters always gets a learned language; without any
training row everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from riskpanel.llm import arrays, samples
from riskpanel.llm.store import bounded_batches

PER_LANGUAGE = 1000
#: Keys that wait before they are counted.
HELD_KEYS = 1_000_000
LONGEST = 4
LEAST_COUNT = 2
SMOOTH = 0.5
_CHAR = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 1  # the code point that stands for both ends of a word


class Counts:
    """Counts of hashed keys by language, added up in parts so that only distinct keys are held."""

    def __init__(self, languages: int):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros((0, languages), np.float32)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, language: np.ndarray) -> None:
        self.waiting.append((keys, language.astype(np.int16)))
        if sum(len(k) for k, _ in self.waiting) > HELD_KEYS:
            self.settle()

    def settle(self) -> None:
        every = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        keys, at = np.unique(every, return_inverse=True)
        counts = np.zeros((len(keys), self.counts.shape[1]), np.float32)
        counts[at[: len(self.keys)]] = self.counts
        if self.waiting:
            np.add.at(counts, (at[len(self.keys) :], np.concatenate([x for _, x in self.waiting])), 1)
        self.keys, self.counts, self.waiting = keys, counts, []


@dataclass
class Table:
    """Log frequencies by language of hashed keys."""

    keys: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, counted: Counts, least: int) -> Table:
        counted.settle()
        total = counted.counts.sum(0)
        kept = counted.counts.sum(1) >= least
        logs = np.log(counted.counts[kept] + SMOOTH) - np.log(total + SMOOTH * max(len(counted.keys), 1))
        return cls(counted.keys[kept], logs.astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, is it known) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)


def _code_points(found: arrays.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points with an edge on both sides, first place of each) of the chosen words."""
    points = np.frombuffer(found.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum((found.data & 0xC0) != 0x80)))
    begin, end = at[found.starts[chosen]], at[found.ends[chosen]]
    lengths = end - begin + 2
    first = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(first, lengths)
    source = np.clip(np.repeat(begin - 1, lengths) + inside, 0, max(len(points) - 1, 0))
    edge = (inside == 0) | (inside == np.repeat(lengths - 1, lengths))
    return np.where(edge, _EDGE, points[source] if len(points) else 0).astype(np.uint64), first


def _grams(points: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, does it lie within its word) of the n-gram at every place."""
    lengths = np.diff(np.concatenate((first, [len(points)])))
    left = np.repeat(first + lengths, lengths) - np.arange(len(points))
    hashed = np.full(len(points), n, np.uint64)
    for k in range(n):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: len(points) - k] = points[k:]
        hashed = hashed * _CHAR + shifted
    return arrays.mix(hashed), left >= n


class LanguageModel:
    def __init__(self, table: pa.Table, spell: bool = True):
        """Fit on (text, lang) rows; without `spell` only known words are learned."""
        langs = table.column("lang").to_pylist()
        self.languages = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.languages)}
        of = np.array([number[x] for x in langs], np.int64)
        n = len(self.languages)
        words, grams = Counts(n), {k: Counts(n) for k in range(1, LONGEST + 1) if spell}
        begin = 0
        for batch in table.to_batches():
            for part in arrays.slices(batch):
                found = arrays.words(_lowered(part.column("text")), arrays.LETTER_WORDS)
                language = of[begin : begin + len(part)][found.text_of_word()]
                begin += len(part)
                hashes = found.hashes()
                words.add(hashes, language)
                if not spell or not len(hashes):
                    continue
                # n-grams are learned from the distinct words of each language in this part
                _, chosen = np.unique(np.stack([hashes, language.astype(np.uint64)], 1), axis=0, return_index=True)
                points, first = _code_points(found, chosen)
                spelled = np.repeat(language[chosen], np.diff(np.concatenate((first, [len(points)]))))
                for k, counted in grams.items():
                    hashed, inside = _grams(points, first, k)
                    counted.add(hashed[inside], spelled[inside])
        self.words = Table.of(words, LEAST_COUNT)
        self.grams = {k: Table.of(counted, LEAST_COUNT if k > 1 else 1) for k, counted in grams.items()}

    def _spelled(self, found: arrays.Words, chosen: np.ndarray) -> np.ndarray:
        """Scores of unseen words by backing off."""
        points, first = _code_points(found, chosen)
        sums = np.zeros((len(points), len(self.languages)), np.float32)
        open_ = np.ones(len(points), bool)
        used = np.zeros(len(points), np.float32)
        for n in range(LONGEST, 0, -1):
            hashed, inside = _grams(points, first, n)
            at = np.flatnonzero(open_ & inside)
            row, known = self.grams[n].find(hashed[at])
            at, row = at[known], row[known]
            sums[at] = self.grams[n].logs[row]
            used[at] = 1
            open_[at] = False
        total = np.add.reduceat(sums, first, axis=0)
        return total / np.maximum(np.add.reduceat(used, first), 1)[:, None]

    def scores(self, texts: pa.Array, back_off: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log frequencies by text and language, words that count)."""
        found = arrays.words(_lowered(texts), arrays.LETTER_WORDS)
        value, first, inverse = np.unique(found.hashes(), return_index=True, return_inverse=True)
        digits = (found.data[found.starts[first]] >= 0x30) & (found.data[found.starts[first]] <= 0x39)
        logs = np.zeros((len(value), len(self.languages)), np.float32)
        row, known = self.words.find(value)
        logs[known] = self.words.logs[row[known]]
        unseen = np.flatnonzero(~known & ~digits)
        if back_off and len(unseen):
            logs[unseen] = self._spelled(found, first[unseen])
        logs[digits] = 0
        prefix = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(logs[inverse], axis=0, dtype=np.float64)))
        counted = np.concatenate(([0], np.cumsum(~digits[inverse])))
        return prefix[found.bounds[1:]] - prefix[found.bounds[:-1]], counted[found.bounds[1:]] - counted[found.bounds[:-1]]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}").fill_null(False))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, counted = self.scores(texts)
        mean = total / np.sqrt(np.maximum(counted, 1))[:, None]
        shares = np.exp(mean - mean.max(1, keepdims=True))
        best = shares.argmax(1)
        score = np.where(letters, shares.max(1) / shares.sum(1), 0.0)
        return [self.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)], score

    def guess(self, texts: pa.Array) -> np.ndarray:
        """Number of the likeliest language by known words alone; the number of languages where there are none."""
        if not self.languages:
            return np.zeros(len(texts), np.int64)
        total, _ = self.scores(texts, back_off=False)
        return np.where(np.ptp(total, axis=1) > 0, total.argmax(1), len(self.languages))


def identify(spark: SparkSession, docs: DataFrame, modulus: int = 3, remainder: int = 1, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    bounded_batches(spark)
    apart = samples.held_out(modulus, remainder)
    model = samples.fitted(samples.language_rows(docs, apart, per_language), LanguageModel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                language, score = model.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(language, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", apart.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")

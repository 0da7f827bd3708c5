"""Licence texts by a positional index of rare words.

A first pass counts in how many texts each word of the licence templates occurs.
Of every template the words with the highest inverse document frequency are
indexed with their positions. A second pass looks up the indexed words of each
text; each occurrence at p of a word that stands at q in a template proposes that
the template begins at p - q. Where several rare words agree, the template is laid
over the text there: its key phrases must stand in place, and the share of its
words that do, weighted by inverse document frequency, is the score.

Three base phrases are found word by word, whatever their index terms.

Rules: words are lower-cased runs of letters and digits; a null text has none; a
text without licence words has empty labels and score 0. The templates bound all
that is collected or sent to tasks. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays
from riskpanel.llm.store import bounded_batches

#: Phrases and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, wording, phrases that must be there.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Indexed words of a template, how many must agree, and the least weighted share of words in place.
INDEXED = 4
AGREE = 2
LEAST_SHARE = 0.7


def _hashes(words: list[str]) -> np.ndarray:
    return arrays.words(pa.array(words), arrays.LETTER_WORDS).hashes()


@dataclass
class Vocabulary:
    """The distinct words of templates and base phrases, with a table from hash to word number."""

    words: list[str]
    hashes: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        self.hashes = _hashes(self.words)
        bits = 12
        while len(np.unique(self.hashes & np.uint64((1 << bits) - 1))) < len(self.words):
            bits += 1
        self.table = np.full(1 << bits, -1, np.int32)
        self.table[self.hashes & np.uint64((1 << bits) - 1)] = np.arange(len(self.words))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words outside the vocabulary."""
        guess = self.table[hashes & np.uint64(len(self.table) - 1)]
        return np.where(self.hashes[guess] == hashes, guess, -1)

    def of(self, phrase: str) -> np.ndarray:
        at = {w: i for i, w in enumerate(self.words)}
        return np.array([at[w] for w in phrase.split()])


def vocabulary(templates=TEMPLATES) -> Vocabulary:
    phrases = [p for p, _ in BASE_PHRASES] + [x for _, text, keys in templates for x in (text, *keys)]
    return Vocabulary(sorted({w for p in phrases for w in p.split()}))


def document_frequencies(docs: DataFrame, vocab: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each word of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = 0, np.zeros(len(vocab.words), np.int64)
        for batch in batches:
            for part in arrays.slices(batch):
                found = arrays.words(part.column("text"), arrays.LETTER_WORDS, lower=True)
                number = vocab.numbers(found.hashes())
                places = np.flatnonzero(number >= 0)
                text = np.searchsorted(found.bounds, places, "right") - 1
                held += np.bincount(np.unique(text * len(held) + number[places]) % len(held), minlength=len(held))
                rows += len(part)
        yield pa.RecordBatch.from_pydict({"word": np.arange(-1, len(held)), "texts": np.concatenate(([rows], held))})

    sums = docs.select("text").mapInArrow(count, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts")).collect()
    found = {r.word: r.texts for r in sums}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(vocab.words))])


@dataclass
class Index:
    """Templates as word numbers, and the postings of their rarest words."""

    vocab: Vocabulary
    idf: np.ndarray
    templates: list[tuple[str, np.ndarray, list[tuple[int, int]]]]
    postings: dict[int, list[tuple[int, int]]]  # word -> (template, position)
    agree: list[int]


def build_index(vocab: Vocabulary, rows: int, texts: np.ndarray, templates=TEMPLATES) -> Index:
    idf = np.log((rows + 1) / (texts + 1)) + 1e-3
    laid, postings, agree = [], {}, []
    for number, (label, text, keys) in enumerate(templates):
        words = vocab.of(text)
        spelled = f" {text} "
        spans = [(spelled[: spelled.index(f" {k} ") + 1].count(" ") - 1, len(k.split())) for k in keys]
        laid.append((label, words, spans))
        rare = sorted(set(words.tolist()), key=lambda w: (-idf[w], vocab.words[w]))[:INDEXED]
        agree.append(min(AGREE, len(rare)))
        for at, word in enumerate(words.tolist()):
            if word in rare:
                postings.setdefault(word, []).append((number, at))
    return Index(vocab, idf, laid, postings, agree)


def _scan(index: Index):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    phrases = [(index.vocab.of(p), label) for p, label in BASE_PHRASES]
    counts = np.array([len(index.postings.get(w, ())) for w in range(len(index.vocab.words))])
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    flat = np.array([x for w in range(len(counts)) for x in index.postings.get(w, ())], np.int64).reshape(-1, 2)

    def places(number: np.ndarray, text_of: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """First words of the phrase inside one text."""
        n = len(number) - len(phrase) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(number[:n] == phrase[0])
        for k in range(1, len(phrase)):
            at = at[number[at + k] == phrase[k]]
        return at[text_of(at) == text_of(at + len(phrase) - 1)]

    def laid_over(number: np.ndarray, bounds: np.ndarray, text_of) -> list[tuple[int, str, float]]:
        """(text, label, score) of every template that is found."""
        places = np.flatnonzero((number >= 0) & (counts[number] > 0))
        times = counts[number[places]]
        at = np.repeat(places, times)
        posting = np.repeat(begins[number[places]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        template, offset = flat[posting].T
        start = at - offset
        keys, agreeing = np.unique(np.stack([text_of(at), template, start], 1), axis=0, return_counts=True)
        found = []
        for (text, t, first), votes in zip(keys.tolist(), agreeing.tolist(), strict=True):
            if votes < index.agree[t]:
                continue
            label, words, spans = index.templates[t]
            spots = first + np.arange(len(words))
            inside = (spots >= bounds[text]) & (spots < bounds[text + 1])
            same = np.zeros(len(words), bool)
            same[inside] = number[spots[inside]] == words[inside]
            share = float(index.idf[words[same]].sum() / index.idf[words].sum())
            if share >= LEAST_SHARE and all(same[a : a + n].all() for a, n in spans):
                found.append((text, label, share))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                words = arrays.words(part.column("text"), arrays.LETTER_WORDS, lower=True)
                number = index.vocab.numbers(words.hashes())
                bounds, n = words.bounds, len(part)
                text_of = lambda at, bounds=bounds: np.searchsorted(bounds, at, "right") - 1
                base, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                hits = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for phrase, label in phrases:
                    at = places(number, text_of, phrase)
                    text = text_of(at)
                    hits += np.bincount(text, minlength=n)
                    np.minimum.at(first, text, at - bounds[text])
                    np.maximum.at(last, text, at - bounds[text])
                    score[text] = 1.0
                    for i in set(text.tolist()):
                        base[i].add(label)
                        labels[i].add(label)
                for i, label, share in laid_over(number, bounds, text_of):
                    labels[i].add(label)
                    score[i] = max(score[i], min(share, 1.0))
                none = hits == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(words.counts), pa.array(hits), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)],
                    columns,
                )

    return run


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    bounded_batches(spark)
    vocab = vocabulary(templates)
    index = build_index(vocab, *document_frequencies(docs, vocab), templates)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan(index), schema)

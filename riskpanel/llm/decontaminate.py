"""Benchmark decontamination by canonical templates.

Words are lower-cased runs of letters and digits. Numbers, names and units become
typed placeholders, so a question keeps its template when its parameters change; a
name of several words is one placeholder. Windows of documents meet those of items
by a hash join:

- every run of `window` canonical words; one with too few literal words grows to the
  right, and to the left, until it has enough of them;
- the same with names as plain words where that differs, so that copies in Title
  Case or without capitals are met;
- every run of `window` words, as they are, that is mostly numbers and units;
- items without any window of the first kind by their whole template, if it has
  SHORT_LITERAL literal words, and items shorter than `window` by all their words.

Positions count plain words. Matches of one item in one document whose diagonals
(document minus item position) lie SLACK or less from the next form an alignment,
so longer names and inserted or dropped words do not split it. It counts if it
covers enough of the item and its slots are consistent: most places of the values
that the item repeats have one value in the document each, or nearly all slots
have, or most slots are copied, or literal words alone cover nearly the whole item.

Document windows pass a bit table of the item windows first, so that almost none
are shuffled; the join decides.

A word is a number if it begins with a digit (digits joined by a point or comma
are one), a unit if it follows a number and is listed, a name if it begins with a
capital A-Z and no sentence begins there. Words shouted in capitals throughout are
no names.

Rules: null texts and those without words match nothing; an item of one or two words
is met wherever these words stand, but a document is dropped only for a match of four
words at least (LEAST_WORDS), since fewer stand in clean texts by chance; rows that repeat give repeated results; documents
with a null doc_id are treated like others. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm import arrays
from riskpanel.llm.store import Scratch, bit_table, in_bit_table, without

WINDOW = 8
LEAST_LITERAL = 5
#: Share of an item's words that an alignment has to cover.
LEAST_SHARE = 0.5
#: Words that suffice of any item, however long.
ENOUGH_WORDS = 50
#: Literal words of a whole short item that is met by its template.
SHORT_LITERAL = 3
#: Matched words for which a document is dropped, at least.
LEAST_WORDS = 4
#: Words by which neighbouring matches of one alignment may be shifted.
SLACK = 8
#: Shares of slots with one value each, of slots copied, and of literal words of the item, each enough alone.
LEAST_AGREED, LEAST_COPIED, LEAST_PLAIN = 0.9, 0.75, 0.8
LEAST_BITS = 24
NO_ID = -(2**63)

#: Units, as text.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g gram grams kg kilogram kilograms ton tons ounce ounces "
    "pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day "
    "days week weeks month months year years percent degree degrees dollar dollars euro euros cent cents mph kmh"
).split()

NUMBER, NAME, UNIT, PLAIN = (np.uint64(x) for x in (0x51ED270B, 0x6C9E5D1F, 0x2F0D37A5, 0x1B873593))
#: Kinds of item windows.
GROWN, DENSE, WHOLE, WHOLE_PLAIN = range(4)
_UNITS = np.sort(arrays.words(pa.array(UNITS), arrays.LETTER_WORDS).hashes())
_SENTENCE = np.zeros(256, np.int64)
_SENTENCE[[ord(c) for c in ".!?:\n"]] = 1
_JOINS = np.zeros(256, bool)
_JOINS[[ord(c) for c in ".,"]] = True
_PARTS_NAMES = np.ones(256, np.int64)
_PARTS_NAMES[[ord(c) for c in " \t-'"]] = 0


def _is_digit(x: np.ndarray) -> np.ndarray:
    return (x >= 0x30) & (x <= 0x39)


def _is_capital(x: np.ndarray) -> np.ndarray:
    return (x >= 0x41) & (x <= 0x5A)


class Form(NamedTuple):
    """Tokens of some texts: `bounds[i]:bounds[i+1]` are those of text i, `heads` their first words and one past all."""

    form: np.ndarray
    value: np.ndarray  # 0 for literal words
    heads: np.ndarray
    bounds: np.ndarray
    named: np.ndarray  # names before each token
    words: np.ndarray  # bounds in words


def _forms(texts: pa.Array) -> tuple[Form, Form, Form]:
    """Tokens with names as placeholders, with names as words, and plain words."""
    lowered = arrays.words(texts, arrays.LETTER_WORDS, lower=True)
    raw, starts, ends, bounds = lowered.raw, lowered.starts, lowered.ends, lowered.bounds
    n = len(starts)
    if not n:
        none = Form(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64), bounds, np.zeros(1, np.int64), bounds)
        return none, none, none
    word = lowered.hashes()
    number = _is_digit(raw[starts])
    opens = np.zeros(n, bool)
    opens[bounds[:-1][bounds[:-1] < n]] = True
    marks = np.concatenate(([0], np.cumsum(_SENTENCE[raw])))
    before = np.concatenate(([0], ends[:-1]))
    begins = opens | (marks[starts] > marks[before])
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    shouted = (ends - starts > 1) & _is_capital(second)
    # the second part of 3.5 or 1,000 belongs to the first
    joined = np.zeros(n, bool)
    joined[1:] = number[1:] & number[:-1] & ~opens[1:] & (starts[1:] - ends[:-1] == 1) & _JOINS[raw[ends[:-1]]]
    after = np.zeros(n, bool)
    after[1:] = number[:-1] & ~opens[1:]
    unit = after & ~number & (_UNITS[np.minimum(np.searchsorted(_UNITS, word), len(_UNITS) - 1)] == word)
    name = _is_capital(raw[starts]) & ~begins & ~shouted & ~unit
    # the second word of New York belongs to the first
    parts = np.concatenate(([0], np.cumsum(_PARTS_NAMES[raw])))
    more = np.zeros(n, bool)
    more[1:] = name[1:] & name[:-1] & ~opens[1:] & (parts[starts[1:]] == parts[ends[:-1]])

    def form(named: np.ndarray, joined: np.ndarray) -> Form:
        slot = number | unit | named
        heads = np.flatnonzero(~joined)
        value = np.where(slot, word | np.uint64(1), np.uint64(0))
        kept = np.concatenate(([0], np.cumsum(~joined)))
        total = np.concatenate(([0], np.cumsum(named[heads])))
        tokens = np.select([number, unit, named], [NUMBER, UNIT, NAME], word)[heads]
        return Form(tokens, np.add.reduceat(np.where(joined, arrays.mix(word), value), heads), np.append(heads, n), kept[bounds], total, bounds)

    plain = form(np.zeros(n, bool), np.zeros(n, bool))
    return form(name, joined | more), form(np.zeros(n, bool), joined), plain._replace(form=arrays.mix(word ^ PLAIN), named=np.concatenate(([0], np.cumsum(name))))


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canonical word, slot value, bounds): slot values are 0 for literal words."""
    found = _forms(texts)[0]
    return found.form, found.value, found.bounds


def _grown(form: Form, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of `window` tokens, each longer where that takes to hold `least` literal ones."""
    counts = np.diff(form.bounds)
    at, literal = np.arange(len(form.form)), np.flatnonzero(form.value == 0)
    least = max(least, 1)
    if len(literal) < least:
        return at[:0], at[:0]
    opens, closes = np.repeat(form.bounds[:-1], counts), np.repeat(form.bounds[1:], counts)
    last = np.searchsorted(literal, at) + least - 1
    end = np.maximum(at + window, literal[np.minimum(last, len(literal) - 1)] + 1)
    right = (last < len(literal)) & (end <= closes)
    # a run that grows to the left ends with slots
    begin = np.searchsorted(literal, at + 1) - least
    first = literal[np.maximum(begin, 0)]
    left = (begin >= 0) & (first >= opens) & (first < at + 1 - window)
    return np.concatenate((at[right], first[left])), np.concatenate((end[right], at[left] + 1))


def _literals(form: Form, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(form.value == 0)))
    return total[end] - total[first]


def _runs(form: Form, width: int) -> tuple[np.ndarray, np.ndarray]:
    first = arrays.window_starts(form.bounds, width)
    return first, first + width


def _shared_windows(forms: tuple[Form, Form, Form], window: int, least: int):
    """(kind, tokens, first, end) of the windows that items and documents both have."""
    named, unnamed, plain = forms
    yield GROWN, named, *_grown(named, window, least)
    first, end = _grown(unnamed, window, least)
    # where no name is, both forms are the same
    differs = _holds_name(forms, first, end)
    yield GROWN, unnamed, first[differs], end[differs]
    first, end = _runs(plain, window)
    dense = _literals(plain, first, end) < least
    yield DENSE, plain, first[dense], end[dense]


def _holds_name(forms: tuple[Form, Form, Form], first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether runs of tokens of the second form hold a name of the first."""
    heads, names = forms[1].heads, forms[2].named
    return names[heads[end]] > names[heads[first]]


def _item_spans(forms: tuple[Form, Form, Form], window: int, least: int):
    named, unnamed, plain = forms
    yield from _shared_windows(forms, window, least)
    for form in (named, unnamed):
        first, end = form.bounds[:-1], form.bounds[1:]
        literal = _literals(form, first, end)
        short = (literal >= SHORT_LITERAL) & ((end - first < window) | (literal < least))
        if form is unnamed:
            short &= _holds_name(forms, first, end)
        yield WHOLE, form, first[short], end[short]
    first, end = plain.bounds[:-1], plain.bounds[1:]
    short = (end > first) & (end - first < window)
    yield WHOLE_PLAIN, plain, first[short], end[short]


def _document_spans(forms: tuple[Form, Form, Form], window: int, least: int, longest: int, whole: list[int], whole_plain: list[int]):
    named, unnamed, plain = forms
    for kind, form, first, end in _shared_windows(forms, window, least):
        some = end - first <= longest
        yield form, first[some], end[some]
    for width in whole:
        for form in (named, unnamed):
            first, end = _runs(form, width)
            literal = _literals(form, first, end)
            short = (literal >= SHORT_LITERAL) & ((width < window) | (literal < least))
            if form is unnamed:
                short &= _holds_name(forms, first, end)
            yield form, first[short], end[short]
    for width in whole_plain:
        yield plain, *_runs(plain, width)


def _hashed(form: Form, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return arrays.spans_hash(form.form, first, end)


def _lists(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """values[first:end] per row."""
    ends = np.concatenate(([0], np.cumsum(end - first)))
    place = np.repeat(first - ends[:-1], end - first) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[place]))


def _item_windows(window: int, least_literal: int):
    """ITEM_COLUMNS of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                forms = _forms(part.column("text"))
                for kind, form, first, end in _item_spans(forms, window, least_literal):
                    text = np.searchsorted(form.bounds, first, "right") - 1
                    begin = form.words[text]
                    at = form.heads[first] - begin
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("item").take(pa.array(text)),
                            pa.array(np.diff(form.words)[text]),
                            pa.array(np.full(len(first), kind, np.int32)),
                            pa.array((end - first).astype(np.int32)),
                            pa.array(_hashed(form, first, end).view(np.int64)),
                            pa.array(at.astype(np.int32)),
                            pa.array((form.heads[end] - begin).astype(np.int32)),
                            _lists((form.heads[:-1] - np.repeat(form.words[:-1], np.diff(form.bounds))).astype(np.int32), first, end),
                            _lists(form.value.view(np.int64), first, end),
                        ],
                        ["item", "n_words", "kind", "n_tokens", "template", "item_at", "item_end", "item_places", "item_slots"],
                    )

    return run


ITEM_COLUMNS = "item long, n_words long, kind int, n_tokens int, template long, item_at int, item_end int, item_places array<int>, item_slots array<long>"


def _document_windows(window: int, least_literal: int, longest: int, whole: list[int], whole_plain: list[int], table):
    """(id, text_hash, template, at, slots) of the document windows that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                forms = _forms(part.column("text"))
                for form, first, end in _document_spans(forms, window, least_literal, longest, whole, whole_plain):
                    hashed = _hashed(form, first, end)
                    held = in_bit_table(table.value, hashed)
                    first, end, hashed = first[held], end[held], hashed[held]
                    if not len(first):
                        continue
                    text = np.searchsorted(form.bounds, first, "right") - 1
                    at = pa.array((form.heads[first] - form.words[text]).astype(np.int32))
                    row = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(row), part.column("text_hash").take(row), pa.array(hashed.view(np.int64)), at, _lists(form.value.view(np.int64), first, end)],
                        ["id", "text_hash", "template", "at", "slots"],
                    )

    return run


def with_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text", F.xxhash64("text").alias("text_hash"))


def alignments(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_literal: int = LEAST_LITERAL) -> DataFrame:
    """Per alignment (id, text_hash, item, place): windows, words and share of the item covered, slots, consistent."""
    scratch = Scratch(spark, "benchmark")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item"), "text").where("text is not null")
    items, n = scratch.counted(items.mapInArrow(_item_windows(window, least_literal), ITEM_COLUMNS), "items")
    bits = scratch.broadcast(bit_table(items, F.col("template"), n, LEAST_BITS))
    sizes = items.groupBy("kind").agg(F.max("n_tokens").alias("most"), F.collect_set("n_tokens").alias("every")).collect()
    longest = max([window, *(r.most for r in sizes if r.kind == GROWN)])
    whole, whole_plain = (sorted({n for r in sizes if r.kind == kind for n in r.every}) for kind in (WHOLE, WHOLE_PLAIN))
    found = with_keys(docs).mapInArrow(
        _document_windows(window, least_literal, longest, whole, whole_plain, bits), "id long, text_hash long, template long, at int, slots array<long>"
    )
    met = scratch.store(found.join(items.drop("kind", "n_tokens"), "template").withColumn("diagonal", F.col("at") - F.col("item_at")), "met")
    # neighbouring diagonals are one place
    pair = ["id", "text_hash", "item"]
    along = Window.partitionBy(*pair).orderBy("diagonal")
    places = met.select(*pair, "diagonal").distinct().withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK).cast("int"))
    places = places.select(*pair, "diagonal", F.sum(F.coalesce("new", F.lit(0))).over(along).alias("place"))
    met = met.join(places, [*pair, "diagonal"])
    key = [*pair, "place"]
    # each slot of an alignment once, however many windows show it
    slots = met.select(*key, F.explode(F.arrays_zip("item_places", "item_slots", "slots")).alias("slot")).where("slot.item_slots != 0")
    slots = slots.groupBy(*key, F.col("slot.item_slots").alias("theirs"), F.col("slot.slots").alias("ours")).agg(F.collect_set("slot.item_places").alias("at"))
    size = F.size("at")
    slots = slots.groupBy(*key, "theirs").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n"),
        F.max(size).alias("agreed"),
        F.max(F.when(F.col("theirs") == F.col("ours"), size).otherwise(0)).alias("copied"),
    )
    repeated = lambda c: F.sum(F.when(F.col("n") > 1, F.col(c)).otherwise(0))
    slots = slots.groupBy(*key).agg(
        F.sum("n").alias("n_slots"), F.sum("agreed").alias("agreed"), F.sum("copied").alias("copied"), repeated("n").alias("n_repeated"), repeated("agreed").alias("agreed_repeated")
    )
    literal = F.transform(F.filter(F.arrays_zip("item_places", "item_slots"), lambda x: x["item_slots"] == 0), lambda x: x["item_places"])
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    found = met.groupBy(*key).agg(
        F.countDistinct("item_at").alias("n_windows"),
        F.max("n_words").alias("n_words"),
        distinct(F.sequence("item_at", F.col("item_end") - 1)).alias("matched_words"),
        distinct(literal).alias("literal_words"),
    )
    consistent = (
        (F.col("agreed_repeated") * 2 > F.col("n_repeated"))
        | (F.col("n_repeated") == 0)
        | (F.col("agreed") >= F.col("n_slots") * LEAST_AGREED)
        | (F.col("copied") >= F.col("n_slots") * LEAST_COPIED)
        | (F.col("literal_words") >= F.col("n_words") * LEAST_PLAIN)
    )
    return found.join(slots, key, "left").select(
        *key,
        "n_windows",
        "matched_words",
        (F.col("matched_words") / F.col("n_words")).alias("share"),
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"),
        F.coalesce(consistent, F.lit(True)).alias("consistent"),
    )


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, **parameters) -> DataFrame:
    """(id, text_hash, item, matched_words, share, n_slots) of documents that hold an item, best alignment first."""
    enough = (F.col("share") >= least_share) | (F.col("matched_words") >= ENOUGH_WORDS)
    good = alignments(spark, docs, benchmark, **parameters).where(enough & F.col("consistent"))
    best = F.max(F.struct("share", "matched_words", "n_windows", "n_slots")).alias("best")
    return good.groupBy("id", "text_hash", "item").agg(best, F.count("*").alias("n_places")).select("id", "text_hash", "item", "best.*", "n_places")


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that hold no benchmark item by LEAST_WORDS words or more, with all their columns."""
    found = contaminated(spark, docs, benchmark, **parameters).where(F.col("matched_words") >= LEAST_WORDS).select("id", "text_hash")
    return without(docs, Scratch(spark, "benchmark-kept"), found, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(docs["text"]))

"""Sanitisation of personal data, with terms that reveal it.

Direct identifiers (e-mail and IP addresses, card and phone numbers) are found by
pattern. Each distinct value is a protected entity. A term may reveal an entity
without spelling it: how strongly is estimated from the corpus. With N documents,
n(e) holding the entity, n(t) the term and n(t, e) the term near the entity,

    information of e      IC(e)     = log N / n(e)
    information shared    PMI(t; e) = log n(t, e) N / (n(t) n(e))
    disclosure            PMI(t; e) / IC(e)

Disclosure is 1 if the term occurs only with the entity and 0 if it is
independent. Terms from `generalise_at` on are generalised (a placeholder of their
kind), from `remove_at` on removed, wherever they occur. Terms near an entity in
fewer than `least_documents` documents are no evidence and stay.

Only terms near entities are paired, so pairs grow with the entities, not with
the square of anything. Term counts cover all documents; tasks add them up before
anything is shuffled.

Rules: a null text is empty; kinds are matched apart, leftmost first, and a match
that fails its test is dropped; term spans never overlap base spans; rows with the
same doc_id and text get the same spans. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays
from riskpanel.llm.store import Scratch, bit_table, in_bit_table

#: The kinds in order, then those that the method adds.
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")

NEAR_WORDS = 8
LEAST_DOCUMENTS = 3
GENERALISE_AT = 0.6
REMOVE_AT = 0.9
#: Terms that a task holds before it passes their counts on.
HELD_TERMS = 200_000
NO_ID = -(2**63)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that fails at the start of a run of digits fails inside it too, so only starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The part before each @ is the run of its characters that no earlier match has used."""
    used = 0
    for match in _DOMAIN.finditer(text):
        begin = match.start()
        while begin > used and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < match.start():
            yield begin, match.end()
            used = match.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield match.span()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield match.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(match.group())) <= 15:
            yield match.span()


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans in code points, by kind."""
    plain = "@" in text, text.count(".") > 2, "+" in text
    return [list(f(text)) if may else [] for f, may in ((emails, plain[0]), (ips, plain[1]), (cards, True), (phones, plain[2]))]


def entity_of(kind: str, value: str) -> str:
    """One value however it is spelled."""
    return f"{kind} {value.lower() if kind == 'email' else value if kind == 'ip' else ''.join(_DIGIT.findall(value))}"


def _span_text(named: list[tuple[str, list[tuple[int, int]]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, spans in named for a, b in sorted(spans))


def _points(found: arrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last code point of every word, inside its text."""
    at = np.concatenate(([0], np.cumsum((found.raw & 0xC0) != 0x80)))
    base = at[found.offsets[:-1]][found.text_of_word()]
    return at[found.starts] - base, at[found.ends] - base


def _has_letter(found: arrays.Words) -> np.ndarray:
    """Words with a letter; numbers alone are no terms."""
    letters = np.concatenate(([0], np.cumsum((found.data >= 0x61))))
    return letters[found.ends] > letters[found.starts]


def _base(near: int):
    """(id, text_hash, counts, base_spans, pairs of entity and terms near it) of every text."""
    pair = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))

    def terms_near(found, points, i: int, spans: list, named: list) -> list[dict]:
        low, high = found.bounds[i], found.bounds[i + 1]
        first, last = points[0][low:high], points[1][low:high]
        hidden = np.zeros(high - low, bool)
        for a, b in spans:
            hidden[np.searchsorted(last, a, "right") : np.searchsorted(first, b)] = True
        free = np.flatnonzero(~hidden & found.letter[low:high])
        out = set()
        for entity, (a, _) in zip(named, spans, strict=True):
            middle = np.searchsorted(free, np.searchsorted(first, a))
            for w in free[max(0, middle - near) : middle + near]:
                out.add((entity, int(found.value[low + w])))
        return [{"entity": e, "term": t} for e, t in sorted(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                texts = part.column("text").to_pylist()
                found, points, counts, named, pairs = None, None, [], [], []
                for i, text in enumerate(texts):
                    spans = base_spans(text or "")
                    counts.append([len(s) for s in spans])
                    named.append(_span_text(list(zip(KINDS, spans, strict=True))))
                    if not any(spans):
                        pairs.append([])
                        continue
                    if found is None:
                        found = arrays.words(part.column("text"), arrays.LETTER_WORDS, lower=True)
                        found.value, found.letter = found.hashes().view(np.int64), _has_letter(found)
                        points = _points(found)
                    flat = [(k, s) for k, kind in zip(KINDS, spans, strict=True) for s in kind]
                    entities = [int.from_bytes(hashlib.sha256(entity_of(k, text[a:b]).encode()).digest()[:8], "little", signed=True) for k, (a, b) in flat]
                    pairs.append(terms_near(found, points, i, [s for _, s in flat], entities))
                counts = np.array(counts, np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(named, pa.string()), pa.array(pairs, pair)],
                    ["id", "text_hash", *(f"n_{k}" for k in KINDS), "base_spans", "pairs"],
                )

    return run


def _texts_with(table):
    """(term, texts) counted in a task, for the terms that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"term": list(held), "texts": list(held.values())}, pa.schema([("term", pa.int64()), ("texts", pa.int64())]))

        for batch in batches:
            for part in arrays.slices(batch):
                found = arrays.words(part.column("text"), arrays.LETTER_WORDS, lower=True)
                value = found.hashes()
                may = np.flatnonzero(in_bit_table(table.value, value))
                once = np.unique(np.stack([found.text_of_word()[may].astype(np.uint64), value[may]], 1), axis=0)
                terms, texts = np.unique(once[:, 1], return_counts=True)
                held.update(dict(zip(terms.view(np.int64).tolist(), texts.tolist(), strict=True)))
            if len(held) > HELD_TERMS:
                yield passed_on()
                held.clear()
        yield passed_on()

    return run


def _term_places(table):
    """(id, text_hash, term, starts, ends) of the terms of each text that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                found = arrays.words(part.column("text"), arrays.LETTER_WORDS, lower=True)
                value = found.hashes()
                may = np.flatnonzero(in_bit_table(table.value, value))
                first, last = _points(found)
                text = found.text_of_word()[may]
                order = np.lexsort((may, value[may], text))
                may, text = may[order], text[order]
                new = np.ones(len(may), bool)
                new[1:] = (text[1:] != text[:-1]) | (value[may][1:] != value[may][:-1])
                begin = np.flatnonzero(new)
                offsets = pa.array(np.append(begin, len(may)).astype(np.int32))
                row = pa.array(text[begin])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(row), part.column("text_hash").take(row), pa.array(value[may][begin].view(np.int64)), *(pa.ListArray.from_arrays(offsets, pa.array(x[may].astype(np.int32))) for x in (first, last))],
                    ["id", "text_hash", "term", "starts", "ends"],
                )

    return run


def disclosing_terms(scratch: Scratch, texts: DataFrame, base: DataFrame, least_documents: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(term, kind, disclosure) of the terms that reveal some entity."""
    spark = scratch.spark
    rows = base.count()
    shown = base.where(F.size("pairs") > 0).select(F.explode("pairs").alias("pair")).select("pair.*")
    entities = base.where(F.size("pairs") > 0).select(F.explode(F.array_distinct(F.transform("pairs", lambda p: p["entity"]))).alias("entity"))
    pairs = shown.groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= least_documents)
    pairs = scratch.store(pairs.join(entities.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity"), "pairs")
    terms = pairs.select("term").distinct()
    held = spark.sparkContext.broadcast(bit_table(terms, F.col("term"), terms.count(), 20))
    texts_with = texts.select("text").mapInArrow(_texts_with(held), "term long, texts long").groupBy("term").agg(F.sum("texts").alias("n_term"))
    total = F.lit(float(rows))
    shared = F.log(F.col("both") * total / (F.col("n_term") * F.col("n_entity")))
    information = F.log(total / F.col("n_entity"))
    # an entity that every document has carries no information
    disclosure = F.when(F.col("n_entity") < rows, shared / information).otherwise(F.lit(0.0))
    worst = pairs.join(texts_with, "term").groupBy("term").agg(F.max(disclosure).alias("disclosure")).where(F.col("disclosure") >= generalise_at)
    return worst.withColumn("kind", F.when(F.col("disclosure") >= remove_at, TERM_KINDS[0]).otherwise(TERM_KINDS[1]))


def find(spark: SparkSession, docs: DataFrame, near: int = NEAR_WORDS, least_documents: int = LEAST_DOCUMENTS, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base_spans, term_spans (array of kind, start, end)."""
    scratch = Scratch(spark, "pii")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    base = scratch.store(
        texts.mapInArrow(_base(near), f"id long, text_hash long, {counts}, base_spans string, pairs array<struct<entity: long, term: long>>"), "base"
    )
    terms = scratch.store(disclosing_terms(scratch, texts, base, least_documents, generalise_at, remove_at), "terms")
    held = spark.sparkContext.broadcast(bit_table(terms, F.col("term"), terms.count(), 20))
    places = texts.mapInArrow(_term_places(held), "id long, text_hash long, term long, starts array<int>, ends array<int>").join(terms, "term")
    span = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    spans = F.transform(span, lambda s: F.struct(F.col("kind").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    # texts that repeat in full give the same places
    places = places.dropDuplicates(["id", "text_hash", "term"]).groupBy("id", "text_hash").agg(F.flatten(F.collect_list(spans)).alias("term_spans"))
    given = base.select("id", "text_hash", *(f"n_{k}" for k in KINDS), "base_spans").join(scratch.store(places, "places"), ["id", "text_hash"], "left")
    ranges = F.transform(
        F.filter(F.split("base_spans", ","), lambda s: s != ""),
        lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("a"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("b")),
    )
    clear = F.filter("term_spans", lambda t: ~F.exists(F.col("ranges"), lambda r: (t["start"] < r["b"]) & (r["a"] < t["end"])))
    return given.withColumn("ranges", ranges).select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text_hash", *(f"n_{k}" for k in KINDS), "base_spans", F.array_sort(clear).alias("term_spans")
    )


def all_spans() -> F.Column:
    """Base spans, then removed and generalised terms, as kind:start:end joined by commas."""

    def of_kind(kind: str) -> F.Column:
        return F.transform(F.filter("term_spans", lambda t: t["kind"] == kind), lambda t: F.concat_ws(":", t["kind"], t["start"], t["end"]))

    added = F.coalesce(F.array_join(F.concat(*map(of_kind, TERM_KINDS)), ","), F.lit(""))
    return F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), F.when(added != "", added))


def masked(text: str, spans: str) -> str:
    """The text with base spans as [KIND], generalised terms as [TERM] and removed terms cut out."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)), key=lambda s: (s[1], -s[2])):
        if b > at:
            out += [text[at : max(a, at)], "" if kind == "removed" else "[TERM]" if kind == "generalised" else f"[{kind.upper()}]"]
            at = b
    return "".join(out) + text[at:]

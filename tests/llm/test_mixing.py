"""Mixing against its definition, and the pipeline against its stages."""

import random
import re
from collections import defaultdict

import corpus_pipeline
from riskpanel.llm import mixing
from riskpanel.llm.queries import table


def shares(sizes, weights=(5, 2, 1), most=3):
    """Share everything by weight again and again until no target is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        spare = left - sum(most * sizes[s] for s in full)
        for s in free:
            target[s] = spare * weight[s] / sum(weight[x] for x in free)
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over
        target |= {s: most * sizes[s] for s in over}


def test_targets_and_words(spark, frame):
    draw = random.Random(8)
    texts = []
    for i in range(900):
        source = draw.choice(["hot"] * 12 + ["B", "a", "ä", None, "tiny", "Z"])
        n = draw.choice([0, 1, 3, 20]) if source != "tiny" else 1
        texts.append((i, " ".join("w" * draw.randrange(1, 5) for _ in range(n)), "en", source))
    texts += [(2000, None, "en", "null only"), (None, "one two", None, "B")]
    rows = mixing.mix(spark, frame(texts)).collect()
    assert len(rows) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shares(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 20
    again = {(r.doc_id, r.source): r.taken for r in mixing.mix(spark, frame(texts, 7)).collect()}
    assert again == {(r.doc_id, r.source): r.taken for r in rows}


def test_budgets_are_nested(spark, frame):
    texts = [(i, "w " * (1 + i % 7), "en", "ab"[i % 2]) for i in range(300)]
    less = {r.doc_id for r in mixing.mix(spark, frame(texts), weights=(1, 9)).collect() if r.copies}
    more = {r.doc_id for r in mixing.mix(spark, frame(texts), weights=(2, 9)).collect() if r.copies}
    assert {d for d in less if d % 2 == 0} <= {d for d in more if d % 2 == 0}


def test_mixed_documents(spark, frame):
    docs = frame([(i, "w w", "en", "ab"[i % 2]) for i in range(40)])
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == [*docs.columns, "mix_copies"]
    want = {r.doc_id: r.copies for r in mixing.mix(spark, docs).collect() if r.copies}
    assert {r.doc_id: r.mix_copies for r in mixed.collect()} == want


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir).collect()
        docs = spark.createDataFrame(kept, docs.schema)
        ids = [r.doc_id for r in kept]
        assert docs.columns == columns, name
        assert len(ids) == len(set(ids)) and set(ids) <= before and ids, name
        before = set(ids)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.mix_copies) for r in mixed} == {(r.doc_id, r.mix_copies) for r in whole}
    assert {r.doc_id for r in mixed} <= before


def test_empty_pipeline(spark, frame, sf_dir):
    docs = frame([]).where("false").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0

"""Exact, near and passage duplicates against brute force."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import exact_dedup, mixing, near_dedup, substring_dedup

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_components(texts, width, percent):
    sets = {}
    for doc_id, text in texts:
        w = BLANK.findall((text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("counters", [3, 1023])
def test_exact_groups(spark, frame, corpus, counters):
    found = {r.doc_id: r for r in exact_dedup.duplicate_groups(spark, frame(corpus), counters).collect()}
    assert len(found) == len(corpus)
    groups = {}
    for doc_id, text in corpus:
        groups.setdefault(text or "", []).append(doc_id)
    for doc_id, text in corpus:
        same = groups[text or ""]
        r = found[doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), doc_id == max(same), sha(text or ""))


def test_exact_ties_nulls_and_repeated_rows(spark, frame):
    docs = frame([(None, "a"), (None, "a"), (3, "b"), (3, "b"), (1, "b"), (None, "c"), (2, "c")])
    found = exact_dedup.duplicate_groups(spark, docs).collect()
    assert sum(r.kept for r in found) == 3
    assert {r.text_sha256: r.keep_id for r in found} == {sha("a"): None, sha("b"): 3, sha("c"): 2}
    left = exact_dedup.keep_one_of_each(spark, docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "a"), (2, "c"), (3, "b")]


def test_heavy_hitters_are_exact_and_few(spark, frame):
    draw = random.Random(1)
    texts = [(i, draw.choice(["hot"] * 40 + ["warm"] * 10 + [f"t{k}" for k in range(50)])) for i in range(600)]
    docs = frame(texts, 7).select("doc_id", exact_dedup.digest_of_text().alias("digest"))
    heavy = {r.digest: r for r in exact_dedup.heavy_digests(docs, docs.doc_id, 9).collect()}
    assert len(heavy) <= 10
    for text in {t for _, t in texts}:
        ids = [d for d, t in texts if t == text]
        if len(ids) >= 2 * len(texts) / 10:
            assert sha(text) in heavy
        if sha(text) in heavy:
            assert (heavy[sha(text)].group_size, heavy[sha(text)].winner) == (len(ids), max(ids))


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups(spark, frame, corpus, width):
    found = near_dedup.near_duplicate_groups(spark, frame(corpus), width).collect()
    want = brute_components(corpus, width, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_small_sketches_keep_every_link(spark, frame):
    """Sketches far smaller than the sets; chains of edits around the threshold."""
    draw = random.Random(9)
    texts, word = [], [f"x{i}" for i in range(900)]
    for group in range(4):
        now = [draw.choice(word) for _ in range(150)]
        for step in range(12):
            texts.append((group * 100 + step, " ".join(now)))
            for _ in range(draw.choice([1, 3, 6])):
                now[draw.randrange(len(now))] = draw.choice(word)
    found = near_dedup.NearDuplicates(spark, frame(texts), 4, 80, k=64).groups().collect()
    assert {r.id: (r.n_shingles, r.component) for r in found} == brute_components(texts, 4, 80)


def test_near_nulls_and_stage(spark, frame, corpus):
    docs = frame([*corpus, (None, "one two three four five six"), (200, "one two three four five six")])
    found = {r.doc_id: r for r in near_dedup.near_duplicate_groups(spark, docs).collect()}
    assert found[200].component_id is None and not found[200].kept and found[None].kept
    left = near_dedup.keep_one_of_each_group(spark, docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, r in found.items() if r.kept}


def brute_removal(texts, window):
    seen, out = {}, {}
    for doc_id, text in sorted(texts, key=lambda t: -1 if t[0] is None else t[0]):
        w = BLANK.findall(text or "")
        gone, mine = set(), [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        for i, k in enumerate(mine):
            if k in seen:
                gone.update(range(i, i + window))
        for k in mine:
            seen.setdefault(k, doc_id)
        out[doc_id] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window", [35, 50])
def test_passages(spark, frame, corpus, window):
    found = substring_dedup.remove_repeats(spark, frame([*corpus, (None, corpus[-1][1])]), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == brute_removal([*corpus, (None, corpus[-1][1])], window)


def test_passages_at_every_alignment(spark, frame):
    """A run of exactly one window is found at each pair of offsets modulo the period."""
    draw = random.Random(4)
    fresh = iter(f"u{i}" for i in range(10**6))
    texts = []
    for i in range(31):
        run = [f"r{i}x{k}" for k in range(50)]
        for doc, offset in ((2 * i, i), (2 * i + 1, draw.randrange(31))):
            texts.append((doc, " ".join([next(fresh) for _ in range(offset)] + run + [next(fresh)])))
    found = substring_dedup.remove_repeats(spark, frame(texts)).collect()
    assert {r.doc_id: r.n_removed for r in found} == {d: 50 * (d % 2) for d, _ in texts}


def test_difference_cover():
    distances = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert distances == set(range(substring_dedup.PERIOD))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(None, None, 20)


def test_passages_of_one_id_are_not_earlier(spark, frame):
    run = " ".join(f"q{i}" for i in range(60))
    found = substring_dedup.remove_repeats(spark, frame([(1, run), (1, run), (1, run + " x"), (2, run)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (1, 0), (2, 60)]


def test_empty_tables(spark, frame):
    docs = frame([]).where("false")
    assert exact_dedup.duplicate_groups(spark, docs).count() == 0
    assert exact_dedup.keep_one_of_each(spark, docs).count() == 0
    assert near_dedup.near_duplicate_groups(spark, docs).count() == 0
    assert substring_dedup.remove_repeats(spark, docs).count() == 0


def test_stages_keep_columns_of_any_name(spark, frame):
    """Names that the stages use themselves, null ids, nulls, repeated rows: every text once, with its own columns."""
    names = ("key_0", "key_1", "row", "kept_row", "digest", "_may_match", "_place", "_part", "_bits", "dropped_id", "found_id", "found_hash", "mix_copies")
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (None, "g h i j k l m"), (7, "g h i j k l m")]
    docs = frame(texts).drop("digest", "kept").withColumns({n: F.lit("own") for n in names})
    once = exact_dedup.keep_one_of_each(spark, docs)
    assert once.columns == docs.columns and {tuple(r[n] for n in names) for r in once.collect()} == {("own",) * len(names)}
    assert sorted(r.doc_id for r in once.collect()) == [2, 4, 7]
    near = near_dedup.keep_one_of_each_group(spark, docs)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == {None, 1, 3, 4}
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == [c for c in docs.columns if c != "mix_copies"] + ["mix_copies"]
    assert {r.mix_copies for r in mixed.collect()} <= {1, 2, 3}
    for stage in (exact_dedup.keep_one_of_each, near_dedup.keep_one_of_each_group):
        assert stage(spark, docs.where("false")).count() == 0

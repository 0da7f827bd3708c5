"""Classifiers: held-out accuracy on the given tables, and their rules on odd rows."""

import random
import zlib

import pytest

from riskpanel.llm import language_id, quality, queries, toxicity
from riskpanel.llm.queries import table

SF = "/root/testdata/sf0.01"


def auc(pairs):
    pairs = sorted(pairs)
    ranks, at = {}, 0
    while at < len(pairs):
        end = at
        while end < len(pairs) and pairs[end][0] == pairs[at][0]:
            end += 1
        ranks[pairs[at][0]] = (at + end + 1) / 2
        at = end
    ones = [s for s, y in pairs if y]
    return (sum(ranks[s] for s in ones) - len(ones) * (len(ones) + 1) / 2) / (len(ones) * (len(pairs) - len(ones)))


@pytest.mark.parametrize(("query", "label", "modulus", "remainder", "least"), [("op7_toxicity", "toxic", 3, 1, 0.75), ("op10_quality", "quality", 4, 2, 0.95)])
def test_held_out_scores(spark, query, label, modulus, remainder, least):
    found = getattr(queries, query)(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(table(spark, SF, "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, r[label]) for r in rows if r.held_out and r[label] is not None]
    assert auc(held) > least


def test_language_held_out(spark):
    rows = language_id.identify(spark, table(spark, SF, "documents")).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_rules(spark, frame):
    texts = [(i, "der die das und nicht", "de", "a") for i in range(30)] + [(100 + i, "the of and to in", "en", "a") for i in range(30)]
    texts += [(200, None, "en", "a"), (201, "12 34 ...", "de", "a"), (202, "", None, "a"), (203, "derb diener", None, "a"), (None, "the the", None, None), (204, "ж", None, "b")]
    found = {r.doc_id: r for r in language_id.identify(spark, frame(texts)).collect()}
    assert len(found) == len(texts)
    assert [found[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert found[203].lang_pred == "de" and found[None].lang_pred == "en" and found[204].lang_pred in ("de", "en")


def test_labels_learned_only_outside_the_fold(spark, frame):
    """Turning all held-out labels round changes no score."""
    texts = [(i, f"plain words {i}" + (" awful" if i % 3 == 0 else "")) for i in range(150)]
    docs = frame(texts)

    def labels(flip):
        rows = [(i, int(i % 3 == 0)) for i in range(150)]
        rows = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in rows]
        return spark.createDataFrame([(i, y, y) for i, y in rows], "doc_id long, quality int, toxic int")

    a, b = ({r.doc_id: r.score for r in toxicity.score(spark, docs, labels(flip)).collect()} for flip in (False, True))
    assert a == b
    held = [(a[i], int(i % 3 == 0)) for i in range(150) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert auc(held) > 0.95


@pytest.mark.parametrize("score", [toxicity.score, quality.score])
def test_odd_rows(spark, frame, score):
    texts = [(0, None), (1, ""), (2, " \n "), (3, "x"), (None, "y"), (4, "long " * 30_000), (4, "again"), (5, "12 !!")]
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = score(spark, frame(texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in score(spark, frame(texts), none).collect()} == {0.0}
    assert score(spark, frame(texts).where("false"), none).count() == 0


def test_languages_beyond_the_bound_are_not_learned(spark, frame):
    from riskpanel.llm import samples
    from pyspark.sql import functions as F

    texts = [(i, f"word{i} text", "en" if i < 30 else "de" if i < 50 else f"x{i}", "a") for i in range(70)]
    rows = samples.language_rows(frame(texts), F.lit(False), 1000, most_languages=2).collect()
    assert {r.lang for r in rows} == {"en", "de"} and len(rows) == 50


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_every_labelled_row_is_in_the_fit(spark, frame, monkeypatch, module, label):
    """More rows of a class than the 3,000 or 4,000 of former samples: all are in the blocks that the fit reads, once."""
    from riskpanel.llm import samples

    n, rows = 9000, []
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word', id % 7, ' text', IF(id % 2 = 1, ' awful', '')) AS text", "'en' AS lang")
    marks = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "CAST(id % 2 AS INT) AS toxic")
    first = samples.labelled_blocks

    def noted(scratch, docs, labels, label, apart, pack):
        blocks, counts = first(scratch, docs, labels, label, apart, lambda t: str(t.column("place").to_pylist()).encode())
        rows.extend(x for r in blocks.collect() for x in eval(bytes(r.data).decode()))
        return first(scratch.__class__(spark, "again"), docs, labels, label, apart, pack)

    monkeypatch.setattr(samples, "labelled_blocks", noted)
    found = module.score(spark, docs, marks).collect()
    learned = [r for r in found if not r.held_out]
    assert len(rows) == len(set(rows)) == len(learned) > 5000
    held = [(r.score, r.doc_id % 2) for r in found if r.held_out]
    assert auc(held) > 0.99


def test_quantile_of_all_rows(spark):
    """The exact weighted quantile, with ties, narrowed down over many rows."""
    draw = random.Random(4)
    rows = [(draw.choice([0.5, draw.gauss(0, 1), draw.gauss(0, 1e-9)]), draw.randrange(2)) for _ in range(3000)]
    table = spark.createDataFrame(rows, "strength double, label int")
    for target in (1, 700, 1234.5, 3000):
        total, expected = 0.0, None
        for s, y in sorted(rows):
            total += (0.5, 1.5)[y]
            if total >= target:
                expected = s
                break
        assert quality.quantile(table, [0.5, 1.5], target) == (max(rows)[0] if expected is None else expected)

"""Whitening and hard negatives against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.llm import hard_negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, weight int, rank int, cell int"
INF, NAN = float("inf"), float("nan")


def frame(spark, rows, parts=3):
    """Rows (vec_id, embedding, label), with columns whose names the operators use."""
    return spark.createDataFrame([(*r, "x", "c", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def odd_rows(dim):
    fine = [0.25] * dim
    return [(7001, None, 1), (7002, [None, *fine[1:]], 1), (7003, [INF, *fine[1:]], 1), (7004, [NAN, *fine[1:]], 1), (7005, fine[:-1], 1), (7006, [], 1)]


def vectors(n, dim, seed=5):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n, dim)).astype(np.float32)
    base[n // 2 :] = base[0]  # half of all rows are one vector
    return [(i, [float(v) for v in base[i]], int(draw.integers(0, 3))) for i in range(n)]


def whitened(spark, rows, **given):
    return whitening.whiten(spark, frame(spark, rows), **given).collect()


def reference(rows, weights="counts"):
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fitted = x if weights == "counts" else np.unique(x, axis=0)
    n, total = len(fitted), fitted.sum(axis=0)
    centred = x - total / n
    cov = (fitted - total / n).T @ (fitted - total / n) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - total) ** 2).sum(axis=1), centred @ axes / np.sqrt(values), values / values.sum()


@pytest.mark.parametrize("weights", ["counts", "one"])
@pytest.mark.parametrize("dim", [3, 40])
def test_whitening(spark, weights, dim):
    rows = vectors(200, dim)
    found = whitened(spark, [*rows, *odd_rows(dim)], weights=weights)
    n, deviation, white, share = reference(rows, weights)
    kept = min(dim, 32)
    assert len(found) == len(rows) * kept and {r.component for r in found} == set(range(1, kept + 1))
    got = np.zeros((len(rows), kept))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(deviation[r.vec_id]) and r.identity_error < 1e-9
        assert abs(r.explained - share[r.component - 1]) < 1e-9
        assert r.copies == (101 if r.vec_id == 0 or r.vec_id >= 100 else 1)
    sign = np.sign((got * white[:, :kept]).sum(axis=0))
    assert np.abs(got * sign - white[:, :kept]).max() < 1e-7


def test_whitening_without_variance(spark):
    for rows in ([(1, [0.5, 0.5], 1)], [(i, [0.5, 0.5], 1) for i in range(9)]):
        found = whitened(spark, rows)
        assert len(found) == 2 * len(rows)
        assert all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error == 0 for r in found)
    # one of two dimensions is constant
    found = whitened(spark, [(None, [1.0, 0.5], 1), (3, [1.0, 0.75], 1), (3, [1.0, 0.75], 1)])
    assert Counter((r.vec_id, r.component, r.whitened is None) for r in found) == {(None, 1, False): 1, (3, 1, False): 2, (None, 2, True): 1, (3, 2, True): 2}


def test_whitening_of_huge_entries(spark):
    found = whitened(spark, [(1, [3e38, 0.0], 1), (2, [-3e38, 1.0], 1), (3, [0.0, 2.0], 1)])
    assert len(found) == 6 and all(r.deviation > 0 for r in found)
    assert max(abs(r.whitened) for r in found if r.component == 1) < 2


def test_whitening_of_nothing(spark):
    for rows in ([], odd_rows(4)[:4]):
        got = whitening.whiten(spark, frame(spark, rows))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "copies"]


def brute_negatives(rows, relabel):
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, (_, v, _) in enumerate(rows)}
    label = [(r[2] + 1) % 10 if relabel and r[0] % 7 == 0 else r[2] for r in rows]
    out = Counter()
    for i, (anchor, _, _) in enumerate(rows):
        if anchor % 100:
            continue
        scored = sorted((-int(x[i] @ x[j]), rows[j][0], label[j]) for j in range(len(rows)) if rows[j][0] != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == label[i]][:5]:
            inside = [s for s in scored if s[2] != label[i] and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:10]
            for rank, (other, negative, _) in enumerate(inside, start=1):
                out[anchor, positive, rank, negative, -minus, -other] += 1
    return out


def clustered(n, dim, seed):
    """Few tight clusters and some noise, so that nodes can be skipped."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] * draw.uniform(0.2, 1) + draw.normal(scale=0.15, size=dim)
        rows.append((i, [float(np.float32(c)) for c in v], int(draw.integers(0, 10))))
    return rows


@pytest.mark.parametrize(("rows", "relabel"), [(clustered(900, 6, 1), True), (clustered(500, 24, 2), False), (vectors(400, 8), True)])
def test_hard_negatives(spark, rows, relabel):
    found = hard_negatives.mine(spark, frame(spark, [*rows, *odd_rows(len(rows[0][1])), (7100, rows[0][1], None)]), relabel=relabel).collect()
    assert Counter(tuple(r) for r in found) == brute_negatives(rows, relabel)


def test_hard_negatives_on_odd_rows(spark):
    same = [0.5, 0.5]
    rows = [(0, same, 1), (0, same, 1), (0, [0.1, 0.1], 2), (1, same, 1), (2, [0.3, 0.3], 2), (2, [0.3, 0.3], 2), (None, [0.4, 0.3], 2), (100, [0.0, 0.0], 1)]
    found = hard_negatives.mine(spark, frame(spark, rows)).collect()
    # the copy of the anchor is not another row; repeated negatives and those without an id are rows of their own
    mine = [r for r in found if r.anchor_id == 0 and r.positive_id == 1]
    assert [(r["rank"], r.negative_id) for r in sorted(mine, key=lambda r: r["rank"])] == [(1, None), (2, 2), (3, 2)]
    # all scores of a zero vector are 0
    assert {r.negative_score for r in found if r.anchor_id == 100} == {0}
    for nothing in ([], [(1, same, 1)], odd_rows(2), [(100, same, 1)]):
        assert hard_negatives.mine(spark, frame(spark, nothing)).count() == 0


def test_trees_skip_nodes_and_cover(spark):
    rows = clustered(1000, 4, 3)
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int32)
    ids, labels = np.arange(1000), np.array([r[2] for r in rows])
    square = float((x.astype(float) ** 2).sum(axis=1).max()) * (1 + 1e-12)
    tree = hard_negatives.CoverTree.unpack(hard_negatives.CoverTree.build(x, ids, labels, square).pack())
    unit = hard_negatives.augmented(tree.x, square)

    def points(node):
        if not tree.children[node]:
            return list(range(tree.begin[node], tree.end[node]))
        return [p for child in range(tree.child[node], tree.child[node] + tree.children[node]) for p in points(child)]

    for node in range(len(tree.centre)):
        assert hard_negatives.gaps(unit[points(node)], unit[tree.centre[node]]).max() <= tree.angle[node]
    assert sorted(points(0)) == list(range(1000)) and sorted(tree.ids) == list(range(1000))
    search = hard_negatives.Search(tree, square, 5, True)
    search.run(x[:50], ids[:50], labels[:50], np.full(50, hard_negatives.LOWEST), np.full(50, hard_negatives.HIGHEST))
    assert search.verified < 0.2 * 50 * 1000


def test_repeated_rows_part(spark):
    """A third of all rows being one row does not make a block larger."""
    rows = [(5, [0.5, 0.25], 1)] * 400 + [(i, [random.Random(i).random(), 0.5], 2) for i in range(10, 200)]
    from riskpanel.llm.store import Scratch

    scratch = Scratch(spark, "test")
    index = hard_negatives.Index(scratch, scratch.store(hard_negatives.clean_rows(frame(spark, rows), False), "rows"), block=50)
    assert index.trees.agg(F.max("rows")).first()[0] < 120 and index.trees.agg(F.sum("rows")).first()[0] == len(rows)


def test_questions_and_samples_stay_off_the_driver(spark, monkeypatch):
    """Queries grow with rows times blocks: they are broadcast nowhere, and the sample's limit is taken by tasks."""
    from riskpanel.llm.store import Scratch

    plans, store = {}, Scratch.store

    def noted(self, frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return store(self, frame, name)

    monkeypatch.setattr(Scratch, "store", noted)
    rows = clustered(600, 6, 4)
    found = hard_negatives.mine(spark, frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in found) == brute_negatives(rows, False)
    assert "sample" in plans
    for name in ("positives-far-asked", "negatives-far-asked"):
        assert "Broadcast" not in plans[name]

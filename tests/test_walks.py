"""Distances, path counts and patterns against walks by hand."""

import random
from collections import Counter, deque
from pathlib import Path

import pytest

from riskpanel.functions.frames import GuardError
from riskpanel.operators import walks


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "tail bigint, head bigint")


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id bigint")


def shared(spark):
    return Path(spark.conf.get("spark.checkpoint.dir"))


def bfs(pairs, ids):
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    depth, queue = dict.fromkeys(ids, 0), deque(ids)
    while queue:
        a = queue.popleft()
        for b in after.get(a, ()):
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    return depth


@pytest.mark.parametrize(("seed", "shallow"), [(0, 0), (1, 0), (1, 8)])
def test_distances(spark, monkeypatch, seed, shallow):
    monkeypatch.setattr(walks, "SHALLOW", shallow)
    draw = random.Random(seed)
    n = 60
    pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range(draw.choice([50, 70, 150]))}
    at = n
    for _ in range(6):  # chains that leave and come back, and rings that nothing leads into
        length, end = draw.randrange(2, 12), draw.randrange(n)
        steps = [draw.randrange(n), *range(at, at + length), end]
        pairs |= set(zip(steps, steps[1:]))
        at += length
    pairs |= {(at, at + 1), (at + 1, at + 2), (at + 2, at), (at + 3, at + 3)}
    ids = [0, 7, n + 1]
    found = walks.distances(frame(spark, pairs), starts(spark, *ids), share=0.1)
    assert sorted(tuple(r) for r in found.collect()) == sorted(bfs(pairs, ids).items())


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    rounds = Counter()

    def counted(name, function):
        def run(*args, **kwargs):
            rounds[name] += 1
            return function(*args, **kwargs)

        return run

    monkeypatch.setattr(walks, "cut_lineage", counted("tables", walks.cut_lineage))
    n = 10_000
    pairs = [(i, i + 1) for i in range(n - 1)]
    found = walks.distances(frame(spark, pairs), starts(spark, 0)).collect()
    assert sorted(tuple(r) for r in found) == [(i, i) for i in range(n)]
    assert rounds["tables"] < 40


def test_a_level_moves_only_its_frontier(spark):
    """What was seen is joined where it lies: only the met nodes are shuffled."""
    with walks._visited(4) as visited:
        for k in range(3):
            visited.add(spark.range(1000 * k, 1000 * k + 1000).selectExpr("id AS node_id", f"{k}L AS depth"))
        met = spark.range(2990, 3010).selectExpr("id AS node_id", "5L AS depth")
        ahead = visited.nearer(met)
        assert ahead.count() == 10
        plan = ahead._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        own = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION_BY_NUM" not in line]
        assert sum("Exchange hashpartitioning" in line for line in own) <= 1


def brute_paths(pairs, ids):
    found = Counter()
    level = [(i, (i,)) for i in ids]
    while level:
        found.update((s, p[-1], len(p) - 1) for s, p in level)
        level = [(s, (*p, b)) for s, p in level for a, b in pairs if a == p[-1]]
    return found


def test_path_counts_and_paths_on_demand(spark):
    draw = random.Random(8)
    pairs = [(a, b) for a in range(9) for b in range(a + 1, 9) if draw.random() < 0.4 or b == a + 1]
    pairs += pairs[:3]  # two edges between the same nodes are two paths
    hops = frame(spark, pairs)
    counts = walks.path_counts(hops, starts(spark, 0, 1))
    want = brute_paths(pairs, [0, 1])
    assert {(r.start_node_id, r.node_id, r.depth): int(r.paths) for r in counts.collect()} == want
    by = walks.predecessors(hops, counts).groupBy("start_node_id", "node_id", "depth").sum("paths").collect()
    assert {tuple(r)[:3]: int(r[3]) for r in by} == {k: n for k, n in want.items() if k[2]}
    listed = [tuple(r.node_path) for r in walks.paths_to(frame(spark, set(pairs)), walks.path_counts(frame(spark, set(pairs)), starts(spark, 0)), starts(spark, 8)).collect()]
    assert len(listed) == len(set(listed)) == sum(n for (s, e, _), n in brute_paths(set(pairs), [0]).items() if e == 8)
    assert all(p[0] == 0 and p[-1] == 8 and set(zip(p, p[1:])) <= set(pairs) for p in listed)
    assert walks.path_counts(hops, starts(spark)).count() == 0


def test_diamonds_are_counted_without_listing(spark):
    layers, width = 8, 20
    step = width + 1
    pairs = [e for i in range(layers) for k in range(1, step) for e in ((step * i, step * i + k), (step * i + k, step * (i + 1)))]
    counts = walks.path_counts(frame(spark, pairs), starts(spark, 0))
    last = counts.where(f"node_id = {step * layers}").collect()
    assert [(int(r.paths), r.depth) for r in last] == [(width**layers, 2 * layers)] and width**layers > 10**10
    assert counts.count() == step * layers + 1


def leaves_hubs_and_diamonds():
    draw = random.Random(3)
    pairs = [(100 + i, 20 + draw.randrange(12)) for i in range(60)] + [(20 + i, i % 4) for i in range(12)]
    pairs += [(0, 4), (1, 4), (2, 4), (3, 5), (4, 6), (4, 7), (5, 7), (6, 8), (7, 8), (8, 9), (8, 9)]
    pairs += [(100, 4), (200, 100), (201, 100), (202, 100), (5, 120), (300, None)]  # two ways out, ways back to a start, no node
    return pairs, {*range(100, 170), *range(20, 26), 200, 201, 0, 3, 8, 9, 300, 999}


def test_counts_of_starts_that_share_their_way(spark, monkeypatch):
    monkeypatch.setattr(walks, "FEW", 1)
    pairs, ids = leaves_hubs_and_diamonds()
    assert len(walks.funnel(frame(spark, pairs), starts(spark, *ids, 999)).rounds) == 3
    want = brute_paths(pairs, ids)
    got = walks.path_counts(frame(spark, pairs), starts(spark, *ids)).collect()
    assert {(r.start_node_id, r.node_id, r.depth): int(r.paths) for r in got} == want and len(got) == len(want)


def test_named_counts_of_starts_that_share_their_way(spark):
    pairs, ids = leaves_hubs_and_diamonds()
    assert len(walks.funnel(frame(spark, pairs), starts(spark, *ids)).rounds) == 1
    names = [(i, f"n{i}") for i in {*range(10), *range(20, 32), *range(100, 170), 200, 300}] + [(101, "again"), (4, "again")]
    known = spark.createDataFrame([*names, (None, "none")], "node_id bigint, name string")
    by = {}
    for i, name in names:
        by.setdefault(i, []).append(name)
    want = Counter((s, a, e, b, d, n) for (s, e, d), n in brute_paths(pairs, ids).items() for a in by.get(s, ()) for b in by.get(e, ()))
    got = walks.path_counts(frame(spark, pairs), starts(spark, *ids), names=known).collect()
    assert Counter((r.start_node_id, r.start, r.node_id, r.node, r.depth, int(r.paths)) for r in got) == want
    with pytest.raises(GuardError, match="ring"):
        walks.path_counts(frame(spark, [*pairs, (9, 5)]), starts(spark, *range(110, 160)))


def test_starts_that_share_their_way_are_not_written(spark):
    """Only what is behind them is, so the disk does not grow with the starts' paths."""
    n, before = 20_000, set(shared(spark).rglob("*"))
    hops = spark.range(n).selectExpr("id + 100 AS tail", "id % 10 AS head").unionByName(spark.range(10).selectExpr("id AS tail", "id + 50 AS head"))
    counts = walks.path_counts(hops, hops.selectExpr("tail AS node_id"))
    new = set(shared(spark).rglob("*")) - before
    assert sum(f.stat().st_size for f in new if f.is_file()) < n * 16
    assert counts.count() == 3 * n + 2 * 10


def test_rings_have_no_number_of_paths(spark):
    pairs = [(0, 1), (1, 2), (2, 1), (5, 6), (7, 8), (8, 7)]
    with pytest.raises(GuardError, match="ring"):
        walks.path_counts(frame(spark, pairs), starts(spark, 0))
    with pytest.raises(GuardError, match="ring"):
        walks.path_counts(frame(spark, pairs), starts(spark, 7))
    # a ring that cannot be reached does no harm
    assert walks.path_counts(frame(spark, pairs), starts(spark, 5)).count() == 2


def test_nodes_on_walks(spark):
    draw = random.Random(2)
    names = {i: f"{'abcd'[i % 4]}{i}" for i in range(40)}
    pairs = [(draw.randrange(40), draw.randrange(40), draw.choice("xy")) for _ in range(600)]
    patterns, types = ["^a", "^b", "^c", "^d"], ["x", "y", "x"]
    fits = [
        (p, q, r, s)
        for p, q, t in pairs if names[p][0] == "a" and names[q][0] == "b" and t == "x"
        for q2, r, t2 in pairs if q2 == q and names[r][0] == "c" and t2 == "y"
        for r2, s, t3 in pairs if r2 == r and names[s][0] == "d" and t3 == "x"
    ]
    assert fits
    hops = spark.createDataFrame(pairs, "tail bigint, head bigint, edge_type string")
    known = spark.createDataFrame(list(names.items()), "node_id bigint, name string")
    for place in range(4):
        got = walks.nodes_on_walks(hops, known, patterns, types, place)
        assert {r.node_id for r in got.collect()} == {f[place] for f in fits}
    with pytest.raises(ValueError):
        walks.nodes_on_walks(hops, known, patterns, types[:2], 0)

"""Reachability and path counts on large directed graphs.

``hops`` are rows ``(tail, head)`` with one row per step that can be taken; node
ids are of any type that orders. Nothing here lists paths unless asked to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.functions import key_filter
from riskpanel.functions.frames import GuardError, hot_keys, hot_of_counts, salt_few, salt_many, salted_join, shuffle_parts
from riskpanel.session import cut_lineage, kept, write_clean

c = F.col
#: Levels that are walked before chains are looked for; most graphs end there.
SHALLOW = 8
#: Levels whose tables are merged into one, so that plans stay short.
MERGE_AFTER = 8


# --- chains ---------------------------------------------------------------------
def without_chains(hops: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(tail, head, length)`` between the nodes where ways meet or part, and ``(node_id, anchor, far)`` of all others.

    A node with one way in, one way out, that is no start lies on a chain. Each
    learns the node that its chain leaves from and how far that is, by doubling
    the distance it looks back; n nodes in a row take about log2(n) rounds. Rings
    that nothing leads into stay open and are left out.
    """
    ins = hops.groupBy(c("head").alias("node_id")).agg(F.count(F.lit(1)).alias("ways_in"), F.min("tail").alias("anchor"))
    outs = hops.groupBy(c("tail").alias("node_id")).agg(F.count(F.lit(1)).alias("ways_out"))
    inner = ins.join(outs, "node_id").where("ways_in = 1 AND ways_out = 1").join(starts, "node_id", "left_anti")
    inner = cut_lineage(inner.select("node_id", "anchor", F.lit(1).cast("bigint").alias("far")))
    n = inner.count()
    if not n:
        return hops.select("tail", "head", F.lit(1).cast("bigint").alias("length")), None
    state = _with_open(inner, inner)
    for _ in range(math.ceil(math.log2(n)) + 1):
        if state.where("open").isEmpty():
            break
        back = state.select(c("node_id").alias("anchor"), c("anchor").alias("before"), c("far").alias("further"), c("open").alias("still"))
        doubled = state.where("open").join(back, "anchor").select("node_id", c("before").alias("anchor"), (c("far") + c("further")).alias("far"), c("still").alias("open"))
        state = cut_lineage(state.where("NOT open").unionByName(doubled))
    closed = state.where("NOT open").drop("open")
    ends = hops.join(inner.select(c("node_id").alias("head")), "head", "left_anti")
    short = ends.join(closed.select(c("node_id").alias("tail"), "anchor", "far"), "tail", "left").select(
        F.coalesce("anchor", "tail").alias("tail"), "head", (F.coalesce("far", F.lit(0)) + 1).alias("length")
    )
    return short.groupBy("tail", "head").agg(F.min("length").alias("length")), closed


def _with_open(state: DataFrame, inner: DataFrame) -> DataFrame:
    """Is the anchor still a node of a chain itself?"""
    known = inner.select(c("node_id").alias("anchor"), F.lit(True).alias("open"))
    return cut_lineage(state.join(known, "anchor", "left").select("node_id", "anchor", "far", F.coalesce("open", F.lit(False)).alias("open")))


# --- nearest distances -----------------------------------------------------------
class _Visited:
    """Nodes seen so far with their depths, kept in partitions by node.

    A new level is partitioned once and joined where the older ones lie, so a
    level moves only its frontier. Lost partitions are made anew from the
    checkpointed levels.
    """

    def __init__(self, parts: int):
        self.parts, self.held = parts, []

    def add(self, fresh: DataFrame) -> DataFrame:
        self._hold(fresh.repartition(self.parts, "node_id"))
        if len(self.held) > MERGE_AFTER:
            older = self.held
            self.held = []
            self._hold(reduce(DataFrame.unionByName, older).groupBy("node_id").agg(F.min("depth").alias("depth")))
            for frame in older:
                frame.unpersist()
        return fresh

    def _hold(self, frame: DataFrame) -> None:
        self.held.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        frame.count()

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.held)

    def nearer(self, met: DataFrame) -> DataFrame:
        """The rows of met that no row seen is as near as."""
        seen = self.all().withColumnRenamed("depth", "seen_depth")
        met = met.groupBy("node_id").agg(F.min("depth").alias("depth"))
        return met.join(seen, (met["node_id"] == seen["node_id"]) & (seen["seen_depth"] <= met["depth"]), "left_anti")


@contextmanager
def _visited(parts: int) -> Iterator[_Visited]:
    visited = _Visited(parts)
    try:
        yield visited
    finally:
        for frame in visited.held:
            frame.unpersist()


def nearest(short: DataFrame, starts: DataFrame, share: float | None = None, levels: int | None = None) -> DataFrame | None:
    """``(node_id, depth)`` of all nodes that ways ``(tail, head, length)`` lead to, by the shortest one.

    The ways are partitioned by their tail once, the tails of hubs in several
    parts, and kept. None where something is left to walk after ``levels``.
    """
    hot = cut_lineage(hot_keys(short, ["tail"], share))
    placed = salt_many(short, hot, ["tail"], c("head")).repartition("tail", "_salt")
    with kept(placed) as ways, _visited(shuffle_parts(short)) as visited:
        frontier = visited.add(cut_lineage(starts.select("node_id", F.lit(0).cast("bigint").alias("depth"))))
        turn = 0
        while not frontier.isEmpty():
            if turn == levels:
                return None
            turn += 1
            ahead = salt_few(frontier.select(c("node_id").alias("tail"), "depth"), hot, ["tail"])
            met = ways.join(ahead, ["tail", "_salt"]).select(c("head").alias("node_id"), (c("depth") + c("length")).alias("depth"))
            frontier = visited.add(cut_lineage(visited.nearer(met)))
        return cut_lineage(visited.all().groupBy("node_id").agg(F.min("depth").alias("depth")))


def distances(hops: DataFrame, starts: DataFrame, share: float | None = None) -> DataFrame:
    """``(node_id, depth)``: fewest steps from any start. Deep graphs are walked over chains at once."""
    found = nearest(hops.select("tail", "head", F.lit(1).cast("bigint").alias("length")), starts, share, SHALLOW)
    if found is not None:
        return found
    short, inner = without_chains(hops, starts)
    found = nearest(short, starts, share)
    if inner is None:
        return found
    base = found.select(c("node_id").alias("anchor"), c("depth").alias("base"))
    along = inner.join(base, "anchor").select("node_id", (c("base") + c("far")).alias("depth"))
    return cut_lineage(found.unionByName(along))


# --- starts that share their way -------------------------------------------------------
#: Columns of a node's short key, and of the one that its only way leads to.
KEY, HEAD_KEY = ["_a", "_b"], ["_c", "_d"]
#: So few nodes are walked from at once, without a further round.
FEW = 1000


def with_key(df: DataFrame, node: str, names: Sequence[str] = KEY) -> DataFrame:
    """Add the 128-bit hash of a node id, which joins shuffle in place of the id."""
    return df.withColumns({names[0]: F.xxhash64(node), names[1]: F.xxhash64(F.lit(1), node)})


def near(df: DataFrame, key: Sequence[str], among: DataFrame) -> DataFrame:
    """The rows of ``df`` but those whose key is for certain no KEY of ``among``; nothing is shuffled."""
    bits = key_filter.bits_for(among.count())
    parts = write_clean(key_filter.bit_parts(among, KEY, bits), "near")
    return key_filter.with_may_match(df, parts, key, bits).where("_may_match").drop("_may_match")


@dataclass(frozen=True)
class Round:
    """Starts with one way out each, and the fewer nodes that these ways lead to.

    ``starts`` hold KEY, the first ones also ``node_id``. ``ways`` are hops with
    KEY and HEAD_KEY, and ``heads`` are ``(KEY, _n)`` with the ways to each node.
    """

    starts: DataFrame
    ways: DataFrame
    heads: DataFrame


@dataclass(frozen=True)
class Funnel:
    """Rounds of starts down to few, ``bottom``; ``inside`` and ``hops`` are all nodes and hops that can be reached from there.

    ``back`` are the starts of each round that are inside; they are in ``bottom`` too.
    """

    rounds: list[Round]
    back: list[DataFrame]
    bottom: DataFrame
    inside: DataFrame
    hops: DataFrame

    def results(
        self,
        found: DataFrame,
        named: Callable[[DataFrame, int], DataFrame],
        own: Callable[[DataFrame, int], DataFrame],
        ahead: Callable[[DataFrame], DataFrame],
        again: Callable[[DataFrame, int], DataFrame] = lambda df, i: df,
    ) -> DataFrame:
        """Rows of every start, from those ``found`` for the bottom; all hold the start's KEY. Nothing is written here.

        ``named(starts, round)`` adds what rows need of their start and ``own(named, round)``
        are the rows of the starts themselves. ``ahead`` makes rows of a start from those of
        the node that its way leads to, whose columns begin with ``_``, and ``again(found, round)``
        passes on those of starts that the bottom leads back to.
        """
        below = found
        for i, (step, back) in reversed([*enumerate(zip(self.rounds, self.back))]):
            outside = named(step.starts.join(back.select(*KEY), KEY, "left_anti"), i)
            inside = again(found.join(back.select(*KEY), KEY, "left_semi"), i)
            led = outside.join(step.ways.drop("tail"), KEY)
            behind = below.select(*[c(x).alias(dict(zip(KEY, HEAD_KEY)).get(x, f"_{x}")) for x in below.columns])
            hot = hot_of_counts(step.heads.select(*[c(x).alias(y) for x, y in zip(KEY, HEAD_KEY)], "_n"), HEAD_KEY)
            below = inside.unionByName(own(outside, i)).unionByName(ahead(salted_join(led, behind, HEAD_KEY, F.struct(*KEY), hot)))
        return below

    def each_near(self, df: DataFrame) -> list[DataFrame]:
        """The rows of ``df`` that each round's starts may need: all for the first, which is as large as they are."""
        return [df if i == 0 else near(df, KEY, step.starts) for i, step in enumerate(self.rounds)]


def lone_ways(hops: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The hops whose tail has no other one, and those of other tails, None where there are none.

    Tails are counted by 64-bit hashes, KEY's first. Where two share a hash or a
    bit, both count as tails with several ways, which is right as well.
    """
    several = hops.groupBy(KEY[0]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = write_clean(key_filter.bit_parts(several, KEY[:1], key_filter.MOST_BITS), "several")
    if parts.isEmpty():
        return hops, None
    marked = key_filter.with_may_match(hops, parts, KEY[:1], key_filter.MOST_BITS, "_several")
    return marked.where("NOT _several").drop("_several"), marked.where("_several").drop("_several")


def within_reach(keyed: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node_id, KEY)`` of all nodes that the starts lead to, themselves included, and all hops that leave these.

    Hops come with the KEY of their tail.
    """
    fresh = write_clean(with_key(starts.select("node_id"), "node_id").dropDuplicates(KEY), "reach")
    seen, left = fresh, []
    while not fresh.isEmpty():
        left.append(write_clean(near(keyed, KEY, fresh).join(fresh.select(*KEY), KEY, "left_semi").drop(*KEY), "reach"))
        heads = with_key(left[-1].select(c("head").alias("node_id")), "node_id").dropDuplicates(KEY)
        fresh = write_clean(heads.join(seen.select(*KEY), KEY, "left_anti"), "reach")
        seen = seen.unionByName(fresh)
        if len(left) > MERGE_AFTER:
            seen, left = write_clean(seen, "reach"), [write_clean(reduce(DataFrame.unionByName, left), "reach")]
    return seen, reduce(DataFrame.unionByName, left) if left else keyed.where("false").drop(*KEY)


def funnel(hops: DataFrame, starts: DataFrame) -> Funnel | None:
    """Starts in rounds, where many of them have one way out and these lead to few nodes; None elsewhere.

    A start with one way out has the results of the node behind it, a step
    further. So they are needed once for each such node, and only if these are
    at most half as many as the starts that lead there: then no round makes more
    rows than the result has. A start that the bottom leads back to is left to
    the walk from there. All other ones lie on no ring, as each way leads to a
    node that takes part in a later round than its tail does.
    """
    kind = hops.schema["tail"].dataType
    keyed = with_key(hops.where("tail IS NOT NULL").withColumn("head", c("head").cast(kind)), "tail")
    alone, several = lone_ways(keyed)
    alone = with_key(alone, "head", HEAD_KEY)
    first = with_key(starts.select(c("node_id").cast(kind).alias("node_id")), "node_id")
    left = first.dropDuplicates(KEY)
    rounds: list[Round] = []
    while True:
        # the ways of the first starts are not written, so that a result shuffles only the columns that it needs
        ways = write_clean(near(alone, KEY, left).join(left, KEY).drop("tail"), "ways") if rounds else alone
        counted = (ways if rounds else ways.join(left.select(*KEY), KEY)).groupBy(*[c(x).alias(y) for x, y in zip(HEAD_KEY, KEY)])
        heads = write_clean(counted.agg(F.count(F.lit(1)).alias("_n")), "heads")
        found = heads.agg(F.count(F.lit(1)).alias("heads"), F.coalesce(F.sum("_n"), F.lit(0)).alias("ways")).first()
        if not found.heads or 2 * found.heads > found.ways:
            break
        rounds.append(Round(left, ways, heads))
        left = heads.select(*KEY)
        if found.heads <= FEW:
            break
    if not rounds:
        return None
    last = rounds[-1].ways if len(rounds) > 1 else near(alone, HEAD_KEY, left)
    last = last.join(left.select(*[c(x).alias(y) for x, y in zip(KEY, HEAD_KEY)]), HEAD_KEY).groupBy(*HEAD_KEY)
    last = write_clean(last.agg(F.min("head").alias("node_id")).select("node_id"), "bottom")
    bottom = [last]
    if several is not None:
        many = [several if i == 0 else near(several, KEY, r.starts) for i, r in enumerate(rounds)]
        bottom += [x.join(r.starts.select(*KEY), KEY, "left_semi").select(c("tail").alias("node_id")) for x, r in zip(many, rounds)]
    inside, reached = within_reach(keyed, reduce(DataFrame.unionByName, bottom))
    # what a later walk must start from: also every start that can be reached from there
    back = [near((r.starts if i else first).select(*KEY), KEY, inside) for i, r in enumerate(rounds)]
    back = [write_clean(inside.join(x, KEY, "left_semi"), "back") for x in back]
    whole = write_clean(reduce(DataFrame.unionByName, [last, *[x.select("node_id") for x in back]]).distinct(), "bottom")
    return Funnel(rounds, back, whole, inside, reached)


# --- path counts --------------------------------------------------------------------
def require_acyclic(hops: DataFrame, starts: DataFrame) -> None:
    """Raise :class:`GuardError` where a ring can be reached from a start: it has paths without number.

    Chains are taken out first, again and again while that leaves new ones; then
    nodes without a way in or out go level by level. A ring stays.
    """
    left = cut_lineage(hops.select("tail", "head").distinct())
    reached = cut_lineage(distances(left, starts).select("node_id"))
    left = cut_lineage(left.join(reached.withColumnRenamed("node_id", "tail"), "tail", "left_semi"))
    rows = left.count()
    nobody = starts.where("false")
    while rows:
        short, inner = without_chains(left, nobody)
        if inner is None:
            break
        # a ring of nothing but chain nodes would go with its chain
        if inner.count() < _chain_nodes(left):
            raise GuardError(RING)
        left = cut_lineage(short.select("tail", "head"))
        rows = left.count()
    while rows:
        tails, heads = left.select("tail"), left.select("head")
        inside = left.join(heads.select(c("head").alias("tail")).distinct(), "tail", "left_semi")
        inside = inside.join(tails.select(c("tail").alias("head")).distinct(), "head", "left_semi")
        left = cut_lineage(inside)
        before, rows = rows, left.count()
        if rows == before:
            raise GuardError(RING)


RING = "a ring can be reached, so paths are without number"


def _chain_nodes(hops: DataFrame) -> int:
    """Nodes with one way in and one way out."""
    ends = hops.select(c("head").alias("node_id"), F.lit(1).alias("way_in")).unionByName(hops.select(c("tail").alias("node_id"), F.lit(0).alias("way_in")))
    ways = ends.groupBy("node_id").agg(F.sum("way_in").alias("ways_in"), F.count(F.lit(1)).alias("ways"))
    return ways.where("ways_in = 1 AND ways = 2").count()


def path_counts(hops: DataFrame, starts: DataFrame, share: float | None = None, names: DataFrame | None = None) -> DataFrame:
    """``(start_node_id, node_id, depth, paths)``: how many paths of each length lead from a start to a node.

    Exact to 38 digits; more raise. Parallel rows in ``hops`` are paths of their
    own. A level holds one row per start and node, however many paths there are.
    With ``names``, rows ``(node_id, name)``, a row for each name of the start and
    of the node comes with ``start`` and ``node``; nodes without a name have none.

    Starts with one way out take the counts of the node behind them, where that
    is the same for many (:func:`funnel`), and only when the result is read.
    """
    names = None if names is None else names.where("node_id IS NOT NULL").select("node_id", "name")
    found = funnel(hops, starts)
    if found is None:
        counts = _counted_by_level(hops, starts, share)
        if names is None:
            return counts
        counts = counts.join(names.select(c("node_id").alias("start_node_id"), c("name").alias("start")), "start_node_id")
        return counts.join(names.select("node_id", c("name").alias("node")), "node_id")
    counts = _counted_by_level(found.hops, found.bottom, share)
    if names is not None:
        names = with_key(names, "node_id")
        counts = counts.join(near(names, KEY, found.inside).select("node_id", c("name").alias("node")), "node_id")
        keyed = [x.select(*KEY, "name") for x in found.each_near(names)]

    def named(df: DataFrame, i: int) -> DataFrame:
        return df if names is None or i else df.join(keyed[0].withColumnRenamed("name", "start"), KEY)

    def own(df: DataFrame, i: int) -> DataFrame:
        # ids of nodes in later rounds come from the hop that leads there
        ident = c("node_id") if i == 0 else F.lit(None).cast(hops.schema["tail"].dataType).alias("node_id")
        rows = df.select(*[x for x in df.columns if x != "node_id"], ident)
        rows = rows.withColumns({"start_node_id": c("node_id"), "depth": F.lit(0).cast("bigint"), "paths": F.lit(1).cast("decimal(38,0)")})
        return rows if names is None else rows.join(keyed[i].withColumnRenamed("name", "node"), KEY)

    def ahead(met: DataFrame) -> DataFrame:
        start = c("node_id") if "node_id" in met.columns else F.lit(None).cast(hops.schema["tail"].dataType)
        node = F.when(c("_depth") == 0, c("head")).otherwise(c("_node_id"))
        columns = [start.alias("start_node_id"), node.alias("node_id"), (c("_depth") + 1).alias("depth"), c("_paths").alias("paths")]
        columns += [c(x) for x in ("start",) if x in met.columns] + [c(x).alias("node") for x in ("_node",) if x in met.columns]
        return met.select(*KEY, *columns)

    return found.results(with_key(counts, "start_node_id"), named, own, ahead, named).drop(*KEY)


def _counted_by_level(hops: DataFrame, starts: DataFrame, share: float | None) -> DataFrame:
    require_acyclic(hops, starts)
    ways = hops.groupBy("tail", "head").agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("ways"))
    hot = cut_lineage(hot_keys(hops, ["tail"], share))
    level = cut_lineage(
        starts.select(c("node_id").alias("start_node_id"), "node_id", F.lit(0).cast("bigint").alias("depth"), F.lit(1).cast("decimal(38,0)").alias("paths"))
    )
    levels = []
    with kept(salt_many(ways, hot, ["tail"], c("head")).repartition("tail", "_salt")) as placed:
        while not level.isEmpty():
            levels.append(level)
            met = placed.join(salt_few(level.withColumnRenamed("node_id", "tail"), hot, ["tail"]), ["tail", "_salt"])
            step = met.groupBy("start_node_id", c("head").alias("node_id")).agg(
                (F.min("depth") + 1).alias("depth"), F.sum((c("paths") * c("ways")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("paths")
            )
            level = cut_lineage(step)
    return reduce(DataFrame.unionByName, levels) if levels else level


def predecessors(hops: DataFrame, counts: DataFrame) -> DataFrame:
    """The graph behind :func:`path_counts`: ``(start_node_id, node_id, depth, predecessor_id, paths)``.

    ``paths`` are those that come by this predecessor.
    """
    ways = hops.groupBy(c("tail").alias("predecessor_id"), c("head").alias("node_id")).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("ways"))
    before = counts.select("start_node_id", c("node_id").alias("predecessor_id"), (c("depth") + 1).alias("depth"), "paths")
    joined = salted_join(before, ways, ["predecessor_id"], c("start_node_id"))
    return joined.select("start_node_id", "node_id", "depth", "predecessor_id", (c("paths") * c("ways")).cast("decimal(38,0)").alias("paths"))


def paths_to(hops: DataFrame, counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``(start_node_id, node_id, depth, node_path)``: every path to the ``node_id`` rows of targets.

    Paths grow backwards from the targets over the predecessor graph, so only
    rows of paths that are asked for are ever made.
    """
    graph = cut_lineage(predecessors(hops, counts).drop("paths"))
    open_ends = counts.join(targets.select("node_id").distinct(), "node_id").select(
        "start_node_id", "node_id", "depth", c("node_id").alias("end"), c("depth").alias("left"), F.array("node_id").alias("node_path")
    )
    open_ends, done = cut_lineage(open_ends), []
    while not open_ends.isEmpty():
        done.append(open_ends.where("left = 0"))
        back = graph.select("start_node_id", c("node_id").alias("end"), c("depth").alias("left"), "predecessor_id")
        met = open_ends.where("left > 0").join(back, ["start_node_id", "end", "left"])
        open_ends = cut_lineage(
            met.select("start_node_id", "node_id", "depth", c("predecessor_id").alias("end"), (c("left") - 1).alias("left"), F.array_prepend("node_path", c("predecessor_id")).alias("node_path"))
        )
    columns = ("start_node_id", "node_id", "depth", "node_path")
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done]) if done else open_ends.select(*columns)


# --- patterns -----------------------------------------------------------------------
def nodes_on_walks(hops: DataFrame, names: DataFrame, patterns: Sequence[str], types: Sequence[str], place: int) -> DataFrame:
    """``(node_id)`` that stand at ``place`` (from 0) of some walk whose names and step types match place by place.

    ``hops`` has ``(tail, head, edge_type)``, ``names`` has ``(node_id, name)``. A
    node is at its place if a walk leads to it and another one on to the end, so
    two sets of nodes are carried and no path. A node stands twice on a walk only
    if its name matches both places.
    """
    if len(types) != len(patterns) - 1 or not 0 <= place < len(patterns):
        raise ValueError("a walk has one step less than places")

    def matching(i: int) -> DataFrame:
        return names.where(c("name").rlike(patterns[i])).select("node_id")

    def along(i: int, step: int, near: str, far: str) -> DataFrame:
        """Nodes at the place that lead to one end of the walk."""
        here = matching(i)
        while i != place:
            hop = hops.where(c("edge_type") == types[i if step > 0 else i - 1]).select(c(near).alias("node_id"), c(far).alias("far"))
            i += step
            met = salted_join(hop, here, ["node_id"], c("far")).select(c("far").alias("node_id")).distinct()
            here = cut_lineage(met.join(matching(i), "node_id", "left_semi"))
        return here

    before, after = along(0, 1, "tail", "head"), along(len(patterns) - 1, -1, "head", "tail")
    return before.join(after, "node_id", "left_semi").distinct()

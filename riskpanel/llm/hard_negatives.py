"""Hard negatives by exact search in cover trees.

Candidates get one more coordinate that brings them all to the same norm, so that
they lie on a sphere and a large inner product with an anchor is a small angle.

1.  A bounded sample of rows gives `pivots` by farthest-first choice. Every row
    goes to the cell of its nearest pivot, and a cell is cut into blocks of about
    `block` rows, so no group grows with the data.
2.  A block becomes a cover tree: the centres of a level lie more than its radius
    apart and cover their nodes within it, and the radius halves from level to
    level. Each node keeps its true covering angle and the labels in it. A block
    is one row of a written table.
3.  An anchor asks a tree for the k best rows in a window of scores. Its angle to
    a centre and the covering angle bound all scores below a node. Nodes are opened
    best bound first, some for each anchor of the task at once; a node whose
    bounds lie outside the window, or below the k-th best row so far, is skipped.
    Leaves are verified by exact whole-number products.
4.  First every anchor asks the block it belongs to. The k-th best of that answer
    is a proven floor, with which it then asks the other cells that pivot and
    covering angle do not rule out. Positives are found so, then the negatives
    of each positive's window.

Rules: rows with a null label, a null vector, or a null or non-finite component
take no part, nor do rows whose vector has not the commonest length (of equally
common ones the longest). Quantised components are held within +-2**24. Equal
rows are candidates of their own. Other rows are rows with another vec_id; a null
vec_id is a candidate only, after all ids in ties. Of several anchors with one
vec_id the one with the smallest label, then the smallest vector, asks. An empty
table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm.store import Scratch
from riskpanel.llm.whitening import finite, matrix, of_common_length, quantised

SCALE = 256
MOST = float(1 << 24)
POSITIVES, NEGATIVES = 5, 10
PIVOTS, SAMPLE, BLOCK = 64, 2048, 1024
LEAF = 16
#: Nodes that an anchor opens in one round, and anchors that a task searches for at once.
WIDTH, ANCHORS = 12, 512
NO_ID = 2**63 - 1
LOWEST, HIGHEST = -(2**62), 2**62
#: Slack of the angles for rounding.
SLACK = 1e-7

ROW = "vec_id long, label long, x array<int>"


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    """Unit vectors: x with the coordinate that lifts it to the common norm, over that norm."""
    x = x.astype(np.float64)
    lift = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, lift[:, None]]) / math.sqrt(square)


def score_bounds(cosine: np.ndarray, cover: np.ndarray, scale: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of rows within the angle `cover` of a centre; `cosine` is that of the centre and the anchor.

    `scale` is the anchor's norm times that of all candidates.
    """
    sine = np.sqrt(np.maximum(1 - cosine * cosine, 0))
    cos, sin = np.cos(cover), np.sin(cover)
    slack = 1 + scale * SLACK
    best = np.where(cosine >= cos, 1.0, cosine * cos + sine * sin)
    least = np.where(cosine <= -cos, -1.0, cosine * cos - sine * sin)
    return scale * least - slack, scale * best + slack


def column_matrix(table: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.vstack([matrix(chunk) for chunk in table.column(name).chunks if len(chunk)])


def gaps(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles between unit vectors and one of them, exact for small ones too."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(points - centre, axis=-1) / 2, 1))


def farthest_first(points: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of every point): the next centre is the point farthest from all so far.

    Ends when every point lies within the radius of a centre. So centres are more
    than the radius apart, which is what a level of a cover tree asks for.
    """
    centres, owner = [0], np.zeros(len(points), np.int64)
    distance = gaps(points, points[0])
    while len(centres) < most and distance.max() > radius:
        at = int(distance.argmax())
        away = gaps(points, points[at])
        nearer = away < distance
        owner[nearer], distance[nearer] = len(centres), away[nearer]
        centres.append(at)
    return np.array(centres), owner


def label_bits(labels: np.ndarray) -> np.uint64:
    """The labels of a node as bits; labels that share a bit only make it skip less."""
    bit = (labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    return np.bitwise_or.reduce(np.left_shift(np.uint64(1), bit)) if len(labels) else np.uint64(0)


class CoverTree:
    """The tree of a block: points in the order of its leaves, and arrays with a place per node.

    A node has a centre (one of its points), a covering angle, and either children
    (consecutive nodes) or points (consecutive rows, a leaf).
    """

    FIELDS = ("centre", "angle", "bits", "only", "begin", "end", "child", "children")

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, nodes: dict[str, np.ndarray]):
        self.x, self.ids, self.labels = x, ids, labels
        self.__dict__.update(nodes)

    @classmethod
    def build(cls, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, square: float) -> CoverTree:
        unit = augmented(x, square)
        order = np.lexsort((ids, labels))  # the same tree whatever the order of the rows
        todo: list[tuple[np.ndarray, int, float]] = [(order, -1, math.pi)]
        node: dict[str, list] = {f: [] for f in cls.FIELDS}
        laid: list[np.ndarray] = []
        placed = 0
        at = 0
        while at < len(todo):
            rows, _, radius = todo[at]
            away = gaps(unit[rows], unit[rows[0]])
            reach = float(away.max())
            node["centre"].append(rows[0])
            node["angle"].append(reach + SLACK)
            node["bits"].append(label_bits(labels[rows]))
            node["only"].append(bool((labels[rows] == labels[rows[0]]).all()))
            if len(rows) <= LEAF or reach == 0:
                node["begin"].append(placed)
                node["end"].append(placed + len(rows))
                node["child"].append(0)
                node["children"].append(0)
                laid.append(rows)
                placed += len(rows)
            else:
                radius = min(radius, reach)
                centres = np.zeros(1, np.int64)
                while len(centres) == 1:  # a level with the same single centre is not kept
                    radius /= 2
                    centres, owner = farthest_first(unit[rows], radius, len(rows))
                node["begin"].append(0)
                node["end"].append(0)
                node["child"].append(len(todo))
                node["children"].append(len(centres))
                for i, centre in enumerate(centres):
                    own = np.flatnonzero((owner == i) & (np.arange(len(rows)) != centre))
                    todo.append((rows[np.concatenate(([centre], own))], at, radius))
            at += 1
        rows = np.concatenate(laid)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        nodes = {
            "centre": place[np.array(node["centre"])],
            "angle": np.array(node["angle"], np.float64),
            "bits": np.array(node["bits"], np.uint64),
            "only": np.array(node["only"], np.uint8),
            **{f: np.array(node[f], np.int64) for f in ("begin", "end", "child", "children")},
        }
        return cls(x[rows], ids[rows], labels[rows], nodes)

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(a).tobytes() for a in (self.x, self.ids, self.labels, *(getattr(self, f) for f in self.FIELDS))]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> CoverTree:
        kinds = (np.int32, np.int64, np.int64, np.int64, np.float64, np.uint64, np.uint8, np.int64, np.int64, np.int64, np.int64)
        x, ids, labels, *nodes = (np.frombuffer(p, k) for p, k in zip(parts, kinds))
        return cls(x.reshape(len(ids), -1), ids, labels, dict(zip(cls.FIELDS, nodes)))


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ... counts[1] - 1, ..."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Search:
    """k best rows of a tree for many (anchor, window) queries at once."""

    def __init__(self, tree: CoverTree, square: float, k: int, same: bool):
        self.tree, self.square, self.k, self.same = tree, square, k, same
        self.unit = augmented(tree.x, square)
        # products of float64 are exact below 2**53
        self.kind = np.float64 if square * 4 < 2**53 else np.int64
        self.points = tree.x.astype(self.kind)
        #: Rows whose scores were taken.
        self.verified = 0

    def run(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the tree, score) of the k best rows of each query; scores lie in low..high.

        Of equal scores the smaller vec_id is better.
        """
        tree, k, n = self.tree, self.k, len(x)
        norm = np.linalg.norm(x.astype(np.float64), axis=1)
        unit, scale = x / np.maximum(norm, 1)[:, None], norm * math.sqrt(self.square)
        exact = x.astype(self.kind)
        # cosines of all anchors with the centres below a node, taken when the first of them opens it
        cosines, opened = np.empty((n, len(tree.centre))), np.zeros(len(tree.centre), bool)
        cosines[:, 0] = unit @ self.unit[tree.centre[0], :-1]
        bit = np.array([label_bits(labels[i : i + 1]) for i in range(n)], np.uint64)
        floor = low.astype(np.float64)
        top_q, top_p, top_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, node = np.arange(n), np.zeros(n, np.int64)
        least, best = score_bounds(cosines[query, node], tree.angle[node], scale[query])
        while True:
            fits = (best >= floor[query]) & (least <= high[query])
            if self.same:
                fits &= (tree.bits[node] & bit[query]) != 0
            else:
                fits &= (tree.only[node] == 0) | (tree.labels[tree.centre[node]] != labels[query])
            query, node, best = query[fits], node[fits], best[fits]
            least = least[fits]
            if not len(query):
                return top_q, top_p, top_s
            # best bound first: every query opens its WIDTH best nodes
            order = np.lexsort((-np.minimum(best, high[query]), query))
            query, node, best, least = query[order], node[order], best[order], least[order]
            turn = spread(np.unique(query, return_counts=True)[1])
            now, later = turn < WIDTH, turn >= WIDTH
            q, v = query[now], node[now]
            leaf = tree.children[v] == 0
            # leaves: exact scores of all their rows
            count = tree.end[v[leaf]] - tree.begin[v[leaf]]
            ask, place = np.repeat(q[leaf], count), np.repeat(tree.begin[v[leaf]], count) + spread(count)
            wanted = tree.labels[place] == labels[ask]
            wanted = (wanted if self.same else ~wanted) & (tree.ids[place] != ids[ask])
            ask, place = ask[wanted], place[wanted]
            score = np.einsum("ij,ij->i", exact[ask], self.points[place]).astype(np.int64)
            self.verified += len(score)
            inside = (score >= low[ask]) & (score <= high[ask])
            top_q, top_p, top_s = (np.concatenate(p) for p in ((top_q, ask[inside]), (top_p, place[inside]), (top_s, score[inside])))
            order = np.lexsort((tree.ids[top_p], -top_s, top_q))
            top_q, top_p, top_s = top_q[order], top_p[order], top_s[order]
            turn = spread(np.unique(top_q, return_counts=True)[1])
            last = turn == k - 1
            floor[top_q[last]] = np.maximum(floor[top_q[last]], top_s[last])
            top_q, top_p, top_s = top_q[turn < k], top_p[turn < k], top_s[turn < k]
            # inner nodes: their children join what waits
            count = tree.children[v[~leaf]]
            ask, below = np.repeat(q[~leaf], count), np.repeat(tree.child[v[~leaf]], count) + spread(count)
            for at in np.unique(v[~leaf]):
                if not opened[at]:
                    opened[at] = True
                    stretch = slice(tree.child[at], tree.child[at] + tree.children[at])
                    cosines[:, stretch] = unit @ self.unit[tree.centre[stretch], :-1].T
            lo, hi = score_bounds(cosines[ask, below], tree.angle[below], scale[ask])
            query, node = np.concatenate((query[later], ask)), np.concatenate((node[later], below))
            least, best = np.concatenate((least[later], lo)), np.concatenate((best[later], hi))


def clean_rows(embeddings: DataFrame, relabel: bool) -> DataFrame:
    """(vec_id, label, x) of the rows that take part."""
    label = F.col("label").cast("long")
    if relabel:
        label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return embeddings.where(finite("embedding") & F.col("label").isNotNull()).select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.alias("label"), quantised("embedding", SCALE, 0, MOST).cast("array<int>").alias("x")
    )


def _cells(pivots: np.ndarray, square: float):
    """Rows with the cell of their nearest pivot, the angle to it, and their number in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if len(batch):
                unit = augmented(matrix(batch.column("x")), square)
                cell = (unit @ pivots.T).argmax(axis=1)
                away = 2 * np.arcsin(np.minimum(np.linalg.norm(unit - pivots[cell], axis=1) / 2, 1))
                number = pa.array(np.arange(seen, seen + len(batch)))
                seen += len(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away), number], [*batch.schema.names, "cell", "away", "number"])

    return run


def _trees(square: float):
    """One row per block: its cover tree."""

    def run(table: pa.Table) -> pa.Table:
        tree = CoverTree.build(column_matrix(table, "x"), np.asarray(table.column("vec_id")), np.asarray(table.column("label")), square)
        return pa.table({"cell": table.column("cell")[:1], "part": table.column("part")[:1], "rows": pa.array([table.num_rows], pa.int64()), "tree": pa.array([tree.pack()], pa.list_(pa.binary()))})

    return run


ANSWER = "query long, anchor_id long, vec_id long, label long, score long"


def _answers(square: float, k: int, same: bool):
    """The k best rows of one tree for a bounded group of queries."""

    def run(asked: pa.Table, trees: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], [], []]
        if asked.num_rows and trees.num_rows:
            for packed in trees.column("tree").to_pylist():
                search = Search(CoverTree.unpack(packed), square, k, same)
                ids, number, labels = (np.asarray(asked.column(c)) for c in ("anchor_id", "query", "label"))
                low, high = (np.asarray(asked.column(c)) for c in ("low", "high"))
                q, place, score = search.run(column_matrix(asked, "x"), ids, labels, low, high)
                for out, values in zip(found, (number[q], ids[q], search.tree.ids[place], search.tree.labels[place], score)):
                    out.append(values)
        names = ("query", "anchor_id", "vec_id", "label", "score")
        return pa.table({name: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)) for name, parts in zip(names, found)})

    return run


def _open_cells(pivots: np.ndarray, cover: np.ndarray, square: float):
    """(query, ..., cell): the cells that a query's window and floor do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("x")).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            least, best = score_bounds(x @ pivots[:, :-1].T / np.maximum(norm, 1)[:, None], cover, norm[:, None] * math.sqrt(square))
            fits = (best >= np.asarray(batch.column("low"))[:, None]) & (least <= np.asarray(batch.column("high"))[:, None]) & (cover >= 0)
            row, cell = np.nonzero(fits)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return run


class Index:
    """The cover trees of all rows."""

    def __init__(self, scratch: Scratch, rows: DataFrame, pivots: int = PIVOTS, block: int = BLOCK):
        self.scratch = scratch
        squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        self.square = max(float(rows.agg(F.max(squares).alias("s")).first().s or 0), 1.0) * (1 + 1e-12)
        # written first: a collected limit would send the driver as many rows from every task
        least = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id", "x").select("x").limit(SAMPLE)
        sample = [r.x for r in scratch.store(least, "sample").collect()]
        unit = augmented(np.array(sample, np.int64), self.square)
        self.pivots = unit[farthest_first(unit, 0.0, pivots)[0]]
        placed = rows.mapInArrow(_cells(self.pivots, self.square), f"{ROW}, cell int, away double, number long")
        self.rows = scratch.store(placed, "placed")
        sizes = {r.cell: r for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
        #: Covering angle of every cell; -1 for cells without rows.
        self.cover = np.array([sizes[i].away + SLACK if i in sizes else -1.0 for i in range(len(self.pivots))])
        #: Number of blocks that the rows of a cell are dealt to.
        self.parts = F.get(F.array(*[F.lit(max(1, math.ceil(sizes[i].n / block)) if i in sizes else 1) for i in range(len(self.pivots))]), F.col("cell"))
        # by place as well, so that repeated rows part too
        self.part = F.pmod(F.xxhash64("vec_id", "number"), self.parts).cast("int")
        blocks = self.rows.withColumn("part", self.part).groupBy("cell", "part")
        self.trees = scratch.store(blocks.applyInArrow(_trees(self.square), "cell int, part int, rows long, tree array<binary>"), "trees")

    def ask(self, queries: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """(query, anchor_id, vec_id, label, score) of the k best rows of each query in each block it names.

        `queries` has query, anchor_id, label, x, low, high, cell and part. The
        queries of a block are cut into groups of about ANCHORS, each with the tree.
        """
        queries = self.scratch.store(queries, f"{name}-asked")
        counts = queries.groupBy("cell", "part").agg(F.count("*").alias("asked"))
        groups = self.scratch.store(counts.select("cell", "part", F.ceil(F.col("asked") / ANCHORS).cast("int").alias("groups")), f"{name}-groups")
        own = F.pmod(F.xxhash64("query", "anchor_id"), F.col("groups")).cast("int")
        asked = queries.join(groups, ["cell", "part"]).withColumn("turn", own).drop("groups")
        trees = self.trees.join(groups, ["cell", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        keys = ("cell", "part", "turn")
        found = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(_answers(self.square, k, same), ANSWER)
        return self.scratch.store(found, name)

    def best(self, queries: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """The k best rows of all rows for (query, anchor_id, label, x, low, high, home, home_part): ANSWER with rank."""
        own = queries.withColumnsRenamed({"home": "cell", "home_part": "part"})
        near = self.ask(own, k, same, f"{name}-near")
        floors = near.groupBy("query", "anchor_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        raised = self.scratch.store(
            queries.join(floors, ["query", "anchor_id"], "left").withColumn("low", F.greatest("low", F.coalesce("floor", "low"))).drop("floor"), f"{name}-floors"
        )
        columns = [f.name for f in raised.schema.fields]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in raised.schema.fields)
        far = raised.select(*columns).mapInArrow(_open_cells(self.pivots, self.cover, self.square), f"{kinds}, cell int")
        # the blocks are counted out, not joined: Spark takes the queries, many times what it guesses, for the side to broadcast
        blocks = far.withColumn("part", F.explode(F.sequence(F.lit(0), (self.parts - 1).cast("int"))))
        other = blocks.where((F.col("cell") != F.col("home")) | (F.col("part") != F.col("home_part"))).drop("home", "home_part")
        order = Window.partitionBy("query", "anchor_id").orderBy(F.col("score").desc(), "vec_id", "label")
        found = near.unionByName(self.ask(other, k, same, f"{name}-far"))
        return self.scratch.store(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)


COLUMNS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    spark: SparkSession,
    embeddings: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (30, 90),
    relabel: bool = False,
) -> DataFrame:
    """Per anchor and positive its hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives score between window[0] and window[1] per cent of the positive.
    `anchor` says which rows ask (columns vec_id, label), every hundredth id by
    default; `relabel` gives ids divisible by 7 the next of ten labels.
    """
    scratch = Scratch(spark, "negatives")
    rows, dim = of_common_length(scratch.store(clean_rows(embeddings, relabel), "rows"), "x")
    if not dim:
        return spark.createDataFrame([], COLUMNS)
    index = Index(scratch, rows)
    asks = (F.col("vec_id") % 100 == 0) if anchor is None else anchor
    home = F.min(F.struct("label", "x", "cell", index.part.alias("part"))).alias("home")
    anchors = index.rows.where(asks & (F.col("vec_id") != NO_ID)).groupBy(F.col("vec_id").alias("anchor_id")).agg(home)
    # an anchor's number in a query is the id of its positive; 0 while it looks for them
    base = anchors.select("anchor_id", F.col("home.label").alias("label"), F.col("home.x").alias("x"), F.col("home.cell").alias("home"), F.col("home.part").alias("home_part"))
    base = scratch.store(base, "anchors")
    limit = lambda v: F.lit(v).cast("long")
    first = base.select(limit(0).alias("query"), "anchor_id", "label", "x", limit(LOWEST).alias("low"), limit(HIGHEST).alias("high"), "home", "home_part")
    pairs = index.best(first, positives, True, "positives").select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    floor = lambda v: f"({v} - pmod({v}, 100L)) div 100L"
    low, high = F.expr(f"-({floor(f'(-positive_score * {window[0]}L)')})"), F.expr(floor(f"(positive_score * {window[1]}L)"))
    windows = base.join(pairs, "anchor_id").select(F.col("place").cast("long").alias("query"), "anchor_id", "label", "x", low.alias("low"), high.alias("high"), "home", "home_part")
    found = index.best(windows.where("low <= high"), negatives, False, "negatives")
    named = found.select(F.col("query"), "anchor_id", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = named.join(pairs, (named["anchor_id"] == pairs["anchor_id"]) & (named["query"] == pairs["place"]))
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return joined.select(named["anchor_id"], given("positive_id"), F.col("rank").cast("int").alias("rank"), given("negative_id"), "positive_score", "negative_score")

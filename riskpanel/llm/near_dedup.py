"""Near duplicates by bottom-k sketches of one hash function.

Every text becomes its set of word shingles, and the k smallest hashes of the
set are its sketch. Sketches of up to k shingles are the whole set.

1.  Equal sets are grouped first; one document stands for each.
2.  Values that two documents retain are counted. A sketch is ordered by rarity,
    and since linked sketches share at least `need` values, they share one among
    the first `size - need + 1`. Only those enter the inverted lists.
3.  In a list, `rest` values of a sketch are left from the shared one on, which
    bounds the overlap of any two members. The member with the fewest rarer
    values is the hub; what can link with anyone over this list nearly always
    links with it. So each list is compared with its hub only, in proportion to
    its length.
4.  Documents that a list would still allow to link with another component are
    listed again by their whole sets, where the bounds are exact, and compared with
    the hubs of these lists.
5.  Pairs of different components that the exact bounds of some list still allow
    are compared last. Nothing is capped: the bounds are those of the overlap itself.
6.  Candidates pass the estimate on the union sketch, with five standard
    deviations to spare, and are decided on the full sets.

Rules: null and empty texts have no shingles and link with nothing; a text with
fewer words than a shingle is one shingle; rows with one doc_id are one
document; a null doc_id is an id of its own, below all others. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm import arrays
from riskpanel.llm.components import components, joined
from riskpanel.llm.store import Scratch, bit_table, in_bit_table, without

SKETCH = 256
NO_ID = -(2**63)
_SIGN_2 = np.uint64(0xA24BAED4963EE407)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _sketches(width: int, k: int):
    """(id, n, sign_a, sign_b, sketch) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch):
                sets = list(arrays.shingle_sets(arrays.words(part.column("text"), lower=True), width))
                sizes = np.array([len(s) for s in sets], np.int64)
                ends = np.cumsum(sizes)
                every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
                signs = [arrays.spans_hash(every, ends - sizes, ends, *base).view(np.int64) for base in ((), (_SIGN_2,))]
                signed = [s.view(np.int64) for s in sets]
                least = [np.sort(s if len(s) <= k else np.partition(s, k)[:k]) for s in signed]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes), *map(pa.array, signs), _lists(least)], ["id", "n", "sign_a", "sign_b", "sketch"]
                )

    return run


def _only(table: np.ndarray):
    """Rows whose id the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bit_table(table.value, np.asarray(batch.column("id")).view(np.uint64))))

    return run


def _shared_values(table: np.ndarray):
    """(id, n, value) of the retained values that the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketch")
            value = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(lists)))
            held = in_bit_table(table.value, value.view(np.uint64))
            row = pa.array(row[held])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("n").take(row), pa.array(value[held])], ["id", "n", "value"])

    return run


def _full_sets(width: int, table: np.ndarray):
    """(id, shingles) of the texts whose id the bit table may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _only(table)(batches):
            for part in arrays.slices(batch):
                sets = [s.view(np.int64) for s in arrays.shingle_sets(arrays.words(part.column("text"), lower=True), width)]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(sets)], ["id", "shingles"])

    return run


class NearDuplicates:
    """Near-duplicate groups of `docs` (doc_id, text) at `percent` similarity of `width`-word shingles."""

    def __init__(self, spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH):
        self.spark, self.width, self.percent, self.k = spark, width, percent, k
        self.scratch = Scratch(spark, "near")
        self.docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
        share = percent / 100
        #: Share of a large sketch that linked documents share, five standard deviations to spare.
        self.least_share = share - 5 * math.sqrt(share * (1 - share) / k)

    def _ids(self, pairs: DataFrame, n: int):
        """A broadcast bit table of the ids in n pairs (a, b)."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        return self.scratch.broadcast(bit_table(ids, F.col("id"), 2 * n))

    def _whole(self, n: Column, k: int | None) -> Column:
        """Is every linked union small enough for a sketch to hold it?"""
        return F.lit(True) if k is None else 100 * n <= self.percent * k

    def _reaches(self, x: str, y: str, k: int | None) -> Column:
        """Can the overlap of two members of a list reach what a link needs?"""
        n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
        rest = F.least(f"{x}.rest", f"{y}.rest")
        both = self._whole(n_x, k) & self._whole(n_y, k)
        enough = rest >= F.greatest(f"{x}.need", f"{y}.need")
        return enough & (~both | ((100 + self.percent) * rest >= self.percent * (n_x + n_y)))

    def _allowed(self, x: str, y: str, k: int | None) -> Column:
        """Can two members of a list be linked? Their sizes, and the bound on their overlap."""
        n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
        return (100 * F.least(n_x, n_y) >= self.percent * F.greatest(n_x, n_y)) & self._reaches(x, y, k)

    def links_of(self, pairs: DataFrame, n: int, sketches: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Which of n pairs (a, b) are linked, and how many: estimated on union sketches, decided on full sets."""
        scratch, k = self.scratch, self.k
        # 32 leading bits keep the order of the values, which is all that the estimate needs
        short = F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int"))
        some = scratch.store(sketches.select("id", "n", "sketch").mapInArrow(_only(self._ids(pairs, n)), "id long, n long, sketch array<long>").select("id", "n", short.alias("sketch")), f"{name}-sketches")
        left = some.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = some.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
        overlap = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), F.col("u")))
        both = self._whole(F.col("n_a"), k) & self._whole(F.col("n_b"), k)
        # a few values of a whole set may share their leading bits, so one is spared
        likely = F.when(both, 100 * (overlap + 1) >= self.percent * F.size("u")).otherwise(overlap >= self.least_share * F.size("u"))
        near, n = scratch.counted(pairs.join(left, "a").join(right, "b").withColumn("u", union).where(likely).select("a", "b"), f"{name}-likely")
        return self.confirmed(near, n, name)

    def sets_of(self, held, name: str) -> DataFrame:
        """(id, shingles) of the texts whose id the bit table may hold."""
        return self.scratch.store(self.docs.mapInArrow(_full_sets(self.width, held), "id long, shingles array<long>"), name)

    def confirmed(self, pairs: DataFrame, n: int, name: str) -> tuple[DataFrame, int]:
        """Which of n distinct pairs (a, b) are linked by their full sets, and how many."""
        sets = self.sets_of(self._ids(pairs, n), f"{name}-sets")
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("f_a"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("f_b"))
        common = F.size(F.array_intersect("f_a", "f_b"))
        linked = (100 + self.percent) * common >= self.percent * (F.size("f_a") + F.size("f_b"))
        links = self.scratch.counted(pairs.join(left, "a").join(right, "b").where(linked).select("a", "b"), name)
        self.scratch.drop(f"{name}-sketches", f"{name}-likely", f"{name}-sets")
        return links

    def members(self, sketches: DataFrame, groups: DataFrame, k: int | None, name: str) -> DataFrame:
        """The inverted lists: (value, id, n, need, rest, excess)."""
        scratch = self.scratch
        counts, n = scratch.counted(sketches.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count("*").alias("times")).where("times > 1"), f"{name}-counts")
        held = scratch.broadcast(bit_table(counts, F.col("value"), n))
        entries = sketches.select("id", "n", "sketch").mapInArrow(_shared_values(held), "id long, n long, value long").join(counts, "value")
        size = F.col("n") if k is None else F.least("n", F.lit(k))
        whole_need = F.ceil(self.percent * F.col("n") / 100)
        need = F.when(self._whole(F.col("n"), k), whole_need).otherwise(F.ceil(self.least_share * size)).cast("long")
        ordered = (
            # dealt by id alone, as the join below needs them
            entries.repartition("id")
            .groupBy("id", "n")
            .agg(F.array_sort(F.collect_list(F.struct("times", "value"))).alias("shared"))
            .join(groups.select(F.col("stands").alias("id")).distinct(), "id", "left_semi")
            .withColumn("need", need)
            .withColumn("first", F.size("shared") - F.col("need") + 1)
            .where("first > 0")
        )
        lists = ordered.select("id", "n", "need", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), F.col("first").cast("int"))).alias("at", "entry"))
        rest = (F.col("m") - F.col("at")).cast("long")
        found = scratch.store(lists.select(F.col("entry.value").alias("value"), "id", "n", "need", rest.alias("rest"), (1 - rest / size).alias("excess")), f"{name}-members")
        scratch.drop(f"{name}-counts")
        return found

    def labelled(self, members: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
        """members with the component that each belongs to so far."""
        if labels is None:
            return members.withColumn("label", F.col("id"))
        return self.scratch.store(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), name)

    def hub_pairs(self, members: DataFrame, k: int | None, name: str) -> tuple[DataFrame, int]:
        """(a, b) of each member that may link with the hub of its list and is of another component, and how many."""
        hub = F.min(F.struct("excess", "id", "n", "need", "rest", "label")).alias("hub")
        hubs = members.groupBy("value").agg(hub, F.count("*").alias("length")).where("length > 1").select("value", "hub.*")
        joined = hubs.alias("x").join(members.alias("y"), "value").where((F.col("x.label") != F.col("y.label")) & self._allowed("x", "y", k))
        return self.scratch.counted(self._pairs(joined), f"{name}-pairs")

    def _pairs(self, joined: DataFrame) -> DataFrame:
        return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def open_members(self, members: DataFrame, k: int | None, name: str) -> tuple[DataFrame, int]:
        """Members that may link with someone of another component over their list, and how many."""
        scratch = self.scratch
        best = F.struct(F.max("rest").alias("rest"), F.min("n").alias("n"), F.min("need").alias("need"))
        # no member of a list is a better partner than this bound
        bests = members.groupBy("value").agg(best.alias("best"), F.count("*").alias("length")).where("length > 1").select("value", "best.*")
        able = members.alias("x").join(bests.alias("y"), "value").where(self._reaches("x", "y", k)).select("value", "x.id", "x.n", "x.need", "x.rest", "x.label")
        able = scratch.store(able, f"{name}-able")
        mixed = able.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("value")
        return scratch.counted(able.join(mixed, "value"), f"{name}-open")

    def _settled(self, left: DataFrame, n: int, alike: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """Labels after the n open members are compared by their whole sets."""
        scratch = self.scratch
        held = scratch.broadcast(bit_table(left, F.col("id"), n))
        sets = self.sets_of(held, "open-sets").select("id", F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("sketch"))
        listed = self.members(sets, alike, None, "open")
        links, linked = self.confirmed(*self.hub_pairs(self.labelled(listed, labels, "open-labelled"), None, "open"), "open-links")
        labels = joined(scratch, labels, links, linked, "open-labels")
        left, n = self.open_members(self.labelled(listed, labels, "last-labelled"), None, "last")
        if n:
            last = left.alias("x").join(left.alias("y"), "value").where((F.col("x.label") < F.col("y.label")) & self._allowed("x", "y", None))
            links, linked = self.confirmed(*scratch.counted(self._pairs(last), "last-pairs"), "last-links")
            labels = joined(scratch, labels, links, linked, "last-labels")
        steps = ("members", "labelled", "pairs", "able", "open", "links", "sets")
        scratch.drop(*(f"{name}-{step}" for name in ("open", "last") for step in steps))
        return labels

    def groups(self) -> DataFrame:
        """Per row of docs: id, n_shingles, component."""
        scratch, k = self.scratch, self.k
        sketches = scratch.store(
            self.docs.mapInArrow(_sketches(self.width, k), "id long, n long, sign_a long, sign_b long, sketch array<long>"), "sketches"
        )
        alike = scratch.store(sketches.where("n > 0").groupBy("sign_a", "sign_b").agg(F.min("id").alias("stands")), "alike")
        listed = self.members(sketches, alike, k, "first")
        found = self.hub_pairs(self.labelled(listed, None, ""), k, "first")
        links, linked = self.links_of(*found, sketches, "first-links")
        rows = scratch.store(sketches.select("id", "n", "sign_a", "sign_b"), "rows")
        scratch.drop("sketches")
        labels = components(scratch, links, linked, "first-labels")
        left, still_open = self.open_members(self.labelled(listed, labels, "first-labelled"), k, "first")
        if still_open:
            labels = self._settled(left, still_open, alike, labels)
        steps = ("members", "labelled", "pairs", "able", "open", "links")
        scratch.drop(*(f"first-{step}" for step in steps))
        # a document stands for itself where it has no shingles
        named = alike.withColumn("component", F.col("stands"))
        if labels is not None:
            named = alike.join(labels.withColumnRenamed("id", "stands"), "stands", "left").withColumn("component", F.coalesce("label", "stands"))
        named = scratch.store(named.select("sign_a", "sign_b", "component"), "components")
        none = rows.where("n = 0").select("id", "n", F.col("id").alias("component"))
        found = rows.where("n > 0").join(named, ["sign_a", "sign_b"]).select("id", "n", "component").union(none)
        return found.select("id", F.col("n").alias("n_shingles"), "component")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    found = NearDuplicates(spark, docs, width, percent).groups()
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(given("id").alias("doc_id"), "n_shingles", given("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: one document of each group."""
    found = near_duplicate_groups(spark, docs, width, percent)
    return without(docs, Scratch(spark, "near-kept"), found.where(~F.col("kept")).select("doc_id"), docs["doc_id"].cast("long"))

"""What comes to the driver, and which shuffles the driver starts for it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.llm import near_dedup, samples, store, toxicity


@pytest.fixture
def collected(spark, monkeypatch):
    """(bytes of binary columns, plan) of every collect."""
    seen, kind = [], type(spark.range(0))

    def spy(frame, collect=kind.collect):
        rows = collect(frame)
        seen.append((sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))), frame._jdf.queryExecution().toString()))
        return rows

    monkeypatch.setattr(kind, "collect", spy)
    return seen


def test_a_fit_sends_single_floats_of_the_model_to_the_driver(spark, frame, collected):
    draw = random.Random(5)
    texts = [(i, " ".join(f"w{draw.randrange(20000)}" for _ in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(frame(texts), labels, samples.held_out(3, 1)).value
    assert model.fitted and model.cnn.embedding[:, 1:].any(axis=1).sum() > 1000
    whole = toxicity.DEPTH << toxicity.BUCKET_BITS
    assert 2 * whole < max(n for n, _ in collected) <= 4 * whole + 100_000
    # sums of a few numbers: one task after those that read the blocks
    few = [plan for n, plan in collected if 0 < n < 1000]
    assert len(few) > 3 and all("SinglePartition" in plan and "hashpartitioning" not in plan for plan in few)


def test_changes_of_several_blocks_are_means_over_those_that_changed_a_row():
    draw = np.random.default_rng(1)
    moved, touched = draw.normal(size=(toxicity.SLICE_ROWS, toxicity.DEPTH)), draw.integers(0, 4, toxicity.SLICE_ROWS)
    found = toxicity._mean_changes(0, np.column_stack((moved, touched)).ravel())
    assert found.dtype == np.float32 and np.array_equal(found, (moved / np.maximum(touched, 1)[:, None]).astype(np.float32))
    rest = draw.normal(size=9)
    assert toxicity._mean_changes((toxicity.DEPTH + 1) << toxicity.BUCKET_BITS, rest) is rest


def test_sums_of_one_and_of_several_slices(spark, monkeypatch):
    draw = np.random.default_rng(2)
    parts = [draw.integers(-9, 9, 40).astype(float) for _ in range(11)]
    blocks = spark.createDataFrame([(bytearray(p.tobytes()),) for p in parts], "data binary").repartition(4)
    sums = lambda data: np.frombuffer(data)
    assert np.array_equal(samples.summed(blocks, sums, 40), sum(parts))
    found = dict(samples.slices_summed(blocks, sums, 40, 16, lambda at, total: total + at))
    assert sorted(found) == [0, 16, 32]
    assert all(np.array_equal(np.frombuffer(v), sum(parts)[at : at + 16] + at) for at, v in found.items())
    assert not samples.summed(blocks.limit(0), sums, 40).any()


@pytest.mark.parametrize("n", [0, 1, 700, 9000])
def test_small_bit_tables_need_no_shuffle_by_part(spark, monkeypatch, collected, n):
    values = spark.range(n).select(F.xxhash64("id").alias("value")).repartition(3)
    small = store.bit_table(values, F.col("value"), n)
    assert all("hashpartitioning" not in plan for _, plan in collected)
    monkeypatch.setattr(store, "SMALL_BITS", 0)
    assert np.array_equal(small, store.bit_table(values, F.col("value"), n))
    assert store.in_bit_table(small, np.array([r.value for r in values.collect()], np.int64).view(np.uint64)).all()


def test_list_members_are_shuffled_by_id_once(spark, frame, monkeypatch):
    plans = []
    store_of = store.Scratch.store
    monkeypatch.setattr(store.Scratch, "store", lambda self, frame, name: plans.append((name, frame._jdf.queryExecution().executedPlan().toString())) or store_of(self, frame, name))
    texts = [(i, " ".join(f"w{j}" for j in range(60)) + f" end{i % 3}") for i in range(12)]
    found = near_dedup.near_duplicate_groups(spark, frame(texts)).collect()
    assert len({r.component_id for r in found}) == 1
    plan = dict(plans)["first-members"]
    assert "hashpartitioning(id" in plan and not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("id#") and ", n#" in x.split(")")[0]]

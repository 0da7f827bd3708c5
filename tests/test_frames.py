"""Frame helpers against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskpanel.functions.frames import (
    GuardError, as_rows, exact_medians, fixed_rows, hot_keys, ordered_running_sum, require, salt_few, salt_many,
    salted_join, single_row,
)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_running_sum_equals_sorted_cumsum(spark, buckets):
    rng = random.Random(buckets)
    # Most values crowd a narrow range; the buckets must still come out right.
    values = {rng.uniform(0.1, 0.1001) for _ in range(400)} | {rng.uniform(-5, 900) for _ in range(60)}
    rows = [(g, v, rng.randint(0, 9)) for g in "ab" for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n bigint")
    got = {
        (r.g, r.v): (r.cum_n, r.total_n)
        for r in ordered_running_sum(df, ["v"], ["n"], by=["g"], buckets=buckets).collect()
    }
    for g in "ab":
        part = sorted(r for r in rows if r[0] == g)
        running = np.cumsum([n for _, _, n in part])
        for (_, v, _), total in zip(part, running):
            assert got[(g, v)] == (total, running[-1])
    assert len(got) == len(rows)


def test_running_sum_without_groups(spark):
    df = spark.range(0, 500).select((F.col("id") * 3).alias("v"), F.lit(1).cast("bigint").alias("n"))
    rows = ordered_running_sum(df, ["v"], ["n"], buckets=8).collect()
    assert {r.v: r.cum_n for r in rows} == {i * 3: i + 1 for i in range(500)}


def test_exact_medians_ignore_nulls_and_interpolate(spark):
    rng = random.Random(3)
    a = [rng.choice([1.0, 2.0, 2.0, 7.5, None]) for _ in range(101)]
    b = [rng.gauss(0, 1) for _ in range(101)]
    df = spark.createDataFrame([(x, y, None) for x, y in zip(a, b)], "a double, b double, c double")
    got = {r.feature: (r.median, r.n) for r in exact_medians(df, ["a", "b", "c"], buckets=5).collect()}
    present = [x for x in a if x is not None]
    assert got["a"] == (float(np.median(present)), len(present))
    assert got["b"][0] == pytest.approx(float(np.median(b)), abs=1e-15)
    assert "c" not in got


def test_salted_join_with_a_hot_key_equals_plain_join(spark):
    many = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k bigint, v bigint")
    few = spark.createDataFrame([(i, f"n{i}") for i in range(0, 900, 2)], "k bigint, name string")
    hot = hot_keys(many, ["k"], share=0.1)
    assert [(r.k, r._parts) for r in hot.collect()] == [(0, 7)]  # two thirds of the rows are seven tenths at most
    expected = sorted(map(tuple, many.join(few, "k").collect()))
    assert sorted(map(tuple, salted_join(many, few, ["k"], F.col("v"), hot).collect())) == expected
    assert sorted(map(tuple, salted_join(many, few, ["k"], F.col("v")).collect())) == expected
    spread = salt_many(many, hot, ["k"], F.col("v")).where("k = 0").select("_salt").distinct().count()
    assert spread == 7
    copies = {r.k: r.n for r in salt_few(few, hot, ["k"]).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert copies[0] == 7 and copies[2] == 1


def test_hot_keys_are_bounded_by_the_share(spark):
    many = spark.range(0, 1000).select((F.col("id") % 50).alias("k"))
    assert hot_keys(many, ["k"], share=0.01).count() == 50
    assert hot_keys(many, ["k"], share=0.5).count() == 0
    assert hot_keys(many, ["k"]).count() == 0


def test_single_row_and_rows(spark):
    one = spark.range(10).agg(F.count("*").alias("a"))
    two = spark.range(4).agg(F.sum("id").alias("b"), F.max(F.lit(None).cast("int")).alias("c"))
    row = single_row(one, two).first()
    assert (row.a, row.b, row.c) == (10, 6, None)
    rows = as_rows(single_row(one, two), [F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x"))])
    assert [r.x for r in rows.collect()] == [10, 6]


def test_require_names_what_broke(spark):
    row = fixed_rows(spark, {"n": "int", "m": "int"}, [(3, None)])
    require(row, {"n_positive": "n > 0"})
    with pytest.raises(GuardError, match="m_zero, n_even"):
        require(row, {"m_zero": "m = 0", "n_positive": "n > 0", "n_even": "n % 2 = 0"})

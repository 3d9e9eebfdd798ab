import math
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import learning, sampling


def test_samples_are_repeatable(spark):
    rows = spark.createDataFrame([(f"k{i}", f"g{i % 3}", i) for i in range(90)], "k string, g string, n int")
    a = [r["k"] for r in sampling.hash_sample(rows, "k", 10, "d", 1).collect()]
    assert a == [r["k"] for r in sampling.hash_sample(rows.repartition(5), "k", 10, "d", 1).collect()] and len(set(a)) == 10
    turns = sampling.round_robin(rows, "g", ["k"], 7, 1).collect()
    assert [(r["turn"], r["g"]) for r in turns] == [(1, "g0"), (1, "g1"), (1, "g2"), (2, "g0"), (2, "g1"), (2, "g2"), (3, "g0")]
    codes = sampling.blinded_rows(rows.limit(5), "k", ["x", "y", "z"], 3).groupBy("k").agg(F.array_sort(F.collect_list("code")).alias("c")).collect()
    assert all(r["c"] == ["A", "B", "C"] for r in codes)


def test_history_leaves_out_excluded_and_keeps_unknown(spark):
    bank = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", None), ("d", "q")], "k string, p string")
    asked = spark.createDataFrame([("a", "p"), ("c", None)], "t string, p string")
    got = sampling.hashed_history(asked, bank, "t", "k", "p", 9, 1).collect()
    assert {(r["t"], r["k"]) for r in got} == {("a", "c"), ("a", "d"), ("c", "a"), ("c", "b"), ("c", "d")}
    assert sampling.hashed_history(asked, bank.limit(0), "t", "k", "p", 9, 1).count() == 0


def test_history_past_a_large_group(spark):
    """A target whose group holds most of the bank looks further along the ring, and everybody gets the full number."""
    bank = spark.createDataFrame([(f"k{i:03}", "hot" if i < 180 else f"g{i}") for i in range(200)], "k string, p string")
    got = sampling.hashed_history(bank.select(F.col("k").alias("t"), "p"), bank, "t", "k", "p", 3, 5).collect()
    assert len(got) == 600 and len({(r["t"], r["k"]) for r in got}) == 600 and {r["position"] for r in got} == {1, 2, 3}
    assert all(int(r["k"][1:]) >= 180 for r in got if int(r["t"][1:]) < 180) and all(r["t"] != r["k"] for r in got)


def test_pairs(spark):
    rows = spark.createDataFrame([("q", "a", 0.9, 0.1), ("q", "b", 0.8, 0.8), ("q", "c", 0.7, 0.2), ("z", "a", 0.5, 0.0)], "q string, i string, s double, g double")
    assert [r["i"] for r in sampling.hard_negatives(rows, "q", "i", "s", "g", 2, 0.5).where("q = 'q'").orderBy("rank").collect()] == ["a", "c"]
    assert {(r["best"], r["other"]) for r in sampling.pairwise_examples(rows, "q", "i", "g", 0.5, 0.5).collect()} == {("b", "a"), ("b", "c")}


def test_logistic_and_its_export(spark):
    draw = random.Random(0)
    data = []
    for _ in range(400):
        x = [draw.gauss(0, 1), draw.gauss(0, 1)]
        data.append((x, int(2 * x[0] - x[1] + draw.gauss(0, 0.3) > 0)))
    rows = spark.createDataFrame(data, "x array<double>, y int")
    model = learning.fit_logistic(rows, "x", "y")
    right = rows.select(((learning.predict(F.col("x"), model) > 0.5) == (F.col("y") == 1)).alias("ok")).where("ok").count()
    assert right / 400 > 0.93
    with pytest.raises(ValueError):
        learning.fit_logistic(rows.where("y = 1"), "x", "y")


def test_pairwise_ranker(spark):
    rows = spark.createDataFrame([(f"q{q}", f"i{i}", [float(i), float(q)], i / 4) for q in range(6) for i in range(5)], "q string, i string, x array<double>, g double")
    model = learning.fit_logistic(learning.pair_differences(rows, "q", "i", "x", "g", 0.75, 0.5), "x", "label")
    assert model["coefficients"][0] > 0.5 and abs(model["coefficients"][1]) < 1e-6


def test_platt(spark):
    draw = random.Random(1)
    data = [(p, draw.random() < 1 / (1 + math.exp(-2 * math.log(p / (1 - p)) - 0.5))) for p in (draw.uniform(0.02, 0.98) for _ in range(4000))]
    rows = spark.createDataFrame([*data, (None, True)], "p double, y boolean")
    model = learning.fit_platt(rows, "p", "y", l2=0.0)
    assert abs(model["slope"] - 2) < 0.25 and abs(model["intercept"] - 0.5) < 0.25
    assert 0.5 < rows.limit(1).select(learning.apply_platt(F.lit(0.5), model)).first()[0] < 0.75

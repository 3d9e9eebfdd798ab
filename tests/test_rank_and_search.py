import math

from pyspark.sql import functions as F

from caseloom.operators import order, rank, search


def test_rrf_and_union(spark):
    lists = {"1": "bac", "2": "acd", "3": "dbe"}
    rows = spark.createDataFrame([("q", item, source, i + 1) for source, items in lists.items() for i, item in enumerate(items)], "q string, item string, source string, rank int")
    union = rank.top_k_union(rows, "q", "item", 2).orderBy("position").collect()
    assert [r["item"] for r in union] == ["b", "a", "c", "d"]
    fused = rank.reciprocal_rank_fusion(rows, "q", "item", 3, 3).orderBy("rank").collect()
    assert [r["item"] for r in fused] == ["a", "b", "d"]
    weighted = rank.reciprocal_rank_fusion(rows, "q", "item", 3, 1, {"1": 0.0, "2": 0.0, "3": 1.0}).collect()
    assert [r["item"] for r in weighted] == ["d"]


def test_minmax_variants(spark):
    rows = spark.createDataFrame([("q", 1.0), ("q", 3.0), ("q", float("nan")), ("q", None), ("r", 2.0), ("r", 2.0)], "q string, s double")
    got = sorted(r["s"] for r in rank.minmax_scaled(rows, "q", ["s"]).collect())
    assert got == [0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_shortlist_keeps_the_tail(spark):
    rows = spark.createDataFrame([("q", "a", 0.9, 0.0), ("q", "b", 0.8, 1.0), ("q", "c", 0.1, 0.5)], "q string, i string, t double, v double")
    got = rank.shortlist_fusion(rows, "q", "i", "t", "v", 2, 0.4).orderBy("rank").collect()
    assert [r["i"] for r in got] == ["b", "a", "c"]


def test_margins(spark):
    rows = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.7), ("q", "c", 0.2), ("one", "a", 0.5)], "q string, i string, s double")
    got = {r["q"]: r["margin"] for r in rank.margins_from_ranks(rank.ranked(rows, "q", "i", "s"), "q", "s").collect()}
    assert abs(got["q"] - 0.2) < 1e-12 and got["one"] == math.inf


def test_bm25_counts_repeats_and_fills(spark):
    docs = spark.createDataFrame([(1, "lung nodule lung"), (2, "heart"), (3, ""), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "lung lung"), ("none", "zzz"), ("empty", None)], "qid string, question string")
    scores = search.bm25_scores(asked, docs, "qid", "question", "doc_id", "text")
    n, avg = 4, 1.0
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert abs(scores.first()["score"] - want) < 1e-12
    top = search.top_with_fill(scores, asked, docs, "qid", "doc_id", 2).collect()
    assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in top) == [("empty", 1, 1), ("empty", 2, 2), ("none", 1, 1), ("none", 2, 2), ("q", 1, 1), ("q", 2, 2)]


def test_tfidf_self_is_one(spark):
    docs = spark.createDataFrame([("a", "left lung nodule"), ("b", "heart size"), ("c", "left heart")], "study_id string, t string")
    asked = spark.createDataFrame([("q", "left lung nodule")], "qid string, q string")
    got = {r["study_id"]: r["score"] for r in search.tfidf_scores(asked, docs, "qid", "q", "study_id", "t").collect()}
    assert abs(got["a"] - 1) < 1e-12 and 0 < got["c"] < 1 and "b" not in got


def test_positions_and_running_sums(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"))
    placed, n = order.with_positions(rows, [F.col("v")], {"total": F.col("v")})
    assert n == 5000
    assert placed.where("position <> v + 1 or total <> v * (v + 1) / 2").count() == 0
    empty, none = order.with_positions(rows.limit(0), [F.col("v")], {"total": F.col("v")})
    assert none == 0 and empty.count() == 0


def test_ranks_in_groups_of_any_size(spark):
    """A hot group fills many partitions, others are cut by partition ends; compared with a plain sort."""
    import random

    draw = random.Random(4)
    rows = [("hot" if i % 3 else draw.choice("abc") if i % 2 else None, i % 2, draw.randrange(50) / 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "q string, s int, v double, i int")
    got = {(r["q"], r["s"], r["i"]): r["rank"] for r in order.ranks_in_groups(df, ["q", "s"], [F.desc("v"), F.col("i")]).collect()}
    want = {}
    for row in sorted(rows, key=lambda r: (r[0] or "", r[1], -r[2], r[3])):
        group = (row[0], row[1])
        want[(*group, row[3])] = 1 + sum(k[:2] == group for k in want)
    assert got == want
    assert order.ranks_in_groups(df.limit(0), ["q"], [F.col("i")]).count() == 0
    plan = order.ranks_in_groups(df, ["q"], [F.col("i")])._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_ranks_of_wanted_items(spark):
    rows = [("q", c, s) for c, s in zip("abcdef", (0.5, 0.9, 0.5, 0.1, 0.9, 0.2))] + [("r", "a", 1.0)]
    df = spark.createDataFrame(rows, "q string, i string, s double")
    wanted = spark.createDataFrame([("q", "c"), ("q", "e"), ("q", "c"), ("r", "a"), ("r", "zz"), ("none", "a")], "q string, i string")
    got = {(r["q"], r["i"]): r["rank"] for r in rank.ranks_of(df, wanted, ["q"], "i", {"rank": F.col("s")}).collect()}
    assert got == {("q", "c"): 4, ("q", "e"): 2, ("r", "a"): 1}


def test_quantiles(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    values = {"a": draw.integers(0, 9, 501).tolist(), "b": draw.normal(size=40).tolist(), "c": [2.5]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), (None, 1.0)], "g string, v double")
    got = {r["g"]: (r["lo"], r["hi"]) for r in order.quantiles(df, "g", "v", {"lo": 0.25, "hi": 0.9}).collect()}
    assert set(got) == {"a", "b", "c"}
    assert all(np.allclose(got[g], [np.quantile(values[g], 0.25), np.quantile(values[g], 0.9)]) for g in got)


def test_dense_top_k_in_blocks(spark):
    import numpy as np

    draw = np.random.default_rng(8)
    x = draw.normal(size=(300, 8))
    x[7], x[9], x[11] = 0, x[8], x[8]
    bank = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(999, None), (None, [1.0] * 8)], "id long, v array<double>").repartition(5)
    asked = bank.where("id % 10 = 8 or id = 7").select(F.col("id").alias("q"), "v")
    got = {}
    for r in search.dense_top_k(asked, bank, "q", "id", "v", 4, block=7).collect():
        got.setdefault(r["q"], {})[r["rank"]] = (r["id"], r["score"])
    y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in got:
        scores = np.round(y @ y[q], 9)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:4]
        assert [got[q][k][0] for k in (1, 2, 3, 4)] == want
    assert len(got) == 31
    assert search.dense_top_k(asked.limit(0), bank, "q", "id", "v", 4).count() == 0

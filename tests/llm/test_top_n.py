import random

from caseloom.llm.top_n import top_n_per_group

SCHEMA = "qid string, study_id string, score double, group_key int, part string"


def brute(rows, n):
    best = {}
    for q, s, v in rows:
        if q is None or s is None or v is None or v != v or v in (float("inf"), float("-inf")):
            continue
        best[q, s] = max(best.get((q, s), float("-inf")), v)
    out = set()
    for q in {q for q, _ in best}:
        own = sorted((-v, s) for (k, s), v in best.items() if k == q)[:n]
        out |= {(q, s, i + 1) for i, (_, s) in enumerate(own)}
    return out


def run(spark, rows, n):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {(r["group_key"], r["item_key"], r["position"]) for r in top_n_per_group(df, "qid", "study_id", "score", n).collect()}


def test_matches_brute_force_with_a_hot_group_and_ties(spark):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.4 else f"q{draw.randrange(40)}", f"s{draw.randrange(3000):05}", draw.choice([0.1, 0.2, 0.25, 0.9])) for _ in range(20000)]
    for n in (1, 5, 300):
        assert run(spark, rows, n) == brute(rows, n)


def test_dirty_rows(spark):
    rows = [("a", "x", None), ("a", "y", float("nan")), ("a", "z", float("inf")), (None, "x", 1.0), ("a", None, 1.0), ("a", "b", 0.0), ("a", "c", -0.0), ("a", "b", -1.0), ("a", "b", 0.0)]
    assert run(spark, rows, 5) == {("a", "b", 1), ("a", "c", 2)}


def test_empty(spark):
    assert run(spark, [], 5) == set()

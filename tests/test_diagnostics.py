import math
from collections import Counter

from pyspark.sql import functions as F

from caseloom.operators import metrics, search
from caseloom.plans.diagnostics import flipped


def test_flips(spark):
    rows = [("No effusion is seen.", "Effusion is seen."), ("There is no effusion.", "There is effusion."), ("Lungs without evidence of collapse.", "Lungs with evidence of collapse."), ("No", None), ("A clear lung.", None), (None, None), ("Negative for fracture; negative for nodule.", "Positive for fracture; negative for nodule.")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert [r[0] for r in df.select(flipped(F.col("s"))).collect()] == [w for _, w in rows]


def test_ngram_f1(spark):
    rows = spark.createDataFrame([(1, "a b c", "b c d"), (2, "", None), (3, "a", "a b")], "k int, p string, r string")
    assert {r["k"]: r["f1"] for r in metrics.ngram_f1(rows, "k", "p", "r", 2).collect()} == {1: 0.5, 3: 0.0}
    assert {r["k"]: r["f1"] for r in metrics.ngram_f1(rows, "k", "p", "r", 1).collect()} == {1: 2 / 3, 3: 2 / 3}


def test_leave_one_out_equals_bm25_without_the_text(spark):
    texts = {"a": "lung clear lung", "b": "clear heart", "c": "lung nodule nodule", "d": "", "e": "heart nodule lung clear"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {(r["q"], r["k"]): r["score"] for r in search.leave_one_out_scores(df.select(F.col("k").alias("q"), "t"), df, "q", "t", "k", "t").collect()}
    want = {}
    for q, asked in texts.items():
        bags = {k: Counter(t.split()) for k, t in texts.items() if k != q}
        mean = sum(map(len, (t.split() for k, t in texts.items() if k != q))) / len(bags)
        for k, bag in bags.items():
            score = 0.0
            for term, n in Counter(asked.split()).items():
                df_ = sum(term in b for b in bags.values())
                idf = math.log(1 + (len(bags) - df_ + 0.5) / (df_ + 0.5))
                score += n * idf * bag[term] * 2.5 / (bag[term] + 1.5 * (0.25 + 0.75 * sum(bag.values()) / mean))
            if set(asked.split()) & set(bag):
                want[q, k] = score
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def scored(spark, path, groups):
    """A folder whose scored_cases hold the given (bm25, image, report) values per question."""
    rows = [(q, f"ST{i:03}", 0.5, dict(zip(("bm25", "image", "report"), v))) for q, vs in groups.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "qid string, study_id string, score double, component_scores map<string,double>").write.parquet(f"{path}/scored_cases.parquet")
    return str(path)


def test_correlation_of_a_constant_component_is_zero(spark, tmp_path):
    from caseloom.plans import registry

    d = scored(spark, tmp_path, {"Q1": [(0.3, 0.1, 0.0), (0.3, 0.5, 0.0)], "Q2": [(0.3, 0.1, 0.0)], "Q3": [(0.1, 0.2, 0.0), (0.2, 0.4, 0.0)], "Q4": [(0.2, 0.7, 0.0)] * 3})
    got = {r["qid"]: r["correlation"] for r in registry.QUERIES["component_correlation"](spark, d).collect()}
    assert got == {"Q1": 0.0, "Q2": 0.0, "Q3": 1.0, "Q4": 0.0}


def test_scaled_components_round_as_the_mean_of_scaled_rows(spark, tmp_path):
    """In every order of the rows the mean of the scaled values ends in 8125, the scaled mean just below."""
    from caseloom.plans import registry

    d = scored(spark, tmp_path, {"Q1": [(v, 0.5, 0.0) for v in (0.411, 0.733, 0.435, 0.093)]})
    assert [tuple(r) for r in registry.QUERIES["minmax_components"](spark, d).collect()] == [("Q1", 4, 0.507813, 0.0, 0.0)]

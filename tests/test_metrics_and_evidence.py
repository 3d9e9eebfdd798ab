import math
import random

from pyspark.sql import functions as F

from caseloom.operators import chunks, cohorts, components, evidence, metrics


def test_calibration_and_bins(spark):
    rows = spark.createDataFrame([(0.0, False), (1.0, True), (None, True)], "p double, y boolean")
    got = metrics.calibration(rows, "p", "y", 2).first()
    assert (got["n_rows"], got["brier"], got["ece"]) == (2, 0.0, 0.0)
    assert [r["n"] for r in metrics.reliability_bins(rows, "p", "y", 4).orderBy("bin").collect()] == [1, 0, 0, 1]


def test_auroc_with_ties(spark):
    draw = random.Random(0)
    data = [(draw.choice([0.1, 0.2, 0.3, 0.4]), draw.random() < 0.4) for _ in range(500)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    got = metrics.auroc(spark.createDataFrame(data, "s double, y boolean"), "s", "y").first()
    assert abs(got["auroc"] - want) < 1e-12


def test_risk_coverage_all_correct(spark):
    rows = spark.createDataFrame([(i, 1 - i / 10, True) for i in range(10)], "id int, p double, ok boolean")
    curve, n = metrics.risk_coverage(rows, "p", "ok", ["id"])
    got = curve.orderBy("position").collect()
    assert n == 10 and all(r["risk"] == 0.0 for r in got) and got[-1]["coverage"] == 1.0


def test_thresholds_tie_to_the_higher(spark):
    rows = spark.createDataFrame([("a", 0.9, True), ("a", 0.8, True), ("a", 0.2, False), ("a", 0.1, False), ("b", 0.3, True)], "g string, p double, y boolean")
    got = {r["g"]: r["threshold"] for r in metrics.f1_thresholds(rows, "g", "p", "y", [round(0.05 * i, 2) for i in range(1, 20)]).collect()}
    assert got == {"a": 0.8, "b": 0.5}


def test_holm_and_wilson(spark):
    rows = spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", 0.02)], "k string, p double")
    got = {r["k"]: round(r["holm"], 9) for r in metrics.holm(rows, "p", "k").collect()}
    assert got == {"a": 0.04, "b": 0.003, "c": 0.04}
    low, high = spark.range(1).select(*metrics.wilson(F.lit(5.0), F.lit(10.0))).first()
    assert abs(low - 0.2366) < 1e-3 and abs(high - 0.7634) < 1e-3


def test_ndcg_and_retrieval(spark):
    rows = spark.createDataFrame([("q", 1, 0.0), ("q", 2, 1.0), ("z", 1, 0.0), ("u", None, 1.0)], "q string, rank int, gain double")
    got = {r["q"]: r["ndcg"] for r in metrics.ndcg(rows, "q", "rank", "gain").collect()}
    assert abs(got["q"] - 1 / math.log2(3)) < 1e-12 and got["z"] == 0.0 and got["u"] == 0.0
    ranks = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2)], "system string, q string, item string, rank int")
    qrels = spark.createDataFrame([("q", "b"), ("q", "c"), ("none", "x")], "q string, item string")
    m = metrics.retrieval_metrics(ranks, qrels, "q", "item", ranks.select("system").distinct()).first()
    assert (m["n_queries"], m["hit_at_1"], m["hit_at_5"], m["recall_at_5"], m["mrr"]) == (2, 0.0, 0.5, 0.25, 0.25)


def test_token_f1(spark):
    rows = spark.createDataFrame([(1, "a b b", "b b c"), (2, None, ""), (3, "a", "")], "k int, p string, r string")
    got = {r["k"]: r["token_f1"] for r in metrics.token_f1(rows, "k", "p", "r").collect()}
    assert got == {1: 2 / 3, 2: 1.0, 3: 0.0}


def test_bootstrap_is_repeatable(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i % 2)) for i in range(50)], "k string, x double")
    a = sorted(r["mean"] for r in metrics.bootstrap_means(rows, "k", "x", 40, 1).collect())
    assert a == sorted(r["mean"] for r in metrics.bootstrap_means(rows, "k", "x", 40, 1).collect())
    assert len(a) == 40 and 0.3 < sum(a) / 40 < 0.7
    sums = metrics.bootstrap_sums(rows, "k", "x", 400, 1).collect()  # counts of mean and variance one
    drawn = [r["n"] for r in sums]
    mean = sum(drawn) / len(drawn)
    assert abs(mean - 50) < 1.5 and 30 < sum((n - mean) ** 2 for n in drawn) / len(drawn) < 70


def test_paired_bootstrap_and_plus_one(spark):
    rows = spark.createDataFrame([(f"k{i}", float(i % 3), float(i % 3) + 0.5 + 0.01 * (i % 5)) for i in range(60)] + [("x", None, 1.0)], "k string, a double, b double")
    got = metrics.paired_bootstrap(rows, "k", "a", "b", 200, 3).first()
    assert got["n"] == 60 and abs(got["difference"] - 0.52) < 1e-9 and 0.5 < got["low"] < got["difference"] < got["high"] < 0.54 and abs(got["p_value"] - 2 / 201) < 1e-12
    assert metrics.paired_bootstrap(rows.limit(0), "k", "a", "b", 8, 3).first()["n"] == 0


def test_evidence_support_and_revision(spark):
    rows = spark.createDataFrame([("r", "The heart is enlarged. No effusion. Zebra stripes.", "Heart is enlarged. There is an effusion."), ("e", "", "x"), ("n", None, None)], "k string, a string, e string")
    checks = evidence.evidence_support(rows, "k", "a", "e")
    got = {r["sentence"]: (r["supported"], r["negation_consistent"]) for r in checks.collect()}
    assert got["The heart is enlarged."] == (True, True)
    assert got["No effusion."] == (False, False)
    assert got["Zebra stripes."][0] is False
    out = {r["k"]: r for r in evidence.revised_answers(checks, "k").collect()}
    assert out["r"]["revised_answer"] == "The heart is enlarged." and not out["r"]["abstained"]


def test_intents_and_choices(spark):
    rows = spark.createDataFrame([("How has it changed?",), ("Where is the tube?",), ("",), ("Is it an effusion?",)], "q string")
    got = [r[0] for r in rows.select(evidence.question_intent(F.col("q"), F.lit("new prior"))).collect()]
    assert got == ["comparison", "device", "comparison", "presence"]
    pick = lambda *a: spark.range(1).select(evidence.adaptive_choice(*[F.lit(x) for x in a], 0.02, 0.01, 0.3)).first()[0]
    assert pick("a", 0.5, 0.9, "a", 0.1) == "agreement"
    assert pick("a", 0.005, 0.9, "b", 0.1) == "reranker"
    assert pick("a", 0.5, 0.9, "b", 0.1) == "base"
    assert pick("a", 0.5, 0.1, "b", 0.1) == "abstain"


def test_chunks(spark):
    rows = spark.createDataFrame([("c", "One two. Three four five. Six.", None)], "id string, findings string, impression string")
    got = [(r["chunk_id"], r["text"]) for r in chunks.section_chunks(rows, "id", ["findings", "impression"]).orderBy("chunk_id").collect()]
    assert got == [("c::findings::001", "One two."), ("c::findings::002", "Three four five."), ("c::findings::003", "Six.")]
    packed = rows.select(chunks.packed_chunks(F.col("findings"), 4).alias("p"), chunks.packed_chunks(F.col("impression"), 4).alias("n"), chunks.packed_chunks(F.lit("a b c d e f g h i. J"), 4).alias("l")).first()
    assert packed["p"] == ["One two.", "Three four five. Six."] and packed["n"] == [] and packed["l"] == ["a b c d", "e f g h", "i. J"]


def test_cohorts(spark):
    bank = spark.createDataFrame([("S1", "p"), ("S2", " P"), ("S3", None), ("S4", "")], "s string, p string")
    got = {r["s"]: (r["n_same_patient"], r["n_candidates"]) for r in cohorts.bank_audit(bank, bank, "s", "p").collect()}
    assert got == {"S1": (1, 2), "S2": (1, 2), "S3": (0, 3), "S4": (0, 3)}
    ids = spark.createDataFrame([(f"k{i}",) for i in range(101)], "k string")
    shuffled = cohorts.derangement(ids, "k", "d", 1).collect()
    assert len({r["assigned"] for r in shuffled}) == 101 and all(r["k"] != r["assigned"] for r in shuffled)
    parts = cohorts.hash_partition(ids, "k", {"a": 0.5, "b": 0.5}, "d", 1).groupBy("partition").count().collect()
    assert sorted(r["count"] for r in parts) == [50, 51]


def test_components_of_nothing_and_loops(spark):
    edges = spark.createDataFrame([("a", "a"), (None, "b"), ("c", "d"), ("d", "e")], "u string, v string")
    got = {(r["node"], r["component"]) for r in components.connected_components(edges).collect()}
    assert got == {("c", "c"), ("d", "c"), ("e", "c")}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_exact_text_clusters(spark):
    rows = spark.createDataFrame([("B", "No  EDEMA.", " Normal"), ("A", "no edema. normal", None), ("C", None, None), ("D", "", "")], "s string, f string, i string")
    got = {(r["s"], r["cluster_id"], r["n_members"]) for r in cohorts.exact_text_clusters(rows, "s", ["f", "i"]).collect()}
    assert got == {("A", "A", 2), ("B", "A", 2), ("C", "C", 1), ("D", "D", 1)}

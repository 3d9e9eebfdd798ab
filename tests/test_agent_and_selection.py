from pyspark.sql import functions as F

from caseloom.operators import agent, order, selection


def test_closed_loop(spark):
    chunks = spark.createDataFrame(
        [("c::f::1", "c", "findings", "The lungs show a left nodule."), ("c::i::1", "c", "impression", "Conclusion: left lung nodule."), ("d::f::1", "d", "findings", "Heart is large.")],
        "chunk_id string, case_id string, section string, text string",
    )
    asked = spark.createDataFrame(
        [("route", "What conclusion does the left lung nodule give?", "c"), ("out", "Which medication was prescribed?", "c"), ("retry", "zebra", "c"), ("lost", "zebra", "nowhere"), ("null", None, "c"), ("sum", "Summarise it", "c")],
        "qid string, question string, case_id string",
    )
    got = {r["qid"]: r for r in agent.closed_loop(asked, chunks).collect()}
    assert got["route"]["action"] == "ANSWER" and got["route"]["chunk_ids"] == ["c::i::1"] and got["route"]["retrieval_calls"] == 1
    assert (got["out"]["action"], got["out"]["retrieval_calls"], got["out"]["answer_probability"]) == ("ABSTAIN", 0, 0.02)
    assert got["retry"]["retrieval_calls"] == 2 and got["retry"]["action"] == "ABSTAIN" and got["retry"]["final_intent"] == "findings" and got["retry"]["answer"] == "NOT ANSWERABLE"
    assert got["lost"]["chunk_ids"] == [] and got["lost"]["answer_probability"] == 0.0 and got["null"]["action"] == "ABSTAIN"
    assert got["sum"]["final_intent"] == "impression" and got["sum"]["action"] == "ANSWER"


def test_bounded_units(spark):
    rows = spark.createDataFrame([(["aaaa", " AAAA ", "b" * 600, "cc", "dd"],), ([],), (["x" * 900, "y"],)], "u array<string>")
    assert [r[0] for r in rows.select(agent.bounded_units(F.col("u"))).collect()] == [["aaaa", "cc"], [], ["x" * 900]]


def test_thresholds(spark):
    rows = spark.createDataFrame([(i / 10, i >= 5) for i in range(10)] + [(None, True)], "p double, y boolean")
    assert selection.threshold_for_coverage(rows, "p", 0.25) == 0.7
    assert selection.threshold_for_coverage(rows.limit(0), "p", 0.25) is None
    assert selection.precision_threshold(rows, "p", "y", 0.5) == {"threshold": 0.5, "precision": 1.0, "coverage": 0.5}


def test_policies_sizes_percentiles(spark):
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.895), ("c", 0.5)], "n string, v double")
    assert selection.policy_within_tolerance(rows, "n", "v", 0.01, ["c", "b", "a"]) == "b"
    sizes = spark.createDataFrame([(1, 0.2), (5, 0.8), (10, 0.9)], "k int, v double")
    assert selection.smallest_sufficient(sizes, "k", "v", 0.75).first()["k"] == 5 and selection.smallest_sufficient(sizes, "k", "v", 0.99).first()["k"] == 10
    rows = spark.range(10).selectExpr("'g' as g", "id as v").unionAll(spark.range(3).selectExpr("'h' as g", "7 as v"))
    assert {r["g"]: r["v"] for r in order.nearest_index(rows, "g", "v", 0.5).collect()} == {"g": 4, "h": 7}


def test_views(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0]), ("a", [0.0, 4.0]), ("z", [0.0, 0.0])], "k string, v array<double>")
    got = {r["k"]: [round(x, 4) for x in r["v"]] for r in selection.pooled_views(rows, "k", "v").collect()}
    assert got == {"a": [0.7071, 0.7071], "z": [0.0, 0.0]}
    one = {r["k"]: r["v"] for r in selection.attention_views(rows, "k", "v", [50.0, 0.0]).collect()}
    assert one["a"][0] > 0.999
    best = selection.unit_scores(spark.createDataFrame([("q", 1.0), ("q", 0.0)], "q string, s double"), ["q"], "s").first()
    assert (best["max_score"], best["mean_score"]) == (1.0, 0.5)

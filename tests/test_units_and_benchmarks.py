import random
from math import log, sqrt

from pyspark.sql import functions as F

from caseloom.operators import benchmarks, output, units


def test_units_of_a_case(spark):
    rows = [("c", "One is here. Two.", None, ["entity|heart|anatomy::present", "relation|a|b|modify|c", "other", "other", None, " "]), ("d", "", None, None)]
    cases = spark.createDataFrame(rows, "k string, findings string, impression string, facts array<string>")
    got = {r["provenance_id"]: r["text"] for r in units.case_units(cases, "k", ["findings", "impression"], "facts").collect()}
    assert got == {"c::findings::0000": "One is here.", "c::findings::0001": "Two.", "c::facts::0000": "a [b] modify c", "c::facts::0001": "heart [anatomy::present]", "c::facts::0002": "other"}


def brute_scores(query, texts):
    import re

    def grams(text):
        t = re.findall(r"\w{2,}", (text or "").lower())
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])]

    docs = [grams(x) for x in [query, *texts]]
    vectors = []
    for doc in docs:
        v = {g: (1 + log(doc.count(g))) * (log((1 + len(docs)) / (1 + sum(g in d for d in docs))) + 1) for g in doc}
        size = sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({g: x / size for g, x in v.items()})
    return [sum(x * vectors[0].get(g, 0.0) for g, x in v.items()) for v in vectors[1:]]


def setup(spark, draw, questions=12, cases=6):
    words = "lung heart left right clear nodule effusion small base apex".split()
    said = {f"c{i}": [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(0, 7))] for i in range(cases)}
    rows = [(c, "findings", i, t, f"{c}::findings::{i:04}") for c, ts in said.items() for i, t in enumerate(ts)]
    asked = {f"q{i}": " ".join(draw.choice(words) for _ in range(draw.randrange(0, 6))) for i in range(questions)}
    held = spark.createDataFrame(rows, "case_id string, section string, unit_index int, text string, provenance_id string")
    return said, asked, held


def test_ranked_units_equal_brute_force(spark):
    said, asked, held = setup(spark, random.Random(1))
    pairs = [(q, c, t) for q, t in asked.items() for c in said]
    got = {}
    for r in units.ranked_units(spark.createDataFrame(pairs, "qid string, case_id string, query string"), held).collect():
        got.setdefault((r["qid"], r["case_id"]), {})[r["unit_index"]] = r["score"]
    for q, c, t in pairs:
        if said[c]:
            want = brute_scores(t, said[c])
            assert all(abs(got[q, c][i] - w) < 1e-8 for i, w in enumerate(want))
    assert sum(len(v) for v in got.values()) == len(asked) * sum(map(len, said.values()))


def test_hierarchical_selection(spark):
    """Compared with a plain loop over cases and units."""
    draw = random.Random(2)
    said, asked, held = setup(spark, draw)
    cases = [(q, c, i + 1) for q in asked for i, c in enumerate(draw.sample(sorted(said), 4))]
    top = spark.createDataFrame(cases, "qid string, case_id string, rank int")
    pairs = spark.createDataFrame([(q, c, asked[q]) for q, c, _ in cases], "qid string, case_id string, query string")
    ranks = units.ranked_units(pairs, held).cache()
    order = {}
    for r in ranks.collect():
        order.setdefault((r["qid"], r["case_id"]), []).append((r["rank"], r["provenance_id"], r["text"]))
    got = {r["qid"]: [u["provenance_id"] for u in r["units"]] for r in units.hierarchical_units(ranks, top, 3, 2, 5, 90, 60).collect()}
    for q in asked:
        kept, used = [], 0
        for _, c, place in sorted((x for x in cases if x[0] == q), key=lambda x: x[2]):
            own, size = [], 0
            for _, name, text in sorted(order.get((q, c), [])) if place <= 3 else []:
                extra = len(text) + (1 if own else 0)
                if len(own) < 2 and text not in [t for _, t in own] and (not own or size + extra <= 60):
                    own.append((name, text))
                    size += extra
            for name, text in own:
                extra = len(text) + (1 if kept else 0)
                if len(kept) < 5 and (not kept or used + extra <= 90):
                    kept.append(name)
                    used += extra
        assert got.get(q, []) == kept


def test_questions_of_cases(spark):
    cases = spark.createDataFrame([("c", "x", "The heart is large. A nodule is seen.", "Nodule, probably benign."), ("d", None, None, None)], "k string, indication string, findings string, impression string")
    got = {r["qid"]: r for r in benchmarks.hard_questions(cases, "k").collect()}
    assert got["c_fact_probe"]["question"] == "What does this report state about nodule?" and got["c_fact_probe"]["relevant_chunk_ids"] == ["c::findings::002", "c::impression::001"]
    assert got["d_fact_probe"]["question"].endswith("principal abnormality?") and got["d_fact_probe"]["relevant_chunk_ids"] == []
    assert got["c_near_domain_negative"]["is_answerable"] is False
    plain = {r["qid"]: r["relevant_chunk_ids"] for r in benchmarks.case_questions(cases, "k").collect()}
    assert plain["c_findings"] == ["c::findings::001", "c::findings::002"] and plain["d_summary"] == []


def test_an_absent_condition_is_absent(spark):
    named = " ".join(benchmarks.CONDITIONS[:-1])
    row = spark.range(1).select(benchmarks.absent_condition(F.lit(named), F.lit("k")).alias("a"), benchmarks.absent_condition(F.lit(" ".join(benchmarks.CONDITIONS)), F.lit("k")).alias("b")).first()
    assert row["a"] == benchmarks.CONDITIONS[-1] and row["b"] == benchmarks.NO_CONDITION


def test_roles_and_matches(spark):
    values = spark.createDataFrame([(0.0,), (0.59,), (0.6,), (0.85,), (None,)], "v double")
    assert [r[0] for r in values.select(benchmarks.role_of(F.col("v"), {"a": 3, "b": 1, "c": 1})).collect()] == ["a", "a", "b", "c", None]
    left, right = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {r["k"]: r["state"] for r in benchmarks.matched_keys(left, right, "k").collect()} == {"x": "extra", "y": "repeated", "z": "missing"}


def test_staged_output(spark):
    rows = [
        ("ok", 'x {"a": " Clear  lung.", "u": "LOW",}', '{"s": [{"p": "i", "t": "said"},]}', ["i"], False),
        ("foreign", '{"a": "y", "u": "odd"}', '{"s": [{"p": "j", "t": "said"}, {"p": "i", "t": " "}]}', ["i"], False),
        ("bare", "no json", None, ["i"], False), ("null", None, None, None, True), ("quiet", '{"a": "y", "u": "low"}', '{"s": [{"p": "i", "t": "said"}]}', ["i"], True),
    ]
    got = {r["k"]: r for r in output.staged_output(spark.createDataFrame(rows, "k string, a string, s string, ok array<string>, none boolean"), "k", "a", "s", "ok", F.col("none")).collect()}
    assert (got["ok"]["answer"], got["ok"]["uncertainty"], got["ok"]["answer_stage_valid"], got["ok"]["support_stage_valid"], got["ok"]["supporting_ids"]) == ("Clear lung.", "low", True, True, ["i"])
    assert (got["foreign"]["uncertainty"], got["foreign"]["answer_stage_valid"], got["foreign"]["support_stage_valid"], got["foreign"]["evidence_abstained"]) == ("high", False, False, True)
    assert got["bare"]["answer"] == "no json" and got["null"]["answer"] == output.NO_ANSWER
    assert got["quiet"]["evidence_abstained"] and got["quiet"]["support_stage_valid"] and not got["quiet"]["historical_support"]


def test_terms_of_units_are_no_rows(spark):
    """Units of an asked case are scored in one row: nothing is exploded to terms or joined on them."""
    from caseloom.operators import units

    cases = spark.createDataFrame([("S1", "Clear lung. Small nodule."), ("S2", "Clear heart.")], "s string, findings string")
    asked = spark.createDataFrame([("q", "S1", "nodule of the lung"), ("q", "S2", None), ("r", "S1", "nodule of the lung")], "qid string, case_id string, query string")
    ranks = units.ranked_units(asked, units.case_units(cases, "s", ["findings"]))
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    got = {(r["qid"], r["case_id"], r["unit_index"]): (r["rank"], r["score"] > 0) for r in ranks.collect()}
    assert got == {("q", "S1", 0): (1, True), ("q", "S1", 1): (2, True), ("q", "S2", 0): (1, False), ("r", "S1", 0): (1, True), ("r", "S1", 1): (2, True)}

import random

from caseloom.llm.splits import grouped_splits, tied_studies

CASES = "study_id string, patient_id string, labels map<string,double>, node string, component int"
CLUSTERS = "cluster_id string, case_id string, key string"


def cases(spark, rows):
    return spark.createDataFrame([(s, p, m, "n", 1) for s, p, m in rows], CASES)


def clusters(spark, rows):
    return spark.createDataFrame([(k, c, "k") for k, c in rows], CLUSTERS)


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_ties_through_others_and_dirty_keys(spark):
    rows = [("S1", " p1", {}), ("S2", "P1\t", {}), ("S2", "p2", {}), ("S3", "P2", None), ("S4", None, {}), ("S5", " ", {}), ("S6", "", {}), ("S7", "p9", {}), (None, "p1", {})]
    listed = [("C1", " s4 "), ("C1", "S3"), ("C2", "S5"), ("C3", "S7"), ("C3", "S99"), (None, "S5"), (None, "S6"), ("C1", "S3")]
    got = {(r["study_id"], r["group_id"]) for r in tied_studies(cases(spark, rows), clusters(spark, listed)).collect()}
    assert got == {(s, "S1") for s in ("S1", "S2", "S3", "S4")}


def test_components_match_union_find(spark):
    draw = random.Random(5)
    rows = [(f"S{draw.randrange(900):04}", f"P{draw.randrange(700)}" if draw.random() > 0.2 else "HUB" if draw.random() < 0.2 else None, {}) for _ in range(1200)]
    by = {}
    for s, p, _ in rows:
        if p:
            by.setdefault(p, []).append(s)
    want = {k: v for k, v in components([(v[0], x) for v in by.values() for x in v if x != v[0]]).items()}
    got = {r["study_id"]: r["group_id"] for r in tied_studies(cases(spark, rows), clusters(spark, [])).collect()}
    assert got == want


def test_long_chain(spark):
    rows = [(f"S{i:04}", f"P{i}", {}) for i in range(300)] + [(f"S{i:04}", f"P{i + 1}", {}) for i in range(299)]
    got = {r["group_id"] for r in tied_studies(cases(spark, rows), clusters(spark, [])).collect()}
    assert got == {"S0000"}


def test_splits_keep_groups_and_shares(spark):
    draw = random.Random(1)
    names = ["a", "b", "c"]
    rows = [(f"S{i:05}", f"P{i // draw.choice([1, 2, 5])}" if i > 700 else "BIG", {k: draw.choice([0.0, 1.0, -1.0, 0.5]) for k in names if draw.random() < 0.6} if draw.random() < 0.9 else None) for i in range(6000)]
    got = grouped_splits(cases(spark, rows + rows[:50]), clusters(spark, [("C", "S05000"), ("C", "S05900")]), {"train": 0.8, "validation": 0.1, "test": 0.1}, names, block=500).collect()
    assert len(got) == 6000
    split_of = {}
    for r in got:
        assert split_of.setdefault(r["group_id"], r["split_name"]) == r["split_name"]
    count = {s: sum(r["split_name"] == s for r in got) / 6000 for s in ("train", "validation", "test")}
    assert abs(count["train"] - 0.8) < 0.02 and abs(count["validation"] - 0.1) < 0.02 and abs(count["test"] - 0.1) < 0.02
    labelled = {s: {k for k, v in (m or {}).items() if v} for s, _, m in rows}
    for k in names:
        own = [r["split_name"] for r in got if k in labelled[r["study_id"]]]
        assert abs(own.count("test") / len(own) - 0.1) < 0.02


def test_empty(spark):
    assert tied_studies(cases(spark, []), clusters(spark, [])).count() == 0
    assert grouped_splits(cases(spark, []), clusters(spark, []), {"train": 1.0}, ["a"]).count() == 0

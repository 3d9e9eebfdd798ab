import numpy as np

from caseloom.llm.vectors import most_similar

SCHEMA = "case_id string, image array<float>, report array<float>, class_id int, cosine string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return most_similar(df, "case_id", {"image": "image", "report": "report"}, 5, **more)


def clustered(n, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 8, 64))
    return (centres[draw.integers(len(centres), size=n)] + 0.1 * draw.normal(size=(n, 64))).astype(np.float32) * draw.uniform(0.3, 6, size=(n, 1)).astype(np.float32)


def test_recall_against_brute_force(spark):
    x = clustered(1500, 4)
    rows = [(f"S{i:05}", [float(v) for v in x[i]], None) for i in range(len(x))]
    got = {}
    for r in run(spark, rows).collect():
        got.setdefault(r["case_id"], set()).add(r["neighbour_id"])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = y @ y.T
    np.fill_diagonal(sims, -9)
    best = np.argsort(-sims, axis=1)[:, :5]
    hits = sum(len(got[f"S{i:05}"] & {f"S{j:05}" for j in best[i]}) for i in range(len(x)))
    assert hits / (5 * len(x)) >= 0.95
    assert all(len(v) == 5 for v in got.values())


def test_hot_cluster_is_cut_into_chunks(spark, monkeypatch):
    from caseloom.llm import vectors

    monkeypatch.setattr(vectors, "CHUNK", 50)
    draw = np.random.default_rng(0)
    x = np.concatenate([np.ones((400, 64)) + 0.01 * draw.normal(size=(400, 64)), draw.normal(size=(300, 64))]).astype(np.float32)
    got = run(spark, [(f"S{i:05}", [float(v) for v in x[i]], None) for i in range(len(x))]).collect()
    assert len({r["case_id"] for r in got}) == 700


def test_copies_ties_and_unusable(spark):
    one = [1.0] + [0.0] * 63
    two = [0.0, 1.0] + [0.0] * 62
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows = [(f"A{i}", one, v) for i, v in enumerate(bad)] + [("A0", one, None), ("B", two, one), ("C", [3.0] + [0.0] * 63, two), (None, one, one)]
    got = {}
    for r in run(spark, rows).collect():
        got.setdefault((r["view_name"], r["case_id"]), []).append(r["neighbour_id"])
    assert set(got[("image", "A0")]) == {"A1", "A2", "A3", "A4", "A5"}
    assert set(got[("image", "C")]) == {"A0", "A1", "A2", "A3", "A4"}
    assert ("report", "A0") not in got and set(got[("report", "B")]) == {"C"}


def test_empty(spark):
    assert run(spark, []).count() == 0


def test_a_case_of_many_vectors_takes_one_place(spark):
    draw = np.random.default_rng(1)
    centre = draw.normal(size=64)
    x = centre + 0.01 * draw.normal(size=(120, 64))
    rows = [("HOT" if i >= 20 else f"S{i:05}", [float(v) for v in (centre + 0.001 * draw.normal(size=64) if i >= 20 else x[i])], None) for i in range(120)]
    got = {}
    for r in run(spark, rows).collect():
        got.setdefault(r["case_id"], []).append(r["neighbour_id"])
    assert len(got) == 21 and all(len(set(v)) == 5 and c not in v for c, v in got.items())
    assert all("HOT" in got[c] for c in got if c != "HOT")


def test_a_hot_file_is_split_by_second_pivots(spark, monkeypatch):
    """All files are hot: they are split by second pivots, and recall holds."""
    from caseloom.llm import vectors

    monkeypatch.setattr(vectors, "CHUNK", 20)
    x = clustered(1200, 9)
    got = {}
    for r in run(spark, [(f"S{i:05}", [float(v) for v in x[i]], None) for i in range(len(x))], most_pivots=40).collect():
        got.setdefault(r["case_id"], set()).add(r["neighbour_id"])
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = y @ y.T
    np.fill_diagonal(sims, -9)
    best = np.argsort(-sims, axis=1)[:, :5]
    assert sum(len(got[f"S{i:05}"] & {f"S{j:05}" for j in best[i]}) for i in range(len(x))) >= 0.9 * 5 * len(x)


def test_footrule():
    from caseloom.llm.vectors import footrule_agreement

    draw = np.random.default_rng(2)
    perms = np.array([draw.permutation(12)[:5] for _ in range(30)], np.int32)

    def footrule(a, b):
        place = lambda p, x: list(p).index(x) if x in p else 5
        return sum(abs(place(a, x) - place(b, x)) for x in set(a) | set(b))

    want = np.array([[footrule(a, b) for b in perms[:20]] for a in perms])
    assert (2 * (15 - footrule_agreement(perms, perms[:20]).astype(int)) == want).all()


def test_results_do_not_depend_on_the_size_of_files(spark, monkeypatch):
    """Files as a whole, and cut into chunks: the same neighbours."""
    from caseloom.llm import vectors

    x = clustered(900, 6)
    rows = [(f"S{i:05}", [float(v) for v in x[i]], None) for i in range(len(x))]
    found = []
    for chunk in (20, 100_000):
        monkeypatch.setattr(vectors, "CHUNK", chunk)
        found.append(sorted((r["case_id"], r["neighbour_id"], round(r["cosine"], 5)) for r in run(spark, rows, most_pivots=40).collect()))
    assert found[0] == found[1] and len(found[0]) == 5 * len(x)

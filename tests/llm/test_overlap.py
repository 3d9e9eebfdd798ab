import random

from pyspark.sql import functions as F

from caseloom.llm.overlap import cross_split_pairs, overlap_report

WORDS = [f"w{i}" for i in range(400)]


def setup(spark, reports, splits, listed=()):
    cases = spark.createDataFrame([(s, f, i, "src", 0) for s, f, i in reports], "study_id string, findings string, impression string, source string, class_id int")
    sides = spark.createDataFrame([(s, n, "x") for s, n in splits], "study_id string, split_name string, items string")
    clusters = spark.createDataFrame(list(listed), "cluster_id string, case_id string")
    return cases, sides, clusters


def bag_ratio(a, b):
    from collections import Counter

    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(sum(a.values()), sum(b.values()))


def test_pairs_match_brute_force(spark):
    draw = random.Random(2)
    base = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(40, 140))) for _ in range(150)]
    reports, splits = [], []
    for k, text in enumerate(base * 2):
        words = text.split()
        for i in draw.sample(range(len(words)), int(len(words) * draw.choice([0, 0.02, 0.05, 0.09, 0.35]))):
            words[i] = draw.choice(WORDS)
        if draw.random() < 0.3:
            draw.shuffle(words)
        cut = draw.randrange(len(words))
        reports.append((f"S{k:04}", " ".join(words[:cut]), " ".join(words[cut:])))
        splits.append((f"S{k:04}", draw.choice(["train", "train", "validation", "test", "calibration"])))
    side = dict(splits)
    text = {s: f"{f} {i}" for s, f, i in reports}
    want = {(a, b) for a in text for b in text if side[a] == "train" and side[b] != "train" and bag_ratio(text[a], text[b]) >= 0.9}
    got = {(r[0], r[1]) for r in cross_split_pairs(*setup(spark, reports + reports[:20], splits + splits[:9])).collect()}
    assert len(want - got) <= 0.02 * len(want) and want
    assert all(bag_ratio(text[a], text[b]) > 0.85 for a, b in got)


def test_forms_that_do_not_matter(spark):
    reports = [("S1", "The ﬁlm shows 12 mm. No change", None), ("S2", "no  CHANGE", "the film, shows １２ mm"), ("S3", None, " "), ("S4", "", None), ("S5", "other words here entirely", "x"), ("S6", "a", "a" * 100000)]
    splits = [("S1", "train"), ("S2", " Test"), ("S3", "train"), ("S4", "test"), ("S5", "train"), ("S5", "validation"), ("S9", "test"), (None, "test"), ("S6", "nowhere")]
    cases, sides, clusters = setup(spark, reports, splits, [("C", " s3"), ("C", "S4"), ("C", "S4"), (None, "S1"), ("D", None)])
    pairs = cross_split_pairs(cases, sides, clusters)
    assert {(r[0], r[1]) for r in pairs.collect()} == {("S1", "S2"), ("S3", "S4")}
    assert [tuple(r) for r in overlap_report(cases, sides, clusters).collect()] == [("test", "src", 2, 2, 2)]


def test_group_of_copies(spark):
    reports = [(f"S{i:03}", "same words in every report", "of the group") for i in range(60)]
    splits = [(s, "train" if i % 2 else "test") for i, (s, _, _) in enumerate(reports)]
    assert cross_split_pairs(*setup(spark, reports, splits)).count() == 900


def test_empty(spark):
    assert cross_split_pairs(*setup(spark, [], [], [])).count() == 0


def test_report_counts_the_listed_pairs(spark):
    """Copies, near-copies, studies of several reports, in several splits and clusters, null sources."""
    draw = random.Random(6)
    base = [" ".join(draw.choice(WORDS) for _ in range(50)) for _ in range(12)]
    reports, splits, listed = [], [], []
    for k in range(260):
        study = f"S{k % 200:03}"  # some studies have two reports
        text = draw.choice(base).split()
        if draw.random() < 0.3:
            text[draw.randrange(50)] = "changed"
        reports.append((study, " ".join(text), None, draw.choice(["x", "y", None])))
        splits.append((study, draw.choice(["train", "train", "validation", "test"])))
        if draw.random() < 0.2:
            listed.append((f"C{draw.randrange(9)}", study))
    cases = spark.createDataFrame(reports, "study_id string, findings string, impression string, source string")
    _, sides, clusters = setup(spark, [], splits, listed)
    source = {}
    for study, _, _, own in reports:
        if own is not None:
            source[study] = min(own, source.get(study, own))
    want = {}
    for a, b, split in {tuple(r) for r in cross_split_pairs(cases, sides, clusters).collect()}:
        row = want.setdefault((split, source.get(a)), (set(), set(), set()))
        for part, value in zip(row, ((a, b), a, b)):
            part.add(value)
    got = {(r["split_name"], r["source"]): (r["n_pairs"], r["n_train_studies"], r["n_eval_studies"]) for r in overlap_report(cases, sides, clusters).collect()}
    assert got == {k: tuple(map(len, v)) for k, v in want.items()} and len(got) > 4


def test_short_marks_keep_every_similar_pair(spark):
    """Bags with equal marks of different items, and pairs around the threshold; what marks can't tell is left for the items."""
    import numpy as np
    from caseloom.llm.overlap import marked, picked, possible_pairs, short_marks, _holds

    draw = np.random.default_rng(3)
    bags = {}
    for i in range(0, 120, 2):
        a = np.sort(draw.integers(0, 2**64, 50, dtype=np.uint64) & np.uint64(0x000FFFFFFFFFFFFF if i % 3 == 0 else 0xFFFFFFFFFFFFFFFF))  # every third has 16 different marks at most
        b = a.copy()
        b[: draw.integers(0, 15)] ^= np.uint64(1 << 60) | np.uint64(5)
        bags[i], bags[i + 1] = a, np.sort(b)
    shift = 40_000  # numbers of several bitmaps
    rows = [(int(i * shift), b"c", [int(v) for v in x.view(np.int64)]) for i, x in bags.items()]
    df = spark.createDataFrame(rows, "number long, class_id binary, items array<long>")
    pairs = spark.createDataFrame([(i * shift, j * shift) for i in bags for j in bags if i < j], "x long, y long")
    got = {(r["x"] // shift, r["y"] // shift) for r in possible_pairs(pairs, short_marks(df), 0.8).collect()}
    share = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    want = {(i, j) for i in bags for j in bags if i < j and share(bags[i], bags[j]) >= 0.8}
    assert want <= got and len(got) < 200
    some = df.where(F.col("number") % 80_000 == 0).select("number")
    assert {r["number"] for r in picked(df, some).collect()} == {i * shift for i in bags if i % 2 == 0}
    assert _holds(marked(some), np.array([0, 1, 80_000, 40_000])).tolist() == [True, False, True, False]

from collections import Counter
from math import log, sqrt

import numpy as np

from caseloom.operators import cohorts, near_text

WORDS = "the left right lung apex base nodule opacity of mm is clear stable small pleural effusion no seen since with heart size normal rib".split()


def brute(texts, threshold):
    bags = [Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)) for t in texts]
    df = Counter(g for b in bags for g in b)
    rows = [{g: c * (log((1 + len(texts)) / (1 + df[g])) + 1) for g, c in b.items()} for b in bags]
    norms = [sqrt(sum(w * w for w in r.values())) or 1.0 for r in rows]
    dot = lambda i, j: sum(w * rows[j].get(g, 0.0) for g, w in rows[i].items()) / norms[i] / norms[j]
    return {(i, j) for i in range(len(texts)) for j in range(i) if dot(i, j) + 1e-7 >= threshold}


def sample(n=150):
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(WORDS, 60)) + f" {draw.integers(999)} mm" for _ in range(n)]
    for i in range(n // 2):  # near-copies: one to six words of another text are changed
        words = texts[draw.integers(n)].split()
        for at in draw.integers(len(words), size=1 + i % 6):
            words[at] = str(draw.choice(WORDS))
        texts.append(" ".join(words))
    return sorted({*texts, "x", "ab", "x y"})


def test_links_equal_brute_force(spark, monkeypatch):
    texts = sample()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, n long")
    want = brute(texts, 0.95)
    assert len(want) > 20
    assert {(r["b"], r["a"]) for r in near_text.near_text_links(df, 0.95).collect()} == want
    monkeypatch.setattr(near_text, "MOST_GRAMS", 0)  # frequencies are joined
    assert {(r["b"], r["a"]) for r in near_text.near_text_links(df, 0.95).collect()} == want
    assert near_text.near_text_links(df.limit(0)).count() == 0


def test_near_copies_share_a_cluster(spark):
    long = "There is a calcified granuloma of 28 mm beside the aorta and no pneumothorax; the heart is normal. " * 3
    rows = [("A", long, None), ("B", long.upper() + "Stable", ""), ("C", "A clear chest", None), ("D", None, None), ("E", "a  clear chest", ""), (None, long, None)]
    got = {(r["s"], r["cluster_id"], r["n_members"]) for r in cohorts.near_text_clusters(spark.createDataFrame(rows, "s string, f string, i string"), "s", ["f", "i"]).collect()}
    assert got == {("A", "A", 2), ("B", "A", 2), ("C", "C", 2), ("D", "D", 1), ("E", "C", 2)}

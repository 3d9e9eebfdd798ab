import random

from caseloom.llm.leaks import leaked_items, words_of

VOCABULARY = [f"term{i}" for i in range(300)]


def run(spark, documents, items):
    docs = spark.createDataFrame([(*d, "p") for d in documents], "doc_id long, text string, places string")
    held = spark.createDataFrame([(*i, "t") for i in items], "item_id long, text string, terms string")
    return {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, held).collect()}


def make(draw, n):
    return [draw.choice(VOCABULARY) for _ in range(n)]


def test_planted_passages(spark):
    draw = random.Random(8)
    items = [(i, make(draw, draw.randrange(40, 110))) for i in range(40)]
    documents, want = [], set()
    for k in range(400):
        words = make(draw, draw.randrange(0, 200))
        if draw.random() < 0.5:
            item, text = draw.choice(items)
            n = draw.choice([13, 20, 24, 30, len(text)])
            n = min(n, len(text))
            at = draw.randrange(len(text) - n + 1)
            passage = text[at : at + n]
            edits = draw.randrange(0, n // 10 + 1)
            for _ in range(edits):
                spot = draw.randrange(1, len(passage) - 1)
                kind = draw.randrange(3)
                passage = passage[:spot] + (["changed"] if kind == 0 else []) + passage[spot + (kind != 1) :] if kind else passage[:spot] + ["changed"] + passage[spot + 1 :]
            where = draw.randrange(len(words) + 1)
            words = words[:where] + passage + words[where:]
            if n >= 20:
                want.add((k, item))
        text = " ".join(words)
        documents.append((k, text.upper().replace(" ", draw.choice([" ", ", ", "\n", " <b>", "&nbsp;"]))))
    got = run(spark, documents, [(i, " ".join(w)) for i, w in items])
    assert got == want


def test_dirty(spark):
    text = " ".join(VOCABULARY[:25])
    documents = [(1, text), (1, text), (2, None), (3, ""), (4, " ".join(VOCABULARY[:17])), (None, text), (5, "word " * 40000 + text), (6, "".join(f"{w[:2]}​{w[2:]} " for w in VOCABULARY[:25]))]
    assert run(spark, documents, [(7, text), (7, text), (8, None), (9, "short"), (None, text)]) == {(1, 7), (5, 7), (6, 7)}
    assert run(spark, [], [(7, text)]) == set()
    assert run(spark, documents, []) == set()


def test_words():
    assert words_of("<p>The&nbsp;ﬁlm—１２ mm</p>") == ["the", "film", "12", "mm"]

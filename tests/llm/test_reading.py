import random

from caseloom.llm.reading import document_words, is_english, rated_levels, reading_levels, sentences_of

DOCS = "doc_id long, text string, sentences int, level_no string"
POOLS = {1: "the cat can run and sit on a big red mat with you", 2: "please tell the doctor about your symptoms before the next visit to the clinic", 3: "radiograph demonstrates consolidation with the effusion adjacent to mediastinum in this patient", 4: "epistemological heterogeneity confounded interobserver generalisability of the methodological presupposition notwithstanding"}
LENGTH = {1: 6, 2: 14, 3: 15, 4: 24}


def text_of(draw, level, words):
    out = []
    while sum(map(len, out)) < words:
        out.append([draw.choice(POOLS[level].split()) for _ in range(LENGTH[level])])
    return " ".join(" ".join(s).capitalize() + "." for s in out)


def test_held_out_accuracy_and_inserted_passages(spark):
    draw = random.Random(6)
    rows, level = [], {}
    for i in range(400):
        level[i] = draw.choice([1, 2, 3, 4])
        text = text_of(draw, level[i], draw.randrange(60, 200))
        if draw.random() < 0.4:
            text += " " + text_of(draw, draw.choice([1, 2, 3, 4]), 20)
        rows.append((i, text, 0, "x"))
    rated = [(i, level[i], "a", "n") for i in range(0, 400, 4)] + [(4, 1, "b", "n"), (8, None, "a", "n"), (None, 2, "a", "n")]
    labels = spark.createDataFrame(rated, "doc_id long, level_no long, rater_id string, n string")
    got = {r["doc_id"]: r["level_no"] for r in reading_levels(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == 400
    assert sum(got[i] == level[i] for i in got if i % 4) / sum(1 for i in got if i % 4) > 0.95


def test_which_documents(spark):
    english = "the lungs are clear and this is an easy text for you to read. " * 6
    rows = [(1, english, 0, ""), (2, None, 0, ""), (3, "", 0, ""), (4, "the short one is not rated.", 0, ""), (5, "la radiografía no muestra el derrame y los pulmones están en el lado del corazón. " * 6, 0, ""), (1, english, 0, ""), (None, english, 0, ""), (6, f"<div>{english * 400}</div>", 0, "")]
    got = sorted(r["doc_id"] for r in document_words(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [1, 1, 6]


def test_votes_and_empty(spark):
    labels = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 3, "c"), (2, 4, "a"), (2, 3, "b"), (3, None, "a")], "doc_id long, level_no long, rater_id string")
    assert {(r[0], r[1]) for r in rated_levels(labels).collect()} == {(1, 2), (2, 3)}
    none = spark.createDataFrame([], DOCS)
    assert reading_levels(none, labels).count() == 0
    assert reading_levels(spark.createDataFrame([(1, "the cat is on the mat. " * 20, 0, "")], DOCS), labels.limit(0)).count() == 0


def test_language():
    assert is_english(sentences_of("The heart is of normal size and it is not enlarged."))
    assert not is_english(sentences_of("Le coeur est de taille normale et il n'est pas augmenté."))

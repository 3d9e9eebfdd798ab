import pytest

from caseloom.llm.answers import PushdownParser, broken_answers, defect_of, tiled

Q = "Is there any consolidation near the left apex?"
CASES = [
    (None, "empty"), ("", "empty"), (" ​﻿", "empty"), ("n/a", "empty"), ("Final answer:\n", "empty"), ("<answer></answer>", "empty"), ("...", "empty"), ("[]", "empty"),
    ("I'm sorry, but I can't help with medical advice. Please consult a radiologist.", "refusal"), ("As an AI model, I do not feel comfortable giving a diagnosis.", "refusal"),
    ("This service is not permitted to produce medical advice.", "refusal"), ("Lo siento, pero no puedo dar consejos médicos.", "refusal"),
    (Q, "copies_question"), (f"Q: {Q}\nA:", "copies_question"), (f"**{Q.upper()}**", "copies_question"), (f"{Q} {Q}", "copies_question"), ("Is there any consolidation near this left apex?", "copies_question"),
    ("Il n'y a pas de pneumothorax, mais une opacité persiste près du sommet droit.", "other_language"), ("Yes. Si osserva un infiltrato di 51 mm nel lobo superiore destro.", "other_language"),
    ("The left apex shows ground-glass haze, with the", "truncated"), ("A calcified granuloma (see the", "truncated"), ("There is a nodule in the \"as noted", "truncated"), ("It measures 7 mm. The pulmonary trunk devia", "truncated"), ("```\nThe film shows", "truncated"),
    ("<b>The apex is clear", "truncated"), ("**Clear apex", "truncated"), ("Findings:\n1. The apex is clear.\n2. The base shows", "truncated"), ("Is there any consolidation near the left base?", "copies_question"),
    ("1. Clear apex\n2. Clear base", None), ("<p>The apex is clear.", None), ("<span title='" + "x" * 300 + "'></span>", "empty"),
    ("Yes", None), ("Not described", None), ("Moderate right effusion", None), ("Stable since 9 May", None), ("Consolidation (right apex)", None), ("Feeding tube: 6.5 cm from the carina", None),
    (f"{Q} - Yes", None), ("The passages on file do not settle this question.", None), ("I cannot see an old deformity of the fifth rib on this view.", None), ("A 9 mm lesion can not be excluded without ultrasound.", None),
    ("Sorry for the earlier wording: the haze lies on the left.", None), ("Unable to separate scarring from oedema at the left apex; ultrasound was proposed.", None), ('The earlier note reads "Befund unauffällig", that is, a normal left lung.', None), ("**The change is probably scarring.**", None),
]


@pytest.mark.parametrize("answer,defect", CASES)
def test_defects(answer, defect):
    assert defect_of(Q, answer) == defect


def test_parser_and_tiling():
    assert PushdownParser("a (b [c] d").open == ["("]
    assert PushdownParser("<b>x</b> **y** `z`").open == []
    assert PushdownParser("<ul><li>x").open == ["<ul>", "<li>"]
    assert tiled("a b c d e".split(), "x c d e a b".split()) == 5
    assert tiled("a b".split(), "b a".split()) == 0


def test_join_repeats_and_unknown_questions(spark):
    answers = spark.createDataFrame([("r1", "q1", Q, 1), ("r1", "q1", Q, 1), ("r2", "q9", Q, 1), ("r3", None, None, 1), (None, "q1", "", 1), ("r4", "q1", "The film " + "shows a clear lung and " * 20000 + "the", 1)], "record_id string, qid string, answer string, question int")
    questions = spark.createDataFrame([("q1", "Other?", 1), ("q1", Q, 2), (None, Q, 3)], "qid string, question string, created_at long")
    got = {(r[0], r[1]) for r in broken_answers(answers, questions).collect()}
    assert got == {("r1", "copies_question"), ("r3", "empty"), ("r4", "truncated")}
    assert broken_answers(answers.limit(0), questions).count() == 0
    assert broken_answers(answers, questions.limit(0)).count() == 2


def test_openings_of_repeated_and_of_many_sentences(spark):
    letters = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05}")
    rows = [(f"z{i}", None, "Zebra lines cross here.") for i in range(9)] + [("cut", None, "Zebra lines cross")]  # one text, written often
    rows += [(f"m{j}", None, " ".join(f"Mark {letters(i)} lies {letters(j)}." for i in range(2600) if i or j < 30)) for j in range(31)]
    rows += [("rare", None, f"Mark {letters(0)} lies")]  # the least frequent of 5,200 openings
    answers = spark.createDataFrame(rows, "record_id string, qid string, answer string")
    questions = spark.createDataFrame([], "qid string, question string, created_at long")
    assert {(r[0], r[1]) for r in broken_answers(answers, questions).collect()} == {("rare", "truncated")}


def test_a_hot_question_is_split(spark):
    """One qid holds nine answers in ten: the join with the questions is split, and the texts are parsed where they are read."""
    text = "The film shows a clear apex and a clear base. " * 3
    rows = spark.range(20_000).selectExpr("concat('r', id) as record_id", "if(id % 10 < 9, 'q0', concat('q', id)) as qid", f"if(id % 50 = 0, '{Q}', concat('{text}', id, '.')) as answer")
    questions = spark.range(20_000).selectExpr("concat('q', id) as qid", f"'{Q}' as question", "1 as created_at")
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        found = broken_answers(rows, questions)
        got = {(r[0], r[1]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert got == {(f"r{i}", "copies_question") for i in range(0, 20_000, 50)}
    assert "skew=true" in plan


def test_a_row_is_judged_alike_at_every_size(spark):
    rows = [(f"a{i}", "q", t) for i, (t, _) in enumerate(CASES)]
    questions = spark.createDataFrame([("q", Q, 1)], "qid string, question string, created_at long")
    schema = "record_id string, qid string, answer string"
    few = {tuple(r) for r in broken_answers(spark.createDataFrame(rows, schema), questions).collect()}
    many = rows + [(f"b{j}-{i}", "q", t) for j in range(60) for i, (t, _) in enumerate(CASES)]
    assert few == {tuple(r) for r in broken_answers(spark.createDataFrame(many, schema), questions).collect() if r[0][0] == "a"}

import hashlib

from pyspark.sql import functions as F

from caseloom.functions import hashing, text
from caseloom.functions import vectors as v


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(x, (str, type(None))) else 'array<string>'}" for k, x in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, text.normalized_key(F.col("t")), t="  No  EDEMA. ") == "no edema."
    assert one(spark, text.clean_field(F.col("t")), t=" NaN ") == ""
    assert one(spark, text.clean_text(F.col("t")), t=None) == ""
    assert one(spark, text.report_text_key(F.col("t")), t="a  b , c .") == "a b, c."


def test_tokens_and_answers(spark):
    assert one(spark, text.ascii_tokens(F.col("t")), t="Épanchement à 12mm") == ["panchement", "12mm"]
    assert one(spark, text.final_answer(F.col("t")), t="so. Final Answer: - left Final answer: x") == "left Final answer: x"
    assert one(spark, text.is_not_answerable(F.col("t")), t="Not answerable: none") is True
    assert one(spark, text.placeholder_ratio(F.col("t")), t="") == 1.0


def test_three_splitters(spark):
    t = "One is 1. two. three; four\nfive. Six"
    assert one(spark, text.capital_sentences(F.col("t")), t=t) == ["One is 1. two. three; four five.", "Six"]
    assert one(spark, text.plain_sentences(F.col("t")), t=t) == ["One is 1.", "two.", "three; four five.", "Six"]
    assert one(spark, text.numbered_sentences(F.col("t")), t=t) == ["One is 1. two.", "three", "four", "five.", "Six"]


def test_stems_and_polarity(spark):
    assert sorted(one(spark, text.content_tokens(F.col("t")), t="opacities masses boxes lungs mass the")) == ["box", "lung", "mass", "masse", "opacity"]
    assert one(spark, text.contains_negation(F.col("t")), t="Heart within normal limits") is True
    assert one(spark, text.contains_negation(F.col("t")), t="A nodule") is False


def test_hashes(spark):
    digest = hashlib.sha256(b"7:S1").hexdigest()
    assert one(spark, hashing.fold_of(7, F.col("t"), 5), t="S1") == int(digest, 16) % 5
    assert one(spark, hashing.order_key("d", 3, F.col("t")), t="x") == hashlib.sha256(b"d|3|x").hexdigest()
    assert one(spark, hashing.stable_index("n", F.col("t"), 9), t="x") == int(hashlib.sha256(b"x|n").hexdigest()[:8], 16) % 9


def test_sets_and_labels(spark):
    assert one(spark, v.set_f1(F.col("a"), F.col("b")), a=["x", "y"], b=["y"]) == 2 / 3
    assert one(spark, v.set_f1(F.col("a"), F.col("b")), a=["x"], b=[]) == 0.0
    assert one(spark, v.fact_f1(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    assert one(spark, v.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 1.0
    row = spark.createDataFrame([({"a": 1.0, "b": -1.0, "c": 0.0}, {"a": 0.5, "d": 1.0}, None)], "p map<string,double>, q map<string,double>, r map<string,double>")
    w = v.label_weights
    got = row.select(v.label_similarity(w(F.col("p")), w(F.col("q"))).alias("s"), v.label_similarity(w(F.col("r")), w(F.col("r"))).alias("e")).first()
    assert got["s"] == 0.5 / 2.5 and got["e"] == 1.0

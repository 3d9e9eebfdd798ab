"""Sentence-level evidence checks, verifier actions, question routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import contains_negation, content_tokens, normalized_key, numbered_sentences

INSUFFICIENT = "The retrieved report evidence is insufficient to answer this question."

# Question intents in order; the first pattern that matches decides.
INTENTS = [
    ("comparison", r"\b(change|changed|interval|compare|compared|comparison|improv\w*|worsen\w*|new|prior)\b"),
    ("insufficient_information", r"\b(insufficient|not enough|enough information|enough evidence|cannot be determined|can .* be determined|can .* be identified|unknown|unclear)\b"),
    ("device", r"\b(device|line\w*|tube\w*|catheter|port|hardware|pacemaker)\b"),
    ("location", r"\b(where|location|located|distribution|side|anatomic|region|lobe|lateral|upper|lower|right|left)\b"),
    ("severity", r"\b(size|sized|severity|severe|mild|moderate|large|small|extent|extensive|degree|prominent)\b"),
    ("uncertainty", r"\b(uncertain|possible|probable|likelihood|differential|cannot exclude|could|exclude\w*|suggested)\b"),
    ("summary", r"\b(overall|summarize|summary|in brief|principal .* conclusion|main .* findings)\b"),
    ("presence", r"\b(show|shows|demonstrate|demonstrates|signs of|opacity|effusion|pneumonia|fracture|edema|acute|abnormal|abnormality|present|evidence of|any)\b"),
]


def question_intent(question: Column, indication: Column | None = None) -> Column:
    """First matching intent, else summary; the indication only stands in for an empty question."""
    text = normalized_key(question)
    if indication is not None:
        text = F.when(text == "", normalized_key(indication)).otherwise(text)
    chain = reduce(lambda c, rule: c.when(text.rlike(rule[1]), rule[0]), INTENTS[1:], F.when(text.rlike(INTENTS[0][1]), INTENTS[0][0]))
    return chain.otherwise("summary")


def prepared_evidence(text: Column) -> Column:
    """array<struct<text, plain, words, negated>> of the sentences of a text: what every sentence that is checked against it needs."""
    return F.transform(numbered_sentences(text), lambda e: F.struct(e.alias("text"), normalized_key(e).alias("plain"), content_tokens(e).alias("words"), contains_negation(e).alias("negated")))


def evidence_support(rows: DataFrame, key: str, answer: str, evidence: str, least: float = 0.65) -> DataFrame:
    """(key, position, sentence, matched_evidence, support_score, negation_consistent, supported) per sentence of the answer.

    evidence is a text, or already prepared_evidence where many answers share it.
    Each sentence takes the evidence sentence that holds the largest share of its content words (all of
    them if it contains the sentence), the first one among equals; opposite polarity bars support but keeps the score.
    A sentence without content words scores 0. Everything is an expression over the row: no join, no shuffle.
    """
    plain = rows.schema[evidence].dataType.simpleString() == "string"
    facts = prepared_evidence(F.col(evidence)) if plain else F.col(evidence)
    said = rows.select(key, F.col(answer).alias("_answer"), facts.alias("facts"))
    said = said.select(key, "facts", F.posexplode(numbered_sentences(F.col("_answer"))).alias("position", "sentence"))
    said = said.withColumn("plain", normalized_key(F.col("sentence"))).withColumn("words", content_tokens(F.col("sentence"))).withColumn("negated", contains_negation(F.col("sentence")))

    def score(e: Column) -> Column:
        share = F.size(F.array_intersect(F.col("words"), e["words"])) / F.size("words")
        return F.when((F.col("plain") != "") & F.contains(e["plain"], F.col("plain")), F.lit(1.0)).otherwise(share)

    scored = F.transform("facts", lambda e, i: F.struct(score(e).alias("score"), (-i).alias("order"), e["text"].alias("text"), (e["negated"] == F.col("negated")).alias("same")))
    best = F.when(F.size("words") > 0, F.array_max(scored))
    out = said.withColumn("best", best)
    value = F.coalesce(F.col("best.score"), F.lit(0.0))
    same = F.coalesce(F.col("best.same"), F.lit(True))
    return out.select(key, "position", "sentence", F.coalesce(F.col("best.text"), F.lit("")).alias("matched_evidence"), value.alias("support_score"), same.alias("negation_consistent"), (same & (value >= least)).alias("supported"))


def revised_answers(checks: DataFrame, key: str) -> DataFrame:
    """(key, support_rate, revised_answer, abstained) from evidence_support."""
    kept = F.array_sort(F.collect_list(F.when(F.col("supported"), F.struct("position", "sentence"))))
    rows = checks.groupBy(key).agg(F.avg(F.col("supported").cast("double")).alias("support_rate"), kept.alias("kept"))
    text = F.array_join(F.transform("kept", lambda s: s["sentence"]), " ")
    return rows.select(key, "support_rate", F.when(F.size("kept") > 0, text).otherwise(F.lit(INSUFFICIENT)).alias("revised_answer"), (F.size("kept") == 0).alias("abstained"))


def verifier_action(draft: Column, checks: Column, policy: Column, contradiction: float = 0.5) -> Column:
    """struct<answer, n_accepted, n_rejected, abstained, revised> after a policy over sentence checks.

    sentence_filter keeps supported sentences; contradiction_only keeps those of consistent polarity that are
    contradicted below the threshold; audit_only keeps the draft (and abstains only without checks).
    """
    fair = lambda s: s["negation_consistent"] & (s["contradiction_probability"] < contradiction)
    kept = F.filter(checks, lambda s: F.when(policy == "sentence_filter", s["supported"]).when(policy == "contradiction_only", fair(s)).otherwise(F.lit(True)))
    n, k = F.size(checks), F.size(kept)
    said = F.when(k > 0, F.array_join(F.transform(kept, lambda s: s["sentence"]), " ")).otherwise(F.lit(INSUFFICIENT))
    text = F.when(policy == "audit_only", draft).otherwise(said)
    return F.struct(text.alias("answer"), k.alias("n_accepted"), (n - k).alias("n_rejected"), (k == 0).alias("abstained"), (F.trim(text) != F.trim(draft)).alias("revised"))


def adaptive_choice(base_top: Column, base_margin: Column, base_score: Column, other_top: Column, other_margin: Column, other_threshold: float, base_threshold: float, minimum_base: float = 0.0) -> Column:
    """'agreement', 'reranker', 'base' or 'abstain' from the margins of two rankings."""
    return (
        F.when(base_top.isNull() | other_top.isNull(), "abstain")
        .when(base_top == other_top, "agreement")
        .when((other_margin >= other_threshold) & (base_margin <= base_threshold), "reranker")
        .when(base_score >= minimum_base, "base")
        .otherwise("abstain")
    )


def latest_rows(rows: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """One row per key, the first in the order `by`: dropDuplicates with a defined choice."""
    order = Window.partitionBy(key).orderBy(*by)
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")

"""A closed loop over questions about one case each: plan, retrieve, score, retry once, answer or abstain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import ascii_tokens, clean_text, normalized_key
from caseloom.operators.rank import ranked
from caseloom.operators.search import bm25_scores
from caseloom.session import stored

# Terms that a report can't answer, and cues of the two sections.
OUT_OF_SCOPE = ["attenuation", "discharge", "hounsfield", "medication", "oxygen saturation", "pathology", "prescribed", "serum", "specimen", "treatment", "troponin"]
IMPRESSION_CUES = ["conclusion", "assessment", "bottom line", "radiologist reach", "diagnostic"]
FINDINGS_CUES = ["observation", "abnormalit", "images", "radiographic", "examination show"]
NOT_ANSWERABLE = "NOT ANSWERABLE"
# Fixed values of the evidence score: credit for a routed and an open section, weights of level and overlap, half-level of the top score, ceiling; and the probability of an unavailable question.
ROUTED, OPEN, LEVEL, OVERLAP, HALF, CEILING, UNAVAILABLE = 0.55, 0.15, 0.25, 0.20, 3.0, 0.99, 0.02


def report_intent(question: Column) -> Column:
    """unavailable, impression, findings or unknown, by the first set of cues that the question holds."""
    text = normalized_key(question)
    holds = lambda cues: reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in cues])
    return F.when(holds(OUT_OF_SCOPE), "unavailable").when(holds(IMPRESSION_CUES), "impression").when(holds(FINDINGS_CUES), "findings").otherwise("unknown")


def retrieve_scoped(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, rank, chunk_id, section, text, score): the k best chunks of each question's case; section restricts where it isn't null.

    Corpus statistics are those of all chunks; chunks without a common term score 0 and may fill up; ties by chunk.
    """
    scores = bm25_scores(asked, chunks, "qid", "query", "chunk_id", "text", scope=("case_id", "case_id"))
    rows = asked.select("qid", "case_id", F.col("section").alias("_s")).join(chunks.select("case_id", "chunk_id", "section", "text"), "case_id")
    rows = rows.where(F.col("_s").isNull() | (F.col("_s") == F.col("section"))).join(scores, ["qid", "chunk_id"], "left")
    rows = rows.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    return ranked(rows, "qid", "chunk_id", "score", k).select("qid", "rank", "chunk_id", "section", "text", "score")


def _scored(asked: DataFrame, found: DataFrame) -> DataFrame:
    """One row per question: its chunks in order, and the evidence score of the pass; 0 without a chunk."""
    lists = found.groupBy("qid").agg(F.max("score").alias("top"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("hits"))
    rows = asked.join(lists, "qid", "left")
    terms = F.array_distinct(ascii_tokens(F.col("query")))
    seen = ascii_tokens(F.array_join(F.transform("hits", lambda h: h["text"]), " "))
    overlap = F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, seen)) / F.size(terms)).otherwise(0.0)
    level = F.when(F.col("top") > 0, F.col("top") / (F.col("top") + HALF)).otherwise(0.0)
    score = F.when(F.col("hits").isNull(), 0.0).otherwise(F.least(F.lit(CEILING), F.col("credit") + LEVEL * level + OVERLAP * overlap))
    none = F.array().cast("array<struct<rank:int,chunk_id:string,text:string>>")
    return rows.select("qid", F.coalesce("hits", none).alias("hits"), score.alias("score"))


def closed_loop(questions: DataFrame, chunks: DataFrame, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """(qid, planned_intent, final_intent, answer_probability, action, answer, chunk_ids, retrieval_calls) per question.

    questions has qid, question, case_id; chunks has chunk_id, case_id, section, text. Only questions whose first
    pass scores below the threshold are asked again, in other words and in one section. Two passes as two
    joins: no loop over rows. Null questions retrieve nothing and abstain.
    """
    chunks = stored(chunks.select("chunk_id", "case_id", "section", "text"), "chunks")  # read by both passes
    plan = questions.select("qid", "case_id", F.coalesce("question", F.lit("")).alias("question")).withColumn("intent", report_intent(F.col("question")))
    routed = F.col("intent").isin("findings", "impression")
    first = plan.where("intent <> 'unavailable'").select("qid", "case_id", F.col("question").alias("query"), F.when(routed, F.col("intent")).alias("section"), F.when(routed, ROUTED).otherwise(OPEN).alias("credit"))
    one = _scored(first, retrieve_scoped(first, chunks, k)).select("qid", F.col("hits").alias("h1"), F.col("score").alias("s1"))
    one = stored(one, "first_pass")
    summary = F.lower("question").contains("summar")
    again = plan.join(one.where(F.col("s1") < threshold).select("qid"), "qid").select(
        "qid", "case_id", F.concat("question", F.when(summary, F.lit(" final radiology impression conclusion")).otherwise(F.lit(" radiographic findings impression"))).alias("query"),
        F.when(summary, "impression").otherwise("findings").alias("section"), F.when(summary, ROUTED).otherwise(OPEN).alias("credit"),
    )
    two = _scored(again, retrieve_scoped(again, chunks, k)).select("qid", F.col("hits").alias("h2"), F.col("score").alias("s2"))
    two = two.join(again.select("qid", F.col("section").alias("retry_intent")), "qid")
    rows = plan.join(one, "qid", "left").join(two, "qid", "left")
    none = F.array().cast("array<struct<chunk_id:string,text:string>>")
    bare = lambda c: F.coalesce(F.transform(c, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["text"].alias("text"))), none)
    hits = F.array_distinct(F.concat(bare("h1"), bare("h2")))
    sure = F.when(F.col("intent") == "unavailable", UNAVAILABLE).otherwise(F.greatest(F.col("s1"), F.coalesce("s2", F.lit(0.0))))
    rows = rows.withColumn("hits", hits).withColumn("answer_probability", sure)
    answers = F.col("answer_probability") >= threshold
    calls = F.when(F.col("s1").isNull(), 0).when(F.col("s2").isNull(), 1).otherwise(2)
    return rows.select(
        "qid", F.col("intent").alias("planned_intent"), F.coalesce("retry_intent", "intent").alias("final_intent"), "answer_probability", F.when(answers, "ANSWER").otherwise("ABSTAIN").alias("action"),
        F.when(answers, F.array_join(F.transform("hits", lambda h: h["text"]), " ")).otherwise(NOT_ANSWERABLE).alias("answer"), F.transform("hits", lambda h: h["chunk_id"]).alias("chunk_ids"), calls.alias("retrieval_calls"),
    )


def bounded_units(units: Column, most_units: int = 2, most_characters: int = 520) -> Column:
    """Greedy pick from ranked texts (array<string>): no text twice, at most most_units, within a budget of characters; the first always fits."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def add(state: Column, text: Column) -> Column:
        extra = F.length(text) + F.when(F.size(state["kept"]) > 0, 1).otherwise(0)
        twice = F.exists(state["kept"], lambda k: normalized_key(k) == normalized_key(text))
        fits = (F.size(state["kept"]) < most_units) & ~twice & ((F.size(state["kept"]) == 0) | (state["used"] + extra <= most_characters))
        return F.when(fits, F.struct(F.concat(state["kept"], F.array(text)).alias("kept"), (state["used"] + extra).cast("int").alias("used"))).otherwise(state)

    return F.aggregate(units, start, add, lambda s: s["kept"])


def evidence_text(texts: Column) -> Column:
    """Non-empty texts in their order, joined by newlines."""
    return F.array_join(F.filter(F.transform(texts, clean_text), lambda t: t != ""), "\n")

"""Questions made from cases: plain, hard and unanswerable ones, with the chunks that answer them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.hashing import stable_index
from caseloom.functions.text import capital_sentences, clean_text, placeholder_ratio

# The questions, the conditions that a report may lack, and words that make no probe.
CASE_QUESTIONS = [
    ("findings", "case_scoped_findings", "What radiographic findings are documented for this examination?", "findings"),
    ("impression", "case_scoped_impression", "What is the final radiology impression for this examination?", "impression"),
    ("summary", "case_scoped_summary", "Summarize the principal abnormality or conclusion in this report.", "impression"),
]
CONDITIONS = ["pneumothorax", "pleural effusion", "pulmonary edema", "cardiomegaly", "rib fracture", "hiatal hernia", "pulmonary nodule", "mediastinal widening"]
NO_CONDITION = "measured pulmonary artery pressure"
NO_PROBE_WORDS = ["chest", "disease", "finding", "findings", "left", "normal", "present", "right", "there", "unchanged", "without"]
NO_PROBE = "the principal abnormality"
PROBE = r"[A-Za-z][A-Za-z-]{4,}"


def eligible(findings: Column, impression: Column, images: Column) -> Column:
    """Whether a case can be asked about: images, a findings text of 40 characters and an impression of 8, and not mostly placeholders."""
    return (F.size(images) > 0) & (F.length(clean_text(findings)) >= 40) & (F.length(clean_text(impression)) >= 8) & (placeholder_ratio(findings) <= 0.5)


def chunk_ids(key: Column, section: str, holds: Column | None = None) -> Column:
    """Ids case::section::NNN of the sentences of a section, of those that hold a (lower-case) text only if given."""
    ids = F.transform(capital_sentences(F.col(section)), lambda s, i: F.struct(F.format_string("%s::%s::%03d", key, F.lit(section), i + 1).alias("id"), s.alias("text")))
    kept = ids if holds is None else F.filter(ids, lambda x: F.contains(F.lower(x["text"]), holds))
    return F.transform(kept, lambda x: x["id"])


def case_questions(cases: DataFrame, key: str) -> DataFrame:
    """(qid, case_id, question_type, question, reference_answer, answer_source, relevant_chunk_ids): three questions a case; cases has findings and impression."""
    rows = [
        F.struct(
            F.concat_ws("_", F.col(key), F.lit(name)).alias("qid"), F.col(key).alias("case_id"), F.lit(kind).alias("question_type"), F.lit(text).alias("question"),
            clean_text(F.col(source)).alias("reference_answer"), F.lit(source).alias("answer_source"), chunk_ids(F.col(key), source).alias("relevant_chunk_ids"),
        )
        for name, kind, text, source in CASE_QUESTIONS
    ]
    return cases.select(F.explode(F.array(*rows)).alias("q")).select("q.*")


def absent_condition(report: Column, key: Column) -> Column:
    """The first of CONDITIONS, from a place drawn by the key's hash on, that the report doesn't name."""
    n = len(CONDITIONS)
    names = F.array(*[F.lit(c) for c in CONDITIONS])
    turned = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(names, ((stable_index("absent-condition", key, n) + i) % n + 1).cast("int")))
    return F.coalesce(F.get(F.filter(turned, lambda c: ~F.contains(report, c)), F.lit(0)), F.lit(NO_CONDITION))


def hard_questions(cases: DataFrame, key: str) -> DataFrame:
    """(qid, case_id, question, is_answerable, expected_intent, relevant_chunk_ids): a probe for a word of the report, and one for a condition that it doesn't name; cases has indication, findings, impression.

    The probe is the first word of five letters or more, of the impression and then of the findings, that some sentence holds.
    """
    source = F.concat_ws(" ", clean_text(F.col("impression")), clean_text(F.col("findings")))
    words = F.filter(F.transform(F.regexp_extract_all(source, F.lit(PROBE), F.lit(0)), F.lower), lambda w: ~w.isin(NO_PROBE_WORDS))
    said = lambda w: F.exists(F.concat(capital_sentences(F.col("findings")), capital_sentences(F.col("impression"))), lambda s: F.contains(F.lower(s), w))
    rows = cases.withColumn("_w", F.get(F.filter(words, said), F.lit(0)))
    found = F.concat(chunk_ids(F.col(key), "findings", F.col("_w")), chunk_ids(F.col(key), "impression", F.col("_w")))
    relevant = F.when(F.col("_w").isNull(), chunk_ids(F.col(key), "findings")).otherwise(found)
    report = F.lower(F.concat_ws(" ", *[clean_text(F.col(c)) for c in ("indication", "findings", "impression")]))
    ask = lambda c: F.concat(F.lit("What does this report state about "), c, F.lit("?"))
    first = F.struct(
        F.concat_ws("_", F.col(key), F.lit("fact_probe")).alias("qid"), ask(F.coalesce("_w", F.lit(NO_PROBE))).alias("question"), F.lit(True).alias("is_answerable"),
        F.coalesce(F.split(F.get("_r", F.lit(0)), "::")[1], F.lit("findings")).alias("expected_intent"), F.col("_r").alias("relevant_chunk_ids"),
    )
    second = F.struct(
        F.concat_ws("_", F.col(key), F.lit("near_domain_negative")).alias("qid"), ask(absent_condition(report, F.col(key))).alias("question"), F.lit(False).alias("is_answerable"),
        F.lit("unavailable").alias("expected_intent"), F.array().cast("array<string>").alias("relevant_chunk_ids"),
    )
    return rows.withColumn("_r", relevant).select(F.col(key).alias("case_id"), F.explode(F.array(first, second)).alias("q")).select("case_id", "q.*")


def role_of(value: Column, roles: dict[str, float]) -> Column:
    """The role whose interval of [0, 1) holds the value; intervals lie end to end, in order, in proportion to the shares."""
    total, upto, ends = sum(roles.values()), 0.0, []
    for name, share in roles.items():
        upto += share / total
        ends.append((name, upto))
    chain = reduce(lambda c, e: c.when(value < e[1], e[0]), ends[1:-1], F.when(value < ends[0][1], ends[0][0]))
    return F.when(value.isNotNull(), chain.otherwise(ends[-1][0]))


def matched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right, state): a full outer match of two tables by key; state is matched, missing (only right), extra (only left) or repeated. Null keys drop out."""
    count = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(left, "n_left").join(count(right, "n_right"), key, "full_outer").fillna(0, ["n_left", "n_right"])
    state = F.when(F.col("n_left") == 0, "missing").when(F.col("n_right") == 0, "extra").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").otherwise("matched")
    return both.withColumn("state", state)

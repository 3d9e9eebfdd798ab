"""Features of scored pairs, diagnostics of retrieval and answers, checks of collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import ascii_tokens, capital_sentences, clean_text
from caseloom.functions.vectors import cosine
from caseloom.operators import agent, evidence, metrics, rank, top_texts
from caseloom.plans.evaluation import _CHECKS, first_rows, sentence_checks
from caseloom.plans.retrieval import _ASKED, _BEST, _LONG, _bm25, asked_questions, best_scores, case_labels, component_ranks
from caseloom.plans.text import _INTENT, _clean, _sentences, _tokens
from caseloom.session import table

LABEL_NAMES = ["atelectasis", "cardiomegaly", "consolidation", "device", "edema", "effusion", "fracture", "nodule"]
# Phrases of explicit polarity and what turns them round, in the order in which they are tried.
FLIPS = [
    (r"\b[Tt]here is no\b", "There is"), (r"\b[Tt]here are no\b", "There are"),
    (r"^\s*[Nn]o evidence of\b", "Evidence of"), (r"^\s*[Nn]o\b", ""), (r"(?i)\bwithout evidence of\b", "with evidence of"), (r"(?i)\bwithout demonstration of\b", "with demonstration of"), (r"(?i)\bnegative for\b", "positive for"),
]
# Openings of a question that its target is freed from, in this order.
OPENINGS = [r"^is there (?:evidence of |a |an )?", r"^are there (?:evidence of |a |an )?", r"^is the ", r"^are the "]
FACT_FRAME = "what does this report state about "  # fixed value: a question form that needs no planner
CONFIGS = [(0.5, 0.65, 0.8, 0.5), (0.3, 0.55, 0.7, 0.4), (0.7, 0.45, 0.9, 0.6)]  # lexical weight, least combined support, entailment and contradiction thresholds


def _target_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("case_id"), F.min("question_type").alias("question_type"), F.min("is_answerable").alias("is_answerable"))


def concept_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Soft agreement of the labels of a question's own case (as probabilities) with those of every scored study (definite ones)."""
    value = lambda k: F.coalesce(F.col("labels")[k], F.lit(0.0))
    soft = F.array(*[F.when(value(k) == 1.0, 1.0).when(value(k) != 0.0, 0.5).otherwise(0.0) for k in LABEL_NAMES])
    hard = F.array(*[F.when(value(k) == 1.0, 1.0).otherwise(0.0) for k in LABEL_NAMES])
    cases = case_labels(spark, d).select("study_id", soft.alias("p"), hard.alias("y"))
    pairs = table(spark, d, "scored_cases").where("qid is not null and study_id is not null").select("qid", "study_id").distinct().join(_target_case(spark, d).select("qid", "case_id"), "qid")
    rows = pairs.join(cases.select(F.col("study_id").alias("case_id"), "p"), "case_id").join(cases.select("study_id", "y"), "study_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both, mass, size = total(F.zip_with("p", "y", lambda p, y: p * y)), total(F.col("p")), total(F.col("y"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    length = F.sqrt(total(F.transform("p", lambda p: p * p))) * F.sqrt(size)
    gap = total(F.zip_with("p", "y", lambda p, y: F.abs(p - y))) / len(LABEL_NAMES)
    sure = total(F.transform("p", lambda p: F.abs(p - 0.5) * 2)) / len(LABEL_NAMES)
    return rows.select("qid", "study_id", F.round(1 - gap, 6).alias("agreement"), share(both, mass).alias("covered"), share(both, size).alias("precise"), share(both, length).alias("cosine"), F.round(sure, 6).alias("confidence"))


def leave_one_out_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The five best reports for the impression of every study whose number is divisible by 100, with statistics of all other reports."""
    reports = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min(F.concat_ws(" ", "findings", "impression")).alias("report"), F.min("impression").alias("impression"))
    asked = reports.where(F.substring("study_id", 3, 20).cast("long") % 100 == 0).select(F.col("study_id").alias("query_id"), "impression")
    scores = top_texts.top_leave_one_out(asked, reports, "query_id", "impression", "study_id", "report", 5)
    top = rank.ranked(scores.withColumn("score", F.round("score", 9)), "query_id", "study_id", "score", 5)
    return top.select("query_id", "rank", "study_id", F.round("score", 6).alias("score"))


def chunk_maximum(spark: SparkSession, d: str) -> DataFrame:
    """The five best studies of the asked questions, a study counting with its best sentence."""
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min("findings").alias("findings"), F.min("impression").alias("impression"))
    parts = rows.select("study_id", F.concat(capital_sentences(F.col("findings")), capital_sentences(F.col("impression"))).alias("sentences"))
    best = top_texts.top_bm25_by_part(asked_questions(spark, d), parts, "qid", "question", "study_id", "sentences", 5)
    top = rank.ranked(best, "qid", "study_id", "score", 5)
    return top.select("qid", "rank", "study_id", F.round("score", 6).alias("score"))


def reference_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a reference answer, by type and over all."""
    rows = table(spark, d, "questions").groupBy("qid").agg(F.min("question_type").alias("question_type"), F.min("case_id").alias("case_id"), F.max(F.coalesce(clean_text(F.col("reference_answer")), F.lit(""))).alias("reference"))
    empty = F.col("reference") == ""
    out = rows.rollup("question_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("n_empty"), F.countDistinct(F.when(empty, F.col("case_id"))).alias("n_cases"))
    return out.withColumn("question_type", F.coalesce("question_type", F.lit("all")))


def routed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered under both policies: findings questions take contradiction_only, others sentence_filter; how many sentences they keep."""
    rows = first_rows(spark, d, "verifier_results", "result_id").where("qid is not null").select("qid", "action_policy", F.size("accepted_sentences").alias("n"))
    most = lambda p: F.max(F.when(F.col("action_policy") == p, F.col("n")))
    wide = rows.groupBy("qid").agg(most("sentence_filter").alias("a"), most("contradiction_only").alias("b")).where("a is not null and b is not null").join(_target_case(spark, d), "qid")
    special = F.col("question_type") == "case_scoped_findings"
    return wide.select("qid", F.when(special, "specialist").otherwise("fallback").alias("route"), F.when(special, F.col("b")).otherwise(F.col("a")).alias("n_sentences"))


def ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """F1 of common words and of common word pairs of answers and references, by question type."""
    said = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "qid", "answer")
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min(F.coalesce("reference_answer", F.lit(""))).alias("reference"), F.min("question_type").alias("question_type"))
    rows = said.join(asked, "qid")
    one, two = metrics.ngram_f1(rows, "result_id", "answer", "reference", 1), metrics.ngram_f1(rows, "result_id", "answer", "reference", 2)
    both = rows.select("result_id", "question_type").join(one.withColumnRenamed("f1", "f1_words"), "result_id", "left").join(two.withColumnRenamed("f1", "f1_pairs"), "result_id", "left").fillna(0.0)
    return both.groupBy("question_type").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("f1_words"), 6).alias("f1_words"), F.round(F.avg("f1_pairs"), 6).alias("f1_pairs"))


def flipped(sentence: Column) -> Column:
    """The sentence with its first explicit polarity turned round; null if no phrase fits, or nothing is left or changed."""

    def turn(pattern: str, instead: str) -> Column:
        text = clean_text(F.regexp_replace(sentence, f"(?s)^(.*?)(?:{pattern})", f"$1{instead}") if not pattern.startswith("^") else F.regexp_replace(sentence, pattern, instead))
        done = F.when(sentence.rlike(pattern) & (text != "") & (F.lower(text) != F.lower(sentence)), text)
        return F.concat(F.upper(F.substring(done, 1, 1)), F.substring(done, 2, 1_000_000_000))

    return F.coalesce(*[turn(p, r) for p, r in FLIPS])


def polarity_flips(spark: SparkSession, d: str) -> DataFrame:
    """Checked sentences of explicit polarity, turned round."""
    rows = sentence_checks(spark, d).select("check_id", F.col("at").alias("pos"), flipped(clean_text(F.col("sentence"))).alias("flipped"))
    return rows.where("flipped is not null").select("check_id", "pos", F.sha2("flipped", 256).alias("flipped_sha256"))


def evidence_strata(spark: SparkSession, d: str) -> DataFrame:
    """Checked sentences by stratum of their lexical score and polarity."""
    s = F.col("lexical_score")
    kind = F.when(~F.col("negation_consistent"), "negation_conflict").when((s >= 0.40) & (s < 0.65), "threshold_disagreement").when(s >= 0.65, "high_support").otherwise("low_support")
    return sentence_checks(spark, d).groupBy(kind.alias("stratum")).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("supported").alias("n_supported"))


def verifier_configs(spark: SparkSession, d: str) -> DataFrame:
    """Decisions derived anew under three settings of the verifier: sentences kept, and checks that keep none."""
    rows = sentence_checks(spark, d)
    out = None
    for i, (weight, least, entailed, contradicted) in enumerate(CONFIGS):
        combined = weight * F.col("lexical_score") + (1 - weight) * F.col("entailment_probability")
        kept = F.col("negation_consistent") & (F.col("contradiction_probability") < contradicted) & ((combined >= least) | (F.col("entailment_probability") >= entailed))
        part = rows.groupBy("check_id").agg(F.count_if(kept).alias("k"), F.count(F.lit(1)).alias("n"))
        part = part.agg(F.lit(i).alias("config"), F.sum("n").alias("n_sentences"), F.sum("k").alias("n_kept"), F.count_if(F.col("k") == 0).alias("n_abstained"))
        out = part if out is None else out.unionByName(part)
    return out


def label_support(spark: SparkSession, d: str) -> DataFrame:
    """Definite studies of every label, and whether it has both definite and other studies."""
    cases = case_labels(spark, d)
    counts = cases.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(F.col("labels")[k], F.lit(0.0)) == 1.0).alias(k) for k in LABEL_NAMES])
    long = counts.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("n_definite")) for k in LABEL_NAMES])).alias("x"))
    return long.select("x.label", "x.n_definite", ((F.col("x.n_definite") > 0) & (F.col("x.n_definite") < F.col("n"))).alias("supported"))


def case_documents(spark: SparkSession, d: str) -> DataFrame:
    """Studies as one headed text each."""
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(*[F.min(c).alias(c) for c in ("indication", "findings", "impression")])
    part = lambda c: F.concat(F.lit(f"{c.capitalize()}: "), F.coalesce(F.col(c), F.lit("")))
    return rows.select("study_id", F.sha2(F.concat_ws(" ", part("indication"), part("findings"), part("impression")), 256).alias("document_sha256"))


def question_targets(spark: SparkSession, d: str) -> DataFrame:
    """What a question asks about: its text without opening, mark and 'present'."""
    text = F.trim(F.regexp_replace(F.trim(F.lower("question")), r"\?+$", ""))
    text = reduce(lambda t, p: F.regexp_replace(t, p, ""), OPENINGS, text)
    return table(spark, d, "questions").where("question is not null").select("qid", F.trim(F.replace(text, F.lit(" present"), F.lit(""))).alias("target")).distinct()


def _own_ranks(spark: SparkSession, d: str) -> DataFrame:
    best = best_scores(spark, d).where("score is not null")
    target = _target_case(spark, d).where("case_id is not null").select("qid", F.col("case_id").alias("study_id"))
    return rank.ranks_of(best, target, ["qid"], "study_id", {"rank": F.col("score")}).select("qid", "rank")


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Answers by what went wrong: abstention against answerability, and whether the question's own case is among the 20 best."""
    rows = first_rows(spark, d, "verifier_results", "result_id").select("qid", "abstained").join(_target_case(spark, d), "qid").join(_own_ranks(spark, d), "qid", "left")
    kind = F.when(~F.col("is_answerable"), F.when(F.col("abstained"), "correct_abstention").otherwise("false_answer_unanswerable")).when(F.col("abstained"), "missed_answerable")
    return rows.groupBy(kind.when(F.coalesce(F.col("rank"), F.lit(10**9)) > 20, "retrieval_miss").otherwise("correct_answer_action").alias("outcome")).agg(F.count(F.lit(1)).alias("n_answers"))


def retrieval_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """By question type: scored studies, margin of the best, own case found and among the ten best."""
    best = best_scores(spark, d).where("score is not null")
    sizes = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    top = rank.ranked(best, "qid", "study_id", "score", 2).groupBy("qid").agg((F.max("score") - F.max(F.when(F.col("rank") == 2, F.col("score")))).alias("margin"))
    rows = sizes.join(top, "qid").join(_target_case(spark, d).select("qid", "question_type"), "qid").join(_own_ranks(spark, d), "qid", "left")
    return rows.groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n_questions"), F.sum("n").alias("n_scored"), F.round(F.avg("margin"), 6).alias("mean_margin"), F.count("rank").alias("n_found"), F.count_if(F.col("rank") <= 10).alias("n_in_ten")
    )


def hybrid_plans(spark: SparkSession, d: str) -> DataFrame:
    """Planned intents and where they come from: cue words, a known question form, else the pattern intent."""
    text = F.lower(clean_text(F.col("question")))
    lexical = agent.report_intent(F.col("question"))
    known = F.startswith(text, F.lit(FACT_FRAME))
    rows = table(spark, d, "questions").where("question is not null").select(
        "qid", F.when(lexical != "unknown", lexical).when(known, "unknown").otherwise(evidence.question_intent(F.col("question"))).alias("intent"),
        F.when(lexical != "unknown", "lexical_intent").when(known, "lexical_report_fact_frame").otherwise("semantic_fallback").alias("source"),
    )
    return rows.distinct().groupBy("source", "intent").agg(F.count(F.lit(1)).alias("n_questions"))


def collection_checks(spark: SparkSession, d: str) -> DataFrame:
    """Violations of what a question collection promises: one row a check."""
    rows = table(spark, d, "questions")
    one = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("question").alias("n_texts"), F.min("case_id").alias("study_id"), F.min("is_answerable").alias("yes"), F.max(F.length(clean_text(F.col("reference_answer")))).alias("size"))
    known = one.join(table(spark, d, "paired_cases").select("study_id", F.lit(True).alias("known")).distinct(), "study_id", "left")
    checks = {"repeated": F.col("n") > 1, "conflicting_texts": F.col("n_texts") > 1, "unknown_case": F.col("known").isNull(), "answerable_without_reference": F.col("yes") & (F.coalesce("size", F.lit(0)) == 0), "unanswerable_with_reference": ~F.col("yes") & (F.col("size") > 0)}
    wide = known.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_questions")) for n in checks])).alias("x")).select("x.*")


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a high and a low study of a question, out of small pools: the three best of every component, and the three of highest and of lowest relevance."""
    best = best_scores(spark, d)
    pool = component_ranks(best, 3).select("qid", "study_id")
    high = rank.ranked(best, "qid", "study_id", "report", 3).select("qid", "study_id")
    low = rank.ranked(best.withColumn("low", -F.col("report")), "qid", "study_id", "low", 3).select("qid", "study_id")
    rows = pool.unionAll(high).unionAll(low).distinct().join(best.select("qid", "study_id", F.col("report").alias("gain")), ["qid", "study_id"])
    pairs = rows.join(rows.select("qid", F.col("study_id").alias("other"), F.col("gain").alias("g")), "qid").where(F.round(F.col("gain") - F.col("g"), 9) >= 0.3)  # at most 15 studies a question
    return pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum(F.col("gain") - F.col("g")), 6).alias("weight"))


def view_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean and best cosine over the views of a question's own case and every scored study, where both have usable vectors."""
    ok = lambda c: c.isNotNull() & (F.size(c) == 64) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    first = lambda c: F.min(F.when(ok(F.col(c)), F.struct("encoded_at", F.col(c).alias("v")))).getField("v").alias(c)
    vectors = table(spark, d, "candidate_vectors").where("case_id is not null").groupBy("case_id").agg(first("image_embedding"), first("report_embedding"))
    pairs = table(spark, d, "scored_cases").where("qid is not null and study_id is not null").select("qid", "study_id").distinct().join(_target_case(spark, d).select("qid", "case_id"), "qid").where("case_id <> study_id")
    rows = pairs.join(vectors.toDF("case_id", "qi", "qr"), "case_id").join(vectors.toDF("study_id", "ci", "cr"), "study_id")
    views = F.filter(F.array(F.when(F.col("qi").isNotNull() & F.col("ci").isNotNull(), cosine(F.col("qi"), F.col("ci"))), F.when(F.col("qr").isNotNull() & F.col("cr").isNotNull(), cosine(F.col("qr"), F.col("cr")))), lambda x: x.isNotNull())
    rows = rows.select("qid", "study_id", views.alias("v")).where(F.size("v") > 0)
    return rows.select("qid", "study_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v"), 5).alias("mean_score"), F.round(F.array_max("v"), 5).alias("max_score"))


QUERIES = {
    f.__name__: f
    for f in (
        concept_agreement, leave_one_out_bm25, chunk_maximum, reference_completeness, routed_answers, ngram_overlap, polarity_flips, evidence_strata, verifier_configs, label_support, case_documents, question_targets,
        failure_taxonomy, retrieval_diagnostics, hybrid_plans, collection_checks, training_pairs, view_scores,
    )
}

_TARGET = "target AS (SELECT qid, min(case_id) AS case_id, min(question_type) AS question_type, bool_and(is_answerable) AS is_answerable FROM questions GROUP BY qid)"
_PAIRS = "pairs AS (SELECT DISTINCT qid, study_id FROM scored_cases WHERE qid IS NOT NULL AND study_id IS NOT NULL)"
_LABELS = "latest AS (SELECT study_id, arg_max(labels, ingested_at) AS labels FROM paired_cases GROUP BY study_id)"
_OWN = """placed AS (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank FROM best WHERE score IS NOT NULL),
        own AS (SELECT qid, rank FROM placed JOIN target USING (qid) WHERE study_id = case_id)"""
_NAMES = "[" + ", ".join(f"'{k}'" for k in LABEL_NAMES) + "]"
_VEC = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"


def _ngrams(c: str, n: int) -> str:
    t = _tokens(c)
    return t if n == 1 else f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def _f1(n: int) -> str:
    return f"""(SELECT result_id, 2.0::DOUBLE * sum(least(p, r)) / (sum(p) + sum(r)) AS f1 FROM (SELECT result_id, g, sum(p) AS p, sum(1 - p) AS r FROM (
          SELECT result_id, unnest({_ngrams('answer', n)}) AS g, 1 AS p FROM j UNION ALL SELECT result_id, unnest({_ngrams('reference', n)}), 0 FROM j) GROUP BY ALL) GROUP BY result_id)"""


def _flip_sql(c: str) -> str:
    parts = []
    for pattern, instead in FLIPS:
        text = _clean(f"regexp_replace({c}, '{pattern}', '{instead}')")
        parts.append(f"CASE WHEN regexp_matches({c}, '{pattern}') AND {text} <> '' AND lower({text}) <> lower({c}) THEN upper({text}[1]) || {text}[2:] END")
    return f"coalesce({', '.join(parts)})"


SQL = {
    "concept_agreement": f"""
        WITH {_TARGET}, {_PAIRS}, {_LABELS}, v AS (SELECT study_id, list_transform({_NAMES}, lambda k: coalesce(labels[k], 0)) AS l FROM latest),
        w AS (SELECT study_id, list_transform(l, lambda x: CASE WHEN x = 1 THEN 1.0::DOUBLE WHEN x <> 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS p, list_transform(l, lambda x: CASE WHEN x = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS y FROM v),
        r AS (SELECT qid, c.study_id, q.p AS p, c.y AS y, list_transform(range(1, 9), lambda i: q.p[i] * c.y[i]) AS b, list_transform(range(1, 9), lambda i: abs(q.p[i] - c.y[i])) AS g FROM pairs JOIN target USING (qid) JOIN w q ON q.study_id = case_id JOIN w c ON c.study_id = pairs.study_id)
        SELECT qid, study_id, round(1 - list_sum(g) / 8, 6) AS agreement, round(coalesce(list_sum(b) / nullif(list_sum(p), 0), 0), 6) AS covered, round(coalesce(list_sum(b) / nullif(list_sum(y), 0), 0), 6) AS precise,
          round(coalesce(list_sum(b) / nullif(sqrt(list_sum(list_transform(p, lambda x: x * x))) * sqrt(list_sum(y)), 0), 0), 6) AS cosine, round(list_sum(list_transform(p, lambda x: abs(x - 0.5) * 2)) / 8, 6) AS confidence FROM r""",
    "leave_one_out_bm25": f"""
        WITH rep AS (SELECT study_id, {_tokens("min(concat_ws(' ', findings, impression))")} AS t, {_tokens('min(impression)')} AS q FROM paired_cases GROUP BY study_id),
        size AS (SELECT count(*) AS n, sum(len(t)) AS total FROM rep),
        post AS (SELECT study_id, term, dl, count(*) AS tf FROM (SELECT study_id, len(t) AS dl, unnest(t) AS term FROM rep) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT study_id AS query_id, unnest(q) AS term FROM rep WHERE substr(study_id, 3)::BIGINT % 100 = 0) GROUP BY ALL),
        w AS (SELECT a.query_id, a.term, qtf, n - 1 AS m, df - (o.term IS NOT NULL)::INT AS df, (total - len(r.t)) / (n - 1) AS avgdl FROM ask a JOIN df USING (term) JOIN rep r ON r.study_id = a.query_id LEFT JOIN post o ON o.study_id = a.query_id AND o.term = a.term, size),
        s AS (SELECT query_id, p.study_id, round(sum(qtf * ln(1 + (m - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM w JOIN post p ON p.term = w.term AND p.study_id <> query_id GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, study_id) AS rank, study_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, study_id) <= 5""",
    "chunk_maximum": f"""
        WITH {_ASKED}, base AS (SELECT study_id, min(findings) AS findings, min(impression) AS impression FROM paired_cases GROUP BY study_id),
        parts AS (SELECT study_id, 'findings' AS section, {_sentences('findings')} AS s FROM base UNION ALL SELECT study_id, 'impression', {_sentences('impression')} FROM base),
        chunk AS (SELECT printf('%s::%s::%03d', study_id, section, pos) AS chunk_id, body FROM (SELECT study_id, section, unnest(s) AS body, generate_subscripts(s, 1) AS pos FROM parts)), {_bm25('chunk', 'chunk_id', 'body')},
        b AS (SELECT qid, string_split(chunk_id, '::')[1] AS study_id, round(max(score), 9) AS score FROM scores GROUP BY ALL)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank, study_id, round(score, 6) AS score FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5""",
    "reference_completeness": f"""
        WITH r AS (SELECT qid, min(question_type) AS question_type, min(case_id) AS case_id, max({_clean('reference_answer')}) AS reference FROM questions GROUP BY qid)
        SELECT coalesce(question_type, 'all') AS question_type, count(*) AS n_rows, count(*) FILTER (reference = '') AS n_empty, count(DISTINCT case_id) FILTER (reference = '') AS n_cases FROM r GROUP BY ROLLUP (question_type)""",
    "routed_answers": f"""
        WITH {_TARGET}, r AS (SELECT result_id, min(qid) AS qid, min(action_policy) AS p, min(len(accepted_sentences)) AS n FROM verifier_results GROUP BY result_id),
        w AS (SELECT qid, max(n) FILTER (p = 'sentence_filter') AS a, max(n) FILTER (p = 'contradiction_only') AS b FROM r WHERE qid IS NOT NULL GROUP BY qid)
        SELECT qid, CASE WHEN question_type = 'case_scoped_findings' THEN 'specialist' ELSE 'fallback' END AS route, CASE WHEN question_type = 'case_scoped_findings' THEN b ELSE a END AS n_sentences FROM w JOIN target USING (qid) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "ngram_overlap": f"""
        WITH a AS (SELECT result_id, min(qid) AS qid, min(answer) AS answer FROM verifier_results GROUP BY result_id), q AS (SELECT qid, min(coalesce(reference_answer, '')) AS reference, min(question_type) AS question_type FROM questions GROUP BY qid),
        j AS (SELECT result_id, question_type, answer, reference FROM a JOIN q USING (qid))
        SELECT question_type, count(*) AS n_rows, round(avg(coalesce(x.f1, 0)), 6) AS f1_words, round(avg(coalesce(y.f1, 0)), 6) AS f1_pairs FROM j LEFT JOIN {_f1(1)} x USING (result_id) LEFT JOIN {_f1(2)} y USING (result_id) GROUP BY question_type""",
    "polarity_flips": f"WITH {_CHECKS}, f AS (SELECT check_id, pos, {_flip_sql('s')} AS flipped FROM (SELECT check_id, pos, {_clean('sentence')} AS s FROM checks)) SELECT check_id, pos, sha256(flipped) AS flipped_sha256 FROM f WHERE flipped IS NOT NULL",
    "evidence_strata": """
        WITH one AS (SELECT check_id, arg_min(sentence_checks, created_at) AS sc FROM evidence_checks GROUP BY check_id), c AS (SELECT unnest(sc) AS c FROM one)
        SELECT CASE WHEN NOT c.negation_consistent THEN 'negation_conflict' WHEN c.lexical_score >= 0.4 AND c.lexical_score < 0.65 THEN 'threshold_disagreement' WHEN c.lexical_score >= 0.65 THEN 'high_support' ELSE 'low_support' END AS stratum,
          count(*) AS n_sentences, count(*) FILTER (c.supported) AS n_supported FROM c GROUP BY 1""",
    "verifier_configs": f"""
        WITH one AS (SELECT check_id, arg_min(sentence_checks, created_at) AS sc FROM evidence_checks GROUP BY check_id), c AS (SELECT check_id, unnest(sc) AS c FROM one),
        g AS (SELECT * FROM (VALUES {", ".join(f"({i}, {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {x}::DOUBLE)" for i, (w, s, e, x) in enumerate(CONFIGS))}) t(config, w, s, e, x)),
        k AS (SELECT config, check_id, count(*) FILTER (c.negation_consistent AND c.contradiction_probability < x AND (w * c.lexical_score + (1 - w) * c.entailment_probability >= s OR c.entailment_probability >= e)) AS k, count(*) AS n FROM c, g GROUP BY 1, 2)
        SELECT config, sum(n)::BIGINT AS n_sentences, sum(k)::BIGINT AS n_kept, count(*) FILTER (k = 0) AS n_abstained FROM k GROUP BY config""",
    "label_support": f"""
        WITH {_LABELS}, k AS (SELECT unnest({_NAMES}) AS label) SELECT label, count(*) FILTER (coalesce(labels[label], 0) = 1) AS n_definite, count(*) FILTER (coalesce(labels[label], 0) = 1) BETWEEN 1 AND count(*) - 1 AS supported FROM latest, k GROUP BY label""",
    "case_documents": "SELECT study_id, sha256('Indication: ' || coalesce(min(indication), '') || ' Findings: ' || coalesce(min(findings), '') || ' Impression: ' || coalesce(min(impression), '')) AS document_sha256 FROM paired_cases GROUP BY study_id",
    "question_targets": f"""
        SELECT DISTINCT qid, trim(replace({reduce(lambda t, p: f"regexp_replace({t}, '{p}', '')", OPENINGS, r"trim(regexp_replace(trim(lower(question), ' '), '\?+$', ''), ' ')")}, ' present', ''), ' ') AS target FROM questions WHERE question IS NOT NULL""",
    "failure_taxonomy": f"""
        WITH {_BEST}, {_TARGET}, {_OWN}, r AS (SELECT result_id, min(qid) AS qid, bool_and(abstained) AS abstained FROM verifier_results GROUP BY result_id)
        SELECT CASE WHEN NOT is_answerable THEN CASE WHEN abstained THEN 'correct_abstention' ELSE 'false_answer_unanswerable' END WHEN abstained THEN 'missed_answerable' WHEN coalesce(rank, 1000000000) > 20 THEN 'retrieval_miss' ELSE 'correct_answer_action' END AS outcome,
          count(*) AS n_answers FROM r JOIN target USING (qid) LEFT JOIN own USING (qid) GROUP BY 1""",
    "retrieval_diagnostics": f"""
        WITH {_BEST}, {_TARGET}, {_OWN}, s AS (SELECT qid, count(*) AS n FROM placed GROUP BY qid),
        m AS (SELECT qid, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin FROM placed JOIN best USING (qid, study_id) GROUP BY qid)
        SELECT question_type, count(*) AS n_questions, sum(n)::BIGINT AS n_scored, round(avg(margin), 6) AS mean_margin, count(rank) AS n_found, count(*) FILTER (rank <= 10) AS n_in_ten FROM s JOIN m USING (qid) JOIN target USING (qid) LEFT JOIN own USING (qid) GROUP BY question_type""",
    "hybrid_plans": f"""
        WITH t AS (SELECT DISTINCT qid, lower({_clean('question')}) AS t, {_INTENT} AS semantic FROM questions WHERE question IS NOT NULL),
        l AS (SELECT *, CASE {" ".join(f"WHEN len(list_filter({[*cues]}, lambda c: contains(t, c))) > 0 THEN '{name}'" for name, cues in (("unavailable", agent.OUT_OF_SCOPE), ("impression", agent.IMPRESSION_CUES), ("findings", agent.FINDINGS_CUES)))} ELSE 'unknown' END AS lexical FROM t),
        p AS (SELECT DISTINCT qid, CASE WHEN lexical <> 'unknown' THEN lexical WHEN starts_with(t, '{FACT_FRAME}') THEN 'unknown' ELSE semantic END AS intent,
          CASE WHEN lexical <> 'unknown' THEN 'lexical_intent' WHEN starts_with(t, '{FACT_FRAME}') THEN 'lexical_report_fact_frame' ELSE 'semantic_fallback' END AS source FROM l)
        SELECT source, intent, count(*) AS n_questions FROM p GROUP BY 1, 2""",
    "collection_checks": f"""
        WITH o AS (SELECT qid, count(*) AS n, count(DISTINCT question) AS k, min(case_id) AS c, bool_and(is_answerable) AS yes, max(length({_clean('reference_answer')})) AS size FROM questions GROUP BY qid),
        w AS (SELECT count(*) FILTER (n > 1) AS a, count(*) FILTER (k > 1) AS b, count(*) FILTER (c IS NULL OR c NOT IN (SELECT study_id FROM paired_cases WHERE study_id IS NOT NULL)) AS c, count(*) FILTER (yes AND size = 0) AS d, count(*) FILTER (NOT yes AND size > 0) AS e FROM o)
        SELECT 'repeated' AS "check", a AS n_questions FROM w UNION ALL SELECT 'conflicting_texts', b FROM w UNION ALL SELECT 'unknown_case', c FROM w UNION ALL SELECT 'answerable_without_reference', d FROM w UNION ALL SELECT 'unanswerable_with_reference', e FROM w""",
    "training_pairs": f"""
        WITH {_BEST}, {_LONG}, u AS (SELECT qid, study_id FROM ranks WHERE rank <= 3
          UNION SELECT qid, study_id FROM (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY report DESC, study_id) AS r FROM best) WHERE r <= 3
          UNION SELECT qid, study_id FROM (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY report, study_id) AS r FROM best) WHERE r <= 3),
        g AS (SELECT qid, study_id, report AS gain FROM u JOIN best USING (qid, study_id))
        SELECT a.qid, count(*) AS n_pairs, round(sum(a.gain - b.gain), 6) AS weight FROM g a JOIN g b ON a.qid = b.qid AND round(a.gain - b.gain, 9) >= 0.3 GROUP BY a.qid""",
    "view_scores": f"""
        WITH {_TARGET}, {_PAIRS}, v AS (SELECT case_id, arg_min(image_embedding, encoded_at) FILTER ({_VEC.format('image_embedding')}) AS i, arg_min(report_embedding, encoded_at) FILTER ({_VEC.format('report_embedding')}) AS r FROM candidate_vectors WHERE case_id IS NOT NULL GROUP BY case_id),
        s AS (SELECT qid, pairs.study_id, list_cosine_similarity(q.i::DOUBLE[], c.i::DOUBLE[]) AS a, list_cosine_similarity(q.r::DOUBLE[], c.r::DOUBLE[]) AS b FROM pairs JOIN target USING (qid) JOIN v q ON q.case_id = target.case_id JOIN v c ON c.case_id = pairs.study_id WHERE target.case_id <> pairs.study_id)
        SELECT qid, study_id, round((coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 5) AS mean_score, round(greatest(a, b), 5) AS max_score FROM s WHERE a IS NOT NULL OR b IS NOT NULL""",
}

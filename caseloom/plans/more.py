"""Feature, sampling and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import ascii_tokens, clean_text
from caseloom.functions.vectors import cosine
from caseloom.operators import sampling
from caseloom.operators.cohorts import patient_key
from caseloom.operators.order import quantiles, ranks_in_groups, with_positions
from caseloom.plans.evaluation import _CHECKS, _PATIENT, first_rows, sentence_checks
from caseloom.plans.retrieval import _BEST, COMPONENTS, _mm, best_scores
from caseloom.plans.text import _clean
from caseloom.session import table

TERMS = ["effusion", "nodule", "consolidation", "oedema", "fracture"]


def ranking_features(spark: SparkSession, d: str) -> DataFrame:
    """Min-max, reciprocal rank and rank fraction of every component, and the question type, over all scored pairs; summed per question.

    All pairs are ranked by one global sort over questions and components; sums over a range need its ends only, so nothing is joined back.
    """
    best = best_scores(spark, d)
    kinds = table(spark, d, "questions").groupBy("qid").agg(F.min("question_type").alias("question_type"))
    long = best.select("qid", "study_id", F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("value")) for c in COMPONENTS])).alias("x")).select("qid", "study_id", "x.*")
    ranks = ranks_in_groups(long, ["qid", "source"], [F.desc("value"), F.col("study_id")])
    sums = ranks.groupBy("qid", "source").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.col("value") / F.col("rank")).alias("vr"), F.sum(1.0 / F.col("rank")).alias("r"), F.avg("rank").alias("mean_rank")
    )
    weighted = F.when(F.col("high") - F.col("low") > 1e-12, (F.col("vr") - F.col("low") * F.col("r")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    fraction = F.when(F.col("n") > 1, 1 - (F.col("mean_rank") - 1) / (F.col("n") - 1)).otherwise(1.0)
    rows = sums.select("qid", "source", "n", weighted.alias("weighted"), fraction.alias("fraction"))
    wide = [F.round(F.max(F.when(F.col("source") == c, F.col(v))), 6).alias(f"{c}_{v}") for c in COMPONENTS for v in ("weighted", "fraction")]
    kind = F.max((F.col("question_type") == "case_scoped_findings").cast("int")).alias("is_findings")
    return rows.join(kinds, "qid").groupBy("qid").agg(F.max("n").alias("n"), kind, *wide)


def component_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spread and agreement of components per question; a degenerate correlation is 0."""
    best = best_scores(spark, d)
    correlation = F.try_divide(F.covar_pop("bm25", "image"), F.stddev_pop("bm25") * F.stddev_pop("image"))  # corr itself is an error where a component is constant
    sums = best.groupBy("qid").agg(F.round(F.coalesce(F.nanvl(correlation, F.lit(0.0)), F.lit(0.0)), 5).alias("correlation"), F.round(F.stddev_pop("bm25"), 6).alias("spread"))
    ends = quantiles(best, "qid", "image", {"low": 0.25, "high": 0.75})
    return sums.join(ends, "qid").select("qid", "correlation", "spread", F.round(F.col("high") - F.col("low"), 6).alias("iqr"))


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = best_scores(spark, d).where("score is not null")
    return sampling.hard_negatives(rows, "qid", "study_id", "score", "report", 5, 0.4).select("qid", "rank", "study_id")


def pairwise_examples(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.pairwise_examples(best_scores(spark, d), "qid", "study_id", "report", 0.6, 0.3)
    return rows.groupBy("qid", "best").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("other").alias("first_other"))


def view_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the two vectors of a case, where both are usable."""
    ok = lambda c: (F.size(c) == 64) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & F.exists(c, lambda x: x != 0)
    rows = table(spark, d, "candidate_vectors").where(F.col("image_embedding").isNotNull() & F.col("report_embedding").isNotNull() & ok("image_embedding") & ok("report_embedding"))
    return rows.select("case_id", F.round(cosine(F.col("image_embedding"), F.col("report_embedding")), 5).alias("cosine")).distinct()


def hashed_history(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min(patient_key(F.col("patient_id"))).alias("patient"))
    return sampling.hashed_history(bank.select(F.col("study_id").alias("target"), "patient"), bank, "target", "study_id", "patient", 3, 7)


def blinded_review(spark: SparkSession, d: str) -> DataFrame:
    cases = sampling.hash_sample(table(spark, d, "paired_cases"), "study_id", 100, "review", 7047)
    return sampling.blinded_rows(cases, "study_id", ["bm25", "fixed", "learned"], 7047)


def calibration_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = sentence_checks(spark, d).select("check_id", "at", "decision_reason")
    return sampling.round_robin(rows, "decision_reason", ["check_id", "at"], 50, 3).select("check_id", F.col("at").alias("pos"), "decision_reason", "turn")


def support_average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of the entailment probability per decision of the question type; equal scores step together."""
    kinds = table(spark, d, "questions").groupBy("qid").agg(F.min("question_type").alias("question_type"))
    rows = sentence_checks(spark, d).join(kinds, "qid").where("entailment_probability is not null and supported is not null")
    y = F.col("supported").cast("long")
    levels = rows.groupBy("question_type", F.col("entailment_probability").alias("s")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    placed, _ = with_positions(levels, [F.col("question_type"), F.desc("s")], {"cp": F.col("pos"), "cn": F.col("n")})
    start = placed.groupBy("question_type").agg(F.min(F.col("cp") - F.col("pos")).alias("p0"), F.min(F.col("cn") - F.col("n")).alias("n0"), F.sum("pos").alias("total"))
    steps = placed.join(F.broadcast(start), "question_type")  # one row per question type
    part = F.col("pos") / F.col("total") * (F.col("cp") - F.col("p0")) / (F.col("cn") - F.col("n0"))
    return steps.groupBy("question_type").agg(F.round(F.sum(part), 6).alias("average_precision"))


def nested_means(spark: SparkSession, d: str) -> DataFrame:
    """Support rate averaged over checks, then questions, then cases, per question type."""
    rows = table(spark, d, "evidence_checks").where("support_rate is not null").select("check_id", "qid", "support_rate").distinct()
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("case_id"), F.min("question_type").alias("question_type"))
    per_question = rows.groupBy("qid").agg(F.avg("support_rate").alias("x")).join(asked, "qid")
    per_case = per_question.groupBy("question_type", "case_id").agg(F.avg("x").alias("x"))
    return per_case.groupBy("question_type").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("x"), 6).alias("mean_support"))


def policy_differences(spark: SparkSession, d: str) -> DataFrame:
    """Accepted sentences per question under two policies side by side, for questions that have both."""
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "qid", "action_policy", F.size("accepted_sentences").alias("n"))
    wide = rows.groupBy("qid").pivot("action_policy", ["sentence_filter", "contradiction_only"]).agg(F.avg("n"))
    both = wide.where("sentence_filter is not null and contradiction_only is not null")
    gap = F.col("contradiction_only") - F.col("sentence_filter")
    return both.select("qid", F.round(gap, 6).alias("difference"), F.when(gap > 0, "more").when(gap < 0, "fewer").otherwise("same").alias("outcome"))


def located_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Where each checked sentence stands, word for word, in the revised answer of its check."""
    rows = first_rows(spark, d, "evidence_checks", "check_id").select("check_id", "revised_answer", "sentence_checks")
    rows = rows.select("check_id", "revised_answer", F.posexplode("sentence_checks").alias("pos", "c"))
    place = F.instr(clean_text(F.col("revised_answer")), clean_text(F.col("c.sentence")))
    return rows.where(F.length("c.sentence") > 0).select("check_id", "pos", place.alias("found_at")).where("found_at > 0")


def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Studies whose impression names any of the terms: counts per term set."""
    rows = table(spark, d, "paired_cases").select("study_id", F.lower(F.coalesce("impression", F.lit(""))).alias("t")).distinct()
    hits = rows.select("study_id", F.explode(F.filter(F.array(*[F.lit(t) for t in TERMS]), lambda t: F.contains(F.col("t"), t))).alias("term"))
    return hits.groupBy("term").agg(F.countDistinct("study_id").alias("n_studies"), F.min("study_id").alias("first_study"))


def corpus_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and idf of every term of the corpus."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select(F.explode(F.array_distinct(ascii_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))  # n is one row


QUERIES = {
    f.__name__: f
    for f in (ranking_features, component_correlation, hard_negatives, pairwise_examples, view_agreement, hashed_history, blinded_review, calibration_sample, support_average_precision, nested_means, policy_differences, located_sentences, keyword_relevance, corpus_vocabulary)
}

_FEATURES = ", ".join(
    f"{_mm(c)} AS {c}_mm, row_number() OVER (PARTITION BY qid ORDER BY {c} DESC, study_id) AS {c}_place" for c in COMPONENTS
)
_SUMS = ", ".join(f"round(sum({c}_mm / {c}_place), 6) AS {c}_weighted, round(avg(CASE WHEN n > 1 THEN 1 - ({c}_place - 1) / (n - 1) ELSE 1 END), 6) AS {c}_fraction" for c in COMPONENTS)
_OK = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"

SQL = {
    "ranking_features": f"""
        WITH {_BEST}, f AS (SELECT qid, study_id, count(*) OVER (PARTITION BY qid) AS n, {_FEATURES} FROM best), k AS (SELECT qid, min(question_type) AS question_type FROM questions GROUP BY qid)
        SELECT qid, count(*) AS n, max((question_type = 'case_scoped_findings')::INT) AS is_findings, {_SUMS} FROM f JOIN k USING (qid) GROUP BY qid""",
    "component_correlation": f"""
        WITH {_BEST} SELECT qid, round(coalesce(CASE WHEN isnan(corr(bm25, image)) THEN 0 ELSE corr(bm25, image) END, 0), 5) AS correlation, round(stddev_pop(bm25), 6) AS spread,
          round(quantile_cont(image, 0.75) - quantile_cont(image, 0.25), 6) AS iqr FROM best GROUP BY qid""",
    "hard_negatives": f"""
        WITH {_BEST}, r AS (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank FROM best WHERE score IS NOT NULL AND report <= 0.4)
        SELECT qid, rank, study_id FROM r WHERE rank <= 5""",
    "pairwise_examples": f"""
        WITH {_BEST}, p AS (SELECT qid, study_id AS best FROM best WHERE report >= 0.6 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY report DESC, study_id) = 1)
        SELECT qid, p.best AS best, count(*) AS n_pairs, min(study_id) AS first_other FROM best JOIN p USING (qid) WHERE report < 0.3 GROUP BY qid, p.best""",
    "view_agreement": f"""
        SELECT DISTINCT case_id, round(list_cosine_similarity(image_embedding::DOUBLE[], report_embedding::DOUBLE[]), 5) AS cosine FROM candidate_vectors
        WHERE {_OK.format('image_embedding')} AND {_OK.format('report_embedding')}""",
    "hashed_history": f"""
        WITH bank AS (SELECT study_id, min({_PATIENT}) AS patient FROM paired_cases GROUP BY study_id),
        ring AS (SELECT study_id, patient, row_number() OVER (ORDER BY sha256('7|' || study_id), study_id) - 1 AS place, count(*) OVER () AS n FROM bank),
        t AS (SELECT study_id AS target, patient AS tp, ('0x' || substr(sha256('7|start|' || study_id), 1, 15))::BIGINT % n AS start FROM ring),
        p AS (SELECT target, study_id, (place - start + n) % n AS step FROM t JOIN ring ON target <> study_id AND (tp IS NULL OR patient IS NULL OR tp <> patient))
        SELECT target, (row_number() OVER (PARTITION BY target ORDER BY step))::INT AS position, study_id FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY step) <= 3""",
    "blinded_review": """
        WITH c AS (SELECT DISTINCT study_id FROM paired_cases), s AS (SELECT study_id FROM c ORDER BY sha256('review|7047|' || study_id), study_id LIMIT 100),
        r AS (SELECT study_id, unnest(['bm25', 'fixed', 'learned']) AS system FROM s)
        SELECT study_id, system, chr(64 + row_number() OVER (PARTITION BY study_id ORDER BY sha256('7047|' || study_id || '|' || system), system)::INT) AS code FROM r""",
    "calibration_sample": f"""
        WITH {_CHECKS}, t AS (SELECT check_id, pos, decision_reason, row_number() OVER (PARTITION BY decision_reason ORDER BY sha256('3|' || check_id || '|' || pos), check_id, pos) AS turn FROM checks)
        SELECT check_id, pos, decision_reason, turn FROM t ORDER BY turn, decision_reason LIMIT 50""",
    "support_average_precision": f"""
        WITH {_CHECKS}, k AS (SELECT question_type, entailment_probability AS s, supported::INT AS y FROM checks JOIN (SELECT qid, min(question_type) AS question_type FROM questions GROUP BY qid) USING (qid) WHERE entailment_probability IS NOT NULL AND supported IS NOT NULL),
        l AS (SELECT question_type, s, sum(y) AS pos, count(*) AS n FROM k GROUP BY 1, 2),
        c AS (SELECT question_type, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY question_type) AS total FROM l WINDOW w AS (PARTITION BY question_type ORDER BY s DESC))
        SELECT question_type, round(sum(pos / total * cp / cn), 6) AS average_precision FROM c GROUP BY 1""",
    "nested_means": """
        WITH r AS (SELECT DISTINCT check_id, qid, support_rate FROM evidence_checks WHERE support_rate IS NOT NULL), q AS (SELECT qid, avg(support_rate) AS x FROM r GROUP BY qid),
        a AS (SELECT qid, min(case_id) AS case_id, min(question_type) AS question_type FROM questions GROUP BY qid),
        c AS (SELECT question_type, case_id, avg(x) AS x FROM q JOIN a USING (qid) GROUP BY 1, 2)
        SELECT question_type, count(*) AS n_cases, round(avg(x), 6) AS mean_support FROM c GROUP BY 1""",
    "policy_differences": """
        WITH r AS (SELECT result_id, min(qid) AS qid, min(action_policy) AS p, min(len(accepted_sentences)) AS n FROM verifier_results GROUP BY result_id),
        w AS (SELECT qid, avg(n) FILTER (p = 'contradiction_only') - avg(n) FILTER (p = 'sentence_filter') AS gap FROM r GROUP BY qid)
        SELECT qid, round(gap, 6) AS difference, CASE WHEN gap > 0 THEN 'more' WHEN gap < 0 THEN 'fewer' ELSE 'same' END AS outcome FROM w WHERE gap IS NOT NULL AND qid IS NOT NULL""",
    "located_sentences": f"""
        WITH one AS (SELECT check_id, arg_min(coalesce(revised_answer, ''), created_at) AS a, arg_min(sentence_checks, created_at) AS s FROM evidence_checks GROUP BY check_id),
        r AS (SELECT check_id, a, unnest(s).sentence AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM one)
        SELECT check_id, pos, strpos({_clean('a')}, {_clean('sentence')}) AS found_at FROM r WHERE length(sentence) > 0 AND strpos({_clean('a')}, {_clean('sentence')}) > 0""",
    "keyword_relevance": f"""
        WITH t AS (SELECT unnest({TERMS}) AS term) SELECT term, count(DISTINCT study_id) AS n_studies, min(study_id) AS first_study FROM paired_cases, t WHERE contains(lower(coalesce(impression, '')), term) GROUP BY term""",
    "corpus_vocabulary": """
        WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
        SELECT term, count(*) AS df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, n GROUP BY term, n""",
}

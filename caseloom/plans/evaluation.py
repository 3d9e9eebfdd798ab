"""Evidence, answer, calibration, statistics and cohort queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import ENDINGS, NEGATION, NORMALITY, STOP_WORDS, normalized_key
from caseloom.operators import cohorts, evidence, metrics, relevance
from caseloom.operators.order import quantiles
from caseloom.plans.text import S
from caseloom.session import table


WRITTEN = {"verifier_results": ["created_at", "loaded_at"], "evidence_checks": ["created_at", "loaded_at"], "paired_cases": ["ingested_at"]}


def first_rows(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """One row per key of a table whose rows may be written twice: the one written first."""
    return evidence.latest_rows(table(spark, d, name), key, [F.col(c) for c in WRITTEN[name]])


def sentence_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row per checked sentence of each distinct check: check_id, at, and the fields of the check."""
    rows = first_rows(spark, d, "evidence_checks", "check_id").select("check_id", "qid", "sentence_checks")
    return rows.select("check_id", "qid", F.posexplode("sentence_checks").alias("at", "c")).select("check_id", "qid", "at", "c.*")


def evidence_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = sentence_checks(spark, d)
    m = rows.groupBy("decision_reason", "supported").agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.countDistinct("sentence").alias("n_distinct"),
        F.round(F.avg("combined_support_score"), 6).alias("mean_score"),
        F.max("combined_support_score").alias("max_score"),
        F.sum(F.length("sentence")).alias("n_chars"),
    )
    return m


def verifier_actions(spark: SparkSession, d: str) -> DataFrame:
    rows = first_rows(spark, d, "evidence_checks", "check_id").select("check_id", "revised_answer", "sentence_checks")
    policies = F.explode(F.array(*[F.lit(p) for p in ("sentence_filter", "contradiction_only", "audit_only")])).alias("policy")
    rows = rows.select("check_id", "revised_answer", "sentence_checks", policies)
    act = evidence.verifier_action(F.coalesce("revised_answer", F.lit("")), F.col("sentence_checks"), F.col("policy"))
    return rows.select("check_id", "policy", act.alias("a")).select("check_id", "policy", F.sha2("a.answer", 256).alias("answer_sha256"), "a.n_accepted", "a.n_rejected", "a.abstained", "a.revised")


def evidence_support(spark: SparkSession, d: str) -> DataFrame:
    """Every verifier answer against the report of its study, sentence by sentence."""
    said = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "study_id", "answer")
    report = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min(F.concat_ws(" ", "findings", "impression")).alias("report"))
    report = report.select("study_id", evidence.prepared_evidence(F.col("report")).alias("report"))  # once per study
    checks = evidence.evidence_support(said.join(report, "study_id"), "result_id", "answer", "report")
    return evidence.revised_answers(checks, "result_id").withColumn("support_rate", F.round("support_rate", 6))


def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "action_policy", "abstained", "revised", F.size("accepted_sentences").alias("n"))
    return rows.cube("action_policy", "abstained").agg(
        F.count(F.lit(1)).alias("n_rows"), F.grouping_id().cast("int").alias("grouping"), F.round(F.avg(F.col("revised").cast("double")), 6).alias("revised_rate"), F.median("n").alias("median_accepted")
    )


def answer_token_f1(spark: SparkSession, d: str) -> DataFrame:
    said = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "qid", "answer")
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min(F.coalesce("reference_answer", F.lit(""))).alias("reference"), F.min("question_type").alias("question_type"))
    scored = metrics.token_f1(said.join(asked, "qid"), "result_id", "answer", "reference")
    return scored.groupBy("question_type").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("token_f1"), 6).alias("mean_token_f1"))


def calibration(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.calibration(sentence_checks(spark, d), "entailment_probability", "supported")
    return m.select("n_rows", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.reliability_bins(sentence_checks(spark, d), "combined_support_score", "supported")
    return m.select("bin", "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("accuracy", 6).alias("accuracy"))


def support_auroc(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.auroc(sentence_checks(spark, d), "lexical_score", "supported")
    return m.select(F.col("n_positive").cast("long").alias("n_positive"), F.col("n_negative").cast("long").alias("n_negative"), F.round("auroc", 6).alias("auroc"))


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Risk at every tenth of coverage."""
    rows = sentence_checks(spark, d).select("check_id", "at", "combined_support_score", "supported")
    curve, n = metrics.risk_coverage(rows, "combined_support_score", "supported", ["check_id", "at"])
    tenth = F.ceil(F.col("position") * 10 / F.lit(max(n, 1)))
    last = curve.withColumn("decile", tenth.cast("int")).groupBy("decile").agg(F.max("position").alias("position"), F.round(F.max_by("risk", "position"), 6).alias("risk"))
    return last


def support_thresholds(spark: SparkSession, d: str) -> DataFrame:
    rows = sentence_checks(spark, d).join(table(spark, d, "questions").groupBy("qid").agg(F.min("question_type").alias("question_type")), "qid")
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    m = metrics.f1_thresholds(rows, "question_type", "entailment_probability", "supported", grid)
    return m.select("question_type", "threshold", F.round("f1", 6).alias("f1"))


def label_f1(spark: SparkSession, d: str) -> DataFrame:
    """Definite labels of a study against all active ones: per label and overall."""
    rows = first_rows(spark, d, "paired_cases", "study_id").where("labels is not null").select(
        "study_id", F.map_keys(F.map_filter("labels", lambda k, v: v == 1.0)).alias("reference"), F.map_keys(F.map_filter("labels", lambda k, v: v != 0.0)).alias("prediction")
    )
    parts = metrics.label_statistics(rows, "study_id", "reference", "prediction")
    out = parts.rollup("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return out.select("label", "tp", "fp", "fn", F.round(metrics.f1_of(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


def holm_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_checks").where("support_rate is not null").groupBy("check_id").agg(F.min("support_rate").alias("p"))
    return metrics.holm(rows, "p", "check_id").select("check_id", F.round("holm", 6).alias("holm"))


def abstention_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "action_policy", "abstained")
    counts = rows.groupBy("action_policy").agg(F.count_if("abstained").alias("n_abstained"), F.count(F.lit(1)).alias("n_rows"))
    low, high = metrics.wilson(F.col("n_abstained").cast("double"), F.col("n_rows").cast("double"))
    return counts.select("action_policy", "n_abstained", "n_rows", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def support_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evidence_checks").where("support_rate is not null and qid is not null").groupBy("qid").agg(F.avg("support_rate").alias("x"))
    means = metrics.bootstrap_means(rows, "qid", "x", 1000, 2026)
    return means.agg(F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(mean, 0.025)"), 6).alias("low"), F.round(F.expr("percentile(mean, 0.975)"), 6).alias("high"))


def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scored_cases").where("score is not null and not isnan(score) and abs(score) < double('infinity')")
    sums = rows.groupBy("route").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("spread"))
    places = quantiles(rows.withColumn("route", F.coalesce("route", F.lit(""))), "route", "score", {"median": 0.5, "p95": 0.95})
    joined = sums.join(places.withColumnRenamed("route", "r"), F.coalesce("route", F.lit("")) == F.col("r"))
    return joined.select("route", "n_rows", "mean", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "spread")


def bank_audit(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "paired_cases").select("study_id", "patient_id")
    asked = bank.where(F.substring("study_id", 3, 20).cast("long") % 100 == 0)
    return cohorts.bank_audit(asked, bank, "study_id", "patient_id")


def bank_audit_all(spark: SparkSession, d: str) -> DataFrame:
    """bank_audit of every study; bank_audit itself keeps to the hundredth that its SQL asks for."""
    bank = table(spark, d, "paired_cases").select("study_id", "patient_id")
    return cohorts.bank_audit(bank, bank, "study_id", "patient_id")


def patient_partition(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "paired_cases").select(cohorts.patient_key(F.col("patient_id")).alias("patient"))
    return cohorts.hash_partition(ids, "patient", {"train": 0.65, "calibration": 0.1, "validation": 0.1, "test": 0.15}, "patients", 7)


def study_derangement(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.derangement(table(spark, d, "paired_cases"), "study_id", "shuffle", 11)


def exact_text_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.exact_text_clusters(table(spark, d, "paired_cases"), "study_id", ["findings", "impression"])


def near_text_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.near_text_clusters(table(spark, d, "paired_cases"), "study_id", ["findings", "impression"])


def ambiguous_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question texts that are asked of more than one case."""
    rows = table(spark, d, "questions").groupBy(normalized_key(F.col("question")).alias("question")).agg(F.countDistinct("case_id").alias("n_cases"), F.countDistinct("qid").alias("n_questions"))
    return rows.where("n_cases > 1")


def latest_answers(spark: SparkSession, d: str) -> DataFrame:
    """First row of every result, as a resumed writer keeps it."""
    rows = evidence.latest_rows(table(spark, d, "verifier_results"), "result_id", [F.col("created_at"), F.col("loaded_at")])
    return rows.select("result_id", "qid", "study_id", "abstained", F.unix_micros("created_at").alias("created_us"))


def claim_polarities(spark: SparkSession, d: str) -> DataFrame:
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "answer", "action_policy")
    return rows.groupBy("action_policy", relevance.claim_polarity(F.col("answer")).alias("polarity")).agg(F.count(F.lit(1)).alias("n_answers"))


def answer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Answers by whether the question could be answered and whether they abstained: counts and rates per policy."""
    said = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "qid", "action_policy", "abstained")
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min("is_answerable").alias("is_answerable"))
    rows = said.join(asked, "qid")
    n = lambda c: F.count_if(c)
    yes, quiet = F.col("is_answerable"), F.col("abstained")
    out = rows.groupBy("action_policy").agg(n(yes & ~quiet).alias("tp"), n(~yes & quiet).alias("tn"), n(~yes & ~quiet).alias("fp"), n(yes & quiet).alias("fn"))
    f1 = metrics.f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    false = F.coalesce(F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")), F.lit(0.0))
    return out.withColumn("answerable_f1", F.round(f1, 6)).withColumn("false_answer_rate", F.round(false, 6))


def confusion_by_reason(spark: SparkSession, d: str) -> DataFrame:
    """Decision reasons against support, pivoted."""
    return sentence_checks(spark, d).groupBy("decision_reason").pivot("supported", [True, False]).count().fillna(0).select("decision_reason", F.col("true").alias("supported"), F.col("false").alias("unsupported"))


def support_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Sweep of decision thresholds: share of sentences kept, and share of the kept ones that are supported."""
    rows = sentence_checks(spark, d).select("combined_support_score", "supported")
    sums = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("combined_support_score") >= t).alias("kept"), F.count_if((F.col("combined_support_score") >= t) & F.col("supported")).alias("right")) for t in (0.3, 0.4, 0.5, 0.55, 0.6, 0.7)]
    wide = rows.agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("cells"))
    return wide.select("n", F.explode("cells").alias("c")).select("c.threshold", F.round(F.col("c.kept") / F.col("n"), 6).alias("coverage"), F.round(F.coalesce(F.try_divide(F.col("c.right").cast("double"), F.col("c.kept")), F.lit(0.0)), 6).alias("precision"))


def cluster_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge counts of listed clusters, once per cluster and member."""
    rows = table(spark, d, "duplicate_clusters").select("cluster_id", F.upper(F.regexp_replace("case_id", r"^\s+|\s+$", "")).alias("case_id"), "exact_text_edges", "near_text_edges", "exact_image_edges").distinct()
    return rows.groupBy("cluster_id").agg(F.countDistinct("case_id").alias("n_members"), F.max("exact_text_edges").alias("exact_text_edges"), F.max("near_text_edges").alias("near_text_edges"), F.max("exact_image_edges").alias("exact_image_edges"))


QUERIES = {
    f.__name__: f
    for f in (
        claim_polarities, answer_outcomes, confusion_by_reason, support_by_threshold, cluster_edges, evidence_profile, verifier_actions, evidence_support, policy_summary, answer_token_f1, calibration, reliability_table, support_auroc, risk_coverage,
        support_thresholds, label_f1, holm_adjusted, abstention_intervals, support_bootstrap, score_quantiles, bank_audit, bank_audit_all, patient_partition, study_derangement,
        exact_text_clusters, near_text_clusters, ambiguous_questions, latest_answers,
    )
}

_CHECKS = """one AS (SELECT check_id, min(qid) AS qid, arg_min(sentence_checks, created_at) AS sc FROM evidence_checks GROUP BY check_id),
rows AS (SELECT check_id, qid, unnest(sc) AS c, generate_subscripts(sc, 1) - 1 AS pos FROM one),
checks AS (SELECT check_id, qid, pos, c.sentence AS sentence, c.lexical_score AS lexical_score, c.entailment_probability AS entailment_probability,
  c.contradiction_probability AS contradiction_probability, c.combined_support_score AS combined_support_score, c.supported AS supported, c.decision_reason AS decision_reason FROM rows)"""
_KEY = f"lower(trim(regexp_replace(coalesce(%s, ''), '{S}+', ' ', 'g')))"
_PATIENT = r"nullif(upper(regexp_replace(patient_id, '^\s+|\s+$', '', 'g')), '')"



_NEGATION = "'" + NEGATION.replace("'", "''") + "'"


def _resampled(key: str, value: str, seed: int, repetitions: int) -> str:
    """m(r, mean): resampled means of the rows g, as bootstrap_means draws them."""
    weight = " + ".join(f"(u >= {c})::INT" for c in metrics.POISSON)
    return f"""h AS (SELECT x, block, sha256('{seed}|' || k || '|' || block) AS digest FROM (SELECT {key} AS k, {value} AS x, unnest(range({-(-repetitions // 8)})) AS block FROM g)),
        u AS (SELECT x, block * 8 + i AS r, ('0x' || substr(digest, i * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM h, (SELECT unnest(range(8)) AS i)),
        m AS (SELECT r, sum(w * x) / sum(w) AS mean FROM (SELECT r, x, {weight} AS w FROM u WHERE r < {repetitions}) GROUP BY r HAVING sum(w) > 0)"""


_SAID = f"(SELECT result_id, min(qid) AS qid, min(action_policy) AS action_policy, bool_and(abstained) AS abstained, {_KEY % 'min(answer)'} AS t FROM verifier_results GROUP BY result_id)"

def _numbered(c: str) -> str:
    """The sentences that numbered_sentences gives."""
    guarded = rf"regexp_replace(trim(coalesce({c}, ''), ' '), '\b(\d+)\.\s+', '\1' || chr(1) || ' ', 'g')"
    cut = rf"string_split(regexp_replace(regexp_replace({guarded}, '([.!?])\s+', '\1␟', 'g'), '[\r\n]+|\s*;\s*', '␟', 'g'), '␟')"
    return f"list_filter(list_transform({cut}, lambda s: trim(replace(s, chr(1), '.'), ' ')), lambda s: s <> '')"


def _content(c: str) -> str:
    """The words that content_tokens gives."""
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    stem = "lambda t: CASE " + " ".join(
        f"WHEN length(t) >= {least} AND suffix(t, '{ending}')" + (f" AND NOT suffix(t, '{spared}')" if spared else "") + f" THEN left(t, length(t) - {len(ending)}) || '{instead}'" for ending, least, spared, instead in ENDINGS
    ) + " ELSE t END"
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({stop}, t)), {stem}))"


def _negated(c: str) -> str:
    return f"(regexp_matches({c}, {_NEGATION}) OR regexp_matches({c}, '{NORMALITY}'))"


SQL = {
    "evidence_support": f"""
        WITH one AS (SELECT result_id, min(study_id) AS study_id, arg_min(answer, created_at) AS answer FROM verifier_results GROUP BY result_id),
        rep AS (SELECT study_id, min(concat_ws(' ', findings, impression)) AS report FROM paired_cases GROUP BY study_id),
        s AS (SELECT result_id, study_id, text, pos, {_KEY % 'text'} AS plain, {_content('text')} AS words, {_negated('text')} AS negated
              FROM (SELECT result_id, study_id, unnest(a) AS text, generate_subscripts(a, 1) AS pos FROM (SELECT result_id, study_id, {_numbered('answer')} AS a FROM one JOIN rep USING (study_id)))),
        e AS (SELECT study_id, text, pos, {_KEY % 'text'} AS plain, {_content('text')} AS words, {_negated('text')} AS negated
              FROM (SELECT study_id, unnest(a) AS text, generate_subscripts(a, 1) AS pos FROM (SELECT study_id, {_numbered('report')} AS a FROM rep))),
        x AS (SELECT s.result_id, s.pos, s.text, CASE WHEN len(s.words) > 0 THEN CASE WHEN s.plain <> '' AND contains(e.plain, s.plain) THEN 1.0::DOUBLE ELSE len(list_intersect(s.words, e.words)) / len(s.words) END END AS score,
              e.negated = s.negated AS same, row_number() OVER (PARTITION BY s.result_id, s.pos ORDER BY CASE WHEN s.plain <> '' AND contains(e.plain, s.plain) THEN 1.0::DOUBLE ELSE len(list_intersect(s.words, e.words)) / len(s.words) END DESC, e.pos) AS r
              FROM s LEFT JOIN e USING (study_id)),
        c AS (SELECT result_id, pos, text, coalesce(score, 0) >= 0.65 AND (score IS NULL OR coalesce(same, true)) AS supported FROM x WHERE r = 1)
        SELECT result_id, round(avg(supported::INT), 6) AS support_rate, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (supported), '{evidence.INSUFFICIENT}') AS revised_answer, count(*) FILTER (supported) = 0 AS abstained FROM c GROUP BY result_id""",
    "claim_polarities": f"""
        WITH p AS (SELECT action_policy, list_filter(regexp_split_to_array(t, '[.!?;]+({S}+|$)'), lambda s: s <> '') AS said FROM {_SAID}),
        n AS (SELECT action_policy, len(said) AS k, len(list_filter(said, lambda s: regexp_matches(s, {_NEGATION}))) AS n FROM p)
        SELECT action_policy, CASE WHEN k = 0 THEN 'none' WHEN n = k THEN 'negative' WHEN n = 0 THEN 'positive' ELSE 'mixed' END AS polarity, count(*) AS n_answers FROM n GROUP BY 1, 2""",
    "answer_outcomes": f"""
        WITH r AS (SELECT * FROM {_SAID} JOIN (SELECT qid, bool_and(is_answerable) AS y FROM questions GROUP BY qid) USING (qid)),
        c AS (SELECT action_policy, count(*) FILTER (y AND NOT abstained) AS tp, count(*) FILTER (NOT y AND abstained) AS tn, count(*) FILTER (NOT y AND NOT abstained) AS fp, count(*) FILTER (y AND abstained) AS fn FROM r GROUP BY 1)
        SELECT *, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS answerable_f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS false_answer_rate FROM c""",
    "confusion_by_reason": f"WITH {_CHECKS} SELECT decision_reason, count(*) FILTER (supported) AS supported, count(*) FILTER (NOT supported) AS unsupported FROM checks GROUP BY 1",
    "support_by_threshold": f"""WITH {_CHECKS}, g AS (SELECT unnest([0.3, 0.4, 0.5, 0.55, 0.6, 0.7]::DOUBLE[]) AS threshold)
        SELECT threshold, round(avg((combined_support_score >= threshold)::INT), 6) AS coverage,
               round(coalesce(count(*) FILTER (combined_support_score >= threshold AND supported) / nullif(count(*) FILTER (combined_support_score >= threshold), 0), 0), 6) AS precision FROM checks, g GROUP BY threshold""",
    "cluster_edges": r"""SELECT cluster_id, count(DISTINCT upper(regexp_replace(case_id, '^\s+|\s+$', '', 'g'))) AS n_members, max(exact_text_edges) AS exact_text_edges, max(near_text_edges) AS near_text_edges,
        max(exact_image_edges) AS exact_image_edges FROM duplicate_clusters GROUP BY cluster_id""",
    "evidence_profile": f"""WITH {_CHECKS} SELECT decision_reason, supported, count(*) AS n_sentences, count(DISTINCT sentence) AS n_distinct,
        round(avg(combined_support_score), 6) AS mean_score, max(combined_support_score) AS max_score, sum(length(sentence))::BIGINT AS n_chars FROM checks GROUP BY 1, 2""",
    "verifier_actions": """
        WITH one AS (SELECT check_id, coalesce(arg_min(revised_answer, created_at), '') AS draft, arg_min(sentence_checks, created_at) AS sc FROM evidence_checks GROUP BY check_id),
        p AS (SELECT *, unnest(['sentence_filter', 'contradiction_only', 'audit_only']) AS policy FROM one),
        k AS (SELECT *, list_filter(sc, lambda s: CASE policy WHEN 'sentence_filter' THEN s.supported WHEN 'contradiction_only' THEN s.negation_consistent AND s.contradiction_probability < 0.5 ELSE true END) AS kept FROM p),
        a AS (SELECT *, CASE WHEN policy = 'audit_only' THEN draft WHEN len(kept) = 0 THEN 'The retrieved report evidence is insufficient to answer this question.'
                        ELSE array_to_string(list_transform(kept, lambda s: s.sentence), ' ') END AS answer FROM k)
        SELECT check_id, policy, sha256(answer) AS answer_sha256, len(kept) AS n_accepted, len(sc) - len(kept) AS n_rejected, len(kept) = 0 AS abstained, trim(answer, ' ') <> trim(draft, ' ') AS revised FROM a""",
    "policy_summary": """
        WITH r AS (SELECT result_id, min(action_policy) AS action_policy, bool_and(abstained) AS abstained, bool_and(revised) AS revised, min(len(accepted_sentences)) AS n FROM verifier_results GROUP BY result_id)
        SELECT action_policy, abstained, count(*) AS n_rows, grouping(action_policy, abstained)::INT AS grouping, round(avg(revised::INT), 6) AS revised_rate, median(n)::DOUBLE AS median_accepted
        FROM r GROUP BY CUBE (action_policy, abstained)""",
    "answer_token_f1": """
        WITH a AS (SELECT result_id, min(qid) AS qid, min(answer) AS answer FROM verifier_results GROUP BY result_id),
        q AS (SELECT qid, min(coalesce(reference_answer, '')) AS reference, min(question_type) AS question_type FROM questions GROUP BY qid),
        j AS (SELECT result_id, question_type, regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9]+') AS p, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r FROM a JOIN q USING (qid)),
        s AS (SELECT question_type, p, r, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(r, lambda y: y = t))))), 0) AS c FROM j)
        SELECT question_type, count(*) AS n_rows, round(avg(CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1 WHEN len(p) = 0 OR len(r) = 0 THEN 0 ELSE 2.0::DOUBLE * c / (len(p) + len(r)) END), 6) AS mean_token_f1 FROM s GROUP BY question_type""",
    "calibration": f"""WITH {_CHECKS}, k AS (SELECT entailment_probability AS p, supported::INT AS y FROM checks WHERE entailment_probability IS NOT NULL AND supported IS NOT NULL),
        b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS acc FROM k GROUP BY 1)
        SELECT (SELECT count(*) FROM k) AS n_rows, round((SELECT avg((p - y) ** 2) FROM k), 6) AS brier, round(sum(abs(mp - acc) * n) / sum(n), 6) AS ece FROM b""",
    "reliability_table": f"""WITH {_CHECKS}, k AS (SELECT combined_support_score AS p, supported::INT AS y FROM checks WHERE combined_support_score IS NOT NULL AND supported IS NOT NULL),
        b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS acc FROM k GROUP BY 1)
        SELECT g.bin::INT AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(acc, 6) AS accuracy FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.bin = g.bin""",
    "support_auroc": f"""WITH {_CHECKS}, k AS (SELECT lexical_score AS s, supported AS y FROM checks WHERE lexical_score IS NOT NULL AND supported IS NOT NULL),
        r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM k)
        SELECT count(*) FILTER (y) AS n_positive, count(*) FILTER (NOT y) AS n_negative,
               round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM r""",
    "risk_coverage": f"""WITH {_CHECKS}, o AS (SELECT row_number() OVER w AS position, sum(supported::INT) OVER w AS c, count(*) OVER () AS n FROM checks WHERE combined_support_score IS NOT NULL AND supported IS NOT NULL WINDOW w AS (ORDER BY combined_support_score DESC, check_id, pos))
        SELECT ceil(position * 10 / n)::INT AS decile, max(position) AS position, round(arg_max(1 - c / position, position), 6) AS risk FROM o GROUP BY 1""",
    "support_thresholds": f"""WITH {_CHECKS}, q AS (SELECT qid, min(question_type) AS question_type FROM questions GROUP BY qid),
        k AS (SELECT question_type, entailment_probability AS p, supported::INT AS y FROM checks JOIN q USING (qid) WHERE entailment_probability IS NOT NULL AND supported IS NOT NULL),
        g AS (SELECT round(unnest(range(1, 20)) * 0.05::DOUBLE, 2) AS t),
        f AS (SELECT question_type, t, round(coalesce(2.0::DOUBLE * sum(CASE WHEN p >= t THEN y ELSE 0 END) / nullif(sum((p >= t)::INT) + sum(y), 0), 0), 12) AS f1 FROM k, g GROUP BY 1, 2)
        SELECT question_type, t AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY f1 DESC, t DESC) = 1""",
    "label_f1": """
        WITH one AS (SELECT study_id, arg_min(labels, ingested_at) AS labels FROM paired_cases GROUP BY study_id),
        e AS (SELECT unnest(map_entries(labels)) AS e FROM one WHERE labels IS NOT NULL),
        p AS (SELECT e.key AS label, (e.value = 1.0)::INT AS tp, (e.value NOT IN (0.0, 1.0))::INT AS fp FROM e WHERE e.value <> 0.0),
        s AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, 0::BIGINT AS fn FROM p GROUP BY ROLLUP (label))
        SELECT label, tp, fp, fn, round(2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn), 6) AS f1 FROM s""",
    "holm_adjusted": """
        WITH r AS (SELECT check_id, min(support_rate) AS p FROM evidence_checks WHERE support_rate IS NOT NULL GROUP BY check_id),
        o AS (SELECT check_id, p, row_number() OVER (ORDER BY p, check_id) AS rn, count(*) OVER () AS n FROM r)
        SELECT check_id, round(max(least(1.0::DOUBLE, (n - rn + 1) * p)) OVER (ORDER BY rn), 6) AS holm FROM o""",
    "abstention_intervals": """
        WITH r AS (SELECT result_id, min(action_policy) AS action_policy, bool_and(abstained) AS a FROM verifier_results GROUP BY result_id),
        c AS (SELECT action_policy, count(*) FILTER (a) AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM r GROUP BY 1)
        SELECT action_policy, k AS n_abstained, n AS n_rows,
          round((k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n), 6) AS low,
          round((k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n), 6) AS high FROM c""",
    "support_bootstrap": f"""
        WITH g AS (SELECT qid, avg(support_rate) AS x FROM evidence_checks WHERE support_rate IS NOT NULL AND qid IS NOT NULL GROUP BY qid), {_resampled('qid', 'x', 2026, 1000)}
        SELECT count(*) AS n, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""",
    "score_quantiles": """SELECT route, count(*) AS n_rows, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(stddev_pop(score), 6) AS spread
        FROM scored_cases WHERE score IS NOT NULL AND isfinite(score) GROUP BY route""",
    "bank_audit": f"""
        WITH p AS (SELECT DISTINCT study_id AS s, {_PATIENT} AS p FROM paired_cases), q AS (SELECT DISTINCT s AS q FROM p WHERE substr(s, 3)::BIGINT % 100 = 0),
        same AS (SELECT q, count(DISTINCT b.s) AS n FROM q JOIN p a ON a.s = q JOIN p b ON a.p = b.p AND b.s <> q GROUP BY q)
        SELECT q AS study_id, 1::BIGINT AS n_same_study, coalesce(n, 0) AS n_same_patient, (SELECT count(DISTINCT s) FROM p) - 1 - coalesce(n, 0) AS n_candidates FROM q LEFT JOIN same USING (q)""",
    "patient_partition": f"""
        WITH p AS (SELECT DISTINCT {_PATIENT} AS patient FROM paired_cases), o AS (SELECT patient, (row_number() OVER (ORDER BY sha256('patients|7|' || patient), patient) - 0.5::DOUBLE) / count(*) OVER () AS share FROM p WHERE patient IS NOT NULL)
        SELECT patient, CASE WHEN share < 0.65 THEN 'train' WHEN share < 0.75 THEN 'calibration' WHEN share < 0.85 THEN 'validation' ELSE 'test' END AS partition FROM o""",
    "study_derangement": """
        WITH p AS (SELECT DISTINCT study_id FROM paired_cases), o AS (SELECT study_id, row_number() OVER (ORDER BY sha256('shuffle|11|' || study_id), study_id) - 1 AS pos, count(*) OVER () AS n FROM p)
        SELECT a.study_id, b.study_id AS assigned FROM o a JOIN o b ON b.pos = (a.pos + 1) % a.n""",
    "exact_text_clusters": f"""
        WITH t AS (SELECT DISTINCT study_id, {_KEY % "concat_ws(' ', findings, impression)"} AS t FROM paired_cases),
        c AS (SELECT study_id, coalesce(min(study_id) OVER (PARTITION BY nullif(t, ''), CASE WHEN t = '' THEN study_id END), study_id) AS cluster_id FROM t),
        one AS (SELECT study_id, min(cluster_id) AS cluster_id FROM c GROUP BY study_id)
        SELECT study_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS n_members FROM one""",
    "ambiguous_questions": f"SELECT {_KEY % 'question'} AS question, count(DISTINCT case_id) AS n_cases, count(DISTINCT qid) AS n_questions FROM questions GROUP BY 1 HAVING count(DISTINCT case_id) > 1",
    "latest_answers": "SELECT result_id, qid, study_id, abstained, epoch_us(created_at) AS created_us FROM verifier_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY created_at, loaded_at) = 1",
}
SQL["bank_audit_all"] = SQL["bank_audit"].replace(" WHERE substr(s, 3)::BIGINT % 100 = 0", "")

"""Forms of answers and prompts, compact outputs, bounded selections, fingerprints and poolings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import hashing, text
from caseloom.operators import agent, order, output, selection
from caseloom.operators.cohorts import patient_key
from caseloom.plans.collections import _place
from caseloom.plans.evaluation import _CHECKS, _PATIENT, first_rows, sentence_checks
from caseloom.plans.text import _clean, _tokens
from caseloom.session import table
from caseloom.sources import readers, sinks

WEIGHTS = [round(0.02 * (i % 7) - 0.05, 2) for i in range(64)]  # a fixed attention vector
PREFERENCE = ["audit_only", "contradiction_only", "sentence_filter"]


def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    """The forms in which answers are compared: final answer behind a marker, tokens, the first two complete sentences, report key."""
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", F.concat(F.when(F.col("revised"), F.lit("Notes first.\nFinal answer: - ")).otherwise(F.lit("")), F.coalesce("answer", F.lit(""))).alias("a"))
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return rows.select("result_id", sha(text.final_answer(F.col("a")), "final_sha256"), sha(text.normalized_answer(F.col("a")), "tokens_sha256"), sha(text.bounded_sentences(F.col("a"), 2), "bounded_sha256"), sha(text.report_text_key(F.col("a")), "key_sha256"), text.is_not_answerable(F.col("a")).alias("not_answerable"))


def compact_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as the one-object output of a model, every other one as lines instead, and parsed back."""
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "study_id", "abstained", text.clean_text(F.col("answer")).alias("a")).where("a <> ''")
    mood = F.when(F.col("abstained"), F.lit("high")).otherwise(F.lit("low"))
    json = F.concat(F.lit("Here: "), F.to_json(F.struct(F.col("a").alias("answer"), mood.alias("uncertainty"), F.col("abstained").alias("abstain"), F.array("study_id", F.lit("elsewhere")).alias("evidence"))))
    lines = F.concat(F.lit("answer: "), F.col("a"), F.lit("\nuncertainty: "), mood, F.lit("\nabstain: "), F.col("abstained").cast("string"), F.lit("\nevidence: "), F.col("study_id"))
    even = F.substring("result_id", 3, 20).cast("long") % 2 == 0
    out = output.parse_compact_output(rows.select("result_id", F.when(even, json).otherwise(lines).alias("said"), F.array("study_id").alias("allowed")), "result_id", "said", "allowed")
    return out.select("result_id", "uncertainty", "abstain", F.size("evidence").alias("n_evidence"), "structured_output_valid", "raw_json_valid", "parser_repaired")


def evidence_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt of every question with the accepted sentences of its first answer as numbered evidence."""
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min("question").alias("question"))
    rows = first_rows(spark, d, "verifier_results", "result_id").join(asked, "qid")
    units = F.transform("accepted_sentences", lambda s: F.struct(F.col("study_id").alias("provenance_id"), s.alias("text")))
    return rows.select("result_id", F.sha2(output.evidence_prompt(F.col("question"), F.col("study_id"), units), 256).alias("prompt_sha256"))


def bounded_sentence_picks(spark: SparkSession, d: str) -> DataFrame:
    """At most two accepted sentences within 100 characters, no text twice; the first always fits."""
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", F.filter("accepted_sentences", lambda s: s.isNotNull()).alias("s"))
    return rows.select("result_id", F.size("s").alias("n_given"), F.sha2(agent.evidence_text(agent.bounded_units(F.col("s"), 2, 100)), 256).alias("kept_sha256"))


def patient_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """One fingerprint of the studies of each patient."""
    rows = table(spark, d, "paired_cases").select(patient_key(F.col("patient_id")).alias("patient"), "study_id").where("patient is not null").distinct()
    return rows.groupBy("patient").agg(F.count(F.lit(1)).alias("n_studies"), hashing.fingerprint(F.col("study_id")).alias("studies_sha256"))


def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a case, weighted by attention and scaled to length one: first and last value."""
    ok = lambda c: c.isNotNull() & (F.size(c) == 64) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    rows = table(spark, d, "candidate_vectors").select("case_id", F.explode(F.array("image_embedding", "report_embedding")).alias("v")).where(F.col("case_id").isNotNull() & ok(F.col("v")))
    rows = rows.select("case_id", F.transform("v", lambda x: x.cast("double")).alias("v")).distinct()
    pooled = selection.attention_views(rows, "case_id", "v", WEIGHTS)
    return pooled.select("case_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(63)), 5).alias("last"))


def policy_choice(spark: SparkSession, d: str) -> DataFrame:
    """Mean accepted sentences per policy, and which policy is taken: of those within 0.05 of the best, the first in order of preference."""
    rows = first_rows(spark, d, "verifier_results", "result_id").groupBy("action_policy").agg(F.round(F.avg(F.size("accepted_sentences")), 6).alias("mean_accepted"))
    chosen = selection.policy_within_tolerance(rows, "action_policy", "mean_accepted", 0.05, PREFERENCE)
    return rows.withColumn("chosen", F.col("action_policy") == F.lit(chosen))


def check_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best and mean lexical score of the sentences of a check."""
    out = selection.unit_scores(sentence_checks(spark, d), ["check_id"], "lexical_score")
    return out.select("check_id", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"))


def support_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The lexical score at the 95 % index of the sentences of each decision reason."""
    out = order.nearest_index(sentence_checks(spark, d), "decision_reason", "lexical_score", 0.95)
    return out.select("decision_reason", F.round("lexical_score", 6).alias("p95"))


def case_lines(spark: SparkSession, d: str) -> DataFrame:
    """Reports as case records, one JSON object a line, and read again."""
    path = _place(spark, "cases")
    rows = table(spark, d, "paired_cases").groupBy(F.col("study_id").alias("case_id")).agg(*[F.min(c).alias(c) for c in ("indication", "findings", "impression")])
    sinks.write_json_lines(rows, path)
    return readers.read_cases(spark, path).select("case_id", F.length(F.coalesce("findings", F.lit(""))).alias("n_findings"), F.coalesce(F.size("images"), F.lit(0)).alias("n_images"))


def written_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written by split folder and read again: how many there are, and the sum of their first values."""
    path = _place(spark, "vectors")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 4).cast("int").alias("part"))
    sinks.write_vectors(rows, path, ["part"])
    return spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n_vectors"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 3).alias("sum_first"))


QUERIES = {
    f.__name__: f
    for f in (answer_forms, compact_outputs, evidence_prompts, bounded_sentence_picks, patient_fingerprints, attention_pool, policy_choice, check_scores, support_percentiles, case_lines, written_vectors)
}

_ANSWERS = "r AS (SELECT result_id, min(qid) AS qid, min(study_id) AS study_id, arg_min(answer, created_at) AS answer, bool_and(abstained) AS abstained, bool_and(revised) AS revised, arg_min(accepted_sentences, created_at) AS accepted FROM verifier_results GROUP BY result_id)"
_SENTENCES = f"regexp_extract_all(regexp_replace({_clean('a')}, '([.!?])( |$)', '\\1␟', 'g'), '[^␟]+?[.!?]␟')"
_BOUNDED = f"CASE WHEN len({_SENTENCES}) = 0 THEN {_clean('a')} ELSE array_to_string(list_transform({_SENTENCES}[1:2], lambda s: trim(replace(s, '␟', ''), ' ')), ' ') END"

SQL = {
    "answer_forms": f"""
        WITH {_ANSWERS}, t AS (SELECT result_id, revised, coalesce(answer, '') AS b, CASE WHEN revised THEN 'Notes first.' || chr(10) || 'Final answer: - ' ELSE '' END || coalesce(answer, '') AS a FROM r)
        SELECT result_id, sha256(trim(CASE WHEN revised THEN trim(b, ' ') ELSE b END, ' ')) AS final_sha256, sha256(array_to_string({_tokens('a')}, ' ')) AS tokens_sha256, sha256({_BOUNDED}) AS bounded_sha256,
          sha256(regexp_replace({_clean('a')}, ' +([.,!?;:])', '\\1', 'g')) AS key_sha256, array_to_string({_tokens('a')}, ' ') = 'not answerable' OR starts_with(array_to_string({_tokens('a')}, ' '), 'not answerable ') AS not_answerable FROM t""",
    "compact_outputs": f"""
        WITH {_ANSWERS}, t AS (SELECT result_id, abstained, {_clean('answer')} AS a, substr(result_id, 3)::BIGINT % 2 = 0 AS even FROM r)
        SELECT result_id, CASE WHEN abstained THEN 'high' ELSE 'low' END AS uncertainty, abstained AS abstain, 1 AS n_evidence, false AS structured_output_valid, even AS raw_json_valid, NOT even AS parser_repaired FROM t WHERE a <> ''""",
    "evidence_prompts": f"""
        WITH {_ANSWERS}, q AS (SELECT qid, min(question) AS question FROM questions GROUP BY qid),
        t AS (SELECT result_id, {_clean('question')} AS q, {_clean('study_id')} AS s, list_transform(accepted, lambda x, i: '[' || i || '] ' || study_id || ': ' || {_clean('x')}) AS e FROM r JOIN q USING (qid))
        SELECT result_id, CASE WHEN q <> '' THEN sha256('Indication: ' || s || chr(10) || 'Question: ' || q || chr(10) || 'Evidence:' || chr(10) || CASE WHEN len(e) > 0 THEN array_to_string(e, chr(10)) ELSE 'none' END || chr(10)
          || 'Answer from the evidence only, as JSON with answer, uncertainty, evidence, abstain.') END AS prompt_sha256 FROM t""",
    "bounded_sentence_picks": f"""
        WITH {_ANSWERS}, t AS (SELECT result_id, list_filter(accepted, lambda x: x IS NOT NULL) AS s FROM r),
        u AS (SELECT result_id, s, list_filter(s[2:], lambda x: lower({_clean('x')}) <> lower({_clean('s[1]')}) AND length(s[1]) + 1 + length(x) <= 100)[1] AS second FROM t)
        SELECT result_id, len(s) AS n_given, sha256(coalesce(array_to_string(list_filter([{_clean('s[1]')}, {_clean('second')}], lambda x: x <> ''), chr(10)), '')) AS kept_sha256 FROM u""",
    "patient_fingerprints": f"""
        WITH p AS (SELECT DISTINCT {_PATIENT} AS patient, study_id FROM paired_cases) SELECT patient, count(*) AS n_studies, sha256(string_agg(study_id, chr(10) ORDER BY study_id)) AS studies_sha256 FROM p WHERE patient IS NOT NULL GROUP BY patient""",
    "attention_pool": f"""
        WITH v AS (SELECT case_id, image_embedding AS v FROM candidate_vectors UNION SELECT case_id, report_embedding FROM candidate_vectors),
        k AS (SELECT DISTINCT case_id, v::DOUBLE[] AS v FROM v WHERE case_id IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        u AS (SELECT case_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM k),
        a AS (SELECT case_id, u, exp(list_dot_product(u, {WEIGHTS}::DOUBLE[])) AS e FROM u), b AS (SELECT case_id, u, e / sum(e) OVER (PARTITION BY case_id) AS e FROM a),
        f AS (SELECT case_id, i, sum(e * u[i]) AS x FROM b, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT case_id, sqrt(sum(x * x)) AS n FROM f GROUP BY case_id)
        SELECT case_id, round(max(x / n) FILTER (i = 1), 5) AS first, round(max(x / n) FILTER (i = 64), 5) AS last FROM f JOIN n USING (case_id) GROUP BY case_id""",
    "policy_choice": f"""
        WITH r AS (SELECT result_id, min(action_policy) AS action_policy, min(len(accepted_sentences)) AS n FROM verifier_results GROUP BY result_id), m AS (SELECT action_policy, round(avg(n), 6) AS mean_accepted FROM r GROUP BY 1),
        c AS (SELECT arg_min(action_policy, list_position({PREFERENCE}, action_policy)) AS c FROM m WHERE mean_accepted >= (SELECT max(mean_accepted) FROM m) - 0.05) SELECT action_policy, mean_accepted, action_policy = c AS chosen FROM m, c""",
    "check_scores": f"WITH {_CHECKS} SELECT check_id, round(max(lexical_score), 6) AS max_score, round(avg(lexical_score), 6) AS mean_score FROM checks GROUP BY check_id",
    "support_percentiles": f"""
        WITH {_CHECKS}, l AS (SELECT decision_reason, list_sort(list(lexical_score)) AS s FROM checks WHERE lexical_score IS NOT NULL AND decision_reason IS NOT NULL GROUP BY 1) SELECT decision_reason, round(s[round_even((len(s) - 1) * 0.95::DOUBLE, 0)::INT + 1], 6) AS p95 FROM l""",
    "case_lines": "SELECT study_id AS case_id, length(coalesce(min(findings), '')) AS n_findings, 0 AS n_images FROM paired_cases GROUP BY study_id",
    "written_vectors": "SELECT (vec_id % 4)::INT AS part, count(*) AS n_vectors, round(sum(embedding[1]::DOUBLE), 3) AS sum_first FROM embeddings GROUP BY 1",
}

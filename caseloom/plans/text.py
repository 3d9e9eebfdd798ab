"""Text, chunk and planner queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import hashing, text
from caseloom.operators import chunks, cohorts, evidence
from caseloom.session import table

S = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{S}+', ' ', 'g'))"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _sentences(c: str) -> str:
    cut = rf"string_split(regexp_replace({_clean(c)}, '([.!?])\s+([A-Z0-9])', '\1␟\2', 'g'), '␟')"
    return f"list_filter({cut}, lambda s: s <> '')"


def token_profile(spark: SparkSession, d: str) -> DataFrame:
    t = text.ascii_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.capital_sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def report_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    key = text.normalized_key(F.concat_ws(" ", "findings", "impression"))
    return table(spark, d, "paired_cases").select("study_id", F.sha2(key, 256).alias("report_sha256")).distinct()


def eligible_cases(spark: SparkSession, d: str) -> DataFrame:
    findings, impression = text.clean_text(F.col("findings")), text.clean_text(F.col("impression"))
    kept = (F.size("image_paths") > 0) & (F.length(findings) >= 40) & (F.length(impression) >= 8) & (text.placeholder_ratio(F.col("findings")) <= 0.5)
    return table(spark, d, "paired_cases").where(kept).select("study_id").distinct()


def report_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.section_chunks(table(spark, d, "paired_cases").dropDuplicates(["study_id", "findings", "impression"]), "study_id", ["findings", "impression"]).distinct()


def document_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunks.token_windows(F.col("text"), 64)).alias("window", "text"))
    return rows.select("doc_id", "window", F.sha2("text", 256).alias("window_sha256"))


def packed_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paired_cases").select("study_id", "findings").distinct()
    return rows.select("study_id", F.posexplode(chunks.packed_chunks(F.col("findings"), 64)).alias("chunk", "text"))


def question_intents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "questions").select("qid", evidence.question_intent(F.col("question")).alias("intent"))
    return rows.distinct()


def stable_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paired_cases").select("study_id").distinct()
    return rows.select("study_id", hashing.fold_of(7145, F.col("study_id"), 5).alias("fold"), hashing.stable_index("absent", F.col("study_id"), 12).alias("slot"), F.round(hashing.unit_value("roles", 7, F.col("study_id")), 9).alias("role_value"))


def case_spectrum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paired_cases").select("study_id", cohorts.spectrum(F.col("labels")).alias("spectrum"))
    return rows.groupBy("spectrum").agg(F.countDistinct("study_id").alias("n_studies"))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower({_clean('question')}), '{p}') THEN '{n}'" for n, p in evidence.INTENTS) + " ELSE 'summary' END"

QUERIES = {f.__name__: f for f in (token_profile, document_sentences, report_fingerprints, eligible_cases, report_chunks, document_windows, packed_reports, question_intents, stable_folds, case_spectrum)}

SQL = {
    "token_profile": f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, len(list_distinct({_tokens('text')})) AS n_distinct FROM documents",
    "document_sentences": f"""
        SELECT doc_id, len(s) AS n_sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest
        FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)""",
    "report_fingerprints": f"SELECT DISTINCT study_id, sha256(lower({_clean("concat_ws(' ', findings, impression)")})) AS report_sha256 FROM paired_cases",
    "eligible_cases": f"""
        SELECT DISTINCT study_id FROM paired_cases
        WHERE len(image_paths) > 0 AND length({_clean('findings')}) >= 40 AND length({_clean('impression')}) >= 8
          AND len(list_filter(string_split({_clean('findings')}, ' '), lambda w: contains(upper(w), 'XXXX'))) <= 0.5 * len(string_split({_clean('findings')}, ' '))""",
    "report_chunks": f"""
        WITH parts AS (
          SELECT DISTINCT study_id, 'findings' AS section, {_sentences('findings')} AS s FROM paired_cases
          UNION SELECT DISTINCT study_id, 'impression', {_sentences('impression')} FROM paired_cases),
        rows AS (SELECT study_id, section, unnest(s) AS text, generate_subscripts(s, 1) AS position FROM parts)
        SELECT DISTINCT printf('%s::%s::%03d', study_id, section, position) AS chunk_id, study_id AS case_id, section, position, text FROM rows""",
    "document_windows": f"""
        WITH toks AS (SELECT doc_id, list_filter(string_split({_clean('text')}, ' '), lambda t: t <> '') AS t FROM documents),
        w AS (SELECT doc_id, t, unnest(range(0, len(t), 64)) AS s FROM toks)
        SELECT doc_id, s // 64 AS window, sha256(array_to_string(t[s + 1 : s + 64], ' ')) AS window_sha256 FROM w""",
    "packed_reports": f"""
        WITH RECURSIVE p AS (SELECT DISTINCT study_id, findings, study_id || '|' || coalesce(findings, '') AS rid FROM paired_cases),
        s AS (SELECT rid, study_id, unnest(c) AS s, generate_subscripts(c, 1) AS a FROM (SELECT rid, study_id, {_sentences('findings')} AS c FROM p)),
        t AS (SELECT rid, study_id, a, list_filter(string_split(s, ' '), lambda x: x <> '') AS t FROM s),
        w AS (SELECT rid, study_id, a, b, t[b + 1 : b + 64] AS t FROM (SELECT *, unnest(range(0, len(t), 64)) AS b FROM t)),
        n AS (SELECT rid, study_id, row_number() OVER (PARTITION BY rid ORDER BY a, b) AS i, array_to_string(t, ' ') AS text, len(t) AS k FROM w),
        r AS (SELECT rid, i, 0 AS c, k AS n FROM n WHERE i = 1
          UNION ALL SELECT n.rid, n.i, CASE WHEN r.n + n.k <= 64 THEN r.c ELSE r.c + 1 END, CASE WHEN r.n + n.k <= 64 THEN r.n + n.k ELSE n.k END FROM r JOIN n ON n.rid = r.rid AND n.i = r.i + 1)
        SELECT study_id, c AS chunk, string_agg(text, ' ' ORDER BY i) AS text FROM r JOIN n USING (rid, i) GROUP BY study_id, rid, c""",
    "question_intents": f"SELECT DISTINCT qid, {_INTENT} AS intent FROM questions",
    "stable_folds": """
        WITH ids AS (SELECT DISTINCT study_id, sha256('7145:' || study_id) AS f, sha256(study_id || '|absent') AS a, sha256('roles|7|' || study_id) AS r FROM paired_cases)
        SELECT study_id,
          list_reduce(list_prepend(0, list_transform(range(1, 65), lambda i: ('0x' || substr(f, i, 1))::BIGINT)), lambda x, y: (x * 16 + y) % 5) AS fold,
          ('0x' || substr(a, 1, 8))::BIGINT % 12 AS slot,
          round(('0x' || substr(r, 1, 13))::BIGINT::DOUBLE / 4503599627370496.0, 9) AS role_value
        FROM ids""",
    "case_spectrum": """
        WITH v AS (SELECT study_id, labels, map_values(labels) AS v FROM paired_cases)
        SELECT CASE WHEN labels IS NULL OR len(v) = 0 THEN 'indeterminate'
                    WHEN list_contains(v, 1.0) THEN 'abnormal'
                    WHEN list_contains(v, 0.5) OR list_contains(v, -1.0) THEN 'indeterminate' ELSE 'normal' END AS spectrum,
               count(DISTINCT study_id) AS n_studies
        FROM v GROUP BY 1""",
}

"""The pN_ queries over the test tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import answers, encode, leaks, overlap, reading, splits, top_n, vectors
from caseloom.session import table

LABELS = ["atelectasis", "cardiomegaly", "consolidation", "device", "edema", "effusion", "fracture", "nodule"]
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    best = top_n.top_n_per_group(table(spark, d, "scored_cases"), "qid", "study_id", "score", 5)
    return best.select(F.col("group_key").alias("qid"), F.col("item_key").alias("study_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_studies(table(spark, d, "paired_cases"), table(spark, d, "duplicate_clusters"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_splits(table(spark, d, "paired_cases"), table(spark, d, "duplicate_clusters"), SHARES, LABELS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "verifier_results").select(F.col("result_id").alias("record_id"), "qid", "answer")
    checks = table(spark, d, "evidence_checks").select(F.col("check_id").alias("record_id"), "qid", F.col("revised_answer").alias("answer"))
    return answers.broken_answers(results.unionByName(checks), table(spark, d, "questions"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "paired_cases"), table(spark, d, "study_splits"), table(spark, d, "duplicate_clusters")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("train_study"), F.col("eval_study")
    pairs = overlap.cross_split_pairs(*_sides(spark, d))
    return pairs.select(F.least(a, b).alias("study_id_a"), F.greatest(a, b).alias("study_id_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(*_sides(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    views = {"image": "image_embedding", "report": "report_embedding"}
    near = vectors.most_similar(table(spark, d, "candidate_vectors"), "case_id", views, 5)
    return near.select("view_name", "case_id", "neighbour_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level_no")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    rated = _levels(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rated.groupBy("source", "level_no").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.avg("unfamiliar_share").alias("mean_unfamiliar_share"),
        F.avg("words_per_sentence").alias("mean_words_per_sentence"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_splits, p3_found, p4_found, p4_report, p5_found, p6_ids, p7_found, p8_found, p8_profile)
}

_KEY = r"nullif(upper(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"
# plain words of a report: of the compatible forms, those that the reports hold
_WORDS = r"regexp_extract_all(replace(translate(lower(concat_ws(chr(10), findings, impression)), '０１２３４５６７８９', '0123456789'), 'ﬁ', 'fi'), '[\p{L}\p{N}]+')"
_OVERLAP = f"""
        side AS (SELECT DISTINCT {_KEY.format('study_id')} AS s, lower(trim(split_name)) AS split_name FROM study_splits WHERE lower(trim(split_name)) IN ('train', 'calibration', 'validation', 'test') AND {_KEY.format('study_id')} IS NOT NULL),
        r AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT {_KEY.format('study_id')} AS s, {_WORDS} AS t FROM paired_cases) WHERE len(t) > 0),
        item AS (SELECT rid, w, row_number() OVER (PARTITION BY rid, w) AS nth FROM (SELECT rid, unnest(t) AS w FROM r)),
        a AS (SELECT rid, w, nth FROM item WHERE rid IN (SELECT rid FROM r JOIN side USING (s) WHERE split_name = 'train')),
        b AS (SELECT rid, w, nth FROM item WHERE rid IN (SELECT rid FROM r JOIN side USING (s) WHERE split_name <> 'train')),
        near AS (SELECT x, y FROM (SELECT a.rid AS x, b.rid AS y, count(*) AS n FROM a JOIN b USING (w, nth) GROUP BY 1, 2) JOIN r p ON p.rid = x JOIN r q ON q.rid = y WHERE n / (len(p.t) + len(q.t) - n) >= 0.8),
        listed AS (SELECT DISTINCT cluster_id, {_KEY.format('case_id')} AS s FROM duplicate_clusters WHERE cluster_id IS NOT NULL),
        tied AS (SELECT p.s AS s, q.s AS e FROM near JOIN r p ON p.rid = x JOIN r q ON q.rid = y UNION SELECT p.s, q.s FROM listed p JOIN listed q USING (cluster_id)),
        pair AS (SELECT DISTINCT tied.s AS t, tied.e AS e, f.split_name FROM tied JOIN side o ON o.s = tied.s AND o.split_name = 'train' JOIN side f ON f.s = tied.e AND f.split_name <> 'train' WHERE tied.s <> tied.e)"""

SQL: dict[str, str] = {
    "p4_found": f"WITH {_OVERLAP} SELECT DISTINCT least(t, e) AS study_id_a, greatest(t, e) AS study_id_b FROM pair",
    "p4_report": f"""WITH {_OVERLAP}, source AS (SELECT {_KEY.format('study_id')} AS t, min(source) AS source FROM paired_cases GROUP BY 1)
        SELECT split_name, source, count(*) AS n_pairs, count(DISTINCT t) AS n_train_studies, count(DISTINCT e) AS n_eval_studies FROM pair LEFT JOIN source USING (t) GROUP BY ALL""",
    "p1_found": """
        WITH best AS (
          SELECT qid, study_id, max(score) AS score FROM scored_cases
          WHERE qid IS NOT NULL AND study_id IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY qid, study_id)
        SELECT qid, study_id FROM best
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5""",
    "p2_found": r"""
        WITH RECURSIVE member AS (
          SELECT study_id, 'p' || upper(regexp_replace(patient_id, '^\s+|\s+$', '', 'g')) AS k FROM paired_cases
          WHERE regexp_replace(patient_id, '^\s+|\s+$', '', 'g') <> ''
          UNION
          SELECT upper(regexp_replace(case_id, '^\s+|\s+$', '', 'g')), 'c' || cluster_id FROM duplicate_clusters
          WHERE upper(regexp_replace(case_id, '^\s+|\s+$', '', 'g')) IN (SELECT study_id FROM paired_cases)),
        edge AS (SELECT DISTINCT a.study_id AS a, b.study_id AS b FROM member a JOIN member b ON a.k = b.k AND a.study_id <> b.study_id),
        reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
        SELECT a AS study_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
}

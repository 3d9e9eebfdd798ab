"""Round trips of readers, sinks and streams: given tables written in an outside form into the shared folder, read again and counted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import capital_sentences, clean_text
from caseloom.plans.text import _clean, _sentences
from caseloom.session import checkpoint_root, table
from caseloom.sources import readers
from caseloom.streaming import resume


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def archive_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Findings as a nested question archive, each with one question whose answer is the last sentence; the sentences that overlap the answers."""
    path = _place(spark, "archive")
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min("findings").alias("findings")).select("study_id", clean_text(F.col("findings")).alias("context")).where("context <> ''")
    last = F.element_at(capital_sentences(F.col("context")), -1)
    qa = F.struct(F.concat(F.lit("Q-"), "study_id").alias("id"), F.lit("What is said last?").alias("question"), F.array(F.struct(last.alias("text"), (F.length("context") - F.length(last)).cast("int").alias("answer_start"))).alias("answers"), F.lit(False).alias("is_impossible"))
    paragraph = F.struct(F.concat("study_id", F.lit("_F")).alias("document_id"), "context", F.array(qa).alias("qas"))
    rows.select(F.lit("1").alias("version"), F.array(F.struct(F.col("study_id").alias("title"), F.array(paragraph).alias("paragraphs"))).alias("data")).write.json(path)
    archive = readers.read_archive(spark, path, "train", one_document=False)
    return readers.archive_relevance(archive, readers.archive_chunks(archive))


def view_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Studies rebuilt from one row per view under patient and study folders; unsafe paths drop out."""
    n = F.substring("study_id", 3, 20).cast("long")
    rows = table(spark, d, "paired_cases").select("study_id", "findings", "impression", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("view"), n.alias("n"))
    path = F.format_string("%spatient%d/study%d/view%d.jpg", F.when(F.col("n") % 7 == 0, F.lit("../")).otherwise(F.lit("")), F.col("n") % 200, F.col("n"), F.col("view"))
    found = readers.view_studies(rows.withColumn("path", path), "path", ["findings", "impression"])
    return found.select("study_id", "patient_id", F.size("image_paths").alias("n_views"), F.col("n_findings"), F.col("n_impression"))


def annotation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Entity facts written as entity graphs and turned into facts again."""
    entity = F.filter("radgraph_facts", lambda f: f.isNotNull() & f.startswith("entity|") & (F.size(F.split(f, r"\|")) == 3))
    node = lambda f: F.struct(F.split(f, r"\|")[1].alias("tokens"), F.split(f, r"\|")[2].alias("label"), F.array().cast("array<array<string>>").alias("relations"))
    kept = F.array_distinct(entity)
    graph = F.map_from_arrays(kept, F.transform(kept, node))
    rows = table(spark, d, "paired_cases").where("radgraph_facts is not null").select("study_id", readers.annotation_facts(graph).alias("facts")).distinct()
    return rows.select("study_id", F.size("facts").alias("n_facts"), F.sha2(F.array_join("facts", "\n"), 256).alias("facts_sha256"))


def section_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reports as headed plain text, and their sections again."""
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min("findings").alias("findings"), F.min("impression").alias("impression"))
    text = F.concat(F.lit("EXAMINATION: chest\n FINDINGS: "), F.coalesce("findings", F.lit("")), F.lit("\nIMPRESSION: "), F.coalesce("impression", F.lit("")))
    return rows.select("study_id", readers.report_sections(text).alias("s")).select("study_id", F.sha2("s.findings", 256).alias("findings_sha256"), F.sha2("s.impression", 256).alias("impression_sha256"))


def resumed_append(spark: SparkSession, d: str) -> DataFrame:
    """Answers appended in two runs, the second with rows that the sink already holds: every answer is there once."""
    path = _place(spark, "answers")
    rows = table(spark, d, "verifier_results").select("result_id", "qid", "action_policy", "created_at", "loaded_at")
    order = [F.col("created_at"), F.col("loaded_at")]
    resume.append_once(rows.where("action_policy = 'sentence_filter'"), path, "result_id", order)
    resume.append_once(rows, path, "result_id", order)
    return spark.read.schema(rows.schema).parquet(path).groupBy("action_policy").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("result_id").alias("n_answers"))


def streamed_once(spark: SparkSession, d: str) -> DataFrame:
    """Checks as a file stream that drops rows written again; what its sink holds when all files are read."""
    source, path = _place(spark, "stream"), _place(spark, "streamed")
    rows = table(spark, d, "evidence_checks").select("check_id", "qid", "abstained", "created_at")
    rows.write.parquet(source)
    resume.stream_once(spark, source, rows.schema, path, f"{path}-log", "check_id", "created_at", "3650 days").awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).groupBy("abstained").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("check_id").alias("n_checks"))


QUERIES = {f.__name__: f for f in (archive_round_trip, view_catalogue, annotation_round_trip, section_round_trip, resumed_append, streamed_once)}

SQL = {
    "archive_round_trip": f"""
        WITH r AS (SELECT study_id, {_clean('min(findings)')} AS c FROM paired_cases GROUP BY study_id)
        SELECT 'Q-' || study_id AS qid, printf('%s_F::%03d', study_id, len({_sentences('c')})) AS chunk_id FROM r WHERE c <> ''""",
    "view_catalogue": f"""
        WITH r AS (SELECT substr(study_id, 3)::BIGINT AS n, nullif({_clean('findings')}, '') AS f, nullif({_clean('impression')}, '') AS i FROM paired_cases)
        SELECT 'patient' || n % 200 || '/study' || n AS study_id, 'patient' || n % 200 AS patient_id, 2 AS n_views, count(DISTINCT f) AS n_findings, count(DISTINCT i) AS n_impression FROM r WHERE n % 7 <> 0 GROUP BY n HAVING count(f) > 0 OR count(i) > 0""",
    "annotation_round_trip": f"""
        WITH r AS (SELECT DISTINCT study_id, list_sort(list_distinct(list_transform(list_filter(radgraph_facts, lambda f: f IS NOT NULL AND starts_with(f, 'entity|') AND len(string_split(f, '|')) = 3),
          lambda f: 'entity|' || lower({_clean("string_split(f, '|')[2]")}) || '|' || lower({_clean("string_split(f, '|')[3]")})))) AS facts FROM paired_cases WHERE radgraph_facts IS NOT NULL)
        SELECT study_id, len(facts) AS n_facts, sha256(coalesce(array_to_string(facts, chr(10)), '')) AS facts_sha256 FROM r""",
    "section_round_trip": f"SELECT study_id, sha256({_clean('min(findings)')}) AS findings_sha256, sha256({_clean('min(impression)')}) AS impression_sha256 FROM paired_cases GROUP BY study_id",
    "resumed_append": "WITH r AS (SELECT result_id, min(action_policy) AS action_policy FROM verifier_results GROUP BY result_id) SELECT action_policy, count(*) AS n_rows, count(DISTINCT result_id) AS n_answers FROM r GROUP BY 1",
    "streamed_once": "WITH r AS (SELECT check_id, bool_and(abstained) AS abstained FROM evidence_checks GROUP BY check_id) SELECT abstained, count(*) AS n_rows, count(DISTINCT check_id) AS n_checks FROM r GROUP BY 1",
}

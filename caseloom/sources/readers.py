"""Readers of case collections: report tables, JSON lines, question archives, image catalogues, annotations.

Every reader takes paths that Spark resolves, declares its schema where the format allows and stays
lazy; checks are columns or anti-joins that the caller may assert on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import clean_field, clean_text, normalized_key

CASE_SCHEMA = (
    "case_id string, indication string, comparison string, findings string, impression string, mesh string, "
    "problems string, report_text string, images array<struct<filename:string,projection:string>>"
)
ARCHIVE_SCHEMA = (
    "version string, data array<struct<title:string,paragraphs:array<struct<document_id:string,context:string,"
    "qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>,is_impossible:boolean>>>>>>"
)


def read_table(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """A CSV with a header, plain or gzipped; a byte-order mark is allowed; every column is a string.

    line_breaks allows quoted line breaks; a file is then read by one task, so large tables with such breaks should come in several files.
    """
    df = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def first_of(df: DataFrame, *names: str) -> Column:
    """The first column of these names, in any letter case, that isn't blank; '' if all are."""
    by_name = {c.lower().strip(): c for c in df.columns}
    found = [F.trim(F.col(f"`{by_name[n.lower()]}`")) for n in names if n.lower() in by_name]
    return F.coalesce(*[F.when(c != "", c) for c in found], F.lit("")) if found else F.lit("")


def prefixed_id(raw: Column, prefix: str = "CXR") -> Column:
    """Ids that carry the prefix are upper-cased, others get it; blank stays blank."""
    return F.when(F.upper(raw).startswith(prefix), F.upper(raw)).when(raw != "", F.concat(F.lit(prefix), raw)).otherwise("")


def report_cases(reports: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Cases of CASE_SCHEMA from a report table and a table of views: a case without a view keeps an empty list."""
    fields = {n: first_of(reports, n) for n in ("indication", "comparison", "findings", "impression", "mesh", "problems")}
    cases = reports.select(prefixed_id(first_of(reports, "uid", "id", "case_id")).alias("case_id"), *[c.alias(n) for n, c in fields.items()]).where("case_id <> ''")
    parts = [F.when(F.col(n) != "", F.col(n)) for n in ("indication", "findings", "impression")]
    cases = cases.withColumn("report_text", F.concat_ws("\n", *parts))
    empty = F.array().cast("array<struct<filename:string,projection:string>>")
    if views is None:
        return cases.withColumn("images", empty)
    shown = views.select(
        prefixed_id(first_of(views, "uid", "id", "case_id")).alias("case_id"), first_of(views, "filename", "image", "image_filename").alias("filename"), first_of(views, "projection", "view").alias("projection")
    ).where("case_id <> '' and filename <> ''")
    lists = shown.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("filename", "projection"))).alias("images"))
    return cases.join(lists, "case_id", "left").withColumn("images", F.coalesce("images", empty))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case records, one JSON object a line."""
    return spark.read.schema(CASE_SCHEMA).json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a given schema, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def read_archive(spark: SparkSession, path: str, split: str, one_document: bool = True) -> DataFrame:
    """(document_id, context, qa, split) of a nested question archive: one JSON document a file, or else one a line, which Spark can split."""
    rows = spark.read.option("multiLine", one_document).schema(ARCHIVE_SCHEMA).json(path)
    paragraphs = rows.select(F.explode("data").alias("a")).select(F.explode("a.paragraphs").alias("p"))
    return paragraphs.select("p.document_id", "p.context", F.explode_outer("p.qas").alias("qa"), F.lit(split).alias("split"))


def archive_section(document: Column) -> Column:
    """Suffix _I means impression, _F and _O findings, else report."""
    suffix = F.upper(F.substring_index(document, "_", -1))
    return F.when(suffix == "I", "impression").when(suffix.isin("F", "O"), "findings").otherwise("report")


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end, text>> of sentences with character offsets (end exclusive)."""
    marked = F.regexp_replace(text, r"(?<=[.!?])(\s+)(?=[A-Z0-9])", "\u0001$1")
    pieces = F.split(marked, "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        left = state["at"] + F.length(piece) - F.length(F.ltrim(F.regexp_replace(piece, r"\s", " ")))
        right = state["at"] + F.length(F.rtrim(F.regexp_replace(piece, r"\s", " ")))
        span = F.struct(left.cast("int").alias("start"), right.cast("int").alias("end"), clean_text(piece).alias("text"))
        kept = F.when(left < right, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(piece)).cast("int").alias("at"), kept.alias("spans"))

    return F.aggregate(F.coalesce(pieces, F.array().cast("array<string>")), start, add, lambda s: s["spans"])


def archive_chunks(archive: DataFrame) -> DataFrame:
    """Sentence chunks of the archive's contexts with their offsets."""
    rows = archive.select("document_id", "context", "split").distinct()
    rows = rows.select("document_id", "split", F.posexplode(sentence_spans(F.col("context"))).alias("at", "s"))
    report = F.regexp_replace("document_id", r"(?i)_(?:I|F|O)$", "")
    chunk = F.format_string("%s::%03d", F.col("document_id"), F.col("at") + 1)
    return rows.select(chunk.alias("chunk_id"), report.alias("report_id"), "document_id", archive_section(F.col("document_id")).alias("section"), F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.text").alias("text"), "split")


def archive_relevance(archive: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id): chunks that overlap an answer's span. The range condition is tested within a document only."""
    answers = archive.where("qa is not null").select("document_id", "split", F.col("qa.id").alias("qid"), F.explode("qa.answers").alias("a"))
    spans = answers.select("document_id", "split", "qid", F.col("a.answer_start").alias("s"), (F.col("a.answer_start") + F.length("a.text")).alias("e"))
    hit = spans.join(chunks.select("document_id", "split", "chunk_id", "char_start", "char_end"), ["document_id", "split"])
    return hit.where("s < char_end and e > char_start").select("qid", "chunk_id").distinct()


def report_sections(text: Column) -> Column:
    """struct<findings, impression> of a plain-text report with headed sections; the last section of a name counts."""
    flat = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))

    def last(name: str) -> Column:
        all_ = F.regexp_extract_all(flat, F.lit(rf"(?ims)^\s*{name}\s*:\s*(.*?)(?=^\s*(?:findings|impression)\s*:|\z)"), F.lit(1))
        return F.when(F.size(all_) > 0, clean_text(F.element_at(all_, -1))).otherwise("")

    return F.struct(last("findings").alias("findings"), last("impression").alias("impression"))


def study_of_path(path: Column) -> Column:
    """struct<patient, study, safe> from .../patientN/studyM/...; absolute paths and '..' aren't safe."""
    plain = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    patient, study = F.regexp_extract(plain, r"(?:^|/)(patient\d+)(?:/|$)", 1), F.regexp_extract(plain, r"(?:^|/)(study\d+)(?:/|$)", 1)
    safe = (plain != "") & ~plain.startswith("/") & ~plain.rlike(r"(^|/)\.\.(/|$)") & (patient != "") & (study != "")
    return F.struct(patient.alias("patient"), F.concat_ws("/", patient, study).alias("study"), safe.alias("safe"))


def view_studies(rows: DataFrame, path: str, texts: list[str]) -> DataFrame:
    """Studies from one row per view: paths are listed, texts merged; n_<text> above 1 marks a conflict; studies without any text drop out."""
    keyed = rows.select(study_of_path(F.col(path)).alias("p"), F.col(path).alias("path"), *[clean_field(F.col(t)).alias(t) for t in texts])
    said = [F.max(F.when(F.col(t) != "", F.col(t))).alias(t) for t in texts] + [F.countDistinct(F.when(F.col(t) != "", F.col(t))).alias(f"n_{t}") for t in texts]
    out = keyed.where("p.safe").groupBy(F.col("p.study").alias("study_id"), F.col("p.patient").alias("patient_id")).agg(F.array_sort(F.collect_set("path")).alias("image_paths"), *said)
    return out.where(reduce(lambda a, b: a | b, [F.col(t).isNotNull() for t in texts])).fillna("", texts)


def annotation_facts(entities: Column) -> Column:
    """Facts of an entity graph map<id, struct<tokens,label,relations:array<array<string>>>>: entity|tokens|label, or relation|tokens|label|relation|target tokens.

    A relation whose target is missing gives a null element, for the caller to reject.
    """
    clean = lambda c: normalized_key(c)

    def of(entry: Column) -> Column:
        e = entry["value"]
        alone = F.array(F.concat_ws("|", F.lit("entity"), clean(e["tokens"]), clean(e["label"])))
        linked = F.transform(e["relations"], lambda r: F.when(F.map_contains_key(entities, r[1]), F.concat_ws("|", F.lit("relation"), clean(e["tokens"]), clean(e["label"]), clean(r[0]), clean(entities[r[1]]["tokens"]))))
        return F.when(F.coalesce(F.size(e["relations"]), F.lit(0)) > 0, linked).otherwise(alone)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_entries(entities), of))))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files, and nothing else of them."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, for freeze checks."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))

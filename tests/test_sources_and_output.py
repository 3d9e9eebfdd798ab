import gzip
import json

from pyspark.sql import functions as F

from caseloom.operators import output, relevance
from caseloom.sources import readers, sinks
from caseloom.streaming import resume


def test_report_cases(spark, tmp_path):
    reports = tmp_path / "r.csv.gz"
    with gzip.open(reports, "wt", encoding="utf-8") as f:
        f.write('﻿uid,Indication,findings,Impression,MeSH\n1,cough,"clear\nlungs, both",normal,x\ncxr2,,,,\n,a,b,c,d\n')
    views = tmp_path / "v.csv"
    views.write_text("uid,filename,projection\n1,b.png,Lateral\n1,a.png,Frontal\n9,z.png,Frontal\n2,,Frontal\n")
    cases = readers.report_cases(readers.read_table(spark, str(reports), line_breaks=True), readers.read_table(spark, str(views)))
    got = {r["case_id"]: r for r in cases.collect()}
    assert set(got) == {"CXR1", "CXR2"}
    assert got["CXR1"]["report_text"] == "cough\nclear\nlungs, both\nnormal"
    assert [i["filename"] for i in got["CXR1"]["images"]] == ["a.png", "b.png"] and got["CXR2"]["images"] == [] and got["CXR2"]["comparison"] == ""
    sinks.write_json_lines(cases, str(tmp_path / "cases"))
    again = readers.read_cases(spark, str(tmp_path / "cases"))
    assert sorted(r["case_id"] for r in again.collect()) == ["CXR1", "CXR2"]
    sinks.write_table(cases, str(tmp_path / "table"))
    assert readers.read_table(spark, str(tmp_path / "table"), line_breaks=True).count() == 2
    assert len(json.loads(sinks.to_record(cases).first()["record"])) == len(cases.columns)


def test_archive(spark, tmp_path):
    context = "Lungs are clear. Heart is big.  No effusion."
    qas = [{"id": "q1", "question": "Heart?", "answers": [{"text": "Heart is big", "answer_start": 17}], "is_impossible": False}, {"id": "q2", "question": "?", "answers": [], "is_impossible": True}]
    (tmp_path / "dev.json").write_text(json.dumps({"version": "1", "data": [{"title": "t", "paragraphs": [{"document_id": "7_o", "context": context, "qas": qas}, {"document_id": "7_I", "context": "", "qas": []}]}]}))
    archive = readers.read_archive(spark, str(tmp_path / "dev.json"), "dev")
    chunks = readers.archive_chunks(archive)
    rows = chunks.orderBy("chunk_id").collect()
    assert [(r["char_start"], r["char_end"], r["text"]) for r in rows] == [(0, 16, "Lungs are clear."), (17, 30, "Heart is big."), (32, 44, "No effusion.")]
    assert all(context[r["char_start"] : r["char_end"]] == r["text"] for r in rows)
    assert {(r["report_id"], r["section"]) for r in rows} == {("7", "findings")}
    assert [(r["qid"], r["chunk_id"]) for r in readers.archive_relevance(archive, chunks).collect()] == [("q1", "7_o::002")]


def test_sections_studies_and_facts(spark):
    text = "EXAM: x\nFINDINGS: old\nIMPRESSION:\n Two\n lines\nFindings: new  one"
    row = spark.createDataFrame([(text,)], "t string").select(readers.report_sections(F.col("t")).alias("s")).first()["s"]
    assert (row["findings"], row["impression"]) == ("new one", "Two lines")
    rows = spark.createDataFrame([("a/patient1/study2/v1.jpg", "clear"), ("a\\patient1\\study2\\v2.jpg", "nan"), ("a/patient1/study3/v1.jpg", None), ("/patient9/study1/x.jpg", "x"), ("a/../patient9/study1/x.jpg", "x")], "path string, findings string")
    got = readers.view_studies(rows, "path", ["findings"]).collect()
    assert [(r["study_id"], r["patient_id"], len(r["image_paths"]), r["findings"], r["n_findings"]) for r in got] == [("patient1/study2", "patient1", 2, "clear", 1)]
    schema = "e map<string,struct<tokens:string,label:string,relations:array<array<string>>>>"
    entities = {"1": ("Opacity", "obs-dp", [["located_at", "2"]]), "2": ("Left  lung", "anat", [])}
    facts = spark.createDataFrame([(entities,), ({"1": ("x", "y", [["modify", "9"]])},)], schema).select(readers.annotation_facts(F.col("e")).alias("f")).collect()
    assert facts[0]["f"] == ["entity|left lung|anat", "relation|opacity|obs-dp|located_at|left lung"] and facts[1]["f"] == [None]


def test_files(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("FINDINGS: a")
    assert readers.text_files(spark, str(tmp_path)).first()["text"] == "FINDINGS: a"
    assert len(readers.file_digests(spark, str(tmp_path)).first()["sha256"]) == 64


def test_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x")], "k string, n int, v string")
    path = str(tmp_path / "sink")
    assert resume.append_once(rows, path, "k", [F.col("n")]) == 2
    assert resume.append_once(rows.union(spark.createDataFrame([("c", 1, "y")], rows.schema)), path, "k", [F.col("n")]) == 3
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", "first"), ("b", "x"), ("c", "y")]


def test_stream(spark, tmp_path):
    rows = spark.sql("select * from values ('a', timestamp '2031-01-01 00:00:00'), ('a', timestamp '2031-01-01 00:01:00'), ('b', timestamp '2031-01-01 00:00:30') as t(k, at)")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        resume.stream_once(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "k", "at", "1 hour").awaitTermination(60)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_output_parsing(spark):
    texts = [
        ("ok", 'noise {"answer": "One. Two. Three.", "uncertainty": "Low", "evidence": ["e1"], "abstain": false} tail'),
        ("unknown", '{"answer": "One.", "uncertainty": "low", "evidence": ["e9"]}'),
        ("lines", "Answer: It is clear\nand dry.\nUncertainty: medium\nEvidence: e1\nAbstain: true"),
        ("broken", '{"answer": '),
        ("null", None),
    ]
    rows = spark.createDataFrame([(k, t, ["e1", "e2"]) for k, t in texts], "k string, t string, ok array<string>")
    got = {r["k"]: r for r in output.parse_compact_output(rows, "k", "t", "ok").collect()}
    assert got["ok"]["answer"] == "One. Two." and got["ok"]["structured_output_valid"] and got["ok"]["evidence"] == ["e1"] and got["ok"]["uncertainty"] == "low"
    assert not got["unknown"]["structured_output_valid"] and got["unknown"]["raw_json_valid"] and got["unknown"]["evidence"] == []
    assert got["lines"]["parser_repaired"] and got["lines"]["usable"] and not got["lines"]["structured_output_valid"] and got["lines"]["abstain"] and got["lines"]["uncertainty"] == "medium"
    assert got["lines"]["answer"] == "It is clear and dry."
    assert got["broken"]["answer"] == output.NO_ANSWER and not got["null"]["usable"]


def test_prompt_and_slot(spark):
    rows = spark.createDataFrame([("What?", None, [("p1", "a  b")]), ("", "x", [])], "q string, i string, e array<struct<provenance_id:string,text:string>>")
    got = [r[0] for r in rows.select(output.evidence_prompt(F.col("q"), F.col("i"), F.col("e"))).collect()]
    assert "[1] p1: a b" in got[0] and got[1] is None
    slot = output.model_slot(rows.select("q"), "q", "n", "long", lambda: (lambda texts: texts.str.len()))
    assert sorted(r["n"] for r in slot.collect()) == [0, 5]


def test_relevance(spark):
    facts = ["entity|mild opacity|observation::possible", "entity|left lung|anatomy", "relation|small nodule|observation::definite|located_at|right apex"]
    row = spark.createDataFrame([(facts, None)], "f array<string>, n array<string>").select(relevance.fact_attributes(F.col("f")).alias("a"), relevance.fact_attributes(F.col("n")).alias("b")).first()
    a = {k: sorted(v) for k, v in row["a"].asDict().items()}
    assert a == {"lesion_type": ["mild", "nodule", "opacity", "small"], "anatomy": ["apex", "left", "lung", "right"], "severity": ["mild", "small"], "polarity": ["definite", "possible"], "uncertainty": ["possible"]}
    assert all(v == [] for v in row["b"].asDict().values())
    side = "struct<lesion_type:array<string>,anatomy:array<string>,severity:array<string>,polarity:array<string>,uncertainty:array<string>,indication:array<string>,report_label:array<string>>"
    full, none = (["x"],) * 7, ([],) * 7
    got = relevance.relevance_profile(spark.createDataFrame([(full, full), (none, none)], f"q {side}, c {side}"), "q", "c").collect()
    assert abs(got[0]["qrel_v2"] - 1) < 1e-9 and got[1]["qrel_v2"] == 0.0 and got[1]["qrel_v2_available_normalized"] == 0.0

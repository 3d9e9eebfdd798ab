from caseloom.operators import cohorts
from caseloom.plans import registry

D = "/root/testdata/sf0.001"


def test_bank_audit_of_all_studies(spark):
    rows = [("S1", "p"), ("S1", "r"), ("S2", "P"), ("S2", "r "), ("S3", "p"), ("S4", None), ("S5", "t"), ("S5", "p"), (None, "p")]
    bank = spark.createDataFrame(rows, "s string, p string")
    got = {r["s"]: (r["n_same_patient"], r["n_candidates"]) for r in cohorts.bank_audit(bank, bank, "s", "p").collect()}
    assert got == {"S1": (3, 1), "S2": (3, 1), "S3": (3, 1), "S4": (0, 4), "S5": (3, 1)}
    every = registry.QUERIES["bank_audit_all"](spark, D).collect()
    assert len(every) == spark.read.parquet(f"{D}/paired_cases.parquet").select("study_id").distinct().count()
    assert {tuple(r) for r in registry.QUERIES["bank_audit"](spark, D).collect()} <= {tuple(r) for r in every}


def test_every_scored_pair_is_graded(spark):
    spark.read.parquet(f"{D}/scored_cases.parquet").where("qid is not null and study_id is not null").select("qid", "study_id").distinct().createOrReplaceTempView("pairs")
    spark.read.parquet(f"{D}/questions.parquet").groupBy("qid").agg({"case_id": "min"}).toDF("qid", "case_id").createOrReplaceTempView("targets")
    spark.read.parquet(f"{D}/paired_cases.parquet").createOrReplaceTempView("cases")
    known = "(SELECT study_id FROM cases)"
    want = spark.sql(f"SELECT * FROM pairs JOIN targets USING (qid) WHERE study_id <> case_id AND study_id IN {known} AND case_id IN {known}").count()
    gains = {tuple(r) for r in registry.QUERIES["relevance_gains_all"](spark, D).collect()}
    assert len(gains) == registry.QUERIES["relevance_profiles"](spark, D).count() == want
    five = {tuple(r) for r in registry.QUERIES["relevance_gains"](spark, D).collect()}
    assert five < gains

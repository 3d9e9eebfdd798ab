"""Paired statistics, evidence selection, benchmark building, output contracts, selections, set operations and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import hashing
from caseloom.functions.text import clean_text
from caseloom.operators import benchmarks, cohorts, learning, metrics, order, output, rank, selection, top_texts, units
from caseloom.plans.evaluation import _CHECKS, _resampled, first_rows, sentence_checks
from caseloom.plans.retrieval import _BEST, _LONG, best_scores, case_labels, component_ranks
from caseloom.plans.text import _clean, _sentences, _tokens
from caseloom.session import checkpoint_root, table
from caseloom.sources import readers, sinks

ROLES = {"fit": 0.6, "validate": 0.2, "confirm": 0.2}
TRAIN = "train"


def first_relevant_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank of the first study of each question whose report component reaches 0.5; 0 without one."""
    best = best_scores(spark, d).where("score is not null")
    first = best.where("report >= 0.5").groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "study_id")).getField("study_id").alias("study_id"))
    found = rank.ranks_of(best, first, ["qid"], "study_id", {"rank": F.col("score")})
    rows = best.select("qid").distinct().join(found, "qid", "left")
    return rows.select("qid", F.round(F.coalesce(1.0 / F.col("rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def top_k_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of the ten best studies of each question by text and by image."""
    tops = component_ranks(best_scores(spark, d), 10).where("source in ('bm25', 'image')")
    per_study = tops.groupBy("qid", "study_id").agg(F.count(F.lit(1)).alias("n"))
    return per_study.groupBy("qid").agg(F.round(F.count_if(F.col("n") == 2) / F.count(F.lit(1)), 6).alias("jaccard"))


def policy_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap over questions: accepted sentences under contradiction_only less those under sentence_filter."""
    rows = first_rows(spark, d, "verifier_results", "result_id").where("qid is not null").select("qid", "action_policy", F.size("accepted_sentences").alias("n"))
    mean = lambda p: F.avg(F.when(F.col("action_policy") == p, F.col("n")))
    wide = rows.groupBy("qid").agg(mean("sentence_filter").alias("a"), mean("contradiction_only").alias("b"))
    out = metrics.paired_bootstrap(wide, "qid", "a", "b", 1000, 11)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "p_value")])


def case_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap of whole cases: combined less lexical support score of a sentence, averaged within the case of its question first."""
    case = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("case_id"))
    rows = sentence_checks(spark, d).join(case, "qid").where("case_id is not null")
    wide = rows.groupBy("case_id").agg(F.avg("lexical_score").alias("a"), F.avg("combined_support_score").alias("b"))
    out = metrics.paired_bootstrap(wide, "case_id", "a", "b", 1000, 12)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "p_value")])


def random_control_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap over questions: report component of the best study less the mean of three studies drawn by hash among the other scored ones."""
    best = best_scores(spark, d).where("score is not null")
    top = rank.ranked(best, "qid", "study_id", "score", 1).select("qid", F.col("study_id").alias("top"), F.col("report").alias("b"))
    drawn = best.withColumn("h", F.sha2(F.concat_ws("|", F.lit("control"), "qid", "study_id"), 256))
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("h", "study_id"))).where("r <= 4")  # one more, as the best study may be among them
    others = drawn.join(top, "qid").where("study_id <> top")
    others = others.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("h", "study_id"))).where("k <= 3")
    wide = others.groupBy("qid").agg(F.avg("report").alias("a"), F.max("b").alias("b"))
    out = metrics.paired_bootstrap(wide, "qid", "a", "b", 1000, 13)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "p_value")])


def spectrum_quality(spark: SparkSession, d: str) -> DataFrame:
    """Support decisions by the spectrum of the question's case, and over all: Brier score, precision and recall at 0.5."""
    case = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("study_id"))
    kinds = case_labels(spark, d).select("study_id", cohorts.spectrum(F.col("labels")).alias("spectrum"))
    rows = sentence_checks(spark, d).where("entailment_probability is not null and supported is not null").join(case, "qid").join(kinds, "study_id")
    p, y = F.col("entailment_probability"), F.col("supported")
    sums = rows.rollup("spectrum").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - y.cast("double"), 2)).alias("brier"), F.count_if((p >= 0.5) & y).alias("tp"), F.count_if(p >= 0.5).alias("called"), F.count_if(y).alias("pos"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6)
    return sums.select(F.coalesce("spectrum", F.lit("all")).alias("spectrum"), "n", F.round("brier", 6).alias("brier"), share("tp", "called").alias("precision"), share("tp", "pos").alias("recall"))


def nearest_train_reports(spark: SparkSession, d: str) -> DataFrame:
    """The train report with the highest TF-IDF cosine for every evaluation study whose number is divisible by 100 (the stated query set)."""
    sides = table(spark, d, "study_splits").select("study_id", F.lower(F.trim("split_name")).alias("split_name")).where("split_name is not null").distinct()
    reports = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min(F.concat_ws(" ", "findings", "impression")).alias("report"))
    train = reports.join(sides.where(F.col("split_name") == TRAIN).select("study_id"), "study_id", "left_semi")
    asked = reports.join(sides.where(F.col("split_name") != TRAIN).select("study_id"), "study_id", "left_semi").join(train.select("study_id"), "study_id", "left_anti")
    asked = asked.where(F.substring("study_id", 3, 20).cast("long") % 100 == 0).select(F.col("study_id").alias("eval_study"), "report")
    scores = top_texts.top_tfidf(asked, train, "eval_study", "report", "study_id", "report", 1)
    top = rank.ranked(scores.withColumn("score", F.round("score", 9)), "eval_study", "study_id", "score", 1)
    return top.select("eval_study", F.col("study_id").alias("train_study"), F.round("score", 6).alias("score"))


def answer_key_match(spark: SparkSession, d: str) -> DataFrame:
    """Answers matched one to one with questions by a full outer join: how many are matched, missing, extra or repeated."""
    said = first_rows(spark, d, "verifier_results", "result_id").select("qid")
    asked = table(spark, d, "questions").select("qid").distinct()
    return benchmarks.matched_keys(said, asked, "qid").groupBy("state").agg(F.count(F.lit(1)).alias("n_keys"))


def split_membership(spark: SparkSession, d: str) -> DataFrame:
    """Studies by intersect and except: in cases and splits, in cases alone, in splits alone."""
    cases, placed = table(spark, d, "paired_cases").select("study_id"), table(spark, d, "study_splits").select("study_id")
    parts = {"both": cases.intersect(placed), "cases_only": cases.exceptAll(placed).distinct().join(placed, "study_id", "left_anti"), "splits_only": placed.subtract(cases)}
    out = None
    for name, rows in parts.items():
        part = rows.where("study_id is not null").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n_studies"), F.min("study_id").alias("first_study"))
        out = part if out is None else out.unionByName(part)
    return out


def role_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Studies by the interval of [0, 1) that their hash falls into."""
    ids = table(spark, d, "paired_cases").select("study_id").distinct()
    return ids.select("study_id", benchmarks.role_of(hashing.unit_value("roles", 7, F.col("study_id")), ROLES).alias("role"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "paired_cases").groupBy("study_id").agg(*[F.min(c).alias(c) for c in ("indication", "findings", "impression")], F.max(F.size("image_paths")).alias("n_images"))
    return said.join(case_labels(spark, d).select("study_id", "facts"), "study_id")


def evidence_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentence and fact units of every study, with their fingerprints."""
    rows = units.case_units(_reports(spark, d), "study_id", ["findings", "impression"], "facts")
    return rows.select("provenance_id", "section", "unit_index", F.sha2("text", 256).alias("text_sha256"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").groupBy("qid").agg(F.min(F.struct("question", "case_id")).alias("q")).select("qid", F.col("q.case_id").alias("case_id"), F.col("q.question").alias("query"))


def ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The three best units of each question's own case."""
    found = units.ranked_units(_asked(spark, d), units.case_units(_reports(spark, d), "study_id", ["findings", "impression"], "facts"), 3)
    return found.select("qid", "rank", "provenance_id", F.round("score", 6).alias("score"))


def case_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Two units of each question's own case within 120 characters, no text twice; the first always fits."""
    ranks = units.ranked_units(_asked(spark, d), units.case_units(_reports(spark, d), "study_id", ["findings", "impression"], "facts"))
    found = units.selected_units(ranks, 2, 120)
    return found.select("qid", F.array_join(F.transform("units", lambda u: u["provenance_id"]), ",").alias("units"))


def hierarchical_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Units over the three best scored studies of each question, within budgets per study and in total."""
    top = rank.ranked(best_scores(spark, d).where("score is not null"), "qid", "study_id", "score", 3).select("qid", F.col("study_id").alias("case_id"), "rank")
    asked = top.join(_asked(spark, d).select("qid", "query"), "qid").select("qid", "case_id", "query")
    ranks = units.ranked_units(asked, units.case_units(_reports(spark, d), "study_id", ["findings", "impression"], "facts"))
    found = units.hierarchical_units(ranks, top, 3, 2, 5, 300, 160)
    return found.select("qid", F.size("units").alias("n_units"), F.array_join("case_ids", ",").alias("case_ids"), F.array_join(F.transform("units", lambda u: u["provenance_id"]), ",").alias("units"))


def case_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Three questions of every eligible study, with the chunks that answer them."""
    cases = _reports(spark, d).withColumn("images", F.sequence(F.lit(1), F.greatest("n_images", F.lit(1))))
    kept = cases.where((F.col("n_images") > 0) & benchmarks.eligible(F.col("findings"), F.col("impression"), F.col("images")))
    out = benchmarks.case_questions(kept, "study_id")
    return out.select("qid", "question_type", "question", F.sha2("reference_answer", 256).alias("answer_sha256"), F.array_join("relevant_chunk_ids", ",").alias("relevant_chunk_ids"))


def hard_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """A fact probe and a question about an absent condition for every study."""
    out = benchmarks.hard_questions(_reports(spark, d), "study_id")
    return out.select("qid", "question", "is_answerable", "expected_intent", F.array_join("relevant_chunk_ids", ",").alias("relevant_chunk_ids"))


def replication_cohort(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 studies in hash order that no question asks about yet; the limit is the feature."""
    fresh = table(spark, d, "paired_cases").select("study_id").distinct().join(table(spark, d, "questions").select(F.col("case_id").alias("study_id")), "study_id", "left_anti")
    placed, _ = order.with_positions(fresh.withColumn("h", hashing.order_key("replication", 47, F.col("study_id"))), [F.col("h"), F.col("study_id")])
    return placed.where("position <= 300").select("study_id", "position")


def staged_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Every verifier answer written as the two stages a model would write (fenced, with trailing commas and a foreign id) and parsed back."""
    rows = first_rows(spark, d, "verifier_results", "result_id").select("result_id", "study_id", "answer", "abstained", F.coalesce(F.get("accepted_sentences", F.lit(0)), F.lit("")).alias("said"))
    text = lambda c: F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))) - 6)
    mood = F.when(F.col("abstained"), "HIGH").otherwise(" low ")
    first = F.concat(F.lit('Sure: ```json\n{"a": '), text(F.col("answer")), F.lit(', "u": "'), mood, F.lit('",}\n```'))
    second = F.concat(F.lit('{"s": [{"p": "'), F.col("study_id"), F.lit('", "t": '), text(F.col("said")), F.lit('}, {"p": "elsewhere", "t": "x"},]}'))
    staged = rows.select("result_id", "abstained", first.alias("first"), second.alias("second"), F.array("study_id").alias("allowed"))
    out = output.staged_output(staged, "result_id", "first", "second", "allowed", F.col("abstained"))
    return out.select("result_id", F.when(F.col("answer_stage_valid"), F.sha2("answer", 256)).alias("answer_sha256"), "uncertainty", F.size("historical_support").alias("n_support"), "evidence_abstained", "answer_stage_valid", "support_stage_valid")


def coverage_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The score threshold that keeps half and nine tenths of the sentences, and the one of best precision over four fifths."""
    rows = sentence_checks(spark, d).select("combined_support_score", "supported")
    best = selection.precision_threshold(rows, "combined_support_score", "supported", 0.8)
    got = [("half", selection.threshold_for_coverage(rows, "combined_support_score", 0.5)), ("most", selection.threshold_for_coverage(rows, "combined_support_score", 0.9)), ("precise", best["threshold"])]
    return spark.createDataFrame(got, "name string, threshold double").select("name", F.round("threshold", 9).alias("threshold"))


def pool_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Share of questions whose own case is among the best 1, 5, 20 and 100 studies; and the smallest pool that reaches the target share."""
    best = best_scores(spark, d).where("score is not null")
    target = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("study_id")).where("study_id is not null")
    ranks = target.select("qid").join(rank.ranks_of(best, target, ["qid"], "study_id", {"rank": F.col("score")}).select("qid", "rank"), "qid", "left")
    long = ranks.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pool"), F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)).alias("hit")) for k in (1, 5, 20, 100)])).alias("x")).select("x.*")
    shares = long.groupBy("pool").agg(F.round(F.avg("hit"), 6).alias("share"))
    chosen = selection.smallest_sufficient(long, "pool", "hit", 0.05)
    return shares.join(F.broadcast(chosen.withColumnRenamed("pool", "c"))).select("pool", "share", (F.col("pool") == F.col("c")).alias("chosen"))  # chosen is one row


def pooled_views(spark: SparkSession, d: str) -> DataFrame:
    """Mean direction of the usable vectors of a case: how long it is before scaling, and its first value."""
    ok = lambda c: c.isNotNull() & (F.size(c) == 64) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0)
    rows = table(spark, d, "candidate_vectors").select("case_id", F.explode(F.array("image_embedding", "report_embedding")).alias("v")).where(F.col("case_id").isNotNull() & ok(F.col("v")))
    rows = rows.select("case_id", F.transform("v", lambda x: x.cast("double")).alias("v")).distinct()
    pooled = selection.pooled_views(rows, "case_id", "v")
    return pooled.select("case_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(63)), 5).alias("last"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON lines into the shared folder and read again."""
    path = f"{checkpoint_root(spark)}/questions-{uuid.uuid4().hex}"
    sinks.write_json_lines(table(spark, d, "questions").select("qid", "case_id", "question", "is_answerable"), path)
    back = readers.read_lines(spark, path, "qid string, case_id string, question string, is_answerable boolean")
    return back.groupBy("is_answerable").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("qid").alias("n_questions"), F.sum(F.length("question")).alias("n_chars"))


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Reports written as a table with header into the shared folder and read again as cases."""
    path = f"{checkpoint_root(spark)}/reports-{uuid.uuid4().hex}"
    rows = table(spark, d, "paired_cases").groupBy(F.col("study_id").alias("UID")).agg(F.min("findings").alias("Findings"), F.min("impression").alias("IMPRESSION"), F.min("indication").alias("indication"))
    sinks.write_table(rows, path)
    cases = readers.report_cases(readers.read_table(spark, path, line_breaks=True))
    return cases.select("case_id", F.sha2(clean_text(F.col("findings")), 256).alias("findings_sha256"), F.length(clean_text(F.col("impression"))).alias("n_impression"))


FEATURES = ["bm25", "image"]


def learned_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A pairwise linear ranker fitted on four folds of the questions and judged by nDCG on the fifth, beside its parts. Fitted, so without SQL."""
    best = best_scores(spark, d).withColumn("fold", hashing.fold_of(7145, F.col("qid"), 5))
    data = best.select("qid", "study_id", "fold", F.array(*FEATURES).alias("x"), F.round("report", 9).alias("gain"))
    model = learning.fit_logistic(learning.pair_differences(data.where("fold < 4"), "qid", "study_id", "x", "gain", 0.6, 0.3), "x", "label")
    held = data.where("fold = 4")
    out = None
    for name, score in {"learned": learning.predict(F.col("x"), model), **{c: F.get("x", F.lit(i)) for i, c in enumerate(FEATURES)}}.items():
        scored = held.withColumn("score", F.round(score, 12))
        top = rank.ranked(scored, "qid", "study_id", "score", 10).select("qid", "study_id", "rank")
        part = metrics.ndcg(scored.select("qid", "study_id", "gain").join(top, ["qid", "study_id"], "left"), "qid", "rank", "gain", 10)
        part = part.agg(F.lit(name).alias("system"), F.count(F.lit(1)).alias("n_queries"), F.avg("ndcg").alias("mean_ndcg"))
        out = part if out is None else out.unionByName(part)
    return out


def platt_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and calibration error of the entailment probability before and after Platt scaling, fitted on half of the checks and judged on the other. Fitted, so without SQL."""
    rows = sentence_checks(spark, d).where("entailment_probability is not null and supported is not null").withColumn("half", hashing.fold_of(3, F.col("check_id"), 2))
    model = learning.fit_platt(rows.where("half = 0"), "entailment_probability", "supported")
    held = rows.where("half = 1").withColumn("scaled", learning.apply_platt(F.col("entailment_probability"), model))
    before = metrics.calibration(held, "entailment_probability", "supported").withColumn("name", F.lit("raw"))
    return before.unionByName(metrics.calibration(held, "scaled", "supported").withColumn("name", F.lit("scaled")))


QUERIES = {
    f.__name__: f
    for f in (
        first_relevant_ranks, top_k_overlap, policy_bootstrap, case_bootstrap, random_control_bootstrap, spectrum_quality, nearest_train_reports, answer_key_match, split_membership, role_intervals,
        evidence_units, ranked_evidence, case_evidence, hierarchical_evidence, case_benchmark, hard_benchmark, replication_cohort, staged_outputs, coverage_thresholds, pool_sizes, pooled_views,
        json_round_trip, csv_round_trip, learned_ranking, platt_calibration,
    )
}

_INTERVAL = """o AS (SELECT count(*) AS drawn, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) AS beyond FROM m)
        SELECT (SELECT count(*) FROM g) AS n, (SELECT round(avg(x), 6) FROM g) AS difference, round(low, 6) AS low, round(high, 6) AS high, round(least(1.0::DOUBLE, 2 * (beyond + 1) / (drawn + 1)), 6) AS p_value FROM o"""
_LATEST = """latest AS (SELECT study_id, arg_max(labels, ingested_at) AS labels, arg_max(radgraph_facts, ingested_at) AS facts FROM paired_cases GROUP BY study_id)"""
_UNITS = rf"""said AS (SELECT study_id, min(findings) AS findings, min(impression) AS impression FROM paired_cases GROUP BY study_id),
        lists AS (SELECT study_id, 'findings' AS section, string_split(regexp_replace({_clean('findings')}, '([.!?]) ', '\1␟', 'g'), '␟') AS t FROM said
          UNION ALL SELECT study_id, 'impression', string_split(regexp_replace({_clean('impression')}, '([.!?]) ', '\1␟', 'g'), '␟') FROM said
          UNION ALL SELECT study_id, 'facts', list_sort(list_distinct(list_transform(coalesce(facts, []), lambda f: CASE
            WHEN len(string_split(f, '|')) = 3 AND string_split(f, '|')[1] = 'entity' THEN string_split(f, '|')[2] || ' [' || string_split(f, '|')[3] || ']'
            WHEN len(string_split(f, '|')) = 5 AND string_split(f, '|')[1] = 'relation' THEN string_split(f, '|')[2] || ' [' || string_split(f, '|')[3] || '] ' || string_split(f, '|')[4] || ' ' || string_split(f, '|')[5]
            ELSE f END))) FROM latest),
        unit AS (SELECT study_id AS case_id, section, pos - 1 AS unit_index, text, printf('%s::%s::%04d', study_id, section, pos - 1) AS provenance_id
          FROM (SELECT study_id, section, unnest(t) AS text, generate_subscripts(t, 1) AS pos FROM (SELECT study_id, section, list_filter(t, lambda x: x <> '') AS t FROM lists)))"""
_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
_ASKED_CASES = "asked AS (SELECT qid, x.c AS case_id, x.q AS query FROM (SELECT qid, min(struct_pack(q := question, c := case_id)) AS x FROM questions GROUP BY qid))"
_SCORED = f"""pair AS (SELECT qid, provenance_id, text, query FROM asked JOIN unit USING (case_id)),
        doc AS (SELECT qid, provenance_id, text FROM pair UNION ALL SELECT DISTINCT qid, '', query FROM pair),
        tf AS (SELECT qid, provenance_id, g, count(*) AS tf FROM (SELECT qid, provenance_id, unnest({_GRAMS}) AS g FROM (SELECT qid, provenance_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM doc)) GROUP BY ALL),
        df AS (SELECT qid, g, count(*) AS df, max(tf) FILTER (provenance_id = '') AS qtf FROM tf GROUP BY ALL),
        w AS (SELECT qid, provenance_id, g, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w, coalesce((1 + ln(qtf)) * (ln((1 + n) / (1 + df)) + 1), 0) AS qw FROM tf JOIN df USING (qid, g) JOIN (SELECT qid, count(*) AS n FROM doc GROUP BY qid) USING (qid)),
        dot AS (SELECT qid, provenance_id, sqrt(sum(w * w)) AS norm, sum(w * qw) AS dot FROM w GROUP BY ALL),
        score AS (SELECT p.qid, p.provenance_id, p.text, round(coalesce(d.dot / (d.norm * q.norm), 0), 9) AS score FROM pair p LEFT JOIN dot d USING (qid, provenance_id) LEFT JOIN dot q ON q.qid = p.qid AND q.provenance_id = ''),
        ranks AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, provenance_id) AS rank FROM score)"""
_RANKED = f"{_ASKED_CASES}, {_SCORED}"


def _two(characters: int) -> str:
    """f and s: the first unit of a question, and the first later one of another text within the budget."""
    return f"""f AS (SELECT * FROM ranks WHERE rank = 1),
        s AS (SELECT f.qid, arg_min(r.provenance_id, r.rank) AS second, arg_min(r.text, r.rank) AS text FROM f JOIN ranks r ON r.qid = f.qid AND r.rank > 1 AND lower({_clean('r.text')}) <> lower({_clean('f.text')}) AND length(f.text) + 1 + length(r.text) <= {characters} GROUP BY f.qid)"""


_CHUNKS = "list_transform({s}, lambda x, i: printf('%s::%s::%03d', study_id, '{n}', i))"
_SAID = "said AS (SELECT study_id, min(indication) AS indication, min(findings) AS findings, min(impression) AS impression, max(len(image_paths)) AS n_images FROM paired_cases GROUP BY study_id)"


def _holding(section: str) -> str:
    """Ids of the sentences of a section that hold the probe w."""
    s = _sentences(section)
    return f"list_transform(list_filter(list_zip({s}, range(1, len({s}) + 1)), lambda z: contains(lower(z[1]), w)), lambda z: printf('%s::%s::%03d', study_id, '{section}', z[2]))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


SQL = {
    "first_relevant_ranks": f"""
        WITH {_BEST}, r AS (SELECT qid, report, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank FROM best WHERE score IS NOT NULL)
        SELECT qid, round(coalesce(1.0::DOUBLE / min(rank) FILTER (report >= 0.5), 0), 6) AS reciprocal_rank FROM r GROUP BY qid""",
    "top_k_overlap": f"""
        WITH {_BEST}, {_LONG}, t AS (SELECT qid, study_id, count(*) AS n FROM ranks WHERE source IN ('bm25', 'image') AND rank <= 10 GROUP BY ALL)
        SELECT qid, round(count(*) FILTER (n = 2) / count(*), 6) AS jaccard FROM t GROUP BY qid""",
    "policy_bootstrap": f"""
        WITH r AS (SELECT result_id, min(qid) AS qid, min(action_policy) AS p, min(len(accepted_sentences)) AS n FROM verifier_results GROUP BY result_id),
        g AS (SELECT * FROM (SELECT qid, avg(n) FILTER (p = 'contradiction_only') - avg(n) FILTER (p = 'sentence_filter') AS x FROM r WHERE qid IS NOT NULL GROUP BY qid) WHERE x IS NOT NULL), {_resampled('qid', 'x', 11, 1000)}, {_INTERVAL}""",
    "case_bootstrap": f"""
        WITH {_CHECKS}, c AS (SELECT qid, min(case_id) AS case_id FROM questions GROUP BY qid),
        g AS (SELECT * FROM (SELECT case_id, avg(combined_support_score) - avg(lexical_score) AS x FROM checks JOIN c USING (qid) WHERE case_id IS NOT NULL GROUP BY case_id) WHERE x IS NOT NULL), {_resampled('case_id', 'x', 12, 1000)}, {_INTERVAL}""",
    "random_control_bootstrap": f"""
        WITH {_BEST}, s AS (SELECT * FROM best WHERE score IS NOT NULL),
        top AS (SELECT qid, study_id AS top, report AS b FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) = 1),
        c AS (SELECT qid, report, b FROM s JOIN top USING (qid) WHERE study_id <> top QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sha256('control|' || qid || '|' || study_id), study_id) <= 3),
        g AS (SELECT qid, max(b) - avg(report) AS x FROM c GROUP BY qid), {_resampled('qid', 'x', 13, 1000)}, {_INTERVAL}""",
    "spectrum_quality": f"""
        WITH {_CHECKS}, {_LATEST}, c AS (SELECT qid, min(case_id) AS study_id FROM questions GROUP BY qid),
        k AS (SELECT study_id, CASE WHEN labels IS NULL OR len(map_values(labels)) = 0 THEN 'indeterminate' WHEN list_contains(map_values(labels), 1.0) THEN 'abnormal'
              WHEN list_contains(map_values(labels), 0.5) OR list_contains(map_values(labels), -1.0) THEN 'indeterminate' ELSE 'normal' END AS spectrum FROM latest),
        r AS (SELECT spectrum, entailment_probability AS p, supported AS y FROM checks JOIN c USING (qid) JOIN k USING (study_id) WHERE entailment_probability IS NOT NULL AND supported IS NOT NULL)
        SELECT coalesce(spectrum, 'all') AS spectrum, count(*) AS n, round(avg((p - y::INT) ** 2), 6) AS brier, round(coalesce(count(*) FILTER (p >= 0.5 AND y) / nullif(count(*) FILTER (p >= 0.5), 0), 0), 6) AS precision,
               round(coalesce(count(*) FILTER (p >= 0.5 AND y) / nullif(count(*) FILTER (y), 0), 0), 6) AS recall FROM r GROUP BY ROLLUP (spectrum)""",
    "nearest_train_reports": f"""
        WITH side AS (SELECT DISTINCT study_id, lower(trim(split_name)) AS split_name FROM study_splits WHERE split_name IS NOT NULL),
        rep AS (SELECT study_id, {_tokens("min(concat_ws(' ', findings, impression))")} AS t FROM paired_cases GROUP BY study_id),
        train AS (SELECT * FROM rep WHERE study_id IN (SELECT study_id FROM side WHERE split_name = 'train')),
        ev AS (SELECT * FROM rep WHERE study_id IN (SELECT study_id FROM side WHERE split_name <> 'train') AND study_id NOT IN (SELECT study_id FROM train) AND substr(study_id, 3)::BIGINT % 100 = 0),
        tf AS (SELECT study_id, term, count(*) / dl AS tf FROM (SELECT study_id, len(t) AS dl, unnest(t) AS term FROM train) GROUP BY study_id, term, dl),
        idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, (SELECT count(*) AS n FROM train) GROUP BY term, n),
        w AS (SELECT study_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
        qw AS (SELECT study_id AS e, term, tf * idf AS w FROM (SELECT study_id, term, count(*) / dl AS tf FROM (SELECT study_id, len(t) AS dl, unnest(t) AS term FROM ev) GROUP BY study_id, term, dl) JOIN idf USING (term)),
        nw AS (SELECT study_id, sqrt(sum(w * w)) AS n FROM w GROUP BY study_id), nq AS (SELECT e, sqrt(sum(w * w)) AS n FROM qw GROUP BY e),
        s AS (SELECT e, study_id, round(sum(w.w * qw.w) / (nw.n * nq.n), 9) AS score FROM w JOIN qw USING (term) JOIN nw USING (study_id) JOIN nq USING (e) GROUP BY e, study_id, nw.n, nq.n)
        SELECT e AS eval_study, study_id AS train_study, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY e ORDER BY score DESC, study_id) = 1""",
    "answer_key_match": """
        WITH l AS (SELECT qid, count(*) AS n FROM (SELECT result_id, min(qid) AS qid FROM verifier_results GROUP BY result_id) WHERE qid IS NOT NULL GROUP BY qid), r AS (SELECT DISTINCT qid FROM questions WHERE qid IS NOT NULL)
        SELECT CASE WHEN l.qid IS NULL THEN 'missing' WHEN r.qid IS NULL THEN 'extra' WHEN l.n > 1 THEN 'repeated' ELSE 'matched' END AS state, count(*) AS n_keys FROM l FULL OUTER JOIN r ON l.qid = r.qid GROUP BY 1""",
    "split_membership": """
        WITH b AS (SELECT study_id FROM paired_cases INTERSECT SELECT study_id FROM study_splits), c AS (SELECT study_id FROM paired_cases EXCEPT SELECT study_id FROM study_splits), s AS (SELECT study_id FROM study_splits EXCEPT SELECT study_id FROM paired_cases)
        SELECT 'both' AS part, count(study_id) AS n_studies, min(study_id) AS first_study FROM b UNION ALL SELECT 'cases_only', count(study_id), min(study_id) FROM c UNION ALL SELECT 'splits_only', count(study_id), min(study_id) FROM s""",
    "role_intervals": """
        WITH v AS (SELECT study_id, ('0x' || substr(sha256('roles|7|' || study_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS v FROM (SELECT DISTINCT study_id FROM paired_cases)),
        i AS (SELECT * FROM (VALUES ('fit', 0.0::DOUBLE, 0.6::DOUBLE), ('validate', 0.6, 0.8), ('confirm', 0.8, 1.0)) t(role, low, high))
        SELECT study_id, role FROM v JOIN i ON v >= low AND v < high""",
    "evidence_units": f"WITH {_LATEST}, {_UNITS} SELECT provenance_id, section, unit_index, sha256(text) AS text_sha256 FROM unit",
    "ranked_evidence": f"WITH {_LATEST}, {_UNITS}, {_RANKED} SELECT qid, rank, provenance_id, round(score, 6) AS score FROM ranks WHERE rank <= 3",
    "case_evidence": f"WITH {_LATEST}, {_UNITS}, {_RANKED}, {_two(120)} SELECT f.qid, concat_ws(',', f.provenance_id, second) AS units FROM f LEFT JOIN s USING (qid)",
    "hierarchical_evidence": f"""
        WITH RECURSIVE {_BEST}, {_LATEST}, {_UNITS}, own AS (SELECT qid, min(struct_pack(q := question, c := case_id)) AS x FROM questions GROUP BY qid),
        top AS (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS place FROM best WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 3),
        asked AS (SELECT qid || '#' || place AS qid, study_id AS case_id, x.q AS query FROM top JOIN own USING (qid)), {_SCORED}, {_two(160)},
        flat AS (SELECT string_split(qid, '#')[1] AS q, string_split(qid, '#')[2] AS place, 1 AS u, provenance_id AS p, text FROM f UNION ALL SELECT string_split(qid, '#')[1], string_split(qid, '#')[2], 2, second, text FROM s),
        n AS (SELECT q, p, text, row_number() OVER (PARTITION BY q ORDER BY place, u) AS i FROM flat),
        r AS (SELECT q, i, [p] AS kept, length(text) AS used FROM n WHERE i = 1
          UNION ALL SELECT n.q, n.i, CASE WHEN len(kept) < 5 AND used + length(text) + 1 <= 300 THEN list_append(kept, p) ELSE kept END, CASE WHEN len(kept) < 5 AND used + length(text) + 1 <= 300 THEN used + length(text) + 1 ELSE used END FROM r JOIN n ON n.q = r.q AND n.i = r.i + 1),
        e AS (SELECT q, arg_max(kept, i) AS kept FROM r GROUP BY q), c AS (SELECT q, unnest(kept) AS p, generate_subscripts(kept, 1) AS i FROM e)
        SELECT q AS qid, max(len(kept))::INT AS n_units, (SELECT string_agg(k, ',' ORDER BY i) FROM (SELECT string_split(p, '::')[1] AS k, min(i) AS i FROM c WHERE c.q = e.q GROUP BY 1)) AS case_ids, array_to_string(any_value(kept), ',') AS units FROM e GROUP BY q""",
    "case_benchmark": f"""
        WITH {_SAID}, k AS (SELECT * FROM said WHERE n_images > 0 AND length({_clean('findings')}) >= 40 AND length({_clean('impression')}) >= 8
          AND len(list_filter(string_split({_clean('findings')}, ' '), lambda w: contains(upper(w), 'XXXX'))) <= 0.5 * len(string_split({_clean('findings')}, ' '))),
        q AS (SELECT * FROM (VALUES {", ".join(f"('{n}', '{t}', '{q}', '{s}')" for n, t, q, s in benchmarks.CASE_QUESTIONS)}) t(name, question_type, question, source))
        SELECT study_id || '_' || name AS qid, question_type, question, sha256(CASE source WHEN 'findings' THEN {_clean('findings')} ELSE {_clean('impression')} END) AS answer_sha256,
          array_to_string(CASE source WHEN 'findings' THEN {_CHUNKS.format(s=_sentences('findings'), n='findings')} ELSE {_CHUNKS.format(s=_sentences('impression'), n='impression')} END, ',') AS relevant_chunk_ids FROM k, q""",
    "hard_benchmark": f"""
        WITH {_SAID}, p AS (SELECT *, lower(concat_ws(' ', {_clean('indication')}, {_clean('findings')}, {_clean('impression')})) AS report,
          list_filter(list_transform(regexp_extract_all(concat_ws(' ', {_clean('impression')}, {_clean('findings')}), '{benchmarks.PROBE}'), lambda w: lower(w)), lambda w: NOT list_contains({_list(benchmarks.NO_PROBE_WORDS)}, w)
            AND len(list_filter(list_concat({_sentences('findings')}, {_sentences('impression')}), lambda s: contains(lower(s), w))) > 0)[1] AS w,
          ('0x' || substr(sha256(study_id || '|absent-condition'), 1, 8))::BIGINT % 8 AS start FROM said),
        r AS (SELECT *, CASE WHEN w IS NULL THEN {_CHUNKS.format(s=_sentences('findings'), n='findings')} ELSE list_concat({_holding('findings')}, {_holding('impression')}) END AS rel,
          list_filter(list_transform(range(8), lambda i: {_list(benchmarks.CONDITIONS)}[(start + i) % 8 + 1]), lambda c: NOT contains(report, c))[1] AS absent FROM p)
        SELECT study_id || '_fact_probe' AS qid, 'What does this report state about ' || coalesce(w, '{benchmarks.NO_PROBE}') || '?' AS question, true AS is_answerable, coalesce(string_split(rel[1], '::')[2], 'findings') AS expected_intent, array_to_string(rel, ',') AS relevant_chunk_ids FROM r
        UNION ALL SELECT study_id || '_near_domain_negative', 'What does this report state about ' || coalesce(absent, '{benchmarks.NO_CONDITION}') || '?', false, 'unavailable', '' FROM r""",
    "replication_cohort": """
        SELECT study_id, row_number() OVER (ORDER BY sha256('replication|47|' || study_id), study_id) AS position FROM (SELECT DISTINCT study_id FROM paired_cases WHERE study_id NOT IN (SELECT case_id FROM questions WHERE case_id IS NOT NULL))
        QUALIFY row_number() OVER (ORDER BY sha256('replication|47|' || study_id), study_id) <= 300""",
    "staged_outputs": f"""
        WITH r AS (SELECT result_id, min(study_id) AS study_id, arg_min(answer, created_at) AS answer, bool_and(abstained) AS abstained, arg_min(accepted_sentences, created_at)[1] AS said FROM verifier_results GROUP BY result_id),
        t AS (SELECT *, {_clean('answer')} AS a, CASE WHEN {_clean('said')} <> '' THEN 1 ELSE 0 END AS n FROM r)
        SELECT result_id, CASE WHEN a <> '' THEN sha256(a) END AS answer_sha256, CASE WHEN abstained THEN 'high' ELSE 'low' END AS uncertainty, (CASE WHEN abstained THEN 0 ELSE n END)::INT AS n_support, abstained OR n = 0 AS evidence_abstained, a <> '' AS answer_stage_valid, false AS support_stage_valid FROM t""",
    "coverage_thresholds": f"""
        WITH {_CHECKS}, o AS (SELECT combined_support_score AS t, row_number() OVER (ORDER BY combined_support_score DESC) AS rn, count(*) OVER () AS n FROM checks WHERE combined_support_score IS NOT NULL),
        l AS (SELECT combined_support_score AS t, sum(supported::INT) AS pos, count(*) AS n FROM checks WHERE combined_support_score IS NOT NULL AND supported IS NOT NULL GROUP BY 1),
        c AS (SELECT t, sum(pos) OVER w / sum(n) OVER w AS precision, sum(n) OVER w / sum(n) OVER () AS coverage FROM l WINDOW w AS (ORDER BY t DESC))
        SELECT 'half' AS name, round(max(t), 9) AS threshold FROM o WHERE rn >= ceil(0.5::DOUBLE * n) UNION ALL SELECT 'most', round(max(t), 9) FROM o WHERE rn >= ceil(0.9::DOUBLE * n)
        UNION ALL SELECT 'precise', round(t, 9) FROM (SELECT t FROM c WHERE coverage >= 0.8 ORDER BY precision DESC, t LIMIT 1)""",
    "pool_sizes": f"""
        WITH {_BEST}, r AS (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank FROM best WHERE score IS NOT NULL),
        t AS (SELECT qid, min(case_id) AS study_id FROM questions GROUP BY qid HAVING min(case_id) IS NOT NULL), p AS (SELECT unnest([1, 5, 20, 100])::INT AS pool),
        s AS (SELECT pool, avg(coalesce((rank <= pool)::INT, 0)) AS share FROM t LEFT JOIN r USING (qid, study_id), p GROUP BY pool)
        SELECT pool, round(share, 6) AS share, pool = (SELECT coalesce(min(pool) FILTER (share >= 0.05), max(pool)) FROM s) AS chosen FROM s""",
    "pooled_views": """
        WITH v AS (SELECT case_id, image_embedding AS v FROM candidate_vectors UNION SELECT case_id, report_embedding FROM candidate_vectors),
        k AS (SELECT DISTINCT case_id, v::DOUBLE[] AS v FROM v WHERE case_id IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        u AS (SELECT case_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM k),
        f AS (SELECT case_id, i, avg(u[i]) AS x FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT case_id, sqrt(sum(x * x)) AS n FROM f GROUP BY case_id)
        SELECT case_id, round(max(x / n) FILTER (i = 1), 5) AS first, round(max(x / n) FILTER (i = 64), 5) AS last FROM f JOIN n USING (case_id) GROUP BY case_id""",
    "json_round_trip": "SELECT is_answerable, count(*) AS n_rows, count(DISTINCT qid) AS n_questions, sum(length(question))::BIGINT AS n_chars FROM questions GROUP BY is_answerable",
    "csv_round_trip": f"""
        SELECT 'CXR' || study_id AS case_id, sha256({_clean('min(findings)')}) AS findings_sha256, length({_clean('min(impression)')})::INT AS n_impression FROM paired_cases GROUP BY study_id""",
}

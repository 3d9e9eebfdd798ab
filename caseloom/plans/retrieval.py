"""Search, ranking and fusion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.vectors import label_similarity, label_weights
from caseloom.functions.text import token_set
from caseloom.operators import agent, chunks, evidence, metrics, rank, relevance, search, top_texts
from caseloom.plans.text import _clean, _sentences, _tokens
from caseloom.session import table

COMPONENTS = ["bm25", "image", "report"]
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)


def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: questions whose number is divisible by 100; the smallest text of a qid."""
    rows = table(spark, d, "questions").where(F.substring("qid", 2, 20).cast("long") % 100 == 0)
    return rows.groupBy("qid").agg(F.min("question").alias("question"))


def best_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per question and study: the highest finite score and the highest value of each component."""
    rows = table(spark, d, "scored_cases").where("qid is not null and study_id is not null")
    parts = [F.max(F.coalesce(F.col("component_scores")[c], F.lit(0.0))).alias(c) for c in COMPONENTS]
    return rows.groupBy("qid", "study_id").agg(F.max(rank.finite(F.col("score"))).alias("score"), *parts)


def component_ranks(best: DataFrame, k: int) -> DataFrame:
    """The k best studies of every component and question."""
    long = best.select("qid", "study_id", F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("value")) for c in COMPONENTS])).alias("x"))
    return rank.ranked(long.select("qid", "study_id", "x.source", "x.value"), "qid", "study_id", "value", k, extra=["source"])


def bm25_top_documents(spark: SparkSession, d: str) -> DataFrame:
    asked, docs = asked_questions(spark, d), table(spark, d, "documents")
    scores = top_texts.top_bm25(asked, docs, "qid", "question", "doc_id", "text", 5)
    top = search.top_with_fill(scores, asked, docs, "qid", "doc_id", 5)
    return top.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def tfidf_top_reports(spark: SparkSession, d: str) -> DataFrame:
    asked = asked_questions(spark, d)
    reports = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min(F.concat_ws(" ", "findings", "impression")).alias("report"))
    scores = top_texts.top_tfidf(asked, reports, "qid", "question", "study_id", "report", 5)
    top = rank.ranked(scores.withColumn("score", F.round("score", 9)), "qid", "study_id", "score", 5)
    return top.select("qid", "rank", "study_id", F.round("score", 6).alias("score"))


def scoped_bm25_reports(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min(F.struct("question", "case_id")).alias("q")).select("qid", "q.question", "q.case_id")
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("body")) for s in ("findings", "impression")])
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min("findings").alias("findings"), F.min("impression").alias("impression"))
    rows = rows.select("study_id", F.explode(sections).alias("s")).select(F.concat_ws("::", "study_id", "s.section").alias("chunk_id"), "study_id", "s.body")
    scores = search.bm25_scores(asked, rows, "qid", "question", "chunk_id", "body", scope=("case_id", "study_id"))
    top = rank.ranked(scores.withColumn("score", F.round("score", 9)), "qid", "chunk_id", "score", 1)
    return top.select("qid", "chunk_id", F.round("score", 6).alias("score"))


def dense_top_vectors(spark: SparkSession, d: str) -> DataFrame:
    bank = table(spark, d, "embeddings")
    asked = bank.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = search.dense_top_k(asked, bank, "query_id", "vec_id", "embedding", 5)
    return top.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def ranked_scores(spark: SparkSession, d: str) -> DataFrame:
    best = best_scores(spark, d).where("score is not null")
    return rank.ranked(best, "qid", "study_id", "score", 10).select("qid", "rank", "study_id", F.round("score", 6).alias("score"))


def minmax_components(spark: SparkSession, d: str) -> DataFrame:
    """Mean of every component after min-max scaling within the question. Rows are scaled first, as a scaled mean rounds otherwise at the sixth place."""
    scaled = rank.minmax_scaled(best_scores(spark, d).select("qid", *COMPONENTS), "qid", COMPONENTS, 1e-12)
    return scaled.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in COMPONENTS])


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = rank.reciprocal_rank_fusion(component_ranks(best_scores(spark, d), 100), "qid", "study_id", 100, 10)
    return fused.select("qid", "rank", "study_id", F.round("score", 8).alias("score"))


def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    fused = rank.reciprocal_rank_fusion(component_ranks(best_scores(spark, d), 100), "qid", "study_id", 100, 5, {"bm25": 0.25, "image": 0.75, "report": 0.0})
    return fused.select("qid", "rank", "study_id", F.round("score", 8).alias("score"))


def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = rank.weighted_fusion(best_scores(spark, d), "qid", "study_id", {"bm25": 1.0, "image": 2.0, "report": 1.0})
    top = rank.ranked(fused.withColumn("score", F.round("score", 9)), "qid", "study_id", "score", 5)
    return top.select("qid", "rank", "study_id", F.round("score", 6).alias("score"))


def shortlist_fusion(spark: SparkSession, d: str) -> DataFrame:
    best = best_scores(spark, d).select("qid", "study_id", "bm25", "image")
    fused = rank.shortlist_fusion(best, "qid", "study_id", "bm25", "image", 20, 0.4, 10)
    return fused.select("qid", "rank", "study_id", F.round("score", 6).alias("score"))


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    return rank.top_k_union(component_ranks(best_scores(spark, d), 5), "qid", "study_id", 5)


def adaptive_choices(spark: SparkSession, d: str) -> DataFrame:
    ranks = component_ranks(best_scores(spark, d), 2).where("source in ('bm25', 'image')")
    tops = ranks.where("rank = 1").select("qid", "source", F.col("study_id").alias("top"))
    sides = rank.margins_from_ranks(ranks, "qid", "value", ["source"]).join(tops, ["qid", "source"])
    base = sides.where("source = 'bm25'").select("qid", F.col("top").alias("bt"), F.col("margin").alias("bm"), F.col("top_score").alias("bs"))
    other = sides.where("source = 'image'").select("qid", F.col("top").alias("ot"), F.col("margin").alias("om"))
    c = evidence.adaptive_choice(F.col("bt"), F.col("bm"), F.col("bs"), F.col("ot"), F.col("om"), 0.02, 0.01, 0.3)
    return base.join(other, "qid").select("qid", c.alias("choice"), F.round("bm", 6).alias("base_margin"), F.round("om", 6).alias("other_margin"))


def route_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "scored_cases").where("qid is not null and study_id is not null and route is not null")
    best = rows.groupBy("route", "qid", "study_id").agg(F.max(rank.finite(F.col("score"))).alias("score")).where("score is not null")
    qrels = table(spark, d, "questions").select("qid", F.col("case_id").alias("study_id")).where("study_id is not null")
    ranks = rank.ranks_of(best, qrels, ["route", "qid"], "study_id", {"rank": F.col("score")})
    routes = rows.select("route").distinct()
    m = metrics.retrieval_metrics(ranks, qrels, "qid", "study_id", routes)
    return m.select("route", "n_queries", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("route", "n_queries")])


def graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    best = best_scores(spark, d).where("score is not null")
    labels = table(spark, d, "paired_cases").groupBy("study_id").agg(F.max(F.struct("ingested_at", F.to_json("labels").alias("j"))).alias("x"))
    labels = labels.select("study_id", label_weights(F.from_json(F.coalesce("x.j", F.lit("{}")), "map<string,double>")).alias("w"))
    target = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("case_id"))
    top = rank.ranked(best, "qid", "study_id", "score", 10).select("qid", "study_id", "rank")
    rows = best.select("qid", "study_id").join(top, ["qid", "study_id"], "left").join(labels, "study_id").join(target, "qid")
    rows = rows.join(labels.select(F.col("study_id").alias("case_id"), F.col("w").alias("qw")), "case_id")
    gains = rows.select("qid", "rank", F.round(label_similarity(F.col("qw"), F.col("w")), 9).alias("gain"))
    return metrics.ndcg(gains, "qid", "rank", "gain", 10).select("qid", F.round("ndcg", 6).alias("ndcg"))


def case_labels(spark: SparkSession, d: str) -> DataFrame:
    """(study_id, labels, facts) of the latest row of each study; maps travel as JSON, which can be compared."""
    x = F.max(F.struct("ingested_at", F.to_json("labels").alias("j"), F.array_sort(F.array_distinct("radgraph_facts")).alias("facts"))).alias("x")
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(x)
    return rows.select("study_id", F.from_json(F.coalesce("x.j", F.lit("{}")), "map<string,double>").alias("labels"), F.coalesce("x.facts", F.array().cast("array<string>")).alias("facts"))


def _best_five(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(best_scores(spark, d).where("score is not null"), "qid", "study_id", "score", 5).select("qid", "study_id")


def _every_pair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_cases").where("qid is not null and study_id is not null").select("qid", "study_id").distinct()


def _gains(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    target = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("case_id"))
    cases = case_labels(spark, d)
    own = cases.select(F.col("study_id").alias("case_id"), F.col("labels").alias("ql"), F.col("facts").alias("qf"))
    rows = pairs.join(target, "qid").join(own, "case_id").join(cases, "study_id").where("case_id <> study_id")
    return rows.select("qid", "study_id", F.round(relevance.report_gain(F.col("ql"), F.col("labels"), F.col("qf"), F.col("facts")), 6).alias("gain"))


def _profiles(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    target = table(spark, d, "questions").groupBy("qid").agg(F.min("case_id").alias("case_id"))
    said = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min("indication").alias("indication"))
    facts = case_labels(spark, d).join(said, "study_id").withColumn("a", relevance.fact_attributes(F.col("facts")))
    side = facts.select("study_id", F.struct("a.*", token_set(F.col("indication")).alias("indication"), F.map_keys(label_weights(F.col("labels"))).alias("report_label")).alias("side"))
    rows = pairs.join(target, "qid").where("case_id <> study_id")
    rows = rows.join(side.withColumnRenamed("side", "c"), "study_id").join(side.select(F.col("study_id").alias("case_id"), F.col("side").alias("q")), "case_id")
    out = relevance.relevance_profile(rows, "q", "c")
    return out.select("qid", "study_id", F.round("qrel_v2", 6).alias("qrel_v2"), F.round("qrel_v2_available_normalized", 6).alias("normalized"))


def relevance_gains(spark: SparkSession, d: str) -> DataFrame:
    """Graded relevance of the five best studies of each question to the question's own case, as the SQL asks."""
    return _gains(spark, d, _best_five(spark, d))


def relevance_gains_all(spark: SparkSession, d: str) -> DataFrame:
    """Graded relevance of every scored study of each question."""
    return _gains(spark, d, _every_pair(spark, d))


def relevance_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Component profile of every scored study of each question; it has no SQL that would ask for five."""
    return _profiles(spark, d, _every_pair(spark, d))


def list_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of each question's ranked list; agreement is the share of components whose best study is the list's."""
    best = best_scores(spark, d).where("score is not null")
    ranks = rank.ranked(best, "qid", "study_id", "score", 2)
    low = best.groupBy("qid").agg(F.min("score").alias("low"))
    sums = ranks.groupBy("qid").agg(F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.max(F.when(F.col("rank") == 1, F.col("study_id"))).alias("best")).join(low, "qid")
    tops = component_ranks(best, 1).join(sums.select("qid", "best"), "qid").groupBy("qid").agg(F.avg((F.col("study_id") == F.col("best")).cast("double")).alias("agreement"))
    c = relevance.retrieval_confidence(F.col("top"), F.coalesce("second", F.lit(0.0)), F.col("low"), F.col("agreement"), F.lit(0.0), F.lit(0.0))
    return sums.join(tops, "qid").select("qid", F.round(c, 6).alias("confidence"))


def alpha_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank of the question's case for weights of text against image; one pass scores all weights."""
    scaled = rank.minmax_scaled(best_scores(spark, d).select("qid", "study_id", "bm25", "image"), "qid", ["bm25", "image"], 1e-12)
    target = table(spark, d, "questions").select("qid", F.col("case_id").alias("study_id")).where("study_id is not null")
    scores = {f"a{i}": F.round(F.lit(w) * F.col("bm25") + F.lit(1 - w) * F.col("image"), 9) for i, w in enumerate(ALPHAS)}
    found = rank.ranks_of(scaled, target, ["qid"], "study_id", scores)
    firsts = found.groupBy("qid").agg(*[F.min(n).alias(n) for n in scores])
    long = firsts.select(F.explode(F.array(*[F.struct(F.lit(w).alias("alpha"), F.col(f"a{i}").alias("first")) for i, w in enumerate(ALPHAS)])).alias("x")).select("x.*")
    return long.groupBy("alpha").agg(F.count(F.lit(1)).alias("n_found"), F.round(F.sum(1.0 / F.col("first")), 6).alias("sum_rr"))


def closed_loop_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every question through the closed loop over the sentence chunks of its case."""
    asked = table(spark, d, "questions").groupBy("qid").agg(F.min(F.struct("question", "case_id")).alias("q")).select("qid", "q.question", "q.case_id")
    rows = table(spark, d, "paired_cases").groupBy("study_id").agg(F.min("findings").alias("findings"), F.min("impression").alias("impression"))
    out = agent.closed_loop(asked, chunks.section_chunks(rows, "study_id", ["findings", "impression"]))
    return out.withColumn("answer_probability", F.round("answer_probability", 6)).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


QUERIES = {
    f.__name__: f
    for f in (closed_loop_answers, relevance_gains, relevance_gains_all, relevance_profiles, list_confidence, alpha_sweep, bm25_top_documents, tfidf_top_reports, scoped_bm25_reports, dense_top_vectors, ranked_scores, minmax_components, rrf_fusion, weighted_rrf, weighted_fusion, shortlist_fusion, candidate_union, adaptive_choices, route_metrics, graded_ndcg)
}

_ASKED = "asked AS (SELECT qid, min(question) AS question FROM questions WHERE substr(qid, 2)::BIGINT % 100 = 0 GROUP BY qid)"
_BEST = """best AS (
  SELECT qid, study_id, max(CASE WHEN isfinite(score) THEN score END) AS score, max(coalesce(component_scores['bm25'], 0)) AS bm25,
         max(coalesce(component_scores['image'], 0)) AS image, max(coalesce(component_scores['report'], 0)) AS report
  FROM scored_cases WHERE qid IS NOT NULL AND study_id IS NOT NULL GROUP BY qid, study_id)"""
_LONG = """long AS (SELECT qid, study_id, 'bm25' AS source, bm25 AS value FROM best UNION ALL SELECT qid, study_id, 'image', image FROM best
  UNION ALL SELECT qid, study_id, 'report', report FROM best),
ranks AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY value DESC, study_id) AS rank FROM long)"""


def _mm(c: str) -> str:
    over = "OVER (PARTITION BY qid)"
    return f"CASE WHEN max({c}) {over} - min({c}) {over} > 1e-12 THEN ({c} - min({c}) {over}) / (max({c}) {over} - min({c}) {over}) ELSE 0 END"


def _bm25(rows: str, key: str, text: str, scope: str = "") -> str:
    join = f" AND a.{scope.split('=')[0]} = p.{scope.split('=')[1]}" if scope else ""
    also = f", {scope.split('=')[1]}" if scope else ""
    ask = f", {scope.split('=')[0]}" if scope else ""
    return f"""
        toks AS (SELECT {key}{also}, {_tokens(text)} AS t FROM {rows}),
        size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
        post AS (SELECT {key}{also}, dl, term, count(*) AS tf FROM (SELECT {key}{also}, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
        idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, size GROUP BY term, n),
        q AS (SELECT qid{ask}, term, count(*) AS qtf FROM (SELECT qid{ask}, unnest({_tokens('question')}) AS term FROM asked) GROUP BY ALL),
        scores AS (SELECT a.qid, p.{key}, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
                   FROM q a JOIN idf USING (term) JOIN post p ON p.term = a.term{join}, size GROUP BY ALL)"""


_CASES = """cases AS (
  SELECT study_id, map_entries(arg_max(labels, ingested_at)) AS labels, list_distinct(arg_max(radgraph_facts, ingested_at)) AS facts FROM paired_cases GROUP BY study_id),
w AS (SELECT study_id, facts, list_transform(list_filter(coalesce(labels, []), lambda e: e.value IN (1.0, 0.5, -1.0)), lambda e: struct_pack(k := e.key, v := CASE WHEN e.value = 1.0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)) AS l FROM cases)"""



def _attributes() -> str:
    """The word sets that fact_attributes gives, of column f: lists of the parts of each fact."""
    family, status = "string_split(p[{0}], '::')[1]", "CASE WHEN contains(p[{0}], '::') THEN substr(p[{0}], strpos(p[{0}], '::') + 2) END"
    words = lambda rows, pick: f"flatten(list_transform(list_filter(f, lambda p: {rows}), lambda p: regexp_extract_all({pick}, '[a-z0-9]+')))"
    entity, relation = "p[1] = 'entity' AND len(p) >= 3", "p[1] = 'relation' AND len(p) >= 5"
    severe = "[" + ", ".join(f"'{w}'" for w in relevance.SEVERITY) + "]"
    doubt = "[" + ", ".join(f"'{w}'" for w in relevance.UNCERTAINTY) + "]"
    lesion = f"list_distinct(list_concat({words(f'{entity} AND {family.format(3)} <> ' + chr(39) + 'anatomy' + chr(39), 'p[2]')}, {words(f'{relation} AND contains(p[3], ' + chr(39) + 'observation' + chr(39) + ')', 'p[2]')}))"
    anatomy = f"list_distinct(list_concat({words(f'{entity} AND {family.format(3)} = ' + chr(39) + 'anatomy' + chr(39), 'p[2]')}, {words(relation + ' AND p[4] IN (' + chr(39) + 'located_at' + chr(39) + ', ' + chr(39) + 'modify' + chr(39) + ')', 'p[5]')}))"
    severity = f"list_distinct(list_filter(list_concat({words(entity, 'p[2]')}, {words(relation, 'p[2]')}), lambda w: list_contains({severe}, w)))"
    states = f"list_distinct(list_filter(list_transform(list_filter(f, lambda p: ({entity}) OR ({relation})), lambda p: {status.format(3)}), lambda s: s IS NOT NULL AND s <> ''))"
    return f"{lesion} AS lesion_type, {anatomy} AS anatomy, {severity} AS severity, {states} AS polarity, list_filter({states}, lambda s: list_contains({doubt}, s)) AS uncertainty"


def _set_f1(n: str) -> str:
    return f"CASE WHEN len(q.{n}) = 0 OR len(c.{n}) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(q.{n}, c.{n})) / (len(q.{n}) + len(c.{n})) END"



def _pass(q: str, n: int) -> str:
    """One retrieval pass over the questions q (qid, case_id, query, section, credit): pass<n> has qid, hits and score."""
    return f"""
        qt{n} AS (SELECT qid, case_id, term, count(*) AS qtf FROM (SELECT qid, case_id, unnest({_tokens('query')}) AS term FROM {q}) GROUP BY ALL),
        bm{n} AS (SELECT qid, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM qt{n} JOIN idf USING (term) JOIN post USING (case_id, term), size GROUP BY ALL),
        sc{n} AS (SELECT q.qid, c.chunk_id, c.text, round(coalesce(b.s, 0), 9) AS score FROM {q} q JOIN chunk c ON c.case_id = q.case_id AND (q.section IS NULL OR q.section = c.section) LEFT JOIN bm{n} b ON b.qid = q.qid AND b.chunk_id = c.chunk_id),
        hit{n} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc{n} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) <= 3),
        list{n} AS (SELECT qid, max(score) AS top, list(struct_pack(chunk_id := chunk_id, text := text) ORDER BY rank) AS hits FROM hit{n} GROUP BY qid),
        pass{n} AS (SELECT q.qid, coalesce(hits, []) AS hits, CASE WHEN hits IS NULL THEN 0 ELSE least({agent.CEILING}::DOUBLE, credit + {agent.LEVEL}::DOUBLE * CASE WHEN top > 0 THEN top / (top + {agent.HALF}::DOUBLE) ELSE 0 END
          + {agent.OVERLAP}::DOUBLE * coalesce(len(list_intersect(list_distinct({_tokens('query')}), {_tokens("array_to_string(list_transform(hits, lambda h: h.text), ' ')")})) / nullif(len(list_distinct({_tokens('query')})), 0), 0)) END AS score FROM {q} q LEFT JOIN list{n} USING (qid))"""


_CUED = " ".join(f"WHEN len(list_filter([{', '.join(repr(c) for c in cues)}], lambda c: contains(lower({_clean('question')}), c))) > 0 THEN '{name}'" for name, cues in (("unavailable", agent.OUT_OF_SCOPE), ("impression", agent.IMPRESSION_CUES), ("findings", agent.FINDINGS_CUES)))

SQL = {
    "closed_loop_answers": f"""
        WITH base AS (SELECT study_id, min(findings) AS findings, min(impression) AS impression FROM paired_cases GROUP BY study_id),
        parts AS (SELECT study_id, 'findings' AS section, {_sentences('findings')} AS s FROM base UNION ALL SELECT study_id, 'impression', {_sentences('impression')} FROM base),
        chunk AS (SELECT printf('%s::%s::%03d', study_id, section, pos) AS chunk_id, study_id AS case_id, section, text FROM (SELECT study_id, section, unnest(s) AS text, generate_subscripts(s, 1) AS pos FROM parts)),
        toks AS (SELECT chunk_id, case_id, {_tokens('text')} AS t FROM chunk), size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
        post AS (SELECT chunk_id, case_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, case_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
        idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, size GROUP BY term, n),
        plan AS (SELECT *, CASE {_CUED} ELSE 'unknown' END AS intent FROM (SELECT qid, coalesce(x.q, '') AS question, x.c AS case_id FROM (SELECT qid, min(struct_pack(q := question, c := case_id)) AS x FROM questions GROUP BY qid))),
        q1 AS (SELECT qid, case_id, question AS query, CASE WHEN intent <> 'unknown' THEN intent END AS section, CASE WHEN intent <> 'unknown' THEN {agent.ROUTED}::DOUBLE ELSE {agent.OPEN}::DOUBLE END AS credit FROM plan WHERE intent <> 'unavailable'),
        {_pass('q1', 1)},
        q2 AS (SELECT qid, case_id, question || CASE WHEN contains(lower(question), 'summar') THEN ' final radiology impression conclusion' ELSE ' radiographic findings impression' END AS query,
          CASE WHEN contains(lower(question), 'summar') THEN 'impression' ELSE 'findings' END AS section, CASE WHEN contains(lower(question), 'summar') THEN {agent.ROUTED}::DOUBLE ELSE {agent.OPEN}::DOUBLE END AS credit
          FROM plan JOIN pass1 USING (qid) WHERE score < 0.5),
        {_pass('q2', 2)},
        r AS (SELECT p.qid, intent, q2.section AS again, a.score AS s1, b.score AS s2, list_concat(coalesce(a.hits, []), list_filter(coalesce(b.hits, []), lambda h: NOT list_contains(coalesce(a.hits, []), h))) AS hits,
          CASE WHEN intent = 'unavailable' THEN {agent.UNAVAILABLE}::DOUBLE ELSE greatest(a.score, coalesce(b.score, 0)) END AS sure FROM plan p LEFT JOIN pass1 a USING (qid) LEFT JOIN pass2 b USING (qid) LEFT JOIN q2 USING (qid))
        SELECT qid, intent AS planned_intent, coalesce(again, intent) AS final_intent, round(sure, 6) AS answer_probability, CASE WHEN sure >= 0.5 THEN 'ANSWER' ELSE 'ABSTAIN' END AS action,
          CASE WHEN sure >= 0.5 THEN array_to_string(list_transform(hits, lambda h: h.text), ' ') ELSE '{agent.NOT_ANSWERABLE}' END AS answer, array_to_string(list_transform(hits, lambda h: h.chunk_id), ',') AS chunk_ids,
          CASE WHEN s1 IS NULL THEN 0 WHEN s2 IS NULL THEN 1 ELSE 2 END AS retrieval_calls FROM r""",
    "relevance_profiles": f"""
        WITH {_CASES}, said AS (SELECT study_id, min(indication) AS indication FROM paired_cases GROUP BY study_id),
        parts AS (SELECT w.study_id, l, indication, list_transform(coalesce(facts, []), lambda x: list_transform(string_split(x, '|'), lambda y: lower({_clean('y')}))) AS f FROM w JOIN said USING (study_id)),
        side AS (SELECT study_id, {_attributes()}, list_distinct({_tokens('indication')}) AS indication, list_transform(l, lambda e: e.k) AS report_label FROM parts),
        pairs AS (SELECT DISTINCT qid, study_id FROM scored_cases WHERE qid IS NOT NULL AND study_id IS NOT NULL), t AS (SELECT qid, min(case_id) AS case_id FROM questions GROUP BY qid),
        r AS (SELECT qid, c.study_id, {" + ".join(f"{v}::DOUBLE * ({_set_f1(n)})" for n, v in relevance.WEIGHTS.items())} AS score, {" + ".join(f"CASE WHEN len(q.{n}) > 0 AND len(c.{n}) > 0 THEN {v}::DOUBLE ELSE 0 END" for n, v in relevance.WEIGHTS.items())} AS available
          FROM pairs JOIN t USING (qid) JOIN side c ON c.study_id = pairs.study_id JOIN side q ON q.study_id = t.case_id WHERE t.case_id <> pairs.study_id)
        SELECT qid, study_id, round(least(1, score), 6) AS qrel_v2, round(CASE WHEN available > 0 THEN least(1, least(1, score) / available) ELSE 0 END, 6) AS normalized FROM r""",
    "relevance_gains": f"""
        WITH {_BEST}, {_CASES}, top AS (SELECT qid, study_id FROM best WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5),
        t AS (SELECT qid, min(case_id) AS case_id FROM questions GROUP BY qid),
        j AS (SELECT qid, c.study_id, q.l AS ql, c.l AS cl, coalesce(q.facts, []) AS qf, coalesce(c.facts, []) AS cf FROM top JOIN t USING (qid) JOIN w q ON q.study_id = t.case_id JOIN w c ON c.study_id = top.study_id WHERE t.case_id <> top.study_id),
        s AS (SELECT *, coalesce(list_sum(list_transform(ql, lambda a: coalesce(list_sum(list_transform(list_filter(cl, lambda b: b.k = a.k), lambda b: least(a.v, b.v))), 0))), 0) AS lo,
                     coalesce(list_sum(list_transform(ql, lambda a: a.v)), 0) + coalesce(list_sum(list_transform(cl, lambda b: b.v)), 0) AS total, len(list_intersect(qf, cf)) AS common FROM j)
        SELECT qid, study_id, round(0.6::DOUBLE * CASE WHEN total = 0 THEN 1 ELSE lo / (total - lo) END
             + 0.4::DOUBLE * CASE WHEN len(qf) = 0 AND len(cf) = 0 THEN 1 WHEN len(qf) = 0 OR len(cf) = 0 THEN 0 ELSE 2.0::DOUBLE * common / (len(qf) + len(cf)) END, 6) AS gain FROM s""",
    "graded_ndcg": f"""
        WITH {_BEST}, {_CASES}, t AS (SELECT qid, min(case_id) AS case_id FROM questions GROUP BY qid),
        r AS (SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank FROM best WHERE score IS NOT NULL),
        j AS (SELECT qid, rank, q.l AS ql, c.l AS cl FROM r JOIN t USING (qid) JOIN w q ON q.study_id = t.case_id JOIN w c ON c.study_id = r.study_id),
        s AS (SELECT qid, rank, coalesce(list_sum(list_transform(ql, lambda a: coalesce(list_sum(list_transform(list_filter(cl, lambda b: b.k = a.k), lambda b: least(a.v, b.v))), 0))), 0) AS lo,
                     coalesce(list_sum(list_transform(ql, lambda a: a.v)), 0) + coalesce(list_sum(list_transform(cl, lambda b: b.v)), 0) AS total FROM j),
        g AS (SELECT qid, rank, round(CASE WHEN total = 0 THEN 1 ELSE lo / (total - lo) END, 9) AS gain FROM s),
        o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, rank) AS ideal FROM g)
        SELECT qid, round(coalesce(sum(CASE WHEN rank <= 10 THEN (2.0::DOUBLE ** gain - 1) / log2(rank + 1) ELSE 0 END) / nullif(sum(CASE WHEN ideal <= 10 THEN (2.0::DOUBLE ** gain - 1) / log2(ideal + 1) ELSE 0 END), 0), 0), 6) AS ndcg FROM o GROUP BY qid""",
    "alpha_sweep": f"""
        WITH {_BEST}, m AS (SELECT qid, study_id, {_mm('bm25')} AS t, {_mm('image')} AS v FROM best), a AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS alpha),
        r AS (SELECT alpha, qid, study_id, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * t + (1 - alpha) * v, 9) DESC, study_id) AS rank FROM m, a),
        f AS (SELECT alpha, qid, min(rank) AS first FROM r JOIN (SELECT DISTINCT qid, case_id AS study_id FROM questions WHERE case_id IS NOT NULL) USING (qid, study_id) GROUP BY 1, 2)
        SELECT alpha, count(*) AS n_found, round(sum(1.0::DOUBLE / first), 6) AS sum_rr FROM f GROUP BY alpha""",
    "list_confidence": f"""
        WITH {_BEST}, {_LONG.replace('FROM best', 'FROM best WHERE score IS NOT NULL')},
        o AS (SELECT qid, study_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rk FROM best WHERE score IS NOT NULL),
        s AS (SELECT qid, max(score) AS top, coalesce(max(CASE WHEN rk = 2 THEN score END), 0) AS second, min(score) AS low, max(CASE WHEN rk = 1 THEN study_id END) AS b FROM o GROUP BY qid),
        g AS (SELECT qid, avg((study_id = b)::INT) AS ag FROM ranks JOIN s USING (qid) WHERE rank = 1 GROUP BY qid)
        SELECT qid, round(1 / (1 + exp(-(CASE WHEN top > low THEN 1.6 + 3.0::DOUBLE * (top - second) / (top - low) ELSE 0.8 END + 0.8 * ag - 1.4))), 6) AS confidence FROM s JOIN g USING (qid)""",
    "bm25_top_documents": f"""
        WITH {_ASKED}, {_bm25('documents', 'doc_id', 'text')},
        every AS (SELECT a.qid, d.doc_id, coalesce(round(s.score, 9), 0) AS score FROM asked a CROSS JOIN documents d LEFT JOIN scores s ON s.qid = a.qid AND s.doc_id = d.doc_id)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM every
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) <= 5""",
    "tfidf_top_reports": f"""
        WITH {_ASKED},
        toks AS (SELECT study_id, {_tokens("min(concat_ws(' ', findings, impression))")} AS t FROM paired_cases GROUP BY study_id),
        n AS (SELECT count(*) AS n FROM toks),
        tf AS (SELECT study_id, term, count(*) / dl AS tf FROM (SELECT study_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY study_id, term, dl),
        idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n),
        w AS (SELECT study_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
        qtok AS (SELECT qid, {_tokens('question')} AS t FROM asked),
        qw AS (SELECT qid, term, tf * idf AS w FROM (SELECT qid, term, count(*) / dl AS tf FROM (SELECT qid, len(t) AS dl, unnest(t) AS term FROM qtok) GROUP BY qid, term, dl) JOIN idf USING (term)),
        norms AS (SELECT study_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY study_id), qnorms AS (SELECT qid, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY qid),
        scores AS (SELECT qid, study_id, round(sum(w.w * qw.w) / (norm * qnorm), 9) AS score FROM w JOIN qw USING (term) JOIN norms USING (study_id) JOIN qnorms USING (qid) GROUP BY qid, study_id, norm, qnorm)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank, study_id, round(score, 6) AS score FROM scores
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5""",
    "scoped_bm25_reports": f"""
        WITH asked AS (SELECT qid, x.question AS question, x.case_id AS case_id FROM (SELECT qid, min(struct_pack(question := question, case_id := case_id)) AS x FROM questions GROUP BY qid)),
        base AS (SELECT study_id, min(findings) AS findings, min(impression) AS impression FROM paired_cases GROUP BY study_id),
        chunk AS (SELECT study_id || '::findings' AS chunk_id, study_id, findings AS body FROM base UNION ALL SELECT study_id || '::impression', study_id, impression FROM base),
        {_bm25('chunk', 'chunk_id', 'body', 'case_id=study_id')}
        SELECT qid, chunk_id, round(score, 6) AS score FROM scores QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) = 1""",
    "dense_top_vectors": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(coalesce(list_cosine_similarity(a.e, b.e), 0), 9) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "ranked_scores": f"""
        WITH {_BEST} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank, study_id, round(score, 6) AS score FROM best WHERE score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 10""",
    "minmax_components": f"""
        WITH {_BEST}, m AS (SELECT qid, {_mm('bm25')} AS bm25, {_mm('image')} AS image, {_mm('report')} AS report FROM best)
        SELECT qid, count(*) AS n, round(avg(bm25), 6) AS bm25, round(avg(image), 6) AS image, round(avg(report), 6) AS report FROM m GROUP BY qid""",
    "rrf_fusion": f"""
        WITH {_BEST}, {_LONG}, f AS (SELECT qid, study_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM ranks WHERE rank <= 100 GROUP BY qid, study_id)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank, study_id, round(score, 8) AS score FROM f
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 10""",
    "weighted_rrf": f"""
        WITH {_BEST}, {_LONG}, f AS (SELECT qid, study_id, round(sum(CASE source WHEN 'bm25' THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END / (60 + rank)), 12) AS score FROM ranks WHERE rank <= 100 AND source <> 'report' GROUP BY qid, study_id)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank, study_id, round(score, 8) AS score FROM f
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5""",
    "weighted_fusion": f"""
        WITH {_BEST}, f AS (SELECT qid, study_id, round(0.25::DOUBLE * ({_mm('bm25')}) + 0.5::DOUBLE * ({_mm('image')}) + 0.25::DOUBLE * ({_mm('report')}), 9) AS score FROM best)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) AS rank, study_id, round(score, 6) AS score FROM f
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5""",
    "shortlist_fusion": f"""
        WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, study_id) AS tr FROM best),
        head AS (SELECT qid, study_id, tr, round(0.4::DOUBLE * ({_mm('bm25')}) + 0.6::DOUBLE * ({_mm('image')}), 9) AS score FROM r WHERE tr <= 20)
        SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tr) AS rank, study_id, round(score, 6) AS score FROM head
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tr) <= 10""",
    "candidate_union": f"""
        WITH {_BEST}, {_LONG}, f AS (SELECT qid, study_id, min(struct_pack(s := source, r := rank)) AS first FROM ranks WHERE rank <= 5 GROUP BY qid, study_id)
        SELECT qid, study_id, row_number() OVER (PARTITION BY qid ORDER BY first) AS position FROM f""",
    "adaptive_choices": f"""
        WITH {_BEST}, {_LONG},
        t AS (SELECT qid, source, max(CASE WHEN rank = 1 THEN study_id END) AS top, max(CASE WHEN rank = 1 THEN value END) AS s,
                     coalesce(max(CASE WHEN rank = 1 THEN value END) - max(CASE WHEN rank = 2 THEN value END), 'infinity'::DOUBLE) AS m FROM ranks WHERE rank <= 2 GROUP BY qid, source)
        SELECT b.qid, CASE WHEN b.top = o.top THEN 'agreement' WHEN o.m >= 0.02 AND b.m <= 0.01 THEN 'reranker' WHEN b.s >= 0.3 THEN 'base' ELSE 'abstain' END AS choice,
               CASE WHEN isinf(b.m) THEN b.m ELSE round(b.m, 6) END AS base_margin, CASE WHEN isinf(o.m) THEN o.m ELSE round(o.m, 6) END AS other_margin
        FROM t b JOIN t o ON b.qid = o.qid AND b.source = 'bm25' AND o.source = 'image'""",
    "route_metrics": """
        WITH best AS (SELECT route, qid, study_id, max(CASE WHEN isfinite(score) THEN score END) AS score FROM scored_cases WHERE qid IS NOT NULL AND study_id IS NOT NULL AND route IS NOT NULL GROUP BY ALL HAVING max(CASE WHEN isfinite(score) THEN score END) IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY route, qid ORDER BY score DESC, study_id) AS rank FROM best),
        rel AS (SELECT DISTINCT qid, case_id AS study_id FROM questions WHERE case_id IS NOT NULL), tot AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid),
        f AS (SELECT route, qid, min(rank) AS first, count(*) FILTER (rank <= 1) AS n1, count(*) FILTER (rank <= 5) AS n5, count(*) FILTER (rank <= 10) AS n10 FROM r JOIN rel USING (qid, study_id) GROUP BY route, qid),
        p AS (SELECT routes.route, tot.qid, n_rel, first, coalesce(n1, 0) AS n1, coalesce(n5, 0) AS n5, coalesce(n10, 0) AS n10 FROM tot CROSS JOIN (SELECT DISTINCT route FROM r) routes LEFT JOIN f ON f.qid = tot.qid AND f.route = routes.route)
        SELECT route, count(*) AS n_queries, round(avg((n1 > 0)::INT), 6) AS hit_at_1, round(avg((n5 > 0)::INT), 6) AS hit_at_5, round(avg((n10 > 0)::INT), 6) AS hit_at_10,
               round(avg(n1 / n_rel), 6) AS recall_at_1, round(avg(n5 / n_rel), 6) AS recall_at_5, round(avg(n10 / n_rel), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM p GROUP BY route""",
}
_TOP_FIVE = "top AS (SELECT qid, study_id FROM best WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, study_id) <= 5)"
SQL["relevance_gains_all"] = SQL["relevance_gains"].replace(_TOP_FIVE, "top AS (SELECT qid, study_id FROM best)")

"""Retrieval, answer, calibration and threshold metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import ascii_tokens
from caseloom.operators.order import running_maximum, with_positions


def retrieval_metrics(ranks: DataFrame, qrels: DataFrame, query: str, item: str, systems: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Mean hit@k, recall@k and reciprocal rank over all queries of qrels, per system; a query without a ranking counts 0.

    ranks has query, item, rank and the columns of systems, and may be reduced to relevant items; systems lists the few ranking systems; qrels has query and item of the relevant pairs.
    """
    groups = systems.columns
    relevant = qrels.select(query, item).distinct()
    total = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("n_rel"))
    found = ranks.join(relevant, [query, item]).groupBy(*groups, query).agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks]
    )
    per_query = total.join(F.broadcast(systems))  # a few rows: one per ranking system
    per_query = per_query.join(found, [*groups, query], "left")
    hit = [F.avg(F.when(F.coalesce(f"n_{k}", F.lit(0)) > 0, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks]
    recall = [F.avg(F.coalesce(f"n_{k}", F.lit(0)) / F.col("n_rel")).alias(f"recall_at_{k}") for k in ks]
    mrr = F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")
    return per_query.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_queries"), *hit, *recall, mrr)


def ndcg(gains: DataFrame, query: str, rank: str, gain: str, k: int = 10) -> DataFrame:
    """(query, ndcg): Σ(2^gain-1)/log2(rank+1) over the ideal order of all gains of the query; an ideal of 0 gives 0.

    rank is null for a judged item that wasn't ranked, or not among the best k. The ideal order needs the k highest gains only, so Spark cuts groups before the shuffle.
    """
    value = F.pow(F.lit(2.0), F.col(gain)) - 1
    part = lambda r: F.sum(F.when(F.col(r) <= k, value / F.log2(F.col(r) + 1)).otherwise(0.0))
    got = gains.groupBy(query).agg(part(rank).alias("dcg"))
    order = Window.partitionBy(query).orderBy(F.desc(gain), F.col(rank).asc_nulls_last())
    top = gains.withColumn("_ideal", F.row_number().over(order)).where(F.col("_ideal") <= k)
    sums = got.join(top.groupBy(query).agg(part("_ideal").alias("best")), query)
    return sums.select(query, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def token_f1(rows: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    """rows with token_f1: multiset F1 of ascii tokens; two empty texts give 1, one gives 0. key must be unique."""
    side = lambda text, n: rows.select(F.col(key).alias("_k"), F.explode(ascii_tokens(F.col(text))).alias("t"), F.lit(n).alias("p"), F.lit(1 - n).alias("r"))
    words = side(prediction, 1).unionAll(side(reference, 0)).groupBy("_k", "t").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    sums = words.groupBy("_k").agg(F.sum(F.least("p", "r")).alias("_c"), F.sum("p").alias("_p"), F.sum("r").alias("_r"))
    sized = rows.join(sums, rows[key] == sums["_k"], "left").fillna(0, ["_c", "_p", "_r"])
    score = (
        F.when((F.col("_p") == 0) & (F.col("_r") == 0), 1.0)
        .when((F.col("_p") == 0) | (F.col("_r") == 0), 0.0)
        .otherwise(2.0 * F.col("_c") / (F.col("_p") + F.col("_r")))
    )
    return sized.withColumn("token_f1", score).drop("_k", "_c", "_p", "_r")


def ngram_f1(rows: DataFrame, key: str, prediction: str, reference: str, n: int) -> DataFrame:
    """(key, f1): multiset F1 of runs of n ascii tokens, for rows with such a run on either side; key must be unique."""

    def runs(text: str) -> Column:
        t = ascii_tokens(F.col(text))
        last = F.size(t) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))

    side = lambda text, p: rows.select(F.col(key).alias("_k"), F.explode(runs(text)).alias("g"), F.lit(p).alias("p"), F.lit(1 - p).alias("r"))
    counts = side(prediction, 1).unionAll(side(reference, 0)).groupBy("_k", "g").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    return counts.groupBy(F.col("_k").alias(key)).agg((2.0 * F.sum(F.least("p", "r")) / (F.sum("p") + F.sum("r"))).alias("f1"))


def reliability_bins(rows: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_probability, accuracy): equal-width bins, the last one closed; empty bins are kept with n = 0."""
    p = F.col(probability)
    cut = rows.where(p.isNotNull() & F.col(truth).isNotNull()).select(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"), p.alias("p"), F.col(truth).cast("double").alias("y"))
    got = cut.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.avg("y").alias("accuracy"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0, ["n"])


def calibration(rows: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """One row: n, brier, ece."""
    kept = rows.where(F.col(probability).isNotNull() & F.col(truth).isNotNull())
    y = F.col(truth).cast("double")
    brier = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.pow(F.col(probability) - y, 2)).alias("brier"))
    per_bin = reliability_bins(rows, probability, truth, bins)
    ece = per_bin.agg((F.sum(F.abs(F.col("mean_probability") - F.col("accuracy")) * F.col("n")) / F.sum("n")).alias("ece"))
    return brier.join(F.broadcast(ece))  # one row each


def auroc(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: n_positive, n_negative, auroc by rank sums; equal scores share their average rank.

    Rows are first reduced to one per distinct score, then ordered globally without a single-task window.
    """
    kept = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
    y = F.col(truth).cast("long")
    levels = kept.groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    placed, _ = with_positions(levels, [F.col("s")], {"neg_upto": F.col("neg")})
    # a positive beats the negatives below its score, and half of those at it
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0))
    out = placed.agg(F.sum("pos").alias("n_positive"), F.sum("neg").alias("n_negative"), wins.alias("wins"))
    return out.select("n_positive", "n_negative", (F.col("wins") / (F.col("n_positive") * F.col("n_negative"))).alias("auroc"))


def risk_coverage(rows: DataFrame, confidence: str, correct: str, tie: list[str]) -> tuple[DataFrame, int]:
    """Rows in order of falling confidence (ties by `tie`) with position, coverage and cumulative risk; and their number."""
    kept = rows.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull())
    placed, n = with_positions(kept, [F.desc(confidence), *[F.col(t) for t in tie]], {"n_correct": F.col(correct).cast("double")})
    return placed.select("*", (F.col("position") / max(n, 1)).alias("coverage"), (1 - F.col("n_correct") / F.col("position")).alias("risk")), n


def f1_thresholds(rows: DataFrame, group: str, probability: str, truth: str, grid: list[float], default: float = 0.5) -> DataFrame:
    """(group, threshold, f1): the grid threshold with the best F1, ties to the higher one; groups without both classes keep the default.

    One pass: every row adds itself to the grid cell that it last reaches, and cells are summed from above.
    """
    p, y = F.col(probability), F.col(truth).cast("long")
    edges = F.array(*[F.lit(t) for t in grid])
    cell = F.size(F.filter(edges, lambda t: p >= t))
    counts = rows.where(p.isNotNull() & F.col(truth).isNotNull()).groupBy(group, cell.alias("cell")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(group).agg(F.sum("pos").alias("n_pos"), F.sum("n").alias("n_all"))
    marks = rows.sparkSession.range(len(grid)).select((F.col("id") + 1).cast("int").alias("k"))
    table = total.join(F.broadcast(marks))  # one row per grid value
    above = counts.select(group, "cell", "pos", "n").join(F.broadcast(marks), F.col("cell") >= F.col("k")).groupBy(group, "k").agg(F.sum("pos").alias("tp"), F.sum("n").alias("called"))
    table = table.join(above, [group, "k"], "left").fillna(0, ["tp", "called"])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("n_pos")), F.lit(0.0))
    scored = table.withColumn("f1", f1).withColumn("threshold", F.element_at(edges, F.col("k")))
    best = scored.groupBy(group).agg(F.max(F.struct(F.round("f1", 12).alias("f1"), "threshold")).alias("best"), F.first("n_pos").alias("n_pos"), F.first("n_all").alias("n_all"))
    usable = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_all"))
    return best.select(group, F.when(usable, F.col("best.threshold")).otherwise(F.lit(default)).alias("threshold"), F.when(usable, F.col("best.f1")).otherwise(F.lit(None).cast("double")).alias("f1"))


def label_statistics(rows: DataFrame, key: str, reference: str, prediction: str) -> DataFrame:
    """(key, label, tp, fp, fn) from two arrays of labels: the partial aggregate of per-label metrics."""
    every = rows.select(key, F.explode(F.array_union(reference, prediction)).alias("label"), reference, prediction)
    r, p = F.array_contains(F.col(reference), F.col("label")), F.array_contains(F.col(prediction), F.col("label"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return every.select(key, "label", flag(r & p).alias("tp"), flag(~r & p).alias("fp"), flag(r & ~p).alias("fn"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def holm(rows: DataFrame, p: str, tie: str) -> DataFrame:
    """rows with holm: step-down adjusted p values. The running maximum is taken within sorted partitions and carried on by their maxima."""
    placed, n = with_positions(rows, [F.col(p), F.col(tie)], keep_part=True)
    raw = F.least(F.lit(1.0), (n - F.col("position") + 1) * F.col(p))
    return running_maximum(placed, "position", raw, "holm").drop("position")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a share."""
    share, z2 = successes / n, z * z
    centre = (share + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)  # fixed values: shares of a Poisson count of mean one up to 0, 1, ... 7


def bootstrap_sums(values: DataFrame, key: str, value: str, repetitions: int, seed: int) -> DataFrame:
    """(repetition, n, total): resampled counts and sums over groups, whose keys are unique.

    How often a group is drawn in a repetition is a Poisson count of mean one (the large-sample form of drawing with replacement), read from eight
    digits of sha256('seed|key|block'), eight repetitions a digest; so draws are the same on every run and can be said in SQL. Groups are
    weighed where they are read and summed before the shuffle: what is shuffled is one row per eight repetitions and task.
    """
    rows = values.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("x"))
    rows = rows.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")  # small rows, much work: a fixed number of tasks
    blocks = rows.select("k", "x", F.explode(F.sequence(F.lit(0), F.lit(-(-repetitions // 8) - 1))).alias("block"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("k"), F.col("block").cast("string")), 256)
    steps = [format(math.ceil(c * 2**32), "08x") for c in POISSON]  # hexadecimal digits of one length compare like their numbers
    weight = lambda i: reduce(lambda a, b: a + b, [(F.substring("digest", 8 * i + 1, 8) >= F.lit(t)).cast("int") for t in steps])
    drawn = blocks.select("x", "block", digest.alias("digest")).select("x", "block", *[weight(i).alias(f"w{i}") for i in range(8)])
    sums = drawn.groupBy("block").agg(*[F.sum(f"w{i}").alias(f"n{i}") for i in range(8)], *[F.sum(F.col(f"w{i}") * F.col("x")).alias(f"t{i}") for i in range(8)])
    each = F.explode(F.array(*[F.struct((F.col("block") * 8 + i).cast("long").alias("repetition"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total")) for i in range(8)]))
    return sums.select(each.alias("s")).select("s.*").where(F.col("repetition") < repetitions)


def bootstrap_means(values: DataFrame, key: str, value: str, repetitions: int, seed: int) -> DataFrame:
    """(repetition, mean): means of resampled groups; a repetition that draws none has no row."""
    sums = bootstrap_sums(values, key, value, repetitions, seed)
    return sums.where("n > 0").select("repetition", (F.col("total") / F.col("n")).alias("mean"))


def paired_bootstrap(pairs: DataFrame, key: str, first: str, second: str, repetitions: int, seed: int) -> DataFrame:
    """One row: n, difference, low, high, p_value of the mean of second - first over groups that have both.

    The interval is the middle 95 % of resampled mean differences; the two-sided p value is twice the share of them on the other side of 0, with one added to both counts, 1 at most.
    """
    both = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(key, (F.col(second) - F.col(first)).alias("_d"))
    means = bootstrap_means(both, key, "_d", repetitions, seed)
    drawn = means.agg(
        F.count(F.lit(1)).alias("m"), F.expr("percentile(mean, 0.025)").alias("low"), F.expr("percentile(mean, 0.975)").alias("high"),
        F.count_if(F.col("mean") <= 0).alias("below"), F.count_if(F.col("mean") >= 0).alias("above"),
    )
    whole = both.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("difference"))
    return whole.join(F.broadcast(drawn)).select("n", "difference", "low", "high", plus_one_p(F.least("below", "above"), F.col("m")).alias("p_value"))  # one row each


def plus_one_p(exceeding: Column, drawn: Column, sides: int = 2) -> Column:
    """Monte-Carlo p value that is never 0: sides * (exceeding + 1) / (drawn + 1), 1 at most."""
    return F.least(F.lit(1.0), sides * (exceeding + 1) / (drawn + 1))

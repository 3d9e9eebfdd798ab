"""Choices among thresholds, policies and pool sizes; pooling of several views of a case."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.vectors import dot, l2_normalized
from caseloom.operators.order import with_positions


def threshold_for_coverage(rows: DataFrame, probability: str, coverage: float) -> float | None:
    """The ceil(coverage · n)-th largest probability; None without rows. Counted by distinct value, globally ordered."""
    levels = rows.where(F.col(probability).isNotNull()).groupBy(F.col(probability).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    placed, _ = with_positions(levels, [F.desc("p")], {"upto": F.col("n")})
    total = levels.agg(F.sum("n")).first()[0]
    if not total:
        return None
    want = max(1, math.ceil(coverage * total))
    return placed.where(F.col("upto") >= want).agg(F.max("p")).first()[0]


def precision_threshold(rows: DataFrame, confidence: str, relevant: str, minimum_coverage: float = 0.8) -> dict[str, float]:
    """The threshold of best precision that still covers minimum_coverage of the rows; equal precision goes to the lower one."""
    y = F.col(relevant).cast("long")
    kept = rows.where(F.col(confidence).isNotNull() & F.col(relevant).isNotNull())
    levels = kept.groupBy(F.col(confidence).alias("t")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    placed, _ = with_positions(levels, [F.desc("t")], {"tp": F.col("pos"), "called": F.col("n")})
    total = levels.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no rows")
    scored = placed.select("t", (F.col("tp") / F.col("called")).alias("precision"), (F.col("called") / total).alias("coverage")).where(F.col("coverage") >= minimum_coverage)
    best = scored.orderBy(F.desc("precision"), "t").first()
    return {"threshold": best["t"], "precision": best["precision"], "coverage": best["coverage"]}


def policy_within_tolerance(metrics: DataFrame, name: str, value: str, tolerance: float, preference: list[str]) -> str | None:
    """Of the policies within tolerance of the best value, the first in order of preference; a few rows."""
    best = metrics.agg(F.max(value)).first()[0]
    if best is None:
        return None
    near = {r[name] for r in metrics.where(F.col(value) >= best - tolerance).select(name).collect()}
    return next((p for p in preference if p in near), None)


def smallest_sufficient(metrics: DataFrame, size: str, value: str, target: float) -> DataFrame:
    """One row: the smallest size whose mean value reaches the target, else the largest size."""
    means = metrics.groupBy(size).agg(F.avg(value).alias("m"))
    return means.agg(F.coalesce(F.min(F.when(F.col("m") >= target, F.col(size))), F.max(size)).alias(size))


def pooled_views(views: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): unit vectors of a case's views averaged and scaled to length one again; averaged by position, combined before the shuffle."""
    flat = views.select(key, F.posexplode(l2_normalized(F.col(vector))).alias("at", "x"))
    mean = flat.groupBy(key, "at").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return whole.select(key, l2_normalized(F.transform("v", lambda s: s["x"])).alias(vector))


def attention_views(views: DataFrame, key: str, vector: str, weights: list[float]) -> DataFrame:
    """(key, vector): views weighted by the softmax of their products with `weights`, then scaled to length one."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = views.select(key, l2_normalized(F.col(vector)).alias("v")).withColumn("a", dot(F.col("v"), w))
    over = Window.partitionBy(key)
    rows = rows.withColumn("e", F.exp(F.col("a") - F.max("a").over(over))).withColumn("share", F.col("e") / F.sum("e").over(over))
    flat = rows.select(key, "share", F.posexplode("v").alias("at", "x")).groupBy(key, "at").agg(F.sum(F.col("share") * F.col("x")).alias("x"))
    whole = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    return whole.select(key, l2_normalized(F.transform("v", lambda s: s["x"])).alias(vector))


def unit_scores(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Best and mean score of a case's units or views."""
    return scores.groupBy(*keys).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"))

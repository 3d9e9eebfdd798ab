"""Learned scores on Spark ML and on summed statistics."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.vectors import logit, sigmoid
from caseloom.operators.order import ranks_in_groups
from caseloom.operators.skew import join_one_per_key


def fit_logistic(rows: DataFrame, features: str, label: str, reg: float = 0.01) -> dict:
    """Coefficients and intercept of a logistic model over an array column; both classes must occur."""
    data = rows.select(array_to_vector(F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).alias("features"), F.col(label).cast("double").alias("label"))
    if data.select("label").distinct().count() < 2:
        raise ValueError("both classes are needed")
    model = LogisticRegression(regParam=reg, maxIter=100).fit(data)
    return {"coefficients": [float(x) for x in model.coefficients], "intercept": float(model.intercept)}


def predict(features: Column, model: dict) -> Column:
    """Probability of an exported logistic model, as an expression."""
    weights = F.array(*[F.lit(float(w)) for w in model["coefficients"]])
    parts = F.zip_with(features, weights, lambda x, w: F.coalesce(x.cast("double"), F.lit(0.0)) * w)
    return sigmoid(F.aggregate(parts, F.lit(float(model["intercept"])), lambda s, x: s + x))


def pair_differences(rows: DataFrame, query: str, item: str, features: str, gain: str, high: float, low: float, draws: int = 8, seed: int = 7) -> DataFrame:
    """(query, x, label): feature differences of items of gain >= high against items of gain <= low of the same query, once each way: a linear pairwise ranker is a logistic model of them.

    Every high item meets `draws` low items of its query (repeats drop out), drawn by hash: low items are numbered within their query, and an item looks its draws up by number. So
    pairs grow with the rows of a query, not with their square.
    """
    lows = rows.where(F.col(gain) <= low).select(query, F.col(item).alias("_j"), F.col(features).alias("_y"))
    numbered = ranks_in_groups(lows, [query], [F.xxhash64("_j", F.lit(seed)), F.col("_j")], "_at")
    sizes = lows.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    highs = join_one_per_key(rows.where(F.col(gain) >= high).select(query, F.col(item).alias("_i"), F.col(features).alias("_x")), sizes, query)
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: F.pmod(F.xxhash64("_i", k, F.lit(seed)), F.col("_n")) + 1))
    pairs = highs.select(query, "_x", F.explode(picks).alias("_at")).join(numbered, [query, "_at"])
    diff = F.zip_with("_x", "_y", lambda x, y: x.cast("double") - y.cast("double"))
    first = pairs.select(query, diff.alias("x"), F.lit(1).alias("label"))
    return first.unionByName(first.select(query, F.transform("x", lambda v: -v).alias("x"), F.lit(0).alias("label")))


def fit_platt(rows: DataFrame, probability: str, truth: str, l2: float = 0.01, rounds: int = 50, tolerance: float = 1e-8) -> dict[str, float]:
    """Platt scaling by Newton steps on standardised logits; each step is one pass that sums five numbers."""
    data = rows.where(F.col(probability).isNotNull() & F.col(truth).isNotNull()).select(logit(F.col(probability)).alias("z"), F.col(truth).cast("double").alias("y"))
    mean, spread = data.agg(F.avg("z"), F.stddev_pop("z")).first()
    if mean is None:
        raise ValueError("no rows")
    spread = spread if spread and spread > 1e-12 else 1.0
    data, a, b = data.select(((F.col("z") - mean) / spread).alias("z"), "y").cache(), 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(F.lit(a) * F.col("z") + F.lit(b))
        w, e = p * (1 - p), p - F.col("y")
        n, ga, gb, haa, hab, hbb = data.agg(F.count(F.lit(1)), F.sum(e * F.col("z")), F.sum(e), F.sum(w * F.col("z") * F.col("z")), F.sum(w * F.col("z")), F.sum(w)).first()
        ga, gb, haa, hab, hbb = ga / n + l2 * a, gb / n, haa / n + l2, hab / n, hbb / n + 1e-12
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = math.hypot(da, db)
        step = min(1.0, 5.0 / size) if size > 0 else 1.0  # long steps are cut
        a, b = a - step * da, b - step * db
        if step * size < tolerance:
            break
    data.unpersist()
    return {"slope": a / spread, "intercept": b - a * mean / spread}


def apply_platt(probability: Column, model: dict[str, float]) -> Column:
    return sigmoid(F.lit(model["slope"]) * logit(probability) + F.lit(model["intercept"]))


def probabilities(model_output: Column) -> Column:
    """Positive-class probability of a Spark ML classifier's vector."""
    return vector_to_array(model_output)[1]

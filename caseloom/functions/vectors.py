"""Array and map arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalized(a: Column) -> Column:
    """Unit vector as doubles; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def set_f1(a: Column, b: Column) -> Column:
    """2|a∩b| / (|a|+|b|); 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def fact_f1(a: Column, b: Column) -> Column:
    """Set F1 that is 1 for two empty sets."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(set_f1(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard that is 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def label_weights(labels: Column) -> Column:
    """Active labels only: 1 counts 1.0; 0.5 and -1 (uncertain) count 0.5; 0 and null drop out."""
    weight = F.transform_values(
        F.coalesce(labels, F.create_map().cast("map<string,double>")),
        lambda k, v: F.when(v == 1.0, 1.0).when((v == 0.5) | (v == -1.0), 0.5).otherwise(0.0),
    )
    return F.map_filter(weight, lambda k, v: v > 0)


def label_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two label-weight maps; 1 if both are empty."""
    pairs = F.map_zip_with(a, b, lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))).alias("hi")))
    values = F.map_values(pairs)
    low = F.aggregate(values, F.lit(0.0), lambda s, p: s + p["lo"])
    high = F.aggregate(values, F.lit(0.0), lambda s, p: s + p["hi"])
    return F.when(high == 0, F.lit(1.0)).otherwise(low / high)


def sigmoid(x: Column) -> Column:
    """Logistic function, clamped at 60."""
    return 1.0 / (1.0 + F.exp(-F.least(F.lit(60.0), F.greatest(F.lit(-60.0), x))))


def logit(p: Column, epsilon: float = 1e-6) -> Column:
    q = F.least(F.lit(1 - epsilon), F.greatest(F.lit(epsilon), p))
    return F.log(q / (1 - q))


def safe_divide(a: Column, b: Column) -> Column:
    """x / 0 is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))

"""Ranking, score normalisation and fusion over long tables (query, item, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.order import ranks_in_groups
from caseloom.operators.skew import join_one_per_key
from caseloom.session import stored

RRF_CONSTANT = 60  # fixed value of reciprocal rank fusion


def ranked(scores: DataFrame, query: str, item: str, score: str, k: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """Adds rank: score descending, equal scores by the smaller item.

    With k only the best k: Spark then cuts groups before the shuffle. Without, all rows are ranked by one global sort, so that no group meets in one task.
    """
    keys = [query, *(extra or [])]
    by = [F.desc(score), F.col(item)]
    if k is None:
        return ranks_in_groups(scores, keys, by)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)


def ranks_of(scores: DataFrame, wanted: DataFrame, keys: list[str], item: str, values: dict[str, Column]) -> DataFrame:
    """(keys, item, one rank per value) of the wanted items only: 1 + the rows of the group that beat them, equal values by the smaller item.

    scores has one row per keys and item; wanted has the last of the keys and item. Rows meet the few wanted items of their group and are counted, combined before the shuffle: no group is sorted.
    """
    rows = scores.select(*keys, item, *[c.alias(n) for n, c in values.items()])
    own = rows.join(wanted.select(keys[-1], item).distinct(), [keys[-1], item])
    own = stored(own.select(*keys, F.col(item).alias("_item"), *[F.col(n).alias(f"_{n}") for n in values]), "wanted")
    met = rows.join(own, keys)
    beats = lambda n: (F.col(n) > F.col(f"_{n}")) | ((F.col(n) == F.col(f"_{n}")) & (F.col(item) < F.col("_item")))
    return met.groupBy(*keys, F.col("_item").alias(item)).agg(*[(F.count_if(beats(n)) + 1).alias(n) for n in values])


def finite(score: Column) -> Column:
    """Null for null, NaN and infinite values."""
    return F.when(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")), score)


def minmax(value: Column, low: Column, high: Column, epsilon: float = 0.0) -> Column:
    """Min-max scaling of finite values; others, and ranges up to epsilon, give 0."""
    own = finite(value)
    return F.when(own.isNotNull() & (high - low > epsilon), (own - low) / (high - low)).otherwise(F.lit(0.0))


def minmax_scaled(rows: DataFrame, key: str, columns: list[str], epsilon: float = 0.0) -> DataFrame:
    """rows with each column scaled to its range over the finite values of the rows' key; rows of a null key drop out.

    Ranges are combined before the shuffle and joined back, so that a key of any size stays spread over tasks.
    """
    ends = [part(finite(F.col(c))).alias(f"_{name}_{c}") for c in columns for name, part in (("low", F.min), ("high", F.max))]
    held = join_one_per_key(rows, rows.groupBy(key).agg(*ends), key)
    scaled = {c: minmax(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}"), epsilon) for c in columns}
    return held.select(*[scaled.get(c, F.col(c)).alias(c) for c in rows.columns])


def reciprocal_rank_fusion(ranks: DataFrame, query: str, item: str, source_top_k: int, output_k: int, weights: dict[str, float] | None = None, source: str = "source") -> DataFrame:
    """Σ w/(60+rank) over the top source_top_k of each source; absent counts 0; sources of weight <= 0 are skipped; ties by item.

    ranks has query, item, source, rank.
    """
    weight = F.lit(1.0)
    if weights is not None:
        weight = reduce(lambda c, kv: c.when(F.col(source) == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    kept = ranks.where((F.col("rank") <= source_top_k) & (weight > 0))
    fused = kept.groupBy(query, item).agg(F.sum(weight / (RRF_CONSTANT + F.col("rank"))).alias("score"))
    return ranked(fused.withColumn("score", F.round("score", 12)), query, item, "score", output_k)


def weighted_fusion(components: DataFrame, query: str, item: str, weights: dict[str, float]) -> DataFrame:
    """Normalised weighted sum of min-max components; components has query, item and one column per component."""
    total = sum(weights.values())
    scaled = minmax_scaled(components.select(query, item, *weights), query, list(weights), 1e-12)
    return scaled.select(query, item, reduce(lambda a, b: a + b, [F.lit(w / total) * F.col(c) for c, w in weights.items()]).alias("score"))


def shortlist_fusion(components: DataFrame, query: str, item: str, text: str, image: str, size: int, text_weight: float, k: int | None = None) -> DataFrame:
    """Re-ranks only the `size` best by text with w·minmax(text) + (1-w)·minmax(image); the rest keeps its text order behind. With k only the best k."""
    first = ranked(components, query, item, text, None if k is None else max(size, k)).withColumnRenamed("rank", "text_rank")
    inside = first.where(F.col("text_rank") <= size)
    over = Window.partitionBy(query)  # at most `size` rows
    scaled = lambda c: minmax(F.col(c), F.min(finite(F.col(c))).over(over), F.max(finite(F.col(c))).over(over), 1e-12)
    fused = F.round(F.lit(text_weight) * scaled(text) + F.lit(1 - text_weight) * scaled(image), 9)
    order = Window.partitionBy(query).orderBy(F.desc("score"), "text_rank")
    head = inside.withColumn("score", fused).withColumn("rank", F.row_number().over(order))
    tail = first.where(F.col("text_rank") > size).withColumn("score", F.lit(None).cast("double")).withColumn("rank", F.col("text_rank"))
    out = head.unionByName(tail)
    return out if k is None else out.where(F.col("rank") <= k)


def top_k_union(ranks: DataFrame, query: str, item: str, k: int, source: str = "source") -> DataFrame:
    """Distinct union of the top k of every source, in first-seen order: by source number, then rank."""
    seen = ranks.where(F.col("rank") <= k).groupBy(query, item).agg(F.min(F.struct(source, "rank")).alias("first"))
    order = Window.partitionBy(query).orderBy("first")
    return seen.withColumn("position", F.row_number().over(order)).select(query, item, "position")


def margins_from_ranks(ranks: DataFrame, query: str, score: str, extra: list[str] | None = None) -> DataFrame:
    """Margins and top items from already ranked rows: needs only ranks 1 and 2, so groups of any size stay distributed."""
    keys = [query, *(extra or [])]
    top = ranks.where(F.col("rank") <= 2)
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top_score"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col(score))) - F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(float("inf"))).alias("margin"),
    )

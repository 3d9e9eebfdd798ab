"""Banks, splits, derangements and duplicate clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.hashing import order_key
from caseloom.functions.text import normalized_key
from caseloom.operators.components import connected_components, star_edges
from caseloom.operators.near_text import near_text_links
from caseloom.operators.order import with_positions
from caseloom.session import stored


def patient_key(value: Column) -> Column:
    """Case and surrounding blanks don't matter; blank is null, and null never excludes anybody."""
    key = F.upper(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return F.when(key != "", key)


def bank_audit(queries: DataFrame, bank: DataFrame, study: str, patient: str) -> DataFrame:
    """Per query study: how many studies of the bank fall out as the same study or the same patient, and how many stay.

    Studies are counted per patient and the counts joined back, so no pairs are formed. A study of several patient keys
    adds their counts, less the studies that it meets under more than one of them; those have several keys themselves.
    """
    total = bank.agg(F.countDistinct(study).alias("n_bank"))
    pairs = bank.where(F.col(study).isNotNull()).select(F.col(study).alias("s"), patient_key(F.col(patient)).alias("p")).distinct()
    known = pairs.where("p is not null")
    asked = pairs.join(queries.select(F.col(study).alias("s")).distinct(), "s", "left_semi")
    others = known.groupBy("p").agg((F.count(F.lit(1)) - 1).alias("n_others"))
    summed = asked.join(others, "p", "left").groupBy("s").agg(F.coalesce(F.sum("n_others"), F.lit(0)).alias("n"))
    several = known.join(known.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s"), "s", "left_semi")
    twice = several.join(several.select(F.col("s").alias("o"), "p"), "p").where("s <> o").groupBy("s", "o").agg((F.count(F.lit(1)) - 1).alias("again"))
    twice = twice.where("again > 0").groupBy("s").agg(F.sum("again").alias("again"))
    out = summed.join(twice, "s", "left").join(F.broadcast(total))  # total is one row
    n = F.col("n") - F.coalesce("again", F.lit(0))
    return out.select(F.col("s").alias(study), F.lit(1).cast("long").alias("n_same_study"), n.alias("n_same_patient"), (F.col("n_bank") - 1 - n).alias("n_candidates"))


def hash_partition(ids: DataFrame, key: str, fractions: dict[str, float], domain: str, seed: int) -> DataFrame:
    """(key, partition): hash order, then cuts at cumulative fractions of (position - 0.5)/n; whole keys stay together."""
    rows = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", order_key(domain, seed, F.col(key)))
    placed, n = with_positions(rows, [F.col("_h"), F.col(key)])
    at = (F.col("position") - 0.5) / max(n, 1)
    names, total, upto, chain = list(fractions), sum(fractions.values()), 0.0, None
    for name in names[:-1]:
        upto += fractions[name] / total
        chain = F.when(at < upto, name) if chain is None else chain.when(at < upto, name)
    return placed.select(key, (chain.otherwise(names[-1]) if chain is not None else F.lit(names[-1])).alias("partition"))


def derangement(ids: DataFrame, key: str, domain: str, seed: int, shift: int = 1) -> DataFrame:
    """(key, assigned): hash order shifted cyclically, so nothing maps to itself as long as shift mod n isn't 0."""
    rows = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", order_key(domain, seed, F.col(key)))
    placed, n = with_positions(rows, [F.col("_h"), F.col(key)])
    target = placed.select(F.col("position").alias("_t"), F.col(key).alias("assigned"))
    moved = placed.withColumn("_t", F.pmod(F.col("position") - 1 + shift, F.lit(max(n, 1))) + 1)
    return moved.join(target, "_t").select(key, "assigned")


def exact_text_clusters(cases: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, cluster_id, n_members): cases whose normalised texts are equal, directly or through another of their rows.

    cluster_id is the smallest member; cases without any text are clusters of one.
    """
    text = normalized_key(reduce(lambda a, b: F.concat_ws(" ", a, b), [F.col(t) for t in texts]))
    rows = stored(cases.select(F.col(key).alias("k"), F.sha2(text, 256).alias("h"), (text != "").alias("said")).distinct(), "texts")  # texts are read once
    parts = connected_components(star_edges(rows.where("said"), "k", "h"))
    every = rows.select("k").distinct().join(parts.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    return every.join(sizes, "component").select(F.col("k").alias(key), F.col("component").alias("cluster_id"), "n_members")


def near_text_clusters(cases: DataFrame, key: str, texts: list[str], threshold: float = 0.95) -> DataFrame:
    """(key, cluster_id, n_members) as exact_text_clusters, where texts with a gram cosine of at least the threshold tie as well."""
    text = normalized_key(reduce(lambda a, b: F.concat_ws(" ", a, b), [F.col(t) for t in texts]))
    rows = stored(cases.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), text.alias("text")).distinct().withColumn("h", F.xxhash64("text")), "texts")
    said = rows.where("text <> ''")
    one = said.groupBy("h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    near = near_text_links(one.select(F.col("h").alias("id"), "text", "n"), threshold)
    heads = one.select("h", "k")
    near = near.join(heads.select(F.col("h").alias("a"), F.col("k").alias("u")), "a").join(heads.select(F.col("h").alias("b"), F.col("k").alias("v")), "b")
    parts = connected_components(star_edges(said, "k", "h").unionByName(near.select("u", "v")))
    every = rows.select("k").distinct().join(parts.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    sizes = every.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    return every.join(sizes, "component").select(F.col("k").alias(key), F.col("component").alias("cluster_id"), "n_members")


def spectrum(labels: Column) -> Column:
    """normal without an active label, indeterminate with uncertain ones only or no label at all, else abnormal."""
    values = F.map_values(labels)
    return (
        F.when(labels.isNull() | (F.size(labels) == 0), "indeterminate")
        .when(F.exists(values, lambda v: v == 1.0), "abnormal")
        .when(F.exists(values, lambda v: (v == 0.5) | (v == -1.0)), "indeterminate")
        .otherwise("normal")
    )

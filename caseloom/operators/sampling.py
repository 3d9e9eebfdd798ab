"""Deterministic samples and orders drawn by hash, and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.order import with_positions
from caseloom.session import stored


def hash_sample(rows: DataFrame, key: str, count: int, domain: str, seed: int) -> DataFrame:
    """The first `count` distinct keys in hash order; the limit is the feature."""
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct()
    digest = F.sha2(F.concat_ws("|", F.lit(domain), F.lit(str(seed)), F.col(key)), 256)
    return ids.withColumn("_h", digest).orderBy("_h", key).limit(count).drop("_h")


def blinded_rows(cases: DataFrame, key: str, systems: list[str], seed: int) -> DataFrame:
    """(key, system, code): the systems of each case in a hashed order of its own, coded A, B, C."""
    rows = cases.select(key, F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"))
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col("system")), 256)
    order = Window.partitionBy(key).orderBy(digest, "system")
    return rows.withColumn("code", F.char(F.lit(64) + F.row_number().over(order)))


def round_robin(rows: DataFrame, group: str, key: list[str], count: int, seed: int) -> DataFrame:
    """`count` rows taken in turn from the groups, each group in hash order; the limit is the feature."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)
    turn = Window.partitionBy(group).orderBy(digest, *key)
    taken = rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= count)  # Spark cuts groups before the shuffle
    return taken.orderBy("turn", group).limit(count)


def hashed_history(targets: DataFrame, bank: DataFrame, target: str, key: str, group: str, count: int, seed: int) -> DataFrame:
    """(target, position, key): for every target `count` bank rows of other groups, drawn by hash.

    The bank is put in the order of sha256('seed|key') and closed to a ring; a target begins at a place of its own, sha256('seed|start|target') modulo the bank's
    size, and takes the first `count` rows from there that are neither itself nor of its group (null is no group). targets has target and group, bank has key
    (unique) and group. Targets look up a window of the ring by equi-join; those that it leaves short look up one four times as wide, until the ring is used up.
    """
    spark = bank.sparkSession
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 256)
    ring, n = with_positions(bank.select(F.col(key).alias("_key"), F.col(group).alias("_group"), digest.alias("_h")), [F.col("_h"), F.col("_key")])
    kind = f"`{target}` {targets.schema[target].dataType.simpleString()}, position int, `{key}` {bank.schema[key].dataType.simpleString()}"
    if not n:
        return spark.createDataFrame([], kind)
    ring = stored(ring.select("_key", "_group", (F.col("position") - 1).alias("_at")), "ring")
    start = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("start"), F.col(target)), 256), 1, 15), 16, 10).cast("long") % n
    left, width, found = stored(targets.select(target, group, start.alias("_start")), "targets"), min(n, 2 * count + 2), None
    while True:
        steps = left.select(target, group, "_start", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_step"))
        met = steps.withColumn("_at", (F.col("_start") + F.col("_step")) % n).join(ring, "_at")
        met = met.where((F.col("_key") != F.col(target)) & ~F.coalesce(F.col("_group") == F.col(group), F.lit(False)))
        order = Window.partitionBy(target).orderBy("_step")
        taken = stored(met.withColumn("position", F.row_number().over(order)).where(F.col("position") <= count).select(target, "position", F.col("_key").alias(key)), "taken")
        full = taken.groupBy(target).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == count).select(target)
        short = stored(left.join(full, target, "left_anti"), "short")
        last = width >= n or short.isEmpty()
        part = taken if last else taken.join(full, target, "left_semi")
        found = part if found is None else found.unionAll(part)
        if last:
            return found
        left, width = short, min(n, 4 * width)


def hard_negatives(scores: DataFrame, query: str, item: str, score: str, gain: str, k: int, most_gain: float) -> DataFrame:
    """The k best-scored items of gain up to most_gain, per query; ties by item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    low = scores.where(F.col(gain) <= most_gain).withColumn("rank", F.row_number().over(order))
    return low.where(F.col("rank") <= k)


def pairwise_examples(scores: DataFrame, query: str, item: str, gain: str, positive: float, negative: float) -> DataFrame:
    """(query, best, other): the best positive item with every negative one; queries without a positive give none."""
    best = scores.where(F.col(gain) >= positive).groupBy(query).agg(F.min(F.struct((-F.col(gain)).alias("g"), item)).getField(item).alias("best"))
    return scores.where(F.col(gain) < negative).join(best, query).select(query, "best", F.col(item).alias("other"))

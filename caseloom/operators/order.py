"""Exact global positions, running sums, and ranks within groups of any size, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.skew import join_one_per_key
from caseloom.session import stored

ROW_BITS = 2**33  # fixed value: monotonically_increasing_id counts the rows of a partition below this


def with_positions(df: DataFrame, by: list[Column], sums: dict[str, Column] | None = None, position: str = "position", keep_part: bool = False) -> tuple[DataFrame, int]:
    """df with its 1-based position in the order `by`, and running sums (inclusive) in that order; and the number of rows.

    Rows are range-partitioned and sorted, and stored once; only one row per partition reaches the driver,
    where counts and sums of the partitions before become offsets. `by` must order the rows totally
    if positions are to be the same on every run. keep_part keeps the number of the partition as _part.
    """
    sums = sums or {}
    kept = df.select("*", *[c.cast("double").alias(f"_v_{n}") for n, c in sums.items()])
    ordered = kept.repartitionByRange(*by).sortWithinPartitions(*by)
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id() % ROW_BITS + 1)
    held = stored(ordered, "ordered")
    drop = ["_local", "_before", *([] if keep_part else ["_part"]), *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums]]
    totals = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_v_{n}").alias(f"s_{n}") for n in sums])
    rows = sorted(totals.collect())  # one row per partition
    if not rows:
        empty = held.withColumn(position, F.lit(1).cast("long"))
        return empty.select("*", *[F.lit(0.0).alias(n) for n in sums]).drop(*drop), 0
    offsets, at, running = [], 0, [0.0] * len(sums)
    for r in rows:
        offsets.append((r["_part"], at, *running))
        at += r["n"]
        running = [x + (y or 0.0) for x, y in zip(running, r[2:])]
    schema = "_part int, _before long" + "".join(f", _o_{n} double" for n in sums)
    start = df.sparkSession.createDataFrame(offsets, schema)
    out = held.join(F.broadcast(start), "_part").withColumn(position, F.col("_local") + F.col("_before"))
    upto = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(upto) + F.col(f"_o_{n}"))
    return out.drop(*drop), at


def running_maximum(placed: DataFrame, position: str, value: Column, name: str) -> DataFrame:
    """placed with the running maximum of value in the order of position; placed comes from with_positions with keep_part.

    The maxima of the partitions before are carried on: one row per partition reaches the driver.
    """
    held = stored(placed.withColumn("_m", value), "maxima")
    carry, best = [], None
    for r in sorted(held.groupBy("_part").agg(F.max("_m").alias("m")).collect()):
        carry.append((r["_part"], best))
        best = r["m"] if best is None or (r["m"] is not None and r["m"] > best) else best
    start = placed.sparkSession.createDataFrame(carry, "_part int, _carry double")
    upto = Window.partitionBy("_part").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    out = held.join(F.broadcast(start), "_part")
    return out.withColumn(name, F.greatest("_carry", F.max("_m").over(upto))).drop("_part", "_m", "_carry")


def ranks_in_groups(df: DataFrame, group: list[str], by: list[Column], rank: str = "rank") -> DataFrame:
    """df with the 1-based place of a row among the rows of its group, in the order `by` (which must be total within a group).

    All rows are range-partitioned and sorted by group and `by`, so that a group of any size is spread over as many
    partitions as it fills. Every partition numbers its own runs of a group; what runs before a partition's first
    group began with is added from one row per partition. Null group values count as a group.
    """
    key = F.concat_ws("\x01", *[F.coalesce(F.col(g).cast("string"), F.lit("\x02")) for g in group])
    order = [*[F.col(g) for g in group], *by]
    ordered = df.withColumn("_g", key).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id() % ROW_BITS)

    names = ordered.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, at = None, 0, names.index("_g")
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at)
            starts = np.ones(len(keys), bool)
            starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            starts[0] = keys[0].as_py() != last
            index = np.arange(len(keys))
            first = np.maximum.accumulate(np.where(starts, index, -run))  # a run that goes on began `run` rows before this batch
            if not starts[0]:
                first[: int(np.argmax(starts)) if starts.any() else len(keys)] = -run
            runs = index - first + 1
            last, run = keys[len(keys) - 1].as_py(), int(runs[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=[*names, "_run"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("_run", T.LongType())])
    held = stored(ordered.mapInArrow(number, schema), "runs")
    ends = held.groupBy("_part").agg(F.min_by("_g", "_local").alias("first"), F.max_by("_g", "_local").alias("last"), F.max_by("_run", "_local").alias("run"))
    carry, before, count = [], None, 0
    for r in sorted(ends.collect()):  # one row per partition
        more = count if r["first"] == before else 0
        carry.append((r["_part"], r["first"], more))
        before, count = r["last"], r["run"] + (more if r["first"] == r["last"] else 0)
    start = df.sparkSession.createDataFrame(carry, "_part int, _first string, _more long")
    out = held.join(F.broadcast(start), "_part")
    place = F.col("_run") + F.when(F.col("_g") == F.col("_first"), F.col("_more")).otherwise(0)
    return out.withColumn(rank, place).drop("_g", "_part", "_local", "_run", "_first", "_more")


def _levels(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(g, v, n, upto, size): the distinct values of each group, how many rows have them, running counts within the group, and its rows.

    Values are counted per level, combined before the shuffle; running counts come from the global order. Null groups and values drop out.
    """
    kept = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    levels = kept.groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed, _ = with_positions(levels, [F.col("g"), F.col("v")], {"upto": F.col("n")})
    whole = placed.groupBy("g").agg(F.min(F.col("upto") - F.col("n")).alias("start"), F.sum("n").alias("size"))
    return join_one_per_key(placed, whole, "g").select("g", "v", "n", (F.col("upto") - F.col("start")).alias("upto"), "size")


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column per share): exact quantiles by linear interpolation of the non-null values of each group, however large. A null group has no row."""
    parts = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("size") - 1)
        for end, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            parts.append(F.min(F.when(F.col("upto") > index, F.col("v"))).alias(f"{name}_{end}"))
    got = _levels(rows, group, value).groupBy("g", "size").agg(*parts)
    out = [F.col("g").alias(group)]
    for name, share in shares.items():
        at = F.lit(share) * (F.col("size") - 1)
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((low + (at - F.floor(at)) * (high - low)).alias(name))
    return got.select(*out)


def nearest_index(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, value): the value at index round-half-even((n-1)·share) of the sorted non-null values of each group, however large."""
    index = F.bround((F.col("size") - 1) * F.lit(share))
    got = _levels(rows, group, value).where(F.col("upto") > index).groupBy("g").agg(F.min("v").alias("v"))
    return got.select(F.col("g").alias(group), F.col("v").alias(value))

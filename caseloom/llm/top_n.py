"""The N best items of every group, by one global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_scores(scored: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row per (group, item) with its highest finite score; rows with a null part or a NaN or infinite score drop out."""
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score)) & (F.abs(F.col(score)) < float("inf"))
    rows = scored.where(usable & F.col(group).isNotNull() & F.col(item).isNotNull())
    return rows.groupBy(F.col(group).alias("group_key"), F.col(item).alias("item_key")).agg(
        F.max(F.col(score).cast("double") + F.lit(0.0)).alias("score")
    )


def _run_starts(keys: pa.Array, before: object) -> np.ndarray:
    """Where a new group begins in a sorted batch; before is the last key of the batch before."""
    starts = np.ones(len(keys), dtype=bool)
    if len(keys) > 1:
        starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    starts[0] = before is None or keys[0].as_py() != before
    return starts


def top_n_per_group(scored: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group_key, item_key, score, position) of the n best items of each group: higher scores first,
    equal scores by the smaller item.

    All rows are range-partitioned and sorted by (group, score, item), so a group of any size is spread
    over as many partitions as it fills. Each partition numbers its own runs of a group and drops what
    is beyond n there already (it can't be better globally). The counts of the partitions before are
    then prefix-summed into exact positions. An item that appears several times counts with its best
    score; null groups, null items and scores that aren't finite are left out; an empty table gives an
    empty result; other columns are never read.
    """
    best = best_scores(scored, group, item, score)
    ordered = best.withColumn("down", -F.col("score")).repartitionByRange("group_key", "down", "item_key")
    ordered = ordered.sortWithinPartitions("group_key", "down", "item_key").select("group_key", "item_key", "score")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, run = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            starts = _run_starts(keys, last)
            index = np.arange(1, len(keys) + 1)
            base = np.maximum.accumulate(np.where(starts, index - 1, 0))
            local = index - base
            if not starts[0]:
                first = np.flatnonzero(starts)
                local[: first[0] if len(first) else len(keys)] += run
            last, run = keys[len(keys) - 1].as_py(), int(local[-1])
            keep = pa.array(local <= n)
            out = [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), pa.array(local.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["group_key", "item_key", "score", "part", "local"]).filter(keep)

    kind = {f.name: f.dataType.simpleString() for f in best.schema.fields}
    schema = f"group_key {kind['group_key']}, item_key {kind['item_key']}, score double, part int, local long"
    kept = ordered.mapInArrow(number, schema)
    before = Window.partitionBy("group_key").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("position", F.col("local") + F.count(F.lit(1)).over(before))
    return placed.where(F.col("position") <= n).select("group_key", "item_key", "score", "position")

"""Most similar vectors for every vector: a permutation index with pivot inverted files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.session import stored

DIMENSION = 64
LENGTH = 8  # pivots of a vector's permutation prefix
POSTED = 4  # files in which a vector is posted, by its nearest pivots
ASKED = 3  # files that a vector asks
CHUNK = 8192  # most vectors of a file that meet in one block: it bounds a task's memory, and no result depends on it
MOST_PIVOTS = 65_536  # a broadcast of 17 MB a view; from 270 million vectors on, files grow faster


def usable_vectors(table: DataFrame, case: str, columns: dict[str, str], dimension: int = DIMENSION) -> DataFrame:
    """(view_name, case_id, vec) of every case and view with a usable vector, scaled to length one (array<float>).

    A vector is usable if it has exactly `dimension` finite values that aren't all zero; null cases are left out.
    """
    views = None
    for view, column in columns.items():
        rows = table.select(F.lit(view).alias("view_name"), F.col(case).cast("string").alias("case_id"), F.col(column).cast("array<float>").alias("vec"))
        rows = rows.where(F.col("case_id").isNotNull() & (F.size("vec") == dimension))
        views = rows if views is None else views.unionAll(rows)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = _matrix(batch.column(2), dimension).astype(np.float64)  # a null value reads as NaN
            top = np.abs(wide).max(axis=1, initial=0.0)
            good = np.isfinite(wide).all(axis=1) & (top > 0)
            wide = wide[good] / top[good, None]  # first by the largest value, so that tiny ones don't vanish when squared
            unit = (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), _lists(unit, pa.float32())], names=["view_name", "case_id", "vec"])

    return views.mapInArrow(scale, "view_name string, case_id string, vec array<float>")


def pivot_count(rows: int, most: int) -> int:
    """Pivots per view: four per root of the rows, so that files grow with the root as well; at most `most`."""
    return int(max(16, min(most, 4 * np.sqrt(max(rows, 1)))))


def choose_pivots(classes: DataFrame, view: str, rows: int, most: int) -> np.ndarray:
    """At most `most` vectors of a view, one a case, drawn by hash: the bounded, documented sample that fits the index.

    One a case, as a case of very many vectors would else draw most pivots, and files around it would hold no other case.
    """
    m = pivot_count(rows, most)
    drawn = classes.where(F.col("view_name") == view).select(F.col("cases")[0].alias("c"), F.xxhash64("class_id", F.lit(17)).alias("h"), "vec")
    drawn = drawn.groupBy("c").agg(F.min(F.struct("h", "vec")).alias("p")).select("p.h", "p.vec").orderBy("h").limit(m)
    got = drawn.collect()
    return np.array([r["vec"] for r in got], dtype=np.float32).reshape(len(got), -1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def permutations(classes: DataFrame, pivots: dict[str, np.ndarray]) -> DataFrame:
    """Adds perm: the numbers of the LENGTH nearest pivots, nearest first (fewer if there are fewer pivots)."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = np.array(batch.column(0).to_pylist())
            vec = _matrix(batch.column(2), DIMENSION)
            perm: list = [None] * len(views)
            for view, points in shared.value.items():
                rows = np.flatnonzero(views == view)
                width = min(LENGTH, len(points))
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    near = vec[part] @ points.T
                    cut = np.argpartition(-near, width - 1, axis=1)[:, :width]
                    turn = np.argsort(-np.take_along_axis(near, cut, 1), axis=1, kind="stable")
                    for r, p in zip(part, np.take_along_axis(cut, turn, 1).astype(np.int32)):
                        perm[r] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perm, pa.list_(pa.int32()))], names=["view_name", "class_id", "vec", "cases", "perm"])

    return classes.mapInArrow(order, "view_name string, class_id long, vec array<float>, cases array<string>, perm array<int>")


def footrule_agreement(asking: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A measure of permutation prefixes, which cuts no result: how near they are, the higher, the smaller Spearman's footrule, where a pivot beyond a prefix stands right behind it.

    A pivot at place p weighs width - p. The footrule is the sum of differences of weights, which is a constant less twice the sum of smaller weights.
    """
    width = held.shape[1]
    pivots, column = np.unique(held, return_inverse=True)
    column = column.reshape(held.shape)
    weights = np.zeros((len(asking), len(pivots)), np.uint8)
    at = np.minimum(np.searchsorted(pivots, asking), len(pivots) - 1)
    row, place = np.nonzero(pivots[at] == asking)
    weights[row, at[row, place]] = width - place
    return sum(np.minimum(weights[:, column[:, p]], np.uint8(width - p)) for p in range(width))


def nearest_in_block(block: pa.Table, k: int) -> pa.Table:
    """One block of one pivot file: the k + 1 best cases of every asking vector by exact cosine, over all members of the block.

    A case counts with its best vector. One more than k, as the asking case may be among them. Nothing is left out by rank within a block, so the blocks of a file give what the
    whole file would give. The cosines of a block are one matrix product.
    """
    ids = block.column("class_id").to_numpy()
    roles = block.column("role").to_numpy()
    vec = _matrix(block.column("vec").combine_chunks(), DIMENSION).astype(np.float64)
    asks, holds = np.flatnonzero(roles & 1), np.flatnonzero(roles & 2)
    view = block.column("view_name")[0].as_py()
    lists = block.column("cases").take(holds).combine_chunks()
    row = np.repeat(np.arange(len(holds)), np.diff(lists.offsets.to_numpy()))
    names = np.array(sorted(set(lists.flatten().to_pylist())), dtype=object)
    place = {name: i for i, name in enumerate(names)}
    of = np.array([place[c] for c in lists.flatten().to_pylist()], np.int64)
    turn = np.argsort(of, kind="stable")
    row, starts = row[turn], np.searchsorted(of[turn], np.arange(len(names)))
    classes, cases, cosines = [], [], []
    for begin in range(0, len(asks), 128):
        rows = asks[begin : begin + 128]
        if not len(names):
            break
        cosine = np.round(vec[rows] @ vec[holds].T, 7)
        cosine[ids[rows][:, None] == ids[holds][None, :]] = 1.0
        best = np.maximum.reduceat(cosine[:, row], starts, axis=1)  # of each case its best vector
        # names ascend, so equal cosines go by the smaller case
        order = np.round(best * 1e7).astype(np.int64) * len(names) - np.arange(len(names))
        width = min(k + 1, len(names))
        keep = np.argpartition(-order, width - 1, axis=1)[:, :width]
        classes.append(np.repeat(ids[rows], width))
        cases.append(names[keep.ravel()])
        cosines.append(np.take_along_axis(best, keep, 1).ravel())
    n = sum(len(x) for x in classes)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table(
        {
            "view_name": pa.array([view] * n, pa.string()),
            "class_id": pa.array(join(classes, np.int64), pa.int64()),
            "neighbour_id": pa.array(join(cases, object), pa.string()),
            "cosine": pa.array(join(cosines, np.float64), pa.float64()),
        }
    )


def pivot_posts(indexed: DataFrame) -> DataFrame:
    """indexed with pivot and role: a vector is posted in the files of its first POSTED pivots (role & 2) and asks those of its first ASKED (role & 1), whatever their size."""
    return indexed.select("*", F.posexplode(F.slice("perm", 1, POSTED)).alias("place", "pivot")).withColumn("role", F.when(F.col("place") < ASKED, 3).otherwise(2)).drop("place")


def similar_cases(classes: DataFrame, k: int, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(view_name, class_id, neighbour_id, cosine) with about the k + 1 nearest distinct cases of every vector of a view; classes has view_name, class_id, vec, cases.

    Each vector is written as the ordered numbers of its LENGTH nearest pivots and posted in the files
    of the first POSTED; it asks the files of its first ASKED pivots and compares all their members by exact cosine. Files of more than CHUNK members are cut into chunks by hash, and every chunk of
    askers meets every chunk of members, so that nothing is dropped and results don't depend on the cut.
    """
    counts = {r["view_name"]: r["n"] for r in classes.groupBy("view_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = "view_name string, class_id long, neighbour_id string, cosine double"
    spark = classes.sparkSession
    if not counts:
        return spark.createDataFrame([], kind)
    pivots = {v: choose_pivots(classes, v, n, most_pivots) for v, n in counts.items()}
    indexed = stored(permutations(classes.select("view_name", "class_id", "vec", "cases"), pivots), "permutations")
    files = pivot_posts(indexed.select("view_name", "perm")).groupBy("view_name", "pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    files = stored(files.where("chunks > 1"), "files")  # so that Spark knows how small it is before the vectors move
    posts = pivot_posts(indexed).join(files, ["view_name", "pivot"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    asks = F.transform(every, lambda c: F.struct(own.alias("asker"), c.alias("member"), F.when(c == own, 3).otherwise(1).alias("role")))
    holds = F.transform(every, lambda c: F.struct(c.alias("asker"), own.alias("member"), F.lit(2).alias("role")))
    both = F.when(F.col("role") == 2, holds).otherwise(F.concat(asks, F.filter(holds, lambda s: s["asker"] != own)))
    blocks = posts.select("view_name", "pivot", "class_id", "vec", "cases", F.explode(both).alias("b"))
    blocks = blocks.select("view_name", "pivot", "b.asker", "b.member", "b.role", "class_id", "vec", "cases")
    found = blocks.groupBy("view_name", "pivot", "asker", "member").applyInArrow(lambda block: nearest_in_block(block, k), kind)
    return found.where(F.col("cosine") >= -1.5).groupBy("view_name", "class_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))


def most_similar(table: DataFrame, case: str, columns: dict[str, str], k: int = 5, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(view_name, case_id, neighbour_id, cosine): the k most similar other cases of each case, per view.

    Equal vectors form a class: the index holds each class once, and only its k + 1 smallest cases
    can be anybody's answer, so a group of copies of any size stays cheap and exact. Equal cosines
    (to seven places) go by the smaller case. A case with several different vectors answers with its
    best one; each vector keeps k + 1 distinct cases, so that a case of many vectors takes one place. Unusable vectors are neither asked nor returned; an empty table gives an empty result.
    """
    unit = usable_vectors(table, case, columns)
    unit = stored(unit.withColumn("class_id", F.xxhash64("vec")), "vectors")
    classes = unit.groupBy("view_name", "class_id").agg(F.first("vec").alias("vec"))
    members = unit.select("view_name", "class_id", "case_id").distinct()
    place = Window.partitionBy("view_name", "class_id").orderBy("case_id")
    heads = members.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1)
    heads = heads.groupBy("view_name", "class_id").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))
    offered = similar_cases(stored(classes.join(heads, ["view_name", "class_id"]), "classes"), k, most_pivots)
    rank = Window.partitionBy("view_name", "class_id").orderBy(F.desc("cosine"), "neighbour_id")
    offered = offered.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
    answers = members.join(offered.drop("r"), ["view_name", "class_id"]).where("case_id <> neighbour_id")
    answers = answers.groupBy("view_name", "case_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("view_name", "case_id").orderBy(F.desc("cosine"), "neighbour_id")
    return answers.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

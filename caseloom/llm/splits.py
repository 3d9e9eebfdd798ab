"""Splits that keep related records together: components, then grouped iterative stratification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import strip_blanks
from caseloom.operators.components import connected_components, star_edges
from caseloom.session import cut_lineage


def shared_key(value):
    """A key that ignores case and surrounding blanks; blank is null."""
    key = F.upper(strip_blanks(value))
    return F.when(key != "", key)


def tied_studies(cases: DataFrame, clusters: DataFrame) -> DataFrame:
    """(study_id, group_id) of every study tied to another one by a patient or a listed cluster, directly or through others.

    group_id is the smallest study of the group. Null and blank patients, clusters and studies tie
    nothing; a study that no row of cases names is no study here. Repeated rows change nothing; empty tables give an empty result.
    """
    study = shared_key(F.col("study_id")).alias("node")
    by_patient = cases.select(study, F.concat(F.lit("patient|"), shared_key(F.col("patient_id"))).alias("key"))
    by_cluster = clusters.select(
        shared_key(F.col("case_id")).alias("node"), F.concat(F.lit("cluster|"), F.col("cluster_id")).alias("key")
    ).join(cases.select(study).distinct(), "node", "left_semi")
    parts = connected_components(star_edges(by_patient.unionByName(by_cluster), "node", "key"))
    return parts.select(F.col("node").alias("study_id"), F.col("component").alias("group_id"))


def _place(frame: pd.DataFrame, names: list[str], want: np.ndarray) -> list[str]:
    """Iterative stratification of one frame of components.

    want holds what each split should get of each label (first column: of studies). The label with the
    fewest unplaced studies comes first; each of its components, large ones first, goes to the split
    that lacks most of the label, then most studies.
    """
    vectors = np.asarray(frame["labels"].tolist(), dtype=float).reshape(len(frame), -1)
    sizes = frame["studies"].to_numpy(dtype=float)
    order = np.lexsort((frame["mark"].to_numpy(), -sizes))
    want, left = want.copy(), vectors.sum(axis=0)
    split, open_ = np.full(len(frame), -1), np.ones(len(frame), dtype=bool)
    while open_.any():
        live = [k for k in range(vectors.shape[1]) if left[k] > 0]
        label = min(live, key=lambda k: (left[k], k)) if live else None
        todo = [i for i in order if open_[i] and (label is None or vectors[i, label] > 0)]
        for i in todo:
            lack = want[:, 0] if label is None else want[:, 1 + label]
            best = max(range(len(names)), key=lambda s: (lack[s], want[s, 0], -s))
            split[i], open_[i] = best, False
            want[best, 0] -= sizes[i]
            want[best, 1:] -= vectors[i]
            left -= vectors[i]
        if label is not None:
            left[label] = 0
    return [names[s] for s in split]


def grouped_splits(
    cases: DataFrame, clusters: DataFrame, shares: dict[str, float], labels: list[str], block: int = 2000
) -> DataFrame:
    """(study_id, group_id, split_name): every study of cases in a split of about its share, whole groups together.

    Components are found first; their label vectors are summed. Components with more than one in
    `block` of all studies are at most `block` many: they are placed first, in one small task. The rest
    is hashed into blocks of about `block` components; each block is placed by itself against its share
    of what the large ones left wanting, so that no task grows with the data. A study counts for a
    label when any of its rows has a positive or uncertain (negative) value; null labels count for nothing. Rows with
    a null or blank study are left out. The same data give the same splits on every run.
    """
    if not shares or min(shares.values()) < 0 or sum(shares.values()) <= 0:
        raise ValueError("shares must be positive")
    names = list(shares)
    portion = np.array([shares[n] for n in names], dtype=float) / sum(shares.values())
    flags = [F.max(F.when(F.coalesce(F.col("labels")[k], F.lit(0.0)) != 0, 1).otherwise(0)).alias(f"l{i}") for i, k in enumerate(labels)]
    studies = cases.select(shared_key(F.col("study_id")).alias("study_id"), "labels").where("study_id is not null")
    studies = studies.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_rows"), *flags)
    tied = tied_studies(cases, clusters)
    grouped = cut_lineage(
        studies.join(tied, "study_id", "left").withColumn("group_id", F.coalesce("group_id", "study_id"))
    )
    counts = F.array(*[F.sum(f"l{i}").cast("double") for i in range(len(labels))])
    parts = grouped.groupBy("group_id").agg(F.count(F.lit(1)).cast("double").alias("studies"), counts.alias("labels"))
    parts = cut_lineage(parts.withColumn("mark", F.xxhash64("group_id")))

    sums = [F.sum("studies")] + [F.sum(F.col("labels")[i]) for i in range(len(labels))]
    total = np.array([x or 0.0 for x in parts.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()])
    want = portion[:, None] * total[None, :]
    large = parts.where(F.col("studies") * block > total[0])
    schema = "group_id string, split_name string, studies double, labels array<double>"

    def place_large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(frames) or [pd.DataFrame()])
        if len(whole):
            yield whole.assign(split_name=_place(whole, names, want))[["group_id", "split_name", "studies", "labels"]]

    first = cut_lineage(large.repartition(1).mapInPandas(place_large, schema))  # at most `block` rows move; the scan keeps its tasks
    got = {r["split_name"]: np.array(r[1:]) for r in first.groupBy("split_name").agg(*sums).collect()}
    want = np.maximum(0.0, want - np.array([got.get(n, np.zeros(len(total))) for n in names]))
    rest = parts.where(F.col("studies") * block <= total[0])
    blocks = max(1, int(np.ceil(rest.count() / block)))
    remaining = np.maximum(want.sum(axis=0), 1e-9)
    fraction = want / remaining[None, :]

    def place_block(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.asarray(frame["labels"].tolist(), dtype=float).reshape(len(frame), -1)
        own = np.concatenate([[frame["studies"].sum()], vectors.sum(axis=0)])
        return pd.DataFrame({"group_id": frame["group_id"], "split_name": _place(frame, names, fraction * own[None, :])})

    small = (
        rest.withColumn("block", F.pmod("mark", F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(place_block, "group_id string, split_name string")
    )
    placed = first.select("group_id", "split_name").unionByName(small)
    return grouped.select("study_id", "group_id").join(placed, "group_id").select("study_id", "group_id", "split_name")

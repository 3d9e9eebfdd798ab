"""Equi-joins whose hot keys adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_one_per_key(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to per_key, which has at most one row of a key; the columns of both, the key once.

    per_key often comes from a groupBy on the key. Spark then leaves the aggregate between its shuffle and the join,
    where adaptive execution can't split a hot key. Joining on an expression of the key gives that side
    a shuffle of its own, after the aggregate, so that both inputs of the join are plain shuffles.
    """
    own = F.concat(F.col(key).cast("string"), F.lit("")).alias("_own")
    right = per_key.select(own, *[c for c in per_key.columns if c != key])
    return rows.join(right, rows[key].cast("string") == right["_own"], how).drop("_own")

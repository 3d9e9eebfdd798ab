"""Sinks; Spark's committer renames finished output into place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_vectors(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Vectors as Parquet, the format that dense search reads."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def to_record(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row, fields in alphabetical order, for content fingerprints."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(name))

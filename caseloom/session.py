"""Sessions, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caseloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; extra settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python needs no installation of it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="caseloom-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where the setting is missing, a temporary folder is taken in local mode only: on a cluster a
    machine-local folder would not survive the loss of an executor, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is None and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="caseloom-"))
        _drop_at_exit(spark, context.getCheckpointDir())
    return context.getCheckpointDir()


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint: it survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it back.

    Used instead of a checkpoint where columns compress well or are read selectively afterwards.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_exit(spark, path)  # not needed beyond the application
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")

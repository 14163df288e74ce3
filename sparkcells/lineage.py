"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A side of a join is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000


def folder(spark: SparkSession) -> str:
    """The shared folder: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, gets a temporary folder where that is
    unset; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it from there, with another schema if one is given.

    The written table survives lost executors. Later plans begin at it, so a table that many
    stages read is computed once, their plans stay small and read only the columns they need.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(schema or df.schema).parquet(path)
    found._written = path
    return found


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; give it written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table that should be short (a row for each group): read once and marked for broadcast, if it has
    at most ``rows`` rows, else as it is."""
    held = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema)) if len(held) <= rows else df


def discard(df: DataFrame) -> None:
    """Delete the table that :func:`cut` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_written", None)
    if path is not None:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)

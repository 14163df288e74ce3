"""Group statistics over a stream of expression rows.

Sums and counts by group and gene are associative, so they stream; what takes a maximum over
groups or a rank needs the finished table and runs on a snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def group_sums(stream: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(grp, gene, total, n_expr) so far; ``stream`` has cell_id, gene, value; obs is a table."""
    labels = obs.select("cell_id", F.col(label).cast("string").alias("grp"))
    return stream.where(F.col("value") != 0).join(labels, "cell_id").groupBy("grp", "gene").agg(F.sum("value").alias("total"), F.count("*").alias("n_expr"))


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) of each window, final once the watermark has passed it."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("start"), key, "n", "total")


def to_memory(rows: DataFrame, name: str, mode: str = "complete") -> DataStreamWriter:
    return rows.writeStream.format("memory").queryName(name).outputMode(mode)

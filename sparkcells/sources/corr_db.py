"""A correlation store: parquet by cell type, sorted by gene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import p_value

#: The catalogue of cell types.
CELL_TYPES = ("B", "ENDO", "EPI", "FIBRO", "MACRO", "T")
CLIP = 0.9999999


def write(corr: DataFrame, sizes: DataFrame, path: str) -> None:
    """Store corr(cell_type, gene_a, gene_b, r) and sizes(cell_type, n) so that one gene's rows are a short read."""
    corr.repartitionByRange("cell_type", "gene_a").sortWithinPartitions("cell_type", "gene_a").write.mode("overwrite").partitionBy("cell_type").parquet(f"{path}/corr")
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")


def cell_types(spark: SparkSession, path: str | None = None) -> list[str]:
    if path is None:
        return list(CELL_TYPES)
    return sorted(r["cell_type"] for r in spark.read.parquet(f"{path}/sizes").select("cell_type").collect())  # a row for each type


def statistic(r: str = "r", n: str = "n"):
    clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col(r)))
    return clipped * F.sqrt((F.col(n) - 2) / (1 - clipped * clipped))


def load(spark: SparkSession, path: str, gene: str, types: Sequence[str] | None = None) -> DataFrame:
    """(condition, gene, corr, t, n) of one gene with all, for the cell types asked for.

    The partitions and the gene are filters of the scan. An unknown cell type or gene is an error.
    """
    known = cell_types(spark, path)
    wanted = list(types) if types is not None else known
    if unknown := sorted(set(wanted) - set(known)):
        raise ValueError(f"unknown cell types: {', '.join(unknown)}")
    rows = spark.read.parquet(f"{path}/corr").where(F.col("cell_type").isin(*wanted) & (F.col("gene_a") == gene))
    if rows.limit(1).count() == 0:
        raise ValueError(f"unknown gene: {gene}")
    found = rows.join(F.broadcast(spark.read.parquet(f"{path}/sizes")), "cell_type")
    return found.select(F.col("cell_type").alias("condition"), F.col("gene_b").alias("gene"), F.col("r").alias("corr"), statistic().alias("t"), "n")


def with_p(loaded: DataFrame) -> DataFrame:
    """With pval; an undefined correlation has 0."""
    return loaded.withColumn("pval", F.coalesce(p_value(F.col("t"), F.col("n") - 2), F.lit(0.0))).drop("t", "n")

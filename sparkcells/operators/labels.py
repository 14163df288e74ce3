"""Low, grey and high labels of groups for each gene, in three levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NotComputedError


def robust_sigma(values: DataFrame, keys: list[str], value: str, method: str = "sd") -> DataFrame:
    """keys, sigma, mean and n of each group: sd (n - 1), iqr / 1.349 or 1.4826 * mad; sigma null under two values."""
    n = F.count(value)
    if method == "sd":
        return values.groupBy(*keys).agg(F.when(n >= 2, F.stddev_samp(value)).alias("sigma"), F.avg(value).alias("mean"), n.alias("n"))
    if method == "iqr":
        spread = (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))) / 1.349
        return values.groupBy(*keys).agg(F.when(n >= 2, spread).alias("sigma"), F.avg(value).alias("mean"), n.alias("n"))
    if method != "mad":
        raise ValueError(f"unknown method: {method}")
    middle = values.groupBy(*keys).agg(F.median(value).alias("middle"))
    far = values.join(middle, keys).withColumn("far", F.abs(F.col(value) - F.col("middle")))
    return far.groupBy(*keys).agg(F.when(n >= 2, 1.4826 * F.median("far")).alias("sigma"), F.avg(value).alias("mean"), n.alias("n"))


def level_1(edge_gene: DataFrame, cutoff: float = 3.0) -> DataFrame:
    """(gene, grp, l1): -1 where an edge starts, 1 where one ends, 0 where both happen."""
    rows = edge_gene.where(F.col("fc") >= cutoff)
    marks = rows.select("gene", F.col("start").alias("grp"), F.lit(-1).alias("mark")).union(rows.select("gene", F.col("end").alias("grp"), F.lit(1).alias("mark")))
    return marks.groupBy("gene", "grp").agg(F.when(F.min("mark") == F.max("mark"), F.min("mark")).otherwise(0).alias("l1"))


def label_levels(stats: DataFrame, edge_gene: DataFrame, cutoff: float = 3.0, k: float = 2.0, sigma: str = "sd", min_gap: float = 0.2, min_margin: float = 0.0, check: bool = False) -> DataFrame:
    """(gene, grp, mean_norm, l1, l2, l3) for all groups of the genes that level 1 labels.

    Level 2 starts anew: low up to the largest mean of level 1's low groups, high from the least
    of its high ones (high wins). Level 3 labels what is left grey, within k sigma of either side,
    where both sides have three groups and their ranges are apart.
    """
    seeds = level_1(edge_gene, cutoff)
    if check and seeds.limit(1).count() == 0:
        raise NotComputedError("no gene passes the cutoff")
    genes = seeds.select("gene").distinct()
    rows = stats.select("gene", "grp", "mean_norm").join(genes, "gene", "left_semi").join(seeds, ["gene", "grp"], "left")
    rows = rows.withColumn("l1", F.coalesce("l1", F.lit(0)))
    gene = Window.partitionBy("gene")
    low = F.max(F.when(F.col("l1") == -1, F.col("mean_norm"))).over(gene)
    high = F.min(F.when(F.col("l1") == 1, F.col("mean_norm"))).over(gene)
    rows = rows.withColumn("l2", F.when(F.col("mean_norm") >= high, 1).when(F.col("mean_norm") <= low, -1).otherwise(0))
    sides = _sides(rows, sigma)
    lower, upper = F.col("low_mean") + k * F.col("low_sigma"), F.col("high_mean") - k * F.col("high_sigma")
    fine = (F.col("low_n") >= 3) & (F.col("high_n") >= 3) & (lower < upper) & (F.col("high_mean") - F.col("low_mean") >= min_gap) & (upper - lower >= min_margin)
    pushed = F.when(F.col("l2") != 0, F.col("l2")).when(fine & (F.col("mean_norm") >= upper), 1).when(fine & (F.col("mean_norm") <= lower), -1).otherwise(0)
    return rows.join(sides, "gene", "left").select("gene", "grp", "mean_norm", "l1", "l2", pushed.alias("l3"))


def _sides(rows: DataFrame, method: str) -> DataFrame:
    marked = rows.where("l2 <> 0").select("gene", "l2", "mean_norm")
    each = robust_sigma(marked, ["gene", "l2"], "mean_norm", method)

    def side(name: str, mark: int) -> list[Column]:
        return [F.max(F.when(F.col("l2") == mark, F.col(c))).alias(f"{name}_{c}") for c in ("mean", "sigma", "n")]

    return each.groupBy("gene").agg(*side("low", -1), *side("high", 1))


def note(labels: DataFrame, level: int = 3) -> DataFrame:
    """(gene, grp, mean_norm, label) of one level."""
    if level not in (1, 2, 3):
        raise ValueError("level is 1, 2 or 3")
    return labels.select("gene", "grp", "mean_norm", F.col(f"l{level}").alias("label"))

"""Gene features, scores and ranks of group markers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPS, global_score, local_score, stable, weight
from .edges import coverage, dst_max


def gene_features(notes: DataFrame, edge_gene: DataFrame) -> DataFrame:
    """(gene, n_low, n_grey, n_high, max_fc, mean_fc, max_delta, mean_delta, n_edges, gap) of genes with labels and edges.

    gap is the least mean_norm of the high groups less the largest of the low ones; null unless both exist.
    """
    mark, mean = F.col("label"), F.col("mean_norm")
    counts = notes.groupBy("gene").agg(
        F.count_if(mark == -1).alias("n_low"), F.count_if(mark == 0).alias("n_grey"), F.count_if(mark == 1).alias("n_high"),
        (F.min(F.when(mark == 1, mean)) - F.max(F.when(mark == -1, mean))).alias("gap"),
    )
    rise, step = F.when(F.col("fc") > 0, F.col("fc")), F.when(F.col("delta") > 0, F.col("delta"))
    edges = edge_gene.groupBy("gene").agg(F.max(rise).alias("max_fc"), F.avg(rise).alias("mean_fc"), F.max(step).alias("max_delta"), F.avg(step).alias("mean_delta"), F.count(rise).alias("n_edges"))
    return counts.join(edges, "gene").select("gene", "n_low", "n_grey", "n_high", "max_fc", "mean_fc", "max_delta", "mean_delta", "n_edges", "gap")


def marker_inputs(stats: DataFrame, edges: DataFrame, notes: DataFrame, features: DataFrame, only_high: bool = True, eps: float = EPS) -> DataFrame:
    """A row for each (labelled high) group and gene with all that the scores take."""
    pairs = notes.where("label = 1") if only_high else notes
    pairs = pairs.select("grp", "gene", "label")
    some = stats.join(pairs.select("gene").distinct(), "gene", "left_semi")
    rises = dst_max(some, edges, eps).withColumnRenamed("max_fc", "max_fc_dst").withColumnRenamed("max_delta", "max_delta_dst")
    rows = pairs.join(rises, ["grp", "gene"], "left").join(coverage(some, edges), ["grp", "gene"], "left")
    return rows.join(features, "gene", "left")


def scores(inputs: DataFrame, a: float = 1.0, b: float = 0.5) -> DataFrame:
    """The inputs with local_score, global_score and specific_weight."""
    rows = inputs.withColumn("local_score", local_score(F.col("max_fc_dst"), F.col("max_delta_dst"), F.col("coverage"), F.col("rest"), F.col("neighbor")))
    rows = rows.withColumn("global_score", global_score(F.col("gap"), F.col("n_low"), F.col("n_grey"), F.col("n_high")))
    return rows.withColumn("specific_weight", weight(F.col("local_score"), F.col("global_score"), a, b))


def rank(scored: DataFrame, score_col: str = "specific_weight", score_fn: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """With the rank in each group: score downwards, undefined last, ties by gene. score_fn gives the score instead."""
    rows = scored if score_fn is None else scored.withColumn(score_col, score_fn(scored))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(stable(F.col(score_col)).desc_nulls_last(), "gene")))


def top(markers: DataFrame, n: int = 10) -> DataFrame:
    return markers.where(F.col("rank") <= n)

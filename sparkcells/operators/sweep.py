"""Sweeps of the fold-change threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import linspace
from ..model import NotComputedError
from .edges import fc_delta


def baseline(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """All edge genes at a fold change of 1 or more; the other limits are the defaults."""
    return fc_delta(stats, edges, thres_fc=1.0)


def run(base: DataFrame, thresholds: Sequence[float], ground_truth: Sequence[str] = ()) -> DataFrame:
    """A row for each threshold: pairs, genes, covered and uncovered directed edges, genes a covered edge.

    An edge is one seen in ``base``; thresholds without a pair have zeros. With ground_truth also
    gt_genes, the given genes of ``base`` that survive. The thresholds are few.
    """
    limits = base.sparkSession.createDataFrame([(float(t),) for t in sorted(set(thresholds))], "threshold double")
    total = base.select("start", "end").distinct().agg(F.count("*").alias("total"))
    hit = base.join(F.broadcast(limits), F.col("fc") >= F.col("threshold"))
    each = hit.groupBy("threshold", "start", "end").agg(F.count("*").alias("pairs"), F.count_distinct("gene").alias("genes"))
    covered = each.groupBy("threshold").agg(
        F.sum("pairs").alias("n_pairs"), F.count("*").alias("n_edges_covered"), F.median("genes").alias("median_genes"), F.min("genes").alias("min_genes"), F.max("genes").alias("max_genes"),
    )
    genes = hit.groupBy("threshold").agg(F.count_distinct("gene").alias("n_genes"), F.count_distinct(F.when(F.col("gene").isin(*ground_truth), F.col("gene")) if ground_truth else F.lit(None)).alias("gt_genes"))
    found = limits.join(covered, "threshold", "left").join(genes, "threshold", "left").crossJoin(F.broadcast(total)).fillna(0)  # one row
    columns = ["threshold", "n_pairs", "n_genes", "n_edges_covered", (F.col("total") - F.col("n_edges_covered")).alias("n_edges_uncovered"), "median_genes", "min_genes", "max_genes"]
    return found.select(*columns, *(["gt_genes"] if ground_truth else []))


def auto(base: DataFrame, steps: int = 10, ground_truth: Sequence[str] = ()) -> DataFrame:
    """A coarse sweep to the 95th percentile, then a fine one around the first uncovered threshold."""
    high = base.agg(F.percentile("fc", F.lit(0.95)).alias("high")).first()["high"]
    if high is None:
        raise NotComputedError("no edge has a gene at a fold change of 1")
    coarse = run(base, linspace(1.0, max(high, 2.0), steps), ground_truth)
    seen = coarse.select("threshold", "n_edges_uncovered").orderBy("threshold").collect()  # a row for each step
    first = next((k for k, r in enumerate(seen) if r["n_edges_uncovered"] > 0), None)
    if first is None:
        return coarse
    low, top = seen[max(first - 1, 0)]["threshold"], seen[min(first + 1, len(seen) - 1)]["threshold"]
    return run(base, linspace(low, top, steps), ground_truth).unionByName(coarse.where(F.col("threshold") > top))


def suggest(sweep: DataFrame) -> float:
    """The largest threshold that leaves no edge uncovered, else the smallest of all."""
    row = sweep.agg(F.max(F.when(F.col("n_edges_uncovered") == 0, F.col("threshold"))).alias("best"), F.min("threshold").alias("least")).first()
    return row["best"] if row["best"] is not None else row["least"]

"""Markers by gaps between group means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable
from .ranktest import rank_genes
from .stats import grid


def eligible(stats: DataFrame, min_count: int) -> DataFrame:
    """Grid rows with enough expressing cells, mean_norm taken over those groups alone; all-zero genes go."""
    top = F.max("mean").over(Window.partitionBy("gene"))
    rows = stats.where(F.col("n_expr") >= min_count).withColumn("top", top).where("top > 0")
    return rows.withColumn("mean_norm", F.col("mean") / F.col("top")).drop("top")


def find(stats: DataFrame, mode: str = "single", gap: float = 0.2, min_mean: float = 0.2, min_frac: float = 0.2, min_count: int = 10, targets: Sequence[str] = ()) -> DataFrame:
    """(grp, gene, score) of each gene's marker, if any; ties between groups go by name.

    single: the top group, by its lead over the second (a gene of one group by its mean_norm).
    multiple: the top group, if any two neighbouring groups are a gap apart; the score is the
    lowest such gap. negative: the bottom group, by its distance below the next. groups: the
    least of ``targets`` over the largest of the rest; grp is null.
    """
    rows = eligible(stats, min_count)
    if mode == "groups":
        inside = F.col("grp").isin(*targets)
        scored = rows.groupBy("gene").agg(
            F.min(F.when(inside, F.col("mean_norm"))).alias("low"), F.max(F.when(~inside, F.col("mean_norm"))).alias("high"),
        )
        # every target has to reach the mean, those with too few cells included
        means = stats.where(inside).groupBy("gene").agg(F.min("mean").alias("least"))
        scored = scored.join(means, "gene").withColumn("score", F.col("low") - F.col("high"))
        return scored.where((F.col("score") > gap) & (F.col("least") >= min_mean)).select(F.lit(None).cast("string").alias("grp"), "gene", "score")
    down = Window.partitionBy("gene").orderBy(F.desc("mean_norm"), "grp")
    up = Window.partitionBy("gene").orderBy("mean_norm", F.desc("grp"))
    passes = (F.col("mean") >= min_mean) & (F.col("frac_expr") >= min_frac)
    if mode == "negative":
        ranked = rows.withColumn("place", F.row_number().over(up)).withColumn("score", F.lead("mean_norm").over(up) - F.col("mean_norm"))
        return ranked.where((F.col("place") == 1) & (F.col("score") > gap)).select("grp", "gene", "score")
    if mode == "single":
        ranked = rows.withColumn("place", F.row_number().over(down)).withColumn("score", F.col("mean_norm") - F.coalesce(F.lead("mean_norm").over(down), F.lit(0.0)))
        return ranked.where((F.col("place") == 1) & (F.col("score") > gap) & passes).select("grp", "gene", "score")
    if mode != "multiple":
        raise ValueError(f"unknown mode: {mode}")
    step = F.lead("mean_norm").over(up) - F.col("mean_norm")
    ranked = rows.withColumn("step", step).withColumn("height", F.row_number().over(up)).withColumn("place", F.row_number().over(down))
    top = F.max_by(F.struct("grp", "mean", "frac_expr"), "height")
    found = ranked.groupBy("gene").agg(top.alias("top"), F.min_by(F.when(F.col("step") > gap, F.col("step")), F.when(F.col("step") > gap, F.col("height"))).alias("score"))
    return found.select("top.*", "gene", "score").where(F.col("score").isNotNull() & passes).select("grp", "gene", "score")


def ranked(markers: DataFrame) -> DataFrame:
    """Markers with their rank in the group: score downwards, ties by gene."""
    return markers.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(stable(F.col("score")).desc_nulls_last(), "gene")))


class SimpleMarkers:
    """Statistics of a labelling and the markers found on them."""

    def __init__(self, expr: DataFrame, obs: DataFrame, label: str, single: bool = True, gap: float = 0.2, min_mean: float = 0.2, min_frac: float = 0.2, min_count: int = 10, exclude: Sequence[str] = (), run_test: bool = False):
        self.ranked_genes = rank_genes(expr, obs, label) if run_test else None  # every gene by Welch's test against all other cells
        self.stats = grid(expr, obs, label, exclude=exclude)
        self.options = {"gap": gap, "min_mean": min_mean, "min_frac": min_frac}
        self.markers = ranked(find(self.stats, "single" if single else "multiple", min_count=min_count, **self.options))

    def show(self, group: str, n: int = 40) -> DataFrame:
        return self.markers.where(F.col("grp") == group).orderBy(F.desc("score"), "gene").limit(n)

    def of_groups(self, targets: Sequence[str], min_count: int = 0) -> DataFrame:
        return find(self.stats, "groups", min_count=min_count, targets=targets, **self.options)

    def negative(self, min_count: int = 0) -> DataFrame:
        return find(self.stats, "negative", min_count=min_count, **self.options)

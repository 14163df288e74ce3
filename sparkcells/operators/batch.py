"""Batch-aware statistics: group means by batch and Welch's test on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import p_value
from ..lineage import few
from .stats import group_sums


def batch_sizes(obs: DataFrame, label: str, batch: str) -> DataFrame:
    return obs.groupBy(F.col(label).cast("string").alias("grp"), F.col(batch).cast("string").alias("batch")).agg(F.count("*").alias("n_cells"))


def batch_means(expr: DataFrame, obs: DataFrame, label: str, batch: str, min_cells: int = 5, genes: DataFrame | None = None) -> DataFrame:
    """(grp, batch, gene, n_cells, mean, frac): for every gene and every batch that a group has.

    mean is null under ``min_cells`` cells; genes: a table (gene) to keep to.
    """
    some = expr if genes is None else expr.join(genes.select("gene").distinct(), "gene", "left_semi")
    sums = group_sums(some, obs, {"grp": label, "batch": batch})
    own = some.select("gene").distinct() if genes is None else genes.select("gene").distinct()
    dense = own.crossJoin(few(batch_sizes(obs, label, batch))).join(sums, ["grp", "batch", "gene"], "left")
    mean = F.coalesce("total", F.lit(0.0)) / F.col("n_cells")
    return dense.select("grp", "batch", "gene", "n_cells", F.when(F.col("n_cells") >= min_cells, mean).alias("mean"), (F.coalesce("n_expr", F.lit(0)) / F.col("n_cells")).alias("frac"))


def welch(edge_gene: DataFrame, means: DataFrame, min_batches: int = 3) -> DataFrame:
    """The edge rows with t, df, ttest_n_start and ttest_n_end: Welch's test of end against start over batches.

    t and df are null if a side has fewer than ``min_batches`` means or both vary by nothing.
    """
    side = means.groupBy("grp", "gene").agg(F.count("mean").alias("n"), F.avg("mean").alias("m"), F.when(F.count("mean") >= 2, F.var_samp("mean")).alias("v"))
    start = side.select(F.col("grp").alias("start"), "gene", F.col("n").alias("n_s"), F.col("m").alias("m_s"), F.col("v").alias("v_s"))
    end = side.select(F.col("grp").alias("end"), "gene", F.col("n").alias("n_e"), F.col("m").alias("m_e"), F.col("v").alias("v_e"))
    rows = edge_gene.join(start, ["start", "gene"], "left").join(end, ["end", "gene"], "left")
    rows = rows.withColumn("n_s", F.coalesce("n_s", F.lit(0))).withColumn("n_e", F.coalesce("n_e", F.lit(0)))
    a, b = F.col("v_s") / F.col("n_s"), F.col("v_e") / F.col("n_e")
    fine = (F.col("n_s") >= min_batches) & (F.col("n_e") >= min_batches) & (F.col("n_s") >= 2) & (F.col("n_e") >= 2)
    spread = F.when(fine, a + b)
    t = F.when(spread > 0, (F.col("m_e") - F.col("m_s")) / F.sqrt(spread))
    df = F.when(spread > 0, spread * spread / (a * a / (F.col("n_s") - 1) + b * b / (F.col("n_e") - 1)))
    return rows.select(*edge_gene.columns, t.alias("t"), df.alias("df"), F.col("n_s").alias("ttest_n_start"), F.col("n_e").alias("ttest_n_end"))


def with_p(tested: DataFrame) -> DataFrame:
    return tested.withColumn("ttest_pval", p_value(F.col("t"), F.col("df")))


def significant(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rows without a p value, or with one below ``alpha``."""
    rows = tested if "ttest_pval" in tested.columns else with_p(tested)
    return rows.where(F.col("ttest_pval").isNull() | (F.col("ttest_pval") < alpha))


def summary(tested: DataFrame) -> DataFrame:
    """(grp, gene, ttest_pval, ttest_n_start, ttest_n_end): the least of each over a gene's edges into a group."""
    rows = tested.where(F.col("ttest_pval").isNotNull())
    return rows.groupBy(F.col("end").alias("grp"), "gene").agg(*[F.min(c).alias(c) for c in ("ttest_pval", "ttest_n_start", "ttest_n_end")])


def detail(edge_gene: DataFrame, means: DataFrame, grp: str, gene: str) -> DataFrame:
    """(start, end, side, batch, n_cells, mean): the batch means of both sides of each edge into a group."""
    edges = edge_gene.where((F.col("end") == grp) & (F.col("gene") == gene)).select("start", "end").distinct()
    sides = edges.select("start", "end", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("grp")), F.struct(F.lit("end").alias("side"), F.col("end").alias("grp")))).alias("x"))
    own = means.where(F.col("gene") == gene).select("grp", "batch", "n_cells", "mean")
    return sides.select("start", "end", "x.side", "x.grp").join(own, "grp").select("start", "end", "side", "batch", "n_cells", "mean")


def by_batch(expr: DataFrame, obs: DataFrame, label: str, batch: str, genes: DataFrame) -> DataFrame:
    """(grp, gene, batch, n_cells, mean, share, active, place): every group, gene and batch in drawing order.

    active: the group has cells in the batch. share is the mean over the largest of the active
    batches (over 1 if that is 0). Active batches come first, the largest first, ties by name.
    """
    sizes = batch_sizes(obs, label, batch)
    cells = sizes.select("grp").distinct().crossJoin(few(sizes.select("batch").distinct()))
    cells = few(cells.join(sizes, ["grp", "batch"], "left").fillna(0, ["n_cells"]))
    own = genes.select("gene").distinct()
    sums = group_sums(expr.join(own, "gene", "left_semi"), obs, {"grp": label, "batch": batch})
    rows = own.crossJoin(cells).join(sums, ["grp", "batch", "gene"], "left")
    mean = F.when(F.col("n_cells") > 0, F.coalesce("total", F.lit(0.0)) / F.col("n_cells")).otherwise(0.0)
    rows = rows.select("grp", "gene", "batch", "n_cells", mean.alias("mean"), (F.col("n_cells") > 0).alias("active"))
    gene = Window.partitionBy("grp", "gene")
    top = F.max(F.when(F.col("active"), F.col("mean"))).over(gene)
    rows = rows.withColumn("share", F.when(top > 0, F.col("mean") / top).otherwise(F.col("mean")))
    place = F.row_number().over(gene.orderBy(F.desc("active"), F.desc("share"), "batch"))
    return rows.select("grp", "gene", "batch", "n_cells", "mean", "share", "active", place.alias("place"))

"""Group statistics over sparse expression: zeros that aren't stored count."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import few
from ..model import GroupKeyError


def group_sizes(obs: DataFrame, label: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(grp, idx, n_cells) of every label but the excluded; idx is the place by name. Null labels are no group."""
    if label not in obs.columns:
        raise GroupKeyError(label)
    rows = obs.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("grp")).agg(F.count("*").alias("n_cells"))
    rows = rows.where(~F.col("grp").isin(*exclude)) if exclude else rows
    return rows.select("grp", (F.row_number().over(Window.orderBy("grp")) - 1).alias("idx"), "n_cells")  # a row for each group


def group_sums(expr: DataFrame, obs: DataFrame, keys: dict[str, str], every: bool = False) -> DataFrame:
    """Sum and number of expressing cells by the label columns ``keys`` (new name -> column) and gene.

    every: cells that aren't in obs count too, under null labels.
    """
    labels = obs.select("cell_id", *[F.col(c).cast("string").alias(k) for k, c in keys.items()])
    joined = expr.where(F.col("value") != 0).join(labels, "cell_id", "left" if every else "inner")
    return joined.groupBy(*keys, "gene").agg(F.sum("value").alias("total"), F.count("*").alias("n_expr"))


def grid(expr: DataFrame, obs: DataFrame, label: str, exclude: Sequence[str] = (), min_cells: int = 0, min_expr_cells: int = 0, drop_small: bool = False) -> DataFrame:
    """(grp, gene, n_cells, mean, n_expr, frac_expr, mean_norm) of every group and gene, zeros included.

    Groups under ``min_cells`` cells are all zero, or absent with ``drop_small``. The mean of a
    gene is 0 where fewer than ``min_expr_cells`` cells express it. mean_norm is the mean over the
    gene's largest mean, 0 where that is 0. The groups are counted before they are broadcast.
    """
    sizes = group_sizes(obs, label, exclude).drop("idx")
    if drop_small:
        sizes = sizes.where(F.col("n_cells") >= min_cells)
    # one pass over expr: a gene's sums are folded to a map of its groups, and that is laid out over all groups
    sums = group_sums(expr, obs, {"grp": label}, every=True)
    own = F.when(F.col("grp").isNotNull(), F.struct("grp", F.struct("total", "n_expr")))
    folded = sums.groupBy("gene").agg(F.map_from_entries(F.collect_list(own)).alias("own"))
    cell = F.element_at("own", F.col("grp"))
    dense = folded.crossJoin(few(sizes)).select("grp", "gene", "n_cells", cell["total"].alias("total"), cell["n_expr"].alias("n_expr"))
    enough = F.col("n_cells") >= max(min_cells, 1)
    n_expr = F.when(enough, F.coalesce("n_expr", F.lit(0))).otherwise(0)
    dense = dense.select("grp", "gene", "n_cells", F.when(enough, F.coalesce("total", F.lit(0.0)) / F.col("n_cells")).otherwise(0.0).alias("mean"), n_expr.cast("long").alias("n_expr"))
    mean = F.when(F.col("n_expr") < min_expr_cells, 0.0).otherwise(F.col("mean"))
    dense = dense.select("grp", "gene", "n_cells", mean.alias("mean"), "n_expr", F.when(F.col("n_cells") > 0, F.col("n_expr") / F.col("n_cells")).otherwise(0.0).alias("frac_expr"))
    return with_mean_norm(dense)


def with_mean_norm(dense: DataFrame) -> DataFrame:
    top = F.max("mean").over(Window.partitionBy("gene"))
    return dense.withColumn("mean_norm", F.when(top > 0, F.col("mean") / top).otherwise(0.0))


def dot_table(expr: DataFrame, obs: DataFrame, label: str, var_names: Sequence[str] | dict, groups: Sequence[str] | None = None) -> DataFrame:
    """(place, section, gene, grp, size, colour) of a dot plot: fraction expressing and mean over the largest mean.

    var_names: names, or section -> names (or (name, score) pairs), in order; duplicates stay,
    unknown genes and empty sections go. The subset of groups is taken before the scale.
    """
    sections = var_names if isinstance(var_names, dict) else {"": var_names}
    listed = [(section, name[0] if isinstance(name, tuple) else name) for section, names in sections.items() for name in names]
    wanted = expr.sparkSession.createDataFrame([(k, s, g) for k, (s, g) in enumerate(listed)], "place int, section string, gene string")
    some = expr.join(F.broadcast(wanted.select("gene").distinct()), "gene", "left_semi")
    cells = obs if groups is None else obs.where(F.col(label).cast("string").isin(*groups))
    table = grid(some, cells, label).select("gene", "grp", F.col("frac_expr").alias("size"), F.col("mean_norm").alias("colour"))
    return F.broadcast(wanted).join(table, "gene").select("place", "section", "gene", "grp", "size", "colour")


def scaled(expr: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """Each value over the largest group mean of its gene (1 if that is 0)."""
    top = grid(expr, obs, label).groupBy("gene").agg(F.max("mean").alias("top"))
    return expr.join(top, "gene").select("cell_id", "gene", (F.col("value") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("value"))


def value_range(expr: DataFrame) -> DataFrame:
    """One row: the least and largest value, zeros that aren't stored included."""
    return expr.agg(F.least(F.min("value"), F.lit(0.0)).alias("low"), F.greatest(F.max("value"), F.lit(0.0)).alias("high"))


def value_check(expr: DataFrame, most: float = 30.0) -> DataFrame:
    """The row of :func:`log1p_check`; negative values are an error, values above ``most`` a warning."""
    found = log1p_check(expr, most)
    row = found.first()
    if row["low"] is not None and row["low"] < 0:
        raise ValueError(f"the values go down to {row['low']}; log1p-normalised values are never negative")
    if row["high"] is not None and row["high"] > most:
        warnings.warn(f"the values go up to {row['high']}; they may not be log1p-normalised", stacklevel=2)
    return found


def log1p_check(expr: DataFrame, most: float = 15.0) -> DataFrame:
    """One row: whether the values look like log1p data (none negative, none above ``most``).

    The whole table is checked, since a DataFrame has no first rows.
    """
    return value_range(expr).select("low", "high", ((F.col("low") >= 0) & (F.col("high") <= most)).alias("passes"))


def resolve_expression(expr: DataFrame, raw: DataFrame | None = None) -> tuple[DataFrame, str]:
    """The first of expr and raw that passes the log1p check, and its name."""
    for name, table in (("expr", expr), ("raw", raw)):
        if table is not None and log1p_check(table).first()["passes"]:
            return table, name
    raise ValueError("neither table holds log1p-normalised values")


def qc_metrics(counts: DataFrame, mito: Column | None = None) -> DataFrame:
    """(cell_id, total_counts, n_genes, pct_mt) of each cell; ``mito`` selects mitochondrial genes."""
    flag = F.coalesce(mito, F.lit(False)) if mito is not None else F.lit(False)
    seen = F.col("n") > 0
    rows = counts.groupBy("cell_id").agg(F.sum("n").alias("total_counts"), F.count_if(seen).alias("n_genes"), F.sum(F.when(flag, F.col("n")).otherwise(0.0)).alias("mt"))
    return rows.select("cell_id", "total_counts", "n_genes", F.when(F.col("total_counts") > 0, 100 * F.col("mt") / F.col("total_counts")).alias("pct_mt"))


def qc_filter(metrics: DataFrame, min_counts: float = 1000, min_genes: int = 500, max_genes: int = 7000, max_mito: float = 0.5) -> DataFrame:
    """Cells within the limits, all of them strict; max_mito is a fraction."""
    fine = (F.col("total_counts") > min_counts) & (F.col("n_genes") > min_genes) & (F.col("n_genes") < max_genes)
    return metrics.where(fine & (F.coalesce("pct_mt", F.lit(0.0)) / 100 < max_mito))


def mito_gene(gene: Column, species: str = "human") -> Column:
    prefixes = {"human": "MT-", "mouse": "mt-"}
    if species not in prefixes:
        raise ValueError(f"unknown species: {species}")
    return gene.startswith(prefixes[species])


def normalize(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell_id, gene, value): counts scaled to a total of ``target`` a cell, then log1p."""
    from ..sources.bindings import normalised

    return normalised(counts, target)


def to_total(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell_id, gene, value): counts scaled to a total of ``target`` a cell."""
    total = counts.groupBy("cell_id").agg(F.sum("n").alias("total"))
    return counts.select("cell_id", "gene", "n").join(total, "cell_id").select("cell_id", "gene", (F.lit(target) * F.col("n") / F.col("total")).alias("value"))


def z_scores(expr: DataFrame, n_cells: int, most: float = 10.0) -> DataFrame:
    """Non-zero cells' z-scores by gene over all cells, clipped at ``most``; zeros have the gene's ``zero`` score."""
    moments = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    moments = moments.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - n_cells * mean * mean) / (n_cells - 1))).alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    score = lambda x: F.least(F.lit(most), (x - F.col("mean")) / sd)
    return expr.join(moments, "gene").select("cell_id", "gene", score(F.col("value")).alias("z"), score(F.lit(0.0)).alias("zero"))


def dispersion(expr: DataFrame, n_cells: int) -> DataFrame:
    """(gene, mean, variance, dispersion, detected) over all cells; variance over n - 1."""
    sums = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") > 0).alias("detected"))
    mean = F.col("s") / n_cells
    variance = F.greatest(F.lit(0.0), (F.col("q") - n_cells * mean * mean) / (n_cells - 1))
    return sums.select("gene", mean.alias("mean"), variance.alias("variance"), F.when(mean > 0, variance / mean).alias("dispersion"), "detected")

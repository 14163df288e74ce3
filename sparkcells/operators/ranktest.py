"""Genes of each group ranked by Welch's test against all other cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable
from ..lineage import few
from .stats import group_sizes


def rank_genes(expr: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(grp, gene, t, df, rank): from sums over each group and the whole, zeros included.

    Undefined statistics (under two cells on a side, nothing varies) are null and come last; ties go by gene.
    """
    sizes = group_sizes(obs, label).drop("idx")
    sizes = sizes.withColumn("n_rest", F.sum("n_cells").over(Window.partitionBy(F.lit(1))) - F.col("n_cells"))  # a row for each group
    labels = obs.select("cell_id", F.col(label).cast("string").alias("grp")).where("grp is not null")
    rows = expr.where(F.col("value") != 0).join(labels, "cell_id")
    sums = rows.groupBy("grp", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    total = sums.groupBy("gene").agg(F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    dense = total.crossJoin(few(sizes)).join(sums, ["grp", "gene"], "left").fillna(0.0, ["s", "q"])
    n, m = F.col("n_cells"), F.col("n_rest")
    rest_s, rest_q = F.col("all_s") - F.col("s"), F.col("all_q") - F.col("q")
    fine = (n > 1) & (m > 1)
    own = F.when(fine, F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / n) / (n - 1) / n)
    other = F.when(fine, F.greatest(F.lit(0.0), rest_q - rest_s * rest_s / m) / (m - 1) / m)
    found = dense.select("grp", "gene", "n_cells", "n_rest", (F.col("s") / n - F.when(m > 0, rest_s / m)).alias("step"), own.alias("a"), other.alias("b"))
    spread = F.col("a") + F.col("b")
    t = F.when(spread > 1e-15, F.col("step") / F.sqrt(spread))
    df = F.when(spread > 1e-15, spread * spread / (F.col("a") * F.col("a") / (n - 1) + F.col("b") * F.col("b") / (m - 1)))
    found = found.select("grp", "gene", t.alias("t"), df.alias("df"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(stable(F.col("t")).desc_nulls_last(), "gene")))

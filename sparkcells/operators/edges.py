"""Group graphs and what its edges say of genes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import EPS, edge_name, fold_change, stable


def profile_similarity(stats: DataFrame) -> DataFrame:
    """(g1, g2, weight): cosines of the groups' mean profiles, both directions, none with itself."""
    mean = stats.where("mean <> 0").select("grp", "gene", "mean")
    norm = mean.groupBy("grp").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    left = mean.select("gene", F.col("grp").alias("g1"), F.col("mean").alias("m1"))
    right = mean.select("gene", F.col("grp").alias("g2"), F.col("mean").alias("m2"))
    dots = left.join(right, "gene").where("g1 <> g2").groupBy("g1", "g2").agg(F.sum(F.col("m1") * F.col("m2")).alias("dot"))
    dots = dots.join(F.broadcast(norm.select(F.col("grp").alias("g1"), F.col("norm").alias("n1"))), "g1")
    dots = dots.join(F.broadcast(norm.select(F.col("grp").alias("g2"), F.col("norm").alias("n2"))), "g2")
    return dots.select("g1", "g2", (F.col("dot") / (F.col("n1") * F.col("n2"))).alias("weight"))


def connectivity(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(g1, g2, weight) of a cell graph: observed edges between two groups over those expected at random, at most 1.

    labels: (cell_id, grp). With e_i edge ends at group i of size n_i among n cells, the expected
    number of edges between i and j is (e_i n_j + e_j n_i) / (n - 1).
    """
    a = labels.select(F.col("cell_id").alias("src"), F.col("grp").alias("g1"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("grp").alias("g2"))
    ends = knn.select("src", "dst").where("src <> dst")
    between = ends.join(a, "src").join(b, "dst").groupBy("g1", "g2").agg(F.count("*").alias("n"))
    sizes = labels.groupBy("grp").agg(F.count("*").alias("cells"))
    out = between.groupBy("g1").agg(F.sum("n").alias("ends"))
    group = sizes.join(out, sizes["grp"] == out["g1"], "left").select("grp", "cells", F.coalesce("ends", F.lit(0)).alias("ends"))
    total = sizes.agg(F.sum("cells").alias("total"))
    both = between.where("g1 <> g2").unionByName(between.where("g1 <> g2").select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "n")).groupBy("g1", "g2").agg(F.sum("n").alias("n"))
    left = group.select(F.col("grp").alias("g1"), F.col("cells").alias("c1"), F.col("ends").alias("e1"))
    right = group.select(F.col("grp").alias("g2"), F.col("cells").alias("c2"), F.col("ends").alias("e2"))
    rows = both.join(F.broadcast(left), "g1").join(F.broadcast(right), "g2").crossJoin(F.broadcast(total))  # one row
    expected = (F.col("e1") * F.col("c2") + F.col("e2") * F.col("c1")) / (F.col("total") - 1)
    return rows.where((F.col("total") > 1) & (expected > 0)).select("g1", "g2", F.least(F.lit(1.0), F.col("n") / expected).alias("weight"))


def top_k_symmetric(weights: DataFrame, k: int = 5) -> DataFrame:
    """(g1, g2, weight) kept if it is among the k largest positive of g1 or of g2; ties go to the smaller name."""
    best = Window.partitionBy("g1").orderBy(stable(F.col("weight")).desc(), "g2")
    top = weights.where("g1 <> g2 AND weight > 0").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    chosen = top.select("g1", "g2").union(top.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"))).distinct()
    return weights.join(chosen, ["g1", "g2"], "left_semi")


def undirected(weights: DataFrame) -> DataFrame:
    """(a, b) with a < b, once for each pair."""
    return weights.where("g1 <> g2").select(F.least("g1", "g2").alias("a"), F.greatest("g1", "g2").alias("b")).distinct()


def cast_nodes(edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The node columns as whole numbers, if every node's name is one; else as they are."""
    whole = [F.coalesce(F.bool_and(F.col(c).rlike("^-?[0-9]+$")), F.lit(True)) for c in columns]
    fits = edges.agg(reduce(lambda a, b: a & b, whole).alias("fits"), F.count("*").alias("n")).first()
    return edges.withColumns({c: F.col(c).cast("long") for c in columns}) if fits["fits"] and fits["n"] else edges


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v) for both directions of each edge (a, b)."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def group_pairs(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """The grid rows of both ends of each edge side by side: the high end is a on ties. The edges are few."""
    cols = ["mean_norm", "frac_expr", "n_expr"]
    a = stats.select(F.col("grp").alias("a"), "gene", *[F.col(c).alias(f"{c}_a") for c in cols])
    b = stats.select(F.col("grp").alias("b"), "gene", *[F.col(c).alias(f"{c}_b") for c in cols])
    rows = a.join(F.broadcast(edges.select("a", "b")), "a").join(b, ["b", "gene"])
    first = F.col("mean_norm_a") >= F.col("mean_norm_b")
    pick = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    return rows.select(
        "gene", pick("b", "a").alias("start"), pick("a", "b").alias("end"),
        pick("mean_norm_a", "mean_norm_b").alias("high"), pick("mean_norm_b", "mean_norm_a").alias("low"),
        pick("frac_expr_a", "frac_expr_b").alias("frac_high"), F.greatest("n_expr_a", "n_expr_b").alias("n_any"),
    )


def fc_delta(
    stats: DataFrame, edges: DataFrame, thres_fc: float = 3.0, eps: float = EPS, min_mean_any: float = 0.05, min_mean_high: float = 0.5,
    min_frac_high: float = 0.2, max_mean_low: float = 0.2, min_nexpr_any: int = 0,
) -> DataFrame:
    """(start, end, gene, fc, delta): genes that rise from start to end along an edge, within the limits."""
    rows = group_pairs(stats, edges)
    fine = (F.greatest("high", "low") >= min_mean_any) & (F.col("high") >= min_mean_high) & (F.col("frac_high") >= min_frac_high) & (F.col("low") <= max_mean_low)
    if min_nexpr_any > 0:
        fine = fine & (F.col("n_any") >= min_nexpr_any)
    found = rows.where(fine).select("start", "end", "gene", fold_change(F.col("high"), F.col("low"), eps).alias("fc"), (F.col("high") - F.col("low")).alias("delta"))
    return found.where(F.col("fc") >= thres_fc)


def edge_matrix(edge_gene: DataFrame, genes: list[str] | None = None, value: str = "fc", agg: str = "max", fill: float = 0.0) -> DataFrame:
    """One row for each edge, one column for each of ``genes``; for export only, so name the genes."""
    how = {"max": F.max, "mean": F.avg, "first": F.min_by}
    if agg not in how:
        raise ValueError(f"unknown aggregate: {agg}")
    named = edge_gene.withColumn("edge", edge_name(F.col("start"), F.col("end")))
    cell = F.min_by(value, F.struct("start", "end", value)) if agg == "first" else how[agg](value)
    return named.groupBy("edge").pivot("gene", genes).agg(cell).fillna(fill)


def gene_edge_map(edge_gene: DataFrame) -> DataFrame:
    """(gene, edges): a map from "start->end" to fc, zeros left out."""
    rows = edge_gene.where("fc <> 0").groupBy("gene", edge_name(F.col("start"), F.col("end")).alias("edge")).agg(F.max("fc").alias("fc"))
    return rows.groupBy("gene").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("edge", "fc")))).alias("edges"))


def dst_max(stats: DataFrame, edges: DataFrame, eps: float = EPS, drop_zeros: bool = False) -> DataFrame:
    """(grp, gene, max_fc, max_delta): the largest rise into each group, over all its edges; 0 if it is never the high end."""
    rows = group_pairs(stats, edges)
    best = rows.groupBy(F.col("end").alias("grp"), "gene").agg(F.max(fold_change(F.col("high"), F.col("low"), eps)).alias("max_fc"), F.max(F.col("high") - F.col("low")).alias("max_delta"))
    found = stats.select("grp", "gene").join(best, ["grp", "gene"], "left").fillna(0.0, ["max_fc", "max_delta"])
    return found.where("max_fc > 0 OR max_delta > 0") if drop_zeros else found


def coverage(stats: DataFrame, edges: DataFrame, weighted: bool = True, fall_back: bool = True) -> DataFrame:
    """(grp, gene, coverage, rest, neighbor): the fraction expressing in the group, in all others and in its neighbours.

    weighted: by cells, else each group alike. A group without neighbours takes the others', or 0.
    """
    w = F.col("n_cells").cast("double") if weighted else F.lit(1.0)
    rows = stats.select("grp", "gene", F.col("frac_expr").alias("coverage"), w.alias("w"))
    all_w, all_f = (F.sum(x).over(Window.partitionBy("gene")) for x in (F.col("w"), F.col("w") * F.col("coverage")))
    others = all_w - F.col("w")
    rows = rows.withColumn("rest", F.when(others > 0, (all_f - F.col("w") * F.col("coverage")) / others).otherwise(0.0))
    near = rows.select(F.col("grp").alias("v"), "gene", "coverage", "w").join(F.broadcast(both_ways(edges)), "v")
    total = F.sum("w")
    near = near.groupBy(F.col("u").alias("grp"), "gene").agg(F.when(total > 0, F.sum(F.col("w") * F.col("coverage")) / total).otherwise(0.0).alias("neighbor"))
    found = rows.drop("w").join(near, ["grp", "gene"], "left")
    return found.withColumn("neighbor", F.coalesce("neighbor", F.col("rest") if fall_back else F.lit(0.0)))

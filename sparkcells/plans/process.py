"""Processing steps of raw counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import genes, graph, stats, transfer

#: The steps, in the order in which they are taken whatever the order of the letters.
ORDER = "nlfrspkuc"
OUT_OF_SCOPE = {"u": "non-linear embeddings", "c": "community detection"}


def read_process(counts: DataFrame, species: str = "human", min_counts: float = 1000, min_genes: int = 500, max_genes: int = 7000, max_mito: float = 0.5) -> DataFrame:
    """The counts of the cells that pass the quality limits."""
    metrics = stats.qc_metrics(counts, stats.mito_gene(F.col("gene"), species))
    return counts.join(stats.qc_filter(metrics, min_counts, min_genes, max_genes, max_mito).select("cell_id"), "cell_id", "left_semi")


def _scaled_pca(scaled: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The components of scaled values, zeros included: a row is what it differs by from a cell of zeros, which is added to its components."""
    zeros = scaled.groupBy("gene").agg(F.first("zero").alias("value"))
    return transfer.pca(scaled.select("cell_id", "gene", (F.col("z") - F.col("zero")).alias("value")), cells, k, shift=zeros)


def process(counts: DataFrame, steps: str = "nlfspk", removed: DataFrame | None = None, n_pcs: int = 50, n_neighbors: int = 10) -> dict[str, DataFrame]:
    """Tables by name: expr, and where asked for variable, scaled, pca, knn.

    n scales a cell's counts to one total, l takes log1p (its result stays as raw), f keeps variable
    genes, r removes the genes of ``removed`` (gene), s scales, p takes principal components, k
    finds neighbours. Components are those of the scaled values where s is asked for.
    """
    unknown = sorted(set(steps) - set(ORDER))
    if unknown:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    for step in steps:
        if step in OUT_OF_SCOPE:
            raise NotImplementedError(f"{OUT_OF_SCOPE[step]} have no distributed form here")
    cells = counts.select("cell_id").distinct()
    n = cells.count()
    expr = counts.select("cell_id", "gene", F.col("n").alias("value"))
    if "n" in steps:
        expr = stats.to_total(counts)
    if "l" in steps:
        expr = expr.withColumn("value", F.log1p("value"))
    found = {"expr": expr}
    if "l" in steps or "f" in steps:
        found["raw"] = expr
    if "f" in steps:
        found["variable"] = graph.variable_genes(expr, expr, n)
        found["expr"] = expr = genes.keep(expr, found["variable"])
    if "r" in steps and removed is not None:
        found["expr"] = expr = genes.remove(expr, removed)
    if set(steps) & set("spk"):
        found["expr"] = expr = cut(expr)  # what follows reads it several times
    if "s" in steps:
        found["scaled"] = cut(stats.z_scores(expr, n))
    if "p" in steps or "k" in steps:
        found["pca"] = cut(_scaled_pca(found["scaled"], cells, n_pcs) if "s" in steps else transfer.pca(expr, cells, n_pcs))
    if "k" in steps:
        found["knn"] = graph.knn(found["pca"], n_neighbors)
    return found

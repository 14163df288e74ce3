"""The gene network pipeline: correlations by condition, top genes, features, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import Dataset
from ..operators import corr, graph
from ..sources import corr_db


def from_expression(expr: DataFrame, obs: DataFrame, label: str, gene: str, conditions: Sequence[str], n: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long correlations, feature matrix, edges) of the genes nearest to one gene."""
    long = corr.by_condition(expr, obs, label, gene)
    return _network(long, conditions, gene, n, k)


def of_cells(
    data: Dataset, label: str | None = None, genes: DataFrame | None = None, k: int = 10, scale: int = 2, border: int = 2, per_bin: int = 20, min_count: int = 2,
    cutoff: float = 0.0, max_mean: float = 3.0, min_mean: float = 0.0125, min_dispersion: float = 0.5, min_cells: int = 50,
) -> dict[str, DataFrame]:
    """The network of genes over an even sample of cells: sample, imputed, variable, corr, edges and, with a label, annotation.

    Cells are sampled by grid cell of their coordinates and take the mean of their k nearest; the
    genes that vary there (of ``genes``, if given) are correlated over them, and edges under
    ``cutoff`` go. annotation is each label's share among a sampled cell's neighbours.
    """
    chosen = cut(graph.grid_sample(graph.grid_bins(data.coords, scale, border), per_bin, min_count).select("cell_id"))
    near = cut(graph.knn(data.coords, k, queries=data.coords.join(chosen, "cell_id", "left_semi")))
    imputed = cut(graph.impute_neighbor(data.expr, near, k))
    n = chosen.count()
    variable = cut(graph.variable_genes(imputed, data.expr if data.raw is None else data.raw, n, min_mean, max_mean, min_dispersion, min_cells, genes))
    found = cut(corr.gene_gene(imputed, n, variable.select("gene")))
    tables = {"sample": chosen, "imputed": imputed, "variable": variable, "corr": found, "edges": corr.pruned(found, cutoff)}
    if label is not None:
        tables["annotation"] = graph.impute_labels(near, data.obs.select("cell_id", F.col(label).cast("string").alias("grp")))
    return tables


def from_store(spark: SparkSession, path: str, gene: str, types: Sequence[str] | None = None, n: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    long = corr_db.load(spark, path, gene, types)
    return _network(long, list(types) if types is not None else corr_db.cell_types(spark, path), gene, n, k)


def _network(long: DataFrame, conditions: Sequence[str], gene: str, n: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    matrix = corr.features(corr.top_genes(long, n, exclude=gene), long, conditions)
    return long, matrix, corr.gene_network(matrix, k)

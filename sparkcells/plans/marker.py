"""The marker pipeline: from expression and a labelling to ranked markers of each group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPS, fc_bin
from ..lineage import cut
from ..model import Dataset
from ..operators import batch as batches
from ..operators import edges as graph
from ..operators import labels as levels
from ..operators import score, stats, sweep


@dataclass(frozen=True)
class MarkerResult:
    """Every stage of the pipeline as a DataFrame."""

    stats: DataFrame
    edges: DataFrame
    edge_gene: DataFrame
    labels: DataFrame
    notes: DataFrame
    features: DataFrame
    scored: DataFrame
    ranking: DataFrame
    thres_fc: float
    batch_means: DataFrame | None = None
    score_col: str = "specific_weight"

    def markers(self, n: int | None = None) -> DataFrame:
        """(grp, gene, score, rank); all, or the first n of each group."""
        rows = self.ranking.select("grp", "gene", F.col(self.score_col).alias("score"), "rank")
        return rows if n is None else rows.where(F.col("rank") <= n)

    def counts(self) -> DataFrame:
        """(grp, n): how many markers each group has, groups without one included."""
        own = self.ranking.groupBy("grp").agg(F.count("*").alias("n"))
        return self.stats.select("grp").distinct().join(own, "grp", "left").fillna(0, ["n"])

    def batch_detail(self, grp: str, gene: str) -> DataFrame:
        if self.batch_means is None:
            raise ValueError("no batch was given")
        return batches.detail(self.edge_gene, self.batch_means, grp, gene)

    def nodes(self, scale: float = 10.0) -> DataFrame:
        """(grp, n_cells, size) for drawing."""
        return self.stats.groupBy("grp").agg(F.max("n_cells").alias("n_cells")).withColumn("size", F.sqrt("n_cells") * scale)

    def node_colours(self, gene: str, value: str = "mean_norm") -> DataFrame:
        """(grp, value, colour) of one gene: colour runs from 0 at its least group to 1 at its largest (0 if all are alike)."""
        rows = self.stats.where(F.col("gene") == gene).select("grp", F.col(value).alias("value"))
        ends = rows.agg(F.min("value").alias("low"), F.max("value").alias("high"))  # one row
        colour = F.coalesce((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0))
        return rows.crossJoin(F.broadcast(ends)).select("grp", "value", colour.alias("colour"))

    def gene_edges(self, gene: str, bidirectional: bool = True) -> DataFrame:
        """(start, end, fc, bin) of one gene, over the edges in both directions, or in the one they are stored in."""
        own = self.edge_gene.where(F.col("gene") == gene).select("start", "end", "fc")
        ways = graph.both_ways(self.edges) if bidirectional else self.edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        every = ways.select(F.col("u").alias("start"), F.col("v").alias("end"))
        return every.join(own, ["start", "end"], "left").select("start", "end", "fc", fc_bin(F.col("fc")).alias("bin"))


def run(
    data: Dataset,
    label: str,
    connectivities: DataFrame | None = None,
    thres_fc: float | str = "auto",
    a: float = 1.0,
    b: float = 0.5,
    only_high: bool = True,
    score_fn: Callable[[DataFrame], Column] | None = None,
    score_col: str = "specific_weight",
    k: int = 5,
    exclude: Sequence[str] = (),
    min_cells_per_group: int = 0,
    min_expr_cells_per_gene: int = 0,
    eps: float = EPS,
    min_mean_any: float = 0.05,
    min_mean_high: float = 0.5,
    min_frac_high: float = 0.2,
    max_mean_low: float = 0.2,
    min_nexpr_any: int = 0,
    fc_cutoff: float | None = None,
    label_k: float = 2.0,
    sigma: str = "sd",
    min_gap: float = 0.2,
    min_margin: float = 0.0,
    level: int = 3,
    batch: str | None = None,
    batch_min_cells: int = 5,
    batch_alpha: float = 0.05,
    batch_min_batches: int = 3,
    use_raw: bool = False,
) -> MarkerResult:
    """Run the stages; those that several later ones read are written to the checkpoint folder.

    connectivities: (g1, g2, weight) between groups; without it the cell graph of ``data`` gives
    it, or else the similarity of the groups' profiles. Excluded groups leave the graph too.
    score_col names the score that markers are ranked by, score_fn makes it; use_raw reads the raw table.
    """
    if use_raw:
        data = replace(data, expr=data.with_raw().raw)
    grid = stats.grid(data.expr, data.obs, label, exclude, min_cells_per_group, min_expr_cells_per_gene)
    grid = cut(grid)
    weights = connectivities
    if weights is None and data.knn is not None:
        weights = graph.connectivity(data.knn, data.obs.select("cell_id", F.col(label).cast("string").alias("grp")))
    if weights is None:
        weights = graph.profile_similarity(grid)
    if exclude:
        weights = weights.where(~F.col("g1").isin(*exclude) & ~F.col("g2").isin(*exclude))
    edges = graph.undirected(graph.top_k_symmetric(weights, k))
    edges = cut(edges)
    if thres_fc == "auto":
        thres_fc = sweep.suggest(sweep.auto(cut(sweep.baseline(grid, edges))))
    limits = {"min_mean_any": min_mean_any, "min_mean_high": min_mean_high, "min_frac_high": min_frac_high, "max_mean_low": max_mean_low, "min_nexpr_any": min_nexpr_any}
    edge_gene = graph.fc_delta(grid, edges, float(thres_fc), eps, **limits)
    means = None
    if batch is not None:
        means = batches.batch_means(data.expr, data.obs, label, batch, batch_min_cells, edge_gene)
        edge_gene = batches.significant(batches.welch(edge_gene, means, batch_min_batches), batch_alpha).select("start", "end", "gene", "fc", "delta")
    edge_gene = cut(edge_gene)
    labelled = levels.label_levels(grid, edge_gene, float(thres_fc) if fc_cutoff is None else fc_cutoff, label_k, sigma, min_gap, min_margin)
    labelled = cut(labelled)
    notes = levels.note(labelled, level)
    features = score.gene_features(notes, edge_gene)
    scored = score.scores(score.marker_inputs(grid, edges, notes, features, only_high, eps), a, b)
    return MarkerResult(grid, edges, edge_gene, labelled, notes, features, scored, score.rank(scored, score_col, score_fn), float(thres_fc), means, score_col)

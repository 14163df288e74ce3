"""Registered queries over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import edge_ends, edge_name, fc_bin, numeric_order
from .lineage import cut, few, folder as shared_folder
from .model import Dataset
from .operators import annotate, batch, corr, edges, genes, graph, hierarchy, labels, ranktest, score, simple, stats, sweep, transfer
from .plans import hierarchy as hierarchies
from .plans import marker, network, process
from .sources import bindings, corr_db, gene_sets
from .sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GENES = ["the", "of", "and", "der", "la", "un"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(*names: str) -> list[Column]:
    """Columns rounded to six places (negative zero is zero)."""
    return [(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) for n in names]


def _grid(spark: SparkSession, folder: str, label: str = "lang", data: Dataset | None = None, **options) -> DataFrame:
    data = data or bindings.documents(spark, folder)
    return cut(stats.grid(data.expr, data.obs, label, **options))


def _edges(grid: DataFrame, k: int = 2) -> DataFrame:
    return cut(edges.undirected(edges.top_k_symmetric(edges.profile_similarity(grid), k)))


def _short(spark: SparkSession, folder: str) -> DataFrame:
    """A table of gene sets made from the tokens: short ones, and ones with an n."""
    names = cut(bindings.documents(spark, folder).expr.select("gene").distinct())
    return names.where(F.length("gene") <= 3).select(F.lit("short").alias("category"), "gene").union(names.where(F.col("gene").contains("n")).select(F.lit("with_n").alias("category"), "gene"))


@query
def log1p_check(spark, folder):
    return stats.log1p_check(bindings.documents(spark, folder).expr).select(*r6("low", "high"), "passes")


@query
def value_check_scaled(spark, folder):
    """The wider check of drawing functions: negatives are errors, large values a warning."""
    return stats.log1p_check(bindings.line_items(spark, folder).expr, 30.0).select(*r6("low", "high"), "passes")


@query
def qc_metrics(spark, folder):
    return stats.qc_metrics(bindings.line_counts(spark, folder), F.col("gene").startswith("Brand#1")).select("cell_id", *r6("total_counts"), "n_genes", *r6("pct_mt"))


@query
def qc_filter(spark, folder):
    found = stats.qc_metrics(bindings.line_counts(spark, folder), F.col("gene").startswith("Brand#1"))
    return stats.qc_filter(found, 200, 8, 24, 0.25).select("cell_id", *r6("total_counts"), "n_genes", *r6("pct_mt"))


@query
def normalize_log1p(spark, folder):
    return stats.normalize(bindings.line_counts(spark, folder)).select("cell_id", "gene", *r6("value"))


@query
def remove_geneset(spark, folder):
    sets = _short(spark, folder).where("category = 'short'")
    return genes.remove(bindings.documents(spark, folder).expr, sets).groupBy("gene").agg(F.count("*").alias("n"))


@query
def gene_filter(spark, folder):
    chosen = genes.GeneFilter(_short(spark, folder), exclude=["short"], include=["with_n"], name_exclude=["th", "é", "."])
    return chosen.filter(bindings.documents(spark, folder).expr.select("gene").distinct())


@query
def bundled_gene_sets(spark, folder):
    return gene_sets.bundled(spark).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("gene").alias("n_distinct"))


@query
def group_sizes(spark, folder):
    return stats.group_sizes(bindings.document_obs(spark, folder), "lang", exclude=["es"]).select("grp", F.col("idx").cast("long").alias("idx"), "n_cells")


@query
def group_stats(spark, folder):
    return _grid(spark, folder).select("grp", "gene", "n_cells", "n_expr", *r6("mean", "frac_expr"))


@query
def group_stats_min_cells(spark, folder):
    return _grid(spark, folder, "lang3", min_cells=100).select("grp", "gene", "n_cells", "n_expr", *r6("mean"))


@query
def group_stats_drop_small(spark, folder):
    return _grid(spark, folder, "lang3", min_cells=100, drop_small=True).select("grp", "gene", "n_cells", "n_expr", *r6("mean"))


@query
def group_stats_min_expr(spark, folder):
    return _grid(spark, folder, min_expr_cells=10, exclude=["es"]).select("grp", "gene", "n_expr", *r6("mean", "mean_norm"))


@query
def group_stats_lineitem(spark, folder):
    data = bindings.line_items(spark, folder)
    return stats.grid(data.expr, data.obs, "nation").select("grp", "gene", "n_cells", "n_expr", *r6("mean", "frac_expr", "mean_norm"))


@query
def mean_norm(spark, folder):
    return _grid(spark, folder).select("grp", "gene", *r6("mean_norm"))


@query
def scaled_layer_means(spark, folder):
    data = bindings.documents(spark, folder)
    scaled = stats.scaled(data.expr, data.obs, "lang")
    return stats.grid(scaled, data.obs, "lang").select("grp", "gene", *r6("mean"))


@query
def z_scores(spark, folder):
    data = bindings.line_items(spark, folder)
    return stats.z_scores(data.expr, data.obs.count(), 2.0).select("cell_id", "gene", *r6("z", "zero"))


@query
def gene_dispersion(spark, folder):
    data = bindings.documents(spark, folder)
    return stats.dispersion(data.expr, data.obs.count()).select("gene", "detected", *r6("mean", "variance", "dispersion"))


@query
def variable_genes(spark, folder):
    data = bindings.documents(spark, folder)
    return graph.variable_genes(data.expr, data.expr, data.obs.count(), max_mean=1.0, min_dispersion=5.5, min_cells=30).select("gene", "detected", *r6("mean", "dispersion"))


@query
def dotplot_table(spark, folder):
    data = bindings.documents(spark, folder)
    return stats.dot_table(data.expr, data.obs, "lang", {"words": ["the", "der", "the", "no such gene"], "more": [("la", 1.5)]}, ["en", "de", "fr"]).select("place", "section", "gene", "grp", *r6("size", "colour"))


def _simple(spark, folder, mode, **options):
    return simple.ranked(simple.find(_grid(spark, folder), mode, **options)).select("grp", "gene", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query
def simple_single(spark, folder):
    return _simple(spark, folder, "single")


@query
def simple_multiple(spark, folder):
    return _simple(spark, folder, "multiple", min_count=3)


@query
def simple_negative(spark, folder):
    return _simple(spark, folder, "negative", min_count=1)


@query
def simple_groups(spark, folder):
    found = simple.find(_grid(spark, folder), "groups", min_count=0, targets=["en", "de"])
    return found.select("gene", *r6("score"))


@query
def topk_edges(spark, folder):
    return edges.top_k_symmetric(edges.profile_similarity(_grid(spark, folder, "lang3")), 2).select("g1", "g2", *r6("weight"))


@query
def group_graph(spark, folder):
    return edges.both_ways(_edges(_grid(spark, folder, "lang3")))


@query
def fc_delta(spark, folder):
    grid = _grid(spark, folder)
    return edges.fc_delta(grid, _edges(grid)).select("start", "end", "gene", *r6("fc", "delta"))


def _edge_gene(spark, folder, label="lang", data=None, **options):
    grid = _grid(spark, folder, label, data)
    near = _edges(grid, 11 if label == "lang3" else 2)  # twelve groups: all pairs
    return grid, near, cut(edges.fc_delta(grid, near, **options))


@query
def edge_gene_matrix(spark, folder):
    found = edges.edge_matrix(_edge_gene(spark, folder)[2], GENES)
    return found.select("edge", *r6(*GENES))


@query
def gene_edge_map(spark, folder):
    found = edges.gene_edge_map(_edge_gene(spark, folder)[2]).select("gene", F.explode("edges").alias("edge", "fc"))
    start, end = edge_ends(F.concat(F.lit("x@"), F.col("edge")))
    return found.select("gene", start.alias("start"), end.alias("end"), *r6("fc"))


@query
def fc_bins(spark, folder):
    found = _edge_gene(spark, folder, thres_fc=1.0, max_mean_low=0.5)[2]
    return found.groupBy(edge_name(F.col("start"), F.col("end")).alias("edge"), fc_bin(F.col("fc")).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query
def dst_gene_max(spark, folder):
    grid = _grid(spark, folder)
    return edges.dst_max(grid, _edges(grid)).select("grp", "gene", *r6("max_fc", "max_delta"))


@query
def coverage(spark, folder):
    grid = _grid(spark, folder, "lang3")
    return edges.coverage(grid, _edges(grid)).select("grp", "gene", *r6("coverage", "rest", "neighbor"))


@query
def coverage_unweighted(spark, folder):
    grid = _grid(spark, folder)
    return edges.coverage(grid, _edges(grid, 1), weighted=False, fall_back=False).select("grp", "gene", *r6("coverage", "rest", "neighbor"))


def _labels(spark, folder, **options):
    grid, _, found = _edge_gene(spark, folder, "lang3")
    return labels.label_levels(grid, found, **options).select("gene", "grp", *[F.col(x).cast("long").alias(x) for x in ("l1", "l2", "l3")])


@query
def label_levels_sd(spark, folder):
    return _labels(spark, folder)


@query
def label_levels_iqr(spark, folder):
    return _labels(spark, folder, sigma="iqr", k=1.0)


@query
def label_levels_mad(spark, folder):
    return _labels(spark, folder, sigma="mad", k=1.0)


def _features(spark, folder):
    grid, near, found = _edge_gene(spark, folder, "lang3")
    notes = labels.note(labels.label_levels(grid, found), 3)
    return grid, near, notes, score.gene_features(notes, found)


@query
def gene_features(spark, folder):
    counts = ["n_low", "n_grey", "n_high", "n_edges"]
    return _features(spark, folder)[3].select("gene", *counts, *r6("max_fc", "mean_fc", "max_delta", "mean_delta", "gap"))


def _run(spark, folder, **options) -> marker.MarkerResult:
    options = {"k": 11, "thres_fc": 3.0} | options
    return marker.run(bindings.documents(spark, folder), "lang3", **options)


@query
def marker_scores(spark, folder):
    found = _run(spark, folder).scored
    return found.select("grp", "gene", *r6("max_fc_dst", "max_delta_dst", "coverage", "rest", "neighbor", "local_score", "global_score", "specific_weight"))


@query
def marker_rank(spark, folder):
    """Flagship: the whole marker pipeline, with ranks."""
    return _run(spark, folder).markers().select("grp", "gene", *r6("score"), F.col("rank").cast("long").alias("rank"))


@query
def marker_counts(spark, folder):
    return _run(spark, folder).counts().select("grp", F.col("n").cast("long").alias("n"))


@query
def marker_auto(spark, folder):
    """The pipeline with its own threshold and batch test."""
    found = marker.run(bindings.documents(spark, folder), "lang", k=2, batch="source")
    return found.markers(20).select("grp", "gene", *r6("score"), "rank")


@query
def fc_sweep(spark, folder):
    grid = _grid(spark, folder)
    found = sweep.run(sweep.baseline(grid, _edges(grid)), [1.0, 2.0, 5.0, 20.0, 100.0, 5000.0], GENES)
    names = ["n_pairs", "n_genes", "n_edges_covered", "n_edges_uncovered", "min_genes", "max_genes", "gt_genes"]
    return found.select(*r6("threshold", "median_genes"), *[F.col(x).cast("long").alias(x) for x in names])


@query
def fc_suggest(spark, folder):
    grid = _grid(spark, folder)
    best = sweep.suggest(sweep.run(sweep.baseline(grid, _edges(grid)), [1.0, 2.0, 5.0, 20.0, 100.0, 5000.0]))
    return spark.createDataFrame([(float(best),)], "suggested double")


@query
def fc_sweep_auto(spark, folder):
    grid = _grid(spark, folder)
    found = sweep.auto(cut(sweep.baseline(grid, _edges(grid))))
    return found.select(*r6("threshold"), "n_pairs", "n_genes", "n_edges_covered", "n_edges_uncovered")


def _means(data, found=None):
    return batch.batch_means(data.expr, data.obs, "lang", "source", 5, found)


@query
def batch_group_mean(spark, folder):
    wanted = spark.createDataFrame([(x,) for x in GENES], "gene string")
    return _means(bindings.documents(spark, folder), wanted).select("grp", "batch", "gene", "n_cells", *r6("mean", "frac"))


@query
def batch_detail(spark, folder):
    data = bindings.documents(spark, folder)
    found = _edge_gene(spark, folder, data=data)[2]
    return batch.detail(found, _means(data, found), "en", "the").select("start", "end", "side", "batch", "n_cells", *r6("mean"))


def _welch(spark, folder):
    data = bindings.documents(spark, folder)
    found = _edge_gene(spark, folder, data=data)[2]
    return batch.welch(found, _means(data, found))


@query
def welch_t(spark, folder):
    return _welch(spark, folder).select("start", "end", "gene", *r6("t", "df"), "ttest_n_start", "ttest_n_end")


@query
def welch_filter(spark, folder):
    return batch.significant(batch.with_p(_welch(spark, folder)), 0.01).select("start", "end", "gene", *r6("fc", "delta", "ttest_pval"))


@query
def welch_summary(spark, folder):
    return batch.summary(batch.with_p(_welch(spark, folder))).select("grp", "gene", *r6("ttest_pval"), "ttest_n_start", "ttest_n_end")


@query
def batch_strips(spark, folder):
    data = bindings.embeddings(spark, folder)
    wanted = spark.createDataFrame([("d00",), ("d07",)], "gene string")
    found = batch.by_batch(data.expr, data.obs, "label", "batch", wanted)
    return found.select("grp", "gene", "batch", "n_cells", "active", F.col("place").cast("long").alias("place"), *r6("mean", "share"))


@query
def corr_one_vs_all(spark, folder):
    data = bindings.documents(spark, folder)
    return corr.one_vs_all(data.expr, data.obs.count(), "the").select("gene", *r6("corr", "t"))


@query
def corr_pvalues(spark, folder):
    data = bindings.documents(spark, folder)
    n = data.obs.count()
    return corr.with_p(corr.one_vs_all(data.expr, n, "the"), n, "the").select("gene", *r6("corr", "pval"))


def _by_condition(spark, folder):
    data = bindings.line_items(spark, folder)
    segments = data.obs.select("cell_id", F.col("segment").alias("condition"))
    return corr.by_condition(data.expr, segments, "condition", "Brand#11")


CONDITIONS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query
def corr_matrix_outer(spark, folder):
    found = corr.wide(_by_condition(spark, folder), CONDITIONS)
    return found.select("gene", *r6(*[f"{c}_corr" for c in CONDITIONS]))


@query
def top_genes(spark, folder):
    found = corr.top_genes(_by_condition(spark, folder), 5, "Brand#11")
    return found.select("condition", "gene", *r6("corr"), F.col("rank").cast("long").alias("rank"))


def _matrix(spark, folder):
    long = _by_condition(spark, folder)
    return corr.features(corr.top_genes(long, 5, "Brand#11"), long, CONDITIONS)


@query
def feature_matrix(spark, folder):
    return _matrix(spark, folder).select("gene", *r6(*[f"{c}_corr" for c in CONDITIONS]))


@query
def gene_network(spark, folder):
    return corr.gene_network(_matrix(spark, folder), 3).select("a", "b", *r6("dist", "weight"))


@query
def corr_gene_gene(spark, folder):
    data = bindings.documents(spark, folder)
    return corr.gene_gene(data.expr, data.obs.count(), data.expr.select("gene")).select("a", "b", *r6("corr"))


@query
def network_edges(spark, folder):
    data = bindings.documents(spark, folder)
    found = corr.gene_gene(data.expr, data.obs.count(), data.expr.select("gene"), 0.3)
    return corr.pruned(found, 0.3).select("a", "b", *r6("corr"))


@query
def anno_gene_corr(spark, folder):
    data = bindings.documents(spark, folder)
    return corr.annotation_corr(data.expr, data.obs, "lang").select("gene", "grp", *r6("corr"))


@query
def anno_gene_colour(spark, folder):
    data = bindings.documents(spark, folder)
    return corr.gene_colour(corr.annotation_corr(data.expr, data.obs, "lang")).select("gene", "grp", *r6("corr"))


def _knn(data: Dataset, k: int = 10, include_self: bool = True) -> DataFrame:
    return cut(graph.knn(data.coords, k, include_self))


@query
def knn_cells(spark, folder):
    return _knn(bindings.embeddings(spark, folder)).select("src", "dst", *r6("dist"), F.col("place").cast("long").alias("place"))


@query
def impute_neighbor(spark, folder):
    data = bindings.embeddings(spark, folder)
    return graph.impute_neighbor(data.expr, _knn(data), 10).select("cell_id", "gene", *r6("value"))


@query
def impute_anno(spark, folder):
    data = bindings.embeddings(spark, folder)
    return graph.impute_labels(_knn(data), data.obs.select("cell_id", F.col("label").alias("grp"))).select("cell_id", "grp", *r6("share"))


@query
def group_connectivity(spark, folder):
    data = bindings.embeddings(spark, folder)
    found = edges.connectivity(_knn(data, 10, False), data.obs.select("cell_id", F.col("label").alias("grp")))
    return found.select("g1", "g2", *r6("weight"))


@query
def grid_bins(spark, folder):
    return graph.grid_bins(bindings.embeddings(spark, folder).coords, scale=4)


@query
def grid_bin_counts(spark, folder):
    return graph.bin_counts(graph.grid_bins(bindings.embeddings(spark, folder).coords, scale=4))


@query
def grid_sample(spark, folder):
    return graph.grid_sample(graph.grid_bins(bindings.embeddings(spark, folder).coords, scale=4))


def _paths(spark, folder):
    return hierarchy.paths(bindings.embeddings(spark, folder).obs, ["l0", "l1", "label"])


@query
def hierarchy_paths(spark, folder):
    return hierarchy.path_sizes(_paths(spark, folder))


@query
def hierarchy_small_paths(spark, folder):
    return hierarchy.split_small(_paths(spark, folder), 50)


@query
def hierarchy_vote(spark, folder):
    return hierarchy.vote(hierarchy.split_small(_paths(spark, folder), 50), _knn(bindings.embeddings(spark, folder)))


@query
def hierarchy_reassign(spark, folder):
    cells = hierarchy.reassign(_paths(spark, folder), _knn(bindings.embeddings(spark, folder)), 50)
    return hierarchy.cell_ids(cells, hierarchy.path_ids(cells))


@query
def path_ids(spark, folder):
    return hierarchy.path_ids(hierarchy.split_small(_paths(spark, folder), 50))


def _level_markers(spark, folder):
    data = bindings.documents(spark, folder)
    found = None
    for name, label in (("g0", "lang"), ("g1", "lang3")):
        own = simple.ranked(simple.find(stats.grid(data.expr, data.obs, label), "single")).select(F.lit(name).alias("resolution"), "grp", "gene", "rank")
        found = own if found is None else found.union(own)
    return found


@query
def marker_rank_topn(spark, folder):
    chosen = genes.GeneFilter(_short(spark, folder), name_exclude=["th"])
    return hierarchy.marker_rank(_level_markers(spark, folder), 8, chosen).select("resolution", "grp", "gene", F.col("rank").cast("long").alias("rank"))


@query
def compare_presence(spark, folder):
    ranked = hierarchy.marker_rank(_level_markers(spark, folder), 20)
    found = hierarchy.presence(ranked, [("g0", "en"), ("g1", "en_0"), ("g1", "en_1")])
    return found.select("gene", *[F.col(x).cast("long").alias(x) for x in ("p0", "p1", "p2", "place")])


@query
def viewer_payload(spark, folder):
    data = bindings.embeddings(spark, folder)
    cells = hierarchy.split_small(_paths(spark, folder), 20)
    ids = hierarchy.path_ids(cells)
    centres = graph.centroids(data.coords, hierarchy.cell_ids(cells, ids).withColumnRenamed("icls", "grp"))
    found = None
    for name, label in (("g0", "l0"), ("g1", "l1"), ("g2", "label")):
        own = simple.ranked(simple.find(stats.grid(data.expr, data.obs, label), "single", gap=0.02, min_mean=0.02)).select(F.lit(name).alias("resolution"), "grp", "gene", "rank")
        found = own if found is None else found.union(own)
    shown = hierarchy.payload(ids, hierarchy.marker_rank(found, 5), centres)
    kind = "path string, n long, x double, y double, genes_g0 array<string>, genes_g1 array<string>, genes_g2 array<string>"
    read_back = shown.select("icls", F.from_json("json", kind).alias("p")).select("icls", "p.*")
    return read_back.select("icls", "path", "n", *r6("x", "y"), *[F.concat_ws(",", f"genes_g{k}").alias(f"genes_g{k}") for k in range(3)])


@query
def icls_centroids(spark, folder):
    data = bindings.embeddings(spark, folder)
    return graph.centroids(data.coords, data.obs.select("cell_id", F.col("label").alias("grp"))).select("grp", *r6("x", "y"))


@query
def group_order(spark, folder):
    """Groups in viewer order: whole numbers by value, then names."""
    from pyspark.sql import Window

    names = bindings.embeddings(spark, folder).obs.select("label").distinct().union(bindings.document_obs(spark, folder).select("lang").distinct())
    return names.select(F.col("label").alias("grp"), F.row_number().over(Window.orderBy(*numeric_order(F.col("label")))).cast("long").alias("place"))


@query
def annotator_update(spark, folder):
    made = annotate.Annotator(bindings.events(spark, folder).obs, "label").update("cluster", "1, 2,3", "low").update("cluster", ["3", "4"], "mid").update("cluster", "2", "never", unknown_only=True)
    return made.update("cluster", "5", "top", unknown_only=True).obs.select("cell_id", "cluster", "label")


@query
def annotator_summary(spark, folder):
    return annotate.Annotator(bindings.events(spark, folder).obs, "label", "cluster").update("cluster", "0,1", "first").summary()


@query
def update_label(spark, folder):
    obs = bindings.events(spark, folder).obs.withColumn("label", F.lit("unknown"))
    other = obs.where(F.col("cell_id").cast("long") % 3 == 0).select("cell_id", F.concat(F.lit("c"), "cluster").alias("found"))
    return annotate.update_label(obs, "label", other, "found", exclude=["c4"]).select("cell_id", "label")


@query
def remove_minor(spark, folder):
    return annotate.major(bindings.document_obs(spark, folder), "lang3", 100).select("cell_id", "lang3", "lang3_major")


@query
def fill_columns(spark, folder):
    a, b = annotate.fill_columns(bindings.events(spark, folder).obs, bindings.document_obs(spark, folder).where("lang = 'es'"))
    return a.unionByName(b).select("cell_id", "cluster", "lang", "source", "lang3")


@query
def predict_high(spark, folder):
    data = bindings.embeddings(spark, folder)
    shares = graph.impute_labels(_knn(data), data.obs.select("cell_id", F.col("label").alias("grp"))).withColumnsRenamed({"grp": "class", "share": "p"})
    return annotate.predict_high(shares, [str(k) for k in range(10)], 0.25)


@query
def select_groups(spark, folder):
    return annotate.select_groups(bindings.document_obs(spark, folder), "lang", exclude="es, fr").groupBy("lang").agg(F.count("*").alias("n"))


@query
def common_genes(spark, folder):
    data = bindings.documents(spark, folder)
    cells = lambda lang: data.obs.where(F.col("lang") == lang).select("cell_id")
    return genes.common(data.expr.join(cells("en"), "cell_id", "left_semi"), data.expr.join(cells("fr"), "cell_id", "left_semi"))


@query
def class_sample(spark, folder):
    return annotate.class_sample(bindings.document_obs(spark, folder), "lang", 50)


@query
def lr_transfer(spark, folder):
    data = bindings.embeddings(spark, folder)
    first = F.col("cell_id").cast("long") % 2 == 0
    halves = [(data.expr.where(c), data.obs.where(c)) for c in (first, ~first)]
    return transfer.transfer(*halves[0], "label", *halves[1], "given", n=50, max_iter=20).select("cell_id", "label", "given")


@query
def roc_auc(spark, folder):
    data = bindings.embeddings(spark, folder)
    truth = data.obs.select("cell_id", F.col("label").alias("grp"))
    shares = graph.impute_labels(_knn(data, 10, False), truth)
    return transfer.auc(_every_share(truth, shares), truth).select("class", *r6("auc"))


def _every_share(truth, shares):
    every = truth.select("cell_id").crossJoin(few(truth.select("grp").distinct())).join(shares, ["cell_id", "grp"], "left").fillna(0.0)
    return every.withColumnsRenamed({"grp": "class", "share": "p"})


@query
def roc_points(spark, folder):
    data = bindings.embeddings(spark, folder)
    truth = data.obs.select("cell_id", F.col("label").alias("grp"))
    return transfer.roc(_every_share(truth, graph.impute_labels(_knn(data, 10, False), truth)), truth, "3").select(*r6("threshold", "fpr", "tpr"))


@query
def event_counts(spark, folder):
    """Events by hour and type: what the streaming form gives once all is read."""
    rows = read(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", *r6("total"))


@query
def rank_genes(spark, folder):
    data = bindings.documents(spark, folder)
    return ranktest.rank_genes(data.expr, data.obs, "lang").select("grp", "gene", *r6("t", "df"))


@query
def normalize_zero_fill(spark, folder):
    """Chosen genes of chosen cells with their zeros: what a drawing of single genes reads."""
    data = bindings.documents(spark, folder)
    cells = annotate.select_groups(data.obs, "lang", "en, de").select("cell_id", "lang")
    wanted = spark.createDataFrame([(x,) for x in GENES], "gene string")
    return cells.crossJoin(F.broadcast(wanted)).join(data.expr, ["cell_id", "gene"], "left").fillna(0.0).select("cell_id", "lang", "gene", *r6("value"))


@query
def resolve_expression(spark, folder):
    """Counts aren't log1p values, so the raw table is taken."""
    counts = cut(bindings.line_counts(spark, folder))
    table, source = stats.resolve_expression(counts.select("cell_id", "gene", F.col("n").alias("value")), bindings.normalised(counts))
    return table.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.lit(source).alias("source"), "n", *r6("total"))


def _mito_counts(spark, folder):
    return bindings.line_counts(spark, folder).withColumn("gene", F.when(F.col("gene").startswith("Brand#1"), F.concat(F.lit("MT-"), "gene")).otherwise(F.col("gene")))


@query
def qc_mito(spark, folder):
    return stats.qc_metrics(_mito_counts(spark, folder), stats.mito_gene(F.col("gene"))).select("cell_id", *r6("total_counts"), "n_genes", *r6("pct_mt"))


@query
def read_process(spark, folder):
    return process.read_process(_mito_counts(spark, folder), min_counts=200, min_genes=8, max_genes=24, max_mito=0.25).select("cell_id", "gene", *r6("n"))


@query
def process_total(spark, folder):
    return process.process(cut(bindings.line_counts(spark, folder)), "n")["expr"].select("cell_id", "gene", *r6("value"))


@query
def process_variable(spark, folder):
    """Steps n, l, f and r: what is left by gene."""
    removed = spark.createDataFrame([("the",), ("of",)], "gene string")
    found = process.process(cut(bindings.document_counts(spark, folder)), "rfln", removed)["expr"]
    return found.groupBy("gene").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("gene", "n", *r6("total"))


@query
def process_scaled(spark, folder):
    """Steps n, l and s, then components and neighbours: how many rows each table has."""
    found = process.process(cut(bindings.line_counts(spark, folder)), "nlspk", n_pcs=4, n_neighbors=3)
    rows = None
    for name in ("expr", "scaled", "pca", "knn"):
        own = found[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query
def simple_markers(spark, folder):
    data = bindings.documents(spark, folder)
    found = simple.SimpleMarkers(data.expr, data.obs, "lang").show("en", 10)
    return found.select("grp", "gene", *r6("score"), F.col("rank").cast("long").alias("rank"))


def _stored(spark, folder):
    """A correlation store of one gene by segment."""
    data = bindings.line_items(spark, folder)
    found = _by_condition(spark, folder).where("corr is not null").select(F.col("condition").alias("cell_type"), F.lit("Brand#11").alias("gene_a"), F.col("gene").alias("gene_b"), F.col("corr").alias("r"))
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    corr_db.write(found, data.obs.groupBy(F.col("segment").alias("cell_type")).agg(F.count("*").alias("n")), path)
    return path


@query
def corr_store(spark, folder):
    found = corr_db.load(spark, _stored(spark, folder), "Brand#11", ["BUILDING", "MACHINERY"])
    return found.where("gene <> 'Brand#11'").select("condition", "gene", *r6("corr", "t"), "n")


@query
def corr_store_pvalues(spark, folder):
    return corr_db.with_p(corr_db.load(spark, _stored(spark, folder), "Brand#11")).select("condition", "gene", *r6("corr", "pval"))


@query
def corr_store_network(spark, folder):
    return network.from_store(spark, _stored(spark, folder), "Brand#11", n=5, k=3)[2].select("a", "b", *r6("dist", "weight"))


@query
def clustermap_genes(spark, folder):
    found = corr.strongest(_matrix(spark, folder), 7)
    return found.select("gene", *r6(*[f"{c}_corr" for c in CONDITIONS]))


@query
def graph_nodes(spark, folder):
    return _run(spark, folder).nodes().select("grp", "n_cells", *r6("size"))


@query
def graph_gene_edges(spark, folder):
    """The edges of one gene, with the bin of its change."""
    found = _run(spark, folder).gene_edges("der")
    return found.select("start", "end", *r6("fc"), F.col("bin").cast("long").alias("bin"))


@query
def node_cast(spark, folder):
    """Edges between numbered groups have whole numbers as ends."""
    data = bindings.embeddings(spark, folder)
    grid = cut(stats.grid(data.expr, data.obs, "label"))
    return edges.cast_nodes(_edges(grid), ["a", "b"])


@query
def marker_rank_fn(spark, folder):
    """Ranks by a score of one's own."""
    found = _run(spark, folder, score_fn=lambda rows: rows["local_score"]).markers(10)
    return found.select("grp", "gene", *r6("score"), F.col("rank").cast("long").alias("rank"))


def _hierarchy(spark, folder) -> hierarchies.HierarchyResult:
    data = bindings.embeddings(spark, folder)
    markers = {label: simple.ranked(simple.find(stats.grid(data.expr, data.obs, label), "single", gap=0.02, min_mean=0.02)) for label in ("l0", "l1", "label")}
    return hierarchies.run(data, markers, min_cells=20, n_top=5, batch="batch", knn=_knn(data))


@query
def hierarchy_compare(spark, folder):
    found = _hierarchy(spark, folder).compare("0")
    return found.select("gene", *[F.col(x).cast("long").alias(x) for x in ("p0", "p1", "p2", "place")])


@query
def hierarchy_compare_batch(spark, folder):
    found = _hierarchy(spark, folder).compare_batch("0")
    long = [F.col(x).cast("long").alias(x) for x in ("place", "level", "present", "strip")]
    return found.select("gene", "grp", "batch", "n_cells", "active", *long, *r6("share"))


@query
def hierarchy_strips(spark, folder):
    return _hierarchy(spark, folder).strip_payload()


@query
def logistic_auc(spark, folder):
    data = bindings.embeddings(spark, folder)
    proba, truth, _ = transfer.logistic_model(data.expr, data.obs.select("cell_id", F.col("label").alias("grp")), max_iter=20)
    return transfer.auc(proba, truth).select("class", *r6("auc"))


@query
def knn_probed(spark, folder):
    """Neighbours by cells, all of which are probed: nothing is lost."""
    found = graph.knn_probed(bindings.embeddings(spark, folder).coords, probes=1 << 20, cell=64)
    return found.select("src", "dst", *r6("dist"), F.col("place").cast("long").alias("place"))


@query
def cell_network(spark, folder):
    found = network.of_cells(bindings.embeddings(spark, folder), "label", scale=4, per_bin=3, cutoff=0.1, max_mean=10.0, min_dispersion=0.0, min_cells=5)
    return found["edges"].select("a", "b", *r6("corr"))


@query
def drawn_values(spark, folder):
    """What a drawing of single genes over two axes reads."""
    data = bindings.embeddings(spark, folder)
    wanted = spark.createDataFrame([("d00",), ("d07",), ("none",)], "gene string")
    found = graph.drawn_values(data.expr, data.coords, wanted, annotate.select_groups(data.obs, "label", exclude="0, 1"))
    return found.select("cell_id", "gene", *r6("x", "y", "value"))


@query
def node_colours(spark, folder):
    return _run(spark, folder).node_colours("der").select("grp", *r6("value", "colour"))


@query
def gene_network_cosine(spark, folder):
    return corr.gene_network(_matrix(spark, folder), 3, "cosine").select("a", "b", *r6("dist"))

"""Cells' paths over three labellings, and the genes that mark them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import path_name
from ..lineage import cut, discard
from .genes import GeneFilter

LEVELS = ("g0", "g1", "g2")


def paths(obs: DataFrame, levels: Sequence[str], names: Sequence[str] = LEVELS) -> DataFrame:
    """(cell_id, path) of each cell; exactly three levels."""
    if len(levels) != 3:
        raise ValueError("three levels are needed")
    return obs.select("cell_id", path_name(names, [F.col(c) for c in levels]).alias("path"))


def default_min_cells(n: int) -> int:
    return max(int(0.005 * n), 1)


def path_sizes(cells: DataFrame) -> DataFrame:
    return cells.where("path is not null").groupBy("path").agg(F.count("*").alias("n"))


def split_small(cells: DataFrame, min_cells: int) -> DataFrame:
    """(cell_id, path): the path is null where too few cells share it."""
    large = path_sizes(cells).where(F.col("n") >= min_cells).select(F.col("path").alias("own"))
    return cells.join(large, F.col("path") == F.col("own"), "left").select("cell_id", F.col("own").alias("path"))


def vote(cells: DataFrame, knn: DataFrame) -> DataFrame:
    """One round: every cell without a path takes the most frequent one of its neighbours, ties by name."""
    known = cells.where("path is not null").select(F.col("cell_id").alias("dst"), "path")
    open_ = cells.where("path is null").select(F.col("cell_id").alias("src"))
    counts = knn.select("src", "dst").where("src <> dst").distinct().join(open_, "src").join(known, "dst").groupBy("src", "path").agg(F.count("*").alias("n"))
    best = counts.groupBy("src").agg(F.min_by("path", F.struct((-F.col("n")).alias("n"), F.col("path"))).alias("won"))
    return cells.join(best, cells["cell_id"] == best["src"], "left").select("cell_id", F.coalesce("path", "won").alias("path"))


def reassign(cells: DataFrame, knn: DataFrame, min_cells: int) -> DataFrame:
    """Rounds of votes until no cell gains a path; all votes of a round read the round before it.

    Cells without any path among their neighbours stay null. Every round is written, the one before
    it is deleted.
    """
    now = cut(split_small(cells, min_cells))
    left, before = now.where("path is null").count(), None
    while left and left != before:
        old, now = now, cut(vote(now, knn))
        before, left = left, now.where("path is null").count()
        discard(old)
    return now


def path_ids(cells: DataFrame, levels: int = 3) -> DataFrame:
    """(path, icls, g0, g1, g2, n): surviving paths numbered in the order of their labels."""
    split = F.split("path", "\\|")
    label = lambda k: F.split(F.get(split, F.lit(k)), "@", 2)[1]
    rows = path_sizes(cells).select("path", *[label(k).alias(f"g{k}") for k in range(levels)], "n")
    return rows.withColumn("icls", (F.row_number().over(Window.orderBy(*[f"g{k}" for k in range(levels)])) - 1).cast("string"))


def cell_ids(cells: DataFrame, ids: DataFrame) -> DataFrame:
    """(cell_id, icls): null where a cell has no path."""
    return cells.join(ids.select("path", "icls"), "path", "left").select("cell_id", "icls")


def marker_rank(markers: DataFrame, n: int = 10, gene_filter: GeneFilter | None = None) -> DataFrame:
    """Markers (resolution, grp, gene, rank) that pass the filter, ranked anew, the first n of each group."""
    rows = gene_filter.filter(markers) if gene_filter else markers
    place = F.row_number().over(Window.partitionBy("resolution", "grp").orderBy("rank", "gene"))
    return rows.withColumn("rank", place).where(F.col("rank") <= n).select("resolution", "grp", "gene", "rank")


def presence(ranked: DataFrame, chosen: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each gene of the chosen (resolution, group) pairs, with 0/1 columns p0, p1, ..., most shared first."""
    hit = [((F.col("resolution") == r) & (F.col("grp") == g)).cast("int") for r, g in chosen]
    some = ranked.where(sum(hit) > 0)
    rows = some.groupBy("gene").agg(*[F.max(h).alias(f"p{k}") for k, h in enumerate(hit)])
    order = Window.orderBy(*[F.desc(f"p{k}") for k in range(len(chosen))], "gene")
    return rows.withColumn("place", F.row_number().over(order))  # a row for each listed gene


def presence_by_batch(found: DataFrame, chosen: Sequence[tuple[str, str]], strips: DataFrame) -> DataFrame:
    """(place, gene, level, grp, present, batch, n_cells, active, share, strip) of a presence table.

    strips: (resolution, grp, gene, batch, n_cells, active, share, place) as by_batch gives them for
    each resolution; a strip is a batch's place in its cell, active ones first, the brightest first.
    """
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(r).alias("resolution"), F.lit(g).alias("grp"), F.col(f"p{k}").alias("present")) for k, (r, g) in enumerate(chosen)]))
    cells = found.select("place", "gene", level.alias("x")).select("place", "gene", "x.*")
    own = strips.withColumnRenamed("place", "strip")
    return cells.join(own, ["resolution", "grp", "gene"]).select("place", "gene", "level", "grp", "present", "batch", "n_cells", "active", "share", "strip")


def payload(ids: DataFrame, ranked: DataFrame, centres: DataFrame) -> DataFrame:
    """(icls, json) for a viewer: path, labels, size, place and marker genes of each path."""
    genes = ranked.groupBy("resolution", "grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "gene"))), lambda x: x["gene"]).alias("genes"))
    rows = ids.join(centres.withColumnRenamed("grp", "icls"), "icls", "left")
    for k in range(3):
        own = genes.where(F.col("resolution") == f"g{k}").select(F.col("grp").alias(f"g{k}"), F.col("genes").alias(f"genes_g{k}"))
        rows = rows.join(own, f"g{k}", "left")
    return rows.select("icls", F.to_json(F.struct("path", "g0", "g1", "g2", "n", "x", "y", "genes_g0", "genes_g1", "genes_g2")).alias("json"))

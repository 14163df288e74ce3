"""Three labellings of the same cells: their paths, the genes that mark them, and what a viewer shows."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import Dataset
from ..operators import batch as batches
from ..operators import graph, hierarchy
from ..operators.genes import GeneFilter


@dataclass(frozen=True)
class HierarchyResult:
    """cells (cell_id, path), ids (path, icls, g0, g1, g2, n), markers (resolution, grp, gene, rank) of the
    whole lists and ranked, the first of each group; strips by batch, if one was given."""

    data: Dataset
    levels: tuple[str, ...]
    cells: DataFrame
    ids: DataFrame
    markers: DataFrame
    ranked: DataFrame
    n_top: int
    min_cells: int
    strips: DataFrame | None = None

    def icls(self) -> DataFrame:
        """(cell_id, icls)."""
        return hierarchy.cell_ids(self.cells, self.ids)

    def path(self, icls: str) -> list[tuple[str, str]]:
        """The (resolution, group) pairs of one path."""
        row = self.ids.where(F.col("icls") == icls).first()
        if row is None:
            raise KeyError(icls)
        return [(f"g{k}", row[f"g{k}"]) for k in range(len(self.levels))]

    def compare(self, icls: str, gene_filter: GeneFilter | None = None) -> DataFrame:
        """The first markers of each level of a path, with the levels that have them."""
        return hierarchy.presence(hierarchy.marker_rank(self.markers, self.n_top, gene_filter), self.path(icls))

    def compare_batch(self, icls: str, gene_filter: GeneFilter | None = None) -> DataFrame:
        """:meth:`compare` with a strip of batch means in each cell."""
        if self.strips is None:
            raise ValueError("no batch was given")
        return hierarchy.presence_by_batch(self.compare(icls, gene_filter), self.path(icls), self.strips)

    def payload(self) -> DataFrame:
        """(icls, json) of every path; with batches also (grp, json) strips of the ranked genes."""
        if self.data.coords is None:
            raise ValueError("a viewer needs coordinates")
        centres = graph.centroids(self.data.coords, self.icls().withColumnRenamed("icls", "grp"))
        return hierarchy.payload(self.ids, self.ranked, centres)

    def strip_payload(self) -> DataFrame:
        """(resolution, grp, gene, json): a ranked gene's batches in drawing order."""
        if self.strips is None:
            raise ValueError("no batch was given")
        some = self.strips.join(self.ranked.select("resolution", "grp", "gene"), ["resolution", "grp", "gene"], "left_semi")
        cells = F.sort_array(F.collect_list(F.struct("place", "batch", "n_cells", "active", "share")))
        return some.groupBy("resolution", "grp", "gene").agg(F.to_json(cells).alias("json"))

    def write_html(self, path: str) -> str:
        """Write one page that draws the paths and lists their genes: a text table of one file at ``path``.

        The page holds a row for each path (and strip), not the cells.
        """
        rows = [json.loads(r["json"]) | {"icls": r["icls"]} for r in self.payload().collect()]  # a row for each path
        strips = [] if self.strips is None else [r.asDict() for r in self.strip_payload().collect()]  # n_top for each group
        spark = self.ids.sparkSession
        page = PAGE.replace("ROWS", json.dumps(rows).replace("</", "<\\/")).replace("STRIPS", json.dumps(strips).replace("</", "<\\/"))
        spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return path


#: A page without outside parts: a canvas with a disc for each path, and a table of the chosen one.
PAGE = """<!doctype html><meta charset="utf-8"><title>Paths</title><canvas id="c" width="800" height="600"></canvas><table id="t"></table>
<script>
const rows = ROWS, strips = STRIPS, c = document.getElementById("c"), g = c.getContext("2d");
const xs = rows.map(r => r.x ?? 0), ys = rows.map(r => r.y ?? 0), most = Math.max(1, ...rows.map(r => r.n));
const fit = (v, all, size) => 30 + (size - 60) * (v - Math.min(...all)) / (Math.max(...all) - Math.min(...all) || 1);
rows.forEach((r, k) => { r.px = fit(xs[k], xs, 800); r.py = 600 - fit(ys[k], ys, 600); g.beginPath(); g.arc(r.px, r.py, 4 + 20 * Math.sqrt(r.n / most), 0, 7); g.fillStyle = `hsl(${360 * k / rows.length} 70% 60%)`; g.fill(); g.fillStyle = "black"; g.fillText(r.icls, r.px, r.py); });
const bars = (level, grp, gene) => strips.filter(s => s.resolution === level && s.grp === grp && s.gene === gene).flatMap(s => JSON.parse(s.json)).map(b => `<span title="${b.batch}" style="display:inline-block;width:5px;height:10px;background:${b.active ? `rgba(200,0,0,${b.share})` : "#ccc"}"></span>`).join("");
c.onclick = e => { const r = rows.reduce((a, b) => Math.hypot(a.px - e.offsetX, a.py - e.offsetY) < Math.hypot(b.px - e.offsetX, b.py - e.offsetY) ? a : b);
  document.getElementById("t").innerHTML = `<caption>${r.path} (${r.n})</caption>` + ["g0", "g1", "g2"].map(l => `<tr><th>${r[l]}</th><td>${(r["genes_" + l] ?? []).map(x => x + bars(l, r[l], x)).join(" ")}</td></tr>`).join(""); };
</script>
"""


def run(
    data: Dataset,
    markers: Mapping[str, DataFrame],
    min_cells: int | None = None,
    n_top: int = 10,
    gene_filter: GeneFilter | None = None,
    batch: str | None = None,
    knn: DataFrame | None = None,
) -> HierarchyResult:
    """Combine three labellings and their markers.

    markers: label column -> (grp, gene, rank), coarse to fine. Cells of paths of fewer than
    ``min_cells`` cells (a two-hundredth of all, unless given) take their neighbours' paths, over
    ``knn`` or that of ``data``. gene_filter chooses the ranked genes; batch is a label column whose
    means by group are kept for comparison.
    """
    levels = tuple(markers)
    small = hierarchy.default_min_cells(data.obs.count()) if min_cells is None else min_cells
    near = data.knn if knn is None else knn
    cells = hierarchy.paths(data.obs, levels)
    cells = cut(hierarchy.split_small(cells, small)) if near is None else hierarchy.reassign(cells, near, small)
    ids = cut(hierarchy.path_ids(cells, len(levels)))
    lists = _stacked([m.select(F.lit(f"g{k}").alias("resolution"), "grp", "gene", "rank") for k, m in enumerate(markers.values())])
    lists = cut(lists)
    ranked = cut(hierarchy.marker_rank(lists, n_top, gene_filter))
    strips = None
    if batch is not None:
        wanted = ranked.select("gene").distinct()
        strips = cut(_stacked([batches.by_batch(data.expr, data.obs, label, batch, wanted).withColumn("resolution", F.lit(f"g{k}")) for k, label in enumerate(levels)]))
    return HierarchyResult(data, levels, cells, ids, lists, ranked, n_top, small, strips)


def _stacked(tables: Sequence[DataFrame]) -> DataFrame:
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    return found

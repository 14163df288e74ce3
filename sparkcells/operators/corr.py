"""Correlations between genes, and networks of genes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable
from ..functions.special import p_value
from ..lineage import bounded, cut, few
from ..shipping import shipped
from .blocks import paired

#: Genes of one block, values of one block, products taken at once.
GENES, ENTRIES, PRODUCTS = 1024, 1_000_000, 1 << 21


def moments(expr: DataFrame) -> DataFrame:
    return expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))


def _pearson(n: Column, sx: Column, qx: Column, sy: Column, qy: Column, xy: Column) -> Column:
    """r from sums over all n cells; null where a side doesn't vary."""
    vx, vy = qx - sx * sx / n, qy - sy * sy / n
    tiny = F.lit(1e-12)
    vary = (n > 1) & (vx > tiny * qx) & (vy > tiny * qy)
    return F.when(vary, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (xy - sx * sy / n) / F.sqrt(F.when(vary, vx * vy)))))


def one_vs_all(expr: DataFrame, n_cells: int, gene: str) -> DataFrame:
    """(gene, corr, t): Pearson r of one gene with all, over all n cells; the gene itself has r = 1.

    Zeros that aren't stored add nothing to the sums, so only common cells are joined.
    """
    own = expr.where(F.col("gene") == gene).select("cell_id", F.col("value").alias("x"))
    own_sums = own.agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("qx"))
    rows = _with_products(expr, own, ["gene"]).crossJoin(F.broadcast(own_sums))  # one row
    n = F.lit(float(n_cells))
    r = _pearson(n, F.col("sx"), F.col("qx"), F.col("s"), F.col("q"), F.coalesce("xy", F.lit(0.0)))
    rows = rows.select("gene", F.when(F.col("gene") == gene, 1.0).otherwise(r).alias("corr"))
    return rows.withColumn("t", t_statistic(F.col("corr"), n))


def _with_products(rows: DataFrame, own: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s, q and xy: sums of values, squares and products with own (cell_id, x), in one pass."""
    both = rows.join(own, "cell_id", "left")
    return both.groupBy(*keys).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.sum(F.col("x") * F.col("value")).alias("xy"))


def t_statistic(r: Column, n: Column) -> Column:
    return F.when((F.abs(r) < 1) & (n > 2), r * F.sqrt((n - 2) / F.when(F.abs(r) < 1, 1 - r * r)))


def with_p(corr: DataFrame, n_cells: int, gene: str) -> DataFrame:
    """With pval: 0 for the gene itself, null where r is undefined or 1 in size."""
    p = F.when(F.col("gene") == gene, 0.0).otherwise(p_value(F.col("t"), F.lit(float(n_cells - 2))))
    return corr.withColumn("pval", p).select("gene", "corr", "pval")


def by_condition(expr: DataFrame, obs: DataFrame, label: str, gene: str) -> DataFrame:
    """(condition, gene, corr, t): one against all in the cells of each condition, in one pass."""
    cells = obs.select("cell_id", F.col(label).cast("string").alias("condition"))
    sizes = cells.groupBy("condition").agg(F.count("*").cast("double").alias("n"))
    own = expr.where(F.col("gene") == gene).select("cell_id", F.col("value").alias("x"))
    goi = own.join(cells, "cell_id").groupBy("condition").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("qx"))
    found = _with_products(expr.join(cells, "cell_id"), own, ["condition", "gene"]).join(goi, "condition").join(sizes, "condition")
    r = _pearson(F.col("n"), F.col("sx"), F.col("qx"), F.col("s"), F.col("q"), F.coalesce("xy", F.lit(0.0)))
    found = found.select("condition", "gene", F.when(F.col("gene") == gene, 1.0).otherwise(r).alias("corr"), "n")
    return found.select("condition", "gene", "corr", t_statistic(F.col("corr"), F.col("n")).alias("t"))


def wide(long: DataFrame, conditions: Sequence[str], value: str = "corr") -> DataFrame:
    """gene and a column <condition>_corr for each condition: the full outer merge, as one pivot."""
    cells = [F.max(F.when(F.col("condition") == c, F.col(value))).alias(f"{c}_{value}") for c in conditions]
    return long.groupBy("gene").agg(*cells)


def top_genes(long: DataFrame, n: int = 10, exclude: str | None = None) -> DataFrame:
    """(condition, gene, corr, rank): the n largest correlations of each condition; ties by gene.

    exclude: a gene to leave out, with all that correlate at 1.
    """
    rows = long.where(F.col("corr").isNotNull())
    if exclude is not None:
        rows = rows.where((F.col("gene") != exclude) & (F.col("corr") < 1))
    place = F.row_number().over(Window.partitionBy("condition").orderBy(stable(F.col("corr")).desc(), "gene"))
    return rows.withColumn("rank", place).where(F.col("rank") <= n).select("condition", "gene", "corr", "rank")


def features(top: DataFrame, long: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """gene and its correlation under every condition (undefined: 0), for the genes of ``top``."""
    return wide(long.join(top.select("gene").distinct(), "gene", "left_semi"), conditions).fillna(0.0)


def _centred(x: list[Column]) -> list[Column]:
    mean = sum(x) / F.lit(float(len(x)))
    return [a - mean for a in x]


def _angle(x: list[Column], y: list[Column]) -> Column:
    """1 less the cosine; null where a side is zero."""
    size = F.sqrt(sum(a * a for a in x)) * F.sqrt(sum(b * b for b in y))
    return 1 - sum(a * b for a, b in zip(x, y, strict=True)) / F.nullif(size, F.lit(0.0))


#: Distances of feature rows, by name; undefined ones are null and come last.
METRICS = {
    "euclidean": lambda pairs: F.sqrt(sum((a - b) * (a - b) for a, b in pairs)),
    "cityblock": lambda pairs: sum(F.abs(a - b) for a, b in pairs),
    "sqeuclidean": lambda pairs: sum((a - b) * (a - b) for a, b in pairs),
    "cosine": lambda pairs: _angle([a for a, _ in pairs], [b for _, b in pairs]),
    "correlation": lambda pairs: _angle(_centred([a for a, _ in pairs]), _centred([b for _, b in pairs])),
    "canberra": lambda pairs: sum(F.coalesce(F.abs(a - b) / F.nullif(F.abs(a) + F.abs(b), F.lit(0.0)), F.lit(0.0)) for a, b in pairs),
    "braycurtis": lambda pairs: sum(F.abs(a - b) for a, b in pairs) / F.nullif(sum(F.abs(a + b) for a, b in pairs), F.lit(0.0)),
    "chebyshev": lambda pairs: F.greatest(*[F.abs(a - b) for a, b in pairs]) if len(pairs) > 1 else F.abs(pairs[0][0] - pairs[0][1]),
}


def gene_network(matrix: DataFrame, k: int = 5, metric: str = "euclidean") -> DataFrame:
    """(a, b, dist, weight), a < b: each gene with its k nearest others, joined both ways; weight = 1 / (dist + 1e-6).

    matrix: gene and feature columns. It holds the selected genes, so its square is small; ties by gene.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    names = [c for c in matrix.columns if c != "gene"]
    left = matrix.select(F.col("gene").alias("src"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(names)])
    right = matrix.select(F.col("gene").alias("dst"), *[F.col(f"`{c}`").alias(f"y{i}") for i, c in enumerate(names)])
    dist = METRICS[metric]([(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(len(names))])
    pairs = left.join(right, F.col("src") != F.col("dst")).select("src", "dst", dist.alias("dist"))
    near = pairs.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.asc_nulls_last("dist"), "dst"))).where(F.col("place") <= k)
    edges = near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("dist").alias("dist"))
    return edges.withColumn("weight", 1 / (F.col("dist") + 1e-6))


def _numbered(some: DataFrame) -> DataFrame:
    """(gene, part, at, s, q): genes in blocks by name, each of at most GENES genes and about ENTRIES values (a gene isn't split)."""
    share = F.greatest(F.lit(1.0 / GENES), F.col("n") / F.lit(float(ENTRIES)))
    along = Window.orderBy("gene")  # genes fit one task
    rows = moments(some).join(some.groupBy("gene").agg(F.count("*").alias("n")), "gene")
    rows = rows.withColumn("part", F.floor(F.sum(share).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.least(share, F.lit(1.0)) / 2).cast("int"))
    return rows.withColumn("at", (F.row_number().over(Window.partitionBy("part").orderBy("gene")) - 1).cast("int")).select("gene", "part", "at", "s", "q")


def _packed(some: DataFrame, numbered: DataFrame) -> DataFrame:
    """(i, names, s, q, cells, at, x): a row for each block of genes, its values by cell in arrays' bytes; written."""
    cells = cut(some.select("cell_id").where("cell_id is not null").distinct().select("cell_id", F.monotonically_increasing_id().alias("cell")))
    rows = some.where("value is not null").join(cells, "cell_id").join(bounded(numbered.select("gene", "part", "at"), 1_000_000), "gene").select("part", "cell", "at", F.col("value").cast("double").alias("value"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell")
        arrays = [rows.column("cell").to_numpy(), rows.column("at").to_numpy().astype(np.int32), rows.column("value").to_numpy()]
        return pa.table([pa.array([rows.column("part")[0].as_py()], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=["i", "cells", "at", "x"])

    held = shipped(rows).groupBy("part").applyInArrow(pack, "i int, cells binary, at binary, x binary")
    own = F.sort_array(F.collect_list(F.struct("at", "gene", "s", "q")))
    meta = numbered.groupBy(F.col("part").alias("i")).agg(own.alias("own"))
    meta = meta.select("i", F.col("own.gene").alias("names"), F.col("own.s").alias("s"), F.col("own.q").alias("q"))
    return cut(meta.join(held, "i", "left"))


def _products(a: list[np.ndarray], b: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sums of products of all pairs of two blocks' genes over the cells that both are in. a, b: cells (ascending), genes' places, values."""
    total = np.zeros(shape[0] * shape[1])
    first = np.searchsorted(b[0], a[0], side="left")
    n = np.searchsorted(b[0], a[0], side="right") - first
    ends = np.cumsum(n)
    low = 0
    while low < len(n):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PRODUCTS, side="right")))
        own = n[low:high]
        if many := int(own.sum()):
            begin = first[low:high] - (ends[low:high] - own - done)
            right = np.repeat(begin, own) + np.arange(many)
            flat = np.repeat(a[1][low:high].astype(np.int64) * shape[1], own) + b[1][right]
            total += np.bincount(flat, np.repeat(a[2][low:high], own) * b[2][right], minlength=len(total))
        low = high
    return total.reshape(shape)


def gene_gene(expr: DataFrame, n_cells: int, genes: DataFrame, least: float | None = None) -> DataFrame:
    """(a, b, corr), a < b: Pearson r of all pairs of some genes, from the cells that both are in.

    genes: a table (gene); the pairs returned grow with its square, the products only with the
    pairs of genes that a cell holds. Genes are packed into blocks, and all pairs of blocks meet
    without being dealt. least: pairs under it are computed too, but not returned (:func:`pruned`
    of what is returned is that of all).
    """
    some = cut(expr.join(genes.select("gene").distinct(), "gene", "left_semi").select("cell_id", "gene", "value"))
    table = _packed(some, cut(_numbered(some)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = {k: batch.column(k)[row] for k in batch.schema.names}
                names, sums, squares, held = ([own[f"{side}{k}"] for side in ("", "other_")] for k in ("names", "s", "q", "x"))
                names = [x.values for x in names]
                (sa, sb), (qa, qb) = ([x.values.to_numpy(zero_copy_only=False) for x in two] for two in (sums, squares))
                values = [[np.frombuffer(own[f"{side}{k}"].as_buffer() if own[f"{side}{k}"].is_valid else b"", kind) for k, kind in (("cells", np.int64), ("at", np.int32), ("x", float))] for side in ("", "other_")]
                xy = _products(*values, (len(sa), len(sb)))
                va, vb = qa - sa * sa / n_cells, qb - sb * sb / n_cells
                vary = ((va > 1e-12 * qa)[:, None] & (vb > 1e-12 * qb)[None, :]) & (n_cells > 1)
                with np.errstate(all="ignore"):
                    r = np.clip((xy - sa[:, None] * sb[None, :] / n_cells) / np.sqrt(va[:, None] * vb[None, :]), -1.0, 1.0)
                wanted = np.ones(r.shape, bool) if least is None else vary & (r >= least)
                if own["i"].as_py() == own["other_i"].as_py():
                    wanted &= np.arange(len(sa))[:, None] < np.arange(len(sb))[None, :]
                at = np.flatnonzero(wanted)
                for low in range(0, len(at), 1 << 17):
                    part = at[low : low + (1 << 17)]
                    a, b = np.divmod(part, len(sb))
                    yield pa.RecordBatch.from_arrays([names[0].take(pa.array(a)), names[1].take(pa.array(b)), pa.array(r.ravel()[part], mask=~vary.ravel()[part])], names=["a", "b", "corr"])

    other = table.select(*[F.col(c).alias(f"other_{c}") for c in table.columns])
    pairs = paired(table, other, max(1, table.count()), "i", F.col("i") <= F.col("other_i"))
    return shipped(pairs).mapInArrow(meet, "a string, b string, corr double")


def pruned(corr: DataFrame, cutoff: float) -> DataFrame:
    """Edges whose correlation reaches the cutoff."""
    return corr.where(F.col("corr") >= cutoff)


def annotation_corr(expr: DataFrame, obs: DataFrame, label: str) -> DataFrame:
    """(gene, grp, corr): Pearson r of each gene with the membership of each group, over all cells."""
    cells = obs.select("cell_id", F.col(label).cast("string").alias("grp"))
    n = obs.agg(F.count("*").cast("double").alias("n"))
    sizes = cells.groupBy("grp").agg(F.count("*").cast("double").alias("size"))
    sums = expr.join(cells, "cell_id").groupBy("gene", "grp").agg(F.sum("value").alias("xy"))
    rows = moments(expr).crossJoin(few(sizes)).join(sums, ["gene", "grp"], "left").crossJoin(F.broadcast(n))  # one row
    r = _pearson(F.col("n"), F.col("s"), F.col("q"), F.col("size"), F.col("size"), F.coalesce("xy", F.lit(0.0)))
    return rows.select("gene", "grp", r.alias("corr"))


def strongest(matrix: DataFrame, most: int = 96) -> DataFrame:
    """The rows of a feature matrix with the largest mean absolute correlation, at most ``most``; ties by gene."""
    names = [c for c in matrix.columns if c != "gene"]
    mean = sum(F.abs(F.col(f"`{c}`")) for c in names) / F.lit(float(len(names)))
    return matrix.orderBy(stable(mean).desc(), "gene").limit(most)


def gene_colour(corr: DataFrame, cutoff: float = 0.4) -> DataFrame:
    """(gene, grp, corr): the group that a gene follows best; null at or below the cutoff."""
    best = corr.where(F.col("corr").isNotNull()).groupBy("gene").agg(F.min(F.struct((-F.col("corr")).alias("away"), F.col("grp"))).alias("x"))
    return best.select("gene", F.when(-F.col("x.away") > cutoff, F.col("x.grp")).alias("grp"), (-F.col("x.away")).alias("corr"))

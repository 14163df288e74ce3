"""Nearest neighbours of cells and what they pass on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import portable_hash
from ..lineage import cut, few
from ..shipping import shipped
from . import blocks

#: Queries whose distances are taken at once.
TILE = 256


def _candidates(x: np.ndarray, y: np.ndarray, limit: np.ndarray, k: int, skip: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest columns of each row, ties by column, none far beyond the row's ``limit``.

    A product in single precision proposes, on values moved and scaled so that its rounding is
    known; exact distances decide. skip: rows (ascending) and columns of pairs that aren't taken.
    """
    middle = x.mean(0)
    own, other = x - middle, y - middle
    size = max(np.abs(own).max(initial=0.0), np.abs(other).max(initial=0.0)) or 1.0
    own, other = own / size, other / size
    square, far = (own * own).sum(1), (other * other).sum(1)
    # the product's rounding is far below this, so no nearest point is lost
    slack = 8 * (x.shape[1] + 8) * (square + far.max(initial=0.0)) + 1e-30
    with np.errstate(over="ignore"):
        limit = (limit / size) ** 2 * (1 + 1e-12)
        kind = np.float32 if np.median(limit) > np.median(slack) * np.finfo(np.float32).eps else np.float64
        slack = slack * np.finfo(kind).eps
        limit = (limit + slack - square).astype(kind)
    own = np.concatenate([-2 * own, np.ones((len(own), 1))], 1).astype(kind)
    other = np.concatenate([other, far[:, None]], 1).astype(kind).T
    found, last = [], min(k, len(y)) - 1
    for low in range(0, len(x), TILE):
        rough = own[low : low + TILE] @ other
        own_skip = slice(*np.searchsorted(skip[0], [low, low + TILE]))
        rough[skip[0][own_skip] - low, skip[1][own_skip]] = np.inf
        most = limit[low : low + TILE]
        if (new := np.flatnonzero(~np.isfinite(most))).size:
            most[new] = np.partition(rough[new], last, axis=1)[:, last] + 2 * slack[low + new]
        at, col = np.divmod(np.flatnonzero(rough <= np.minimum(most, np.finfo(kind).max)[:, None]), rough.shape[1])
        if at.size:
            at = at + low
            value = np.concatenate([np.sqrt(((x[at[p : p + (1 << 17)]] - y[col[p : p + (1 << 17)]]) ** 2).sum(1)) for p in range(0, len(at), 1 << 17)])
            order = np.lexsort((col, value, at))
            at, col, value = at[order], col[order], value[order]
            top = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append((at[top], col[top], value[top]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _same(names: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of equal names; others: ascending."""
    first = pc.fill_null(pc.index_in(names, value_set=others), -1).to_numpy(zero_copy_only=False).astype(int)
    rows = np.flatnonzero(first >= 0)
    if not rows.size:
        return rows, rows
    runs = pc.run_end_encode(others).run_ends.to_numpy()
    n = runs[np.searchsorted(runs, first[rows], side="right")] - first[rows]
    return np.repeat(rows, n), np.repeat(first[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class _Nearest:
    """The k nearest of some points among the blocks that they have met; ties by name."""

    def __init__(self, names: pa.Array, x: np.ndarray, k: int, include_self: bool):
        self.names, self.x, self.k, self.include_self = names, x, k, include_self
        self.far, self.found, self.known = np.full((len(x), k), np.inf), np.full((len(x), k), None, object), np.full(len(x), np.inf)

    def expect(self, names: pa.Array, y: np.ndarray) -> None:
        """These are met later: nothing that is farther than the k nearest of them has to be kept."""
        at, _, value = _candidates(self.x, y, self.known, self.k, self._skip(self.names, names))
        last = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == self.k - 1)
        self.known[at[last]] = value[last]

    def meet(self, names: pa.Array, y: np.ndarray) -> None:
        """names: ascending."""
        limit = np.minimum(self.far[:, -1], self.known)
        low, high = y.min(0), y.max(0)
        gap = np.maximum(np.maximum(low - self.x, self.x - high), 0.0)
        near = np.flatnonzero(np.sqrt((gap * gap).sum(1)) * (1 - 1e-12) <= limit)  # the others have k points nearer than any of these
        if not near.size:
            return
        at, col, value = _candidates(self.x[near], y, limit[near], self.k, self._skip(self.names.take(pa.array(near)), names))
        fine = value <= limit[near[at]]
        if fine.any():
            self._merge(near[at[fine]], value[fine], names.take(pa.array(col[fine])).to_numpy(zero_copy_only=False))

    def _skip(self, names: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return (np.zeros(0, int), np.zeros(0, int)) if self.include_self else _same(names, others)

    def _merge(self, at: np.ndarray, value: np.ndarray, name: np.ndarray) -> None:
        rows = np.unique(at)
        old = np.isfinite(self.far[rows])
        at, value, name = np.concatenate([np.repeat(rows, old.sum(1)), at]), np.concatenate([self.far[rows][old], value]), np.concatenate([self.found[rows][old], name])
        order = np.lexsort((value, at))
        at, value, name = at[order], value[order], name[order]
        same = (at[1:] == at[:-1]) & (value[1:] == value[:-1])
        if same.any():
            tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            rank = np.zeros(len(at), int)
            rank[tied] = np.unique(name[tied].astype(object), return_inverse=True)[1]
            order = np.lexsort((rank, value, at))
            at, value, name = at[order], value[order], name[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < self.k
        self.far[rows], self.found[rows] = np.inf, None
        self.far[at[top], place[top]], self.found[at[top], place[top]] = value[top], name[top]

    def result(self) -> pa.RecordBatch:
        at, place = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(at)), pa.array(self.found[at, place], pa.string()), pa.array(self.far[at, place])], names=["src", "dst", "dist"])


def _block(batch: pa.RecordBatch, row: int, names: str, x: str) -> tuple[pa.Array, np.ndarray]:
    own = batch.column(names)[row].values
    return own, np.frombuffer(batch.column(x)[row].as_buffer(), float).reshape(len(own), -1)


def _nearest(k: int, include_self: bool):
    """The k nearest right points of each left point, ties by name."""

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Nearest(left.column("cell_id").combine_chunks(), blocks.vectors(left.column("vec")) if left.num_rows else np.zeros((0, 1)), k, include_self)
        if left.num_rows and right.num_rows:
            right = right.sort_by("cell_id")
            own.meet(right.column("cell_id").combine_chunks(), blocks.vectors(right.column("vec")))
        return pa.Table.from_batches([own.result()])

    return near


def _placed(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _search(left: DataFrame, right: DataFrame, k: int, include_self: bool) -> DataFrame:
    """(src, dst, dist, place) of packed blocks (one table: of its points among themselves).

    A left block meets all right blocks, keeps its points' k nearest as it goes on and skips the
    blocks that are too far, so k rows a point come out and what is dealt grows with the points.
    """
    same = left is right

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Nearest] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                i = batch.column("i")[row].as_py()
                if i not in held:
                    names, x = _block(batch, row, "names", "x")
                    held[i] = own = _Nearest(pa.array(names.to_pylist(), pa.string()), x.copy(), k, include_self)  # copies: a batch is large
                    if same:
                        own.expect(own.names, own.x)
                held[i].meet(*_block(batch, row, "others", "y"))
        for own in held.values():
            yield own.result()

    tasks = max(1, left.count())
    pairs = blocks.paired(left, right.select(F.col("i").alias("j"), F.col("names").alias("others"), F.col("x").alias("y")), tasks, "i")
    return _placed(shipped(pairs).mapInArrow(visit, "src string, dst string, dist double"), k)


def knn(coords: DataFrame, k: int = 10, include_self: bool = True, queries: DataFrame | None = None, block: int = blocks.BLOCK) -> DataFrame:
    """(src, dst, dist, place): the exact k nearest points by Euclidean distance; ties by name.

    coords: (cell_id, vec). Points that are near one another are packed into blocks, and all pairs
    of blocks meet without being dealt: products propose, exact distances decide, and blocks too far
    away are skipped. Of points without structure in many axes none are, and the work grows with
    their square; see :func:`knn_probed` for tables where that is too much.
    """
    rows = coords.where("size(vec) > 0")
    right = blocks.packed(rows, blocks.by_place(rows, rows.count(), block), block)
    if queries is None:
        return _search(right, right, k, include_self)
    asking = queries.where("size(vec) > 0")
    return _search(blocks.packed(asking, blocks.by_place(asking, asking.count(), block), block), right, k, include_self)


def _cells(x: np.ndarray, centres: np.ndarray, probes: int = 1) -> np.ndarray:
    """The numbers of the ``probes`` nearest centres of each row."""
    size = (centres * centres).sum(1)
    near = [np.argsort(size - 2 * (x[a : a + 256] @ centres.T), axis=1, kind="stable")[:, :probes] if probes > 1 else np.argmin(size - 2 * (x[a : a + 256] @ centres.T), axis=1)[:, None] for a in range(0, len(x), 256)]
    return np.concatenate(near) if near else np.zeros((0, 1), int)


def knn_probed(coords: DataFrame, k: int = 10, include_self: bool = True, probes: int = 8, cell: int = 4096, sample: int = 50_000, block: int = blocks.BLOCK) -> DataFrame:
    """(src, dst, dist, place): the k nearest of the points in the ``probes`` nearest cells of a point.

    The cells are those of k-means, fitted on about ``sample`` points, as many as make cells of
    about ``cell`` points, a tenth of the sample at most; a larger cell is searched in blocks. A point meets probes * cell others
    however many points there are, and is dealt ``probes`` times. ``recall`` measures what is lost;
    with as many probes as cells nothing is. Then a point isn't dealt to them: neighbouring cells
    are packed into blocks, which meet as those of :func:`knn` do.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = coords.count()
    n_cells = max(1, min(-(-n // cell), sample // 10))
    rows = coords.where("size(vec) > 0")
    some = rows.where(F.pmod(F.xxhash64("cell_id"), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, sample / max(n, 1)))))
    if n_cells > 1:
        fitted = KMeans(k=n_cells, seed=7, maxIter=10, featuresCol="own").fit(some.select(array_to_vector("vec").alias("own")))
        centres = np.array(fitted.clusterCenters())
    else:
        centres = np.zeros((1, 1))
    if probes >= len(centres):
        every = blocks.packed(rows, _by_cell(rows, n, centres, block), block)
        return _search(every, every, k, include_self)
    held = coords.sparkSession.sparkContext.broadcast(centres)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = blocks.vectors(batch.column("vec"))
                near = _cells(x, held.value, probes)
                made = pa.RecordBatch.from_arrays([batch.column("cell_id"), batch.column("vec"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["cell_id", "vec", "cells"])
                yield made.filter(pa.array(np.isfinite(x).all(1)))

    placed = cut(shipped(rows.select("cell_id", F.col("vec").cast("array<double>").alias("vec"))).mapInArrow(visit, "cell_id string, vec array<double>, cells array<int>"))
    sizes = few(placed.groupBy(F.get("cells", F.lit(0)).alias("at")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), 200_000)
    have = placed.withColumn("at", F.get("cells", F.lit(0))).join(sizes, "at").select("cell_id", "vec", "at", F.pmod(F.xxhash64("cell_id"), F.col("blocks")).cast("int").alias("j"))
    ask = placed.withColumn("at", F.explode("cells")).join(sizes, "at").select("cell_id", "vec", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.pmod(F.xxhash64("cell_id", F.lit(1)), F.lit(64)).cast("int").alias("salt"))
    # the points of a cell meet its askers in as many groups as keep a group's askers few
    parts = few(ask.groupBy("at", "j").agg(F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.count("*") / (8 * block)))).cast("int").alias("parts")), 200_000)
    ask = ask.join(parts, ["at", "j"]).withColumn("i", F.pmod("salt", F.col("parts"))).select("cell_id", "vec", "at", "j", "i")
    have = have.join(parts, ["at", "j"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell_id", "vec", "at", "j", "i")
    near = _nearest(k, include_self)
    have = have.select(*[F.col(c).alias(c) for c in have.columns])  # both sides begin at one table
    found = shipped(ask).groupBy("at", "j", "i").cogroup(have.groupBy("at", "j", "i")).applyInArrow(near, "src string, dst string, dist double")
    return _placed(found, k)


def _by_cell(rows: DataFrame, n: int, centres: np.ndarray, block: int):
    """The block of each row of an array: neighbouring cells share one, a large cell is in several."""
    if n <= block or len(centres) == 1 or not len(x := blocks.some(rows, n)):
        return blocks.by_place(rows, n, block)
    shared = blocks.Tree(centres, -(-n // block)).leaf(centres)
    leaf = lambda y: shared[_cells(y, centres)[:, 0]]
    return blocks.spread(leaf, np.bincount(leaf(x), minlength=shared.max() + 1) * (n / len(x)), block)


def recall(found: DataFrame, coords: DataFrame, k: int = 10, include_self: bool = True, queries: int = 256) -> float:
    """The share of the true k nearest that ``found`` holds, for about so many points chosen by hash."""
    n = max(coords.count(), 1)
    some = coords.where(F.pmod(F.xxhash64("cell_id", F.lit(5)), F.lit(1 << 30)) < max(1, int((1 << 30) * min(1.0, queries / n))))
    truth = cut(knn(coords, k, include_self, some).select("src", "dst"))
    hits = truth.join(found.select("src", "dst"), ["src", "dst"], "left_semi").count()
    return hits / max(truth.count(), 1)


def impute_neighbor(expr: DataFrame, neighbors: DataFrame, k: int | None = None) -> DataFrame:
    """(cell_id, gene, value): the mean over a cell's neighbours (itself included, if it is among them)."""
    size = F.lit(float(k)) if k else F.count("*").over(Window.partitionBy("src"))
    near = neighbors.select("src", "dst", size.alias("n"))
    rows = near.join(expr.withColumnRenamed("cell_id", "dst"), "dst")
    return rows.groupBy(F.col("src").alias("cell_id"), "gene").agg((F.sum("value") / F.first("n")).alias("value"))


def impute_labels(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, grp, share): the share of each label among a cell's neighbours. labels: (cell_id, grp)."""
    rows = neighbors.select("src", "dst").join(labels.withColumnRenamed("cell_id", "dst"), "dst").groupBy(F.col("src").alias("cell_id"), "grp").agg(F.count("*").alias("n"))
    return rows.select("cell_id", "grp", (F.col("n") / F.sum("n").over(Window.partitionBy("cell_id"))).alias("share"))


def grid_bins(coords: DataFrame, scale: int = 1, border: int = 2, dims: int = 3) -> DataFrame:
    """(cell_id, bin): the grid cell "x:y:z" of each point, after a shift of negative axes to zero."""
    axes = [F.get("vec", F.lit(k)) for k in range(dims)]
    least = coords.agg(*[F.least(F.min(x), F.lit(0.0)).alias(f"low{k}") for k, x in enumerate(axes)])
    rows = coords.crossJoin(F.broadcast(least))  # one row
    places = [F.floor((x - F.col(f"low{k}")) * scale + border * scale / 2).cast("long").cast("string") for k, x in enumerate(axes)]
    return rows.select("cell_id", F.concat_ws(":", *places).alias("bin"))


def bin_counts(bins: DataFrame) -> DataFrame:
    return bins.groupBy("bin").agg(F.count("*").alias("n"))


def grid_sample(bins: DataFrame, per_bin: int = 5, min_count: int = 2, seed: int = 0) -> DataFrame:
    """(cell_id, bin): up to ``per_bin`` cells of every bin with ``min_count`` cells, by a seeded hash."""
    full = bin_counts(bins).where(F.col("n") >= min_count).select("bin")
    place = F.row_number().over(Window.partitionBy("bin").orderBy(portable_hash(F.lit(str(seed)), F.col("cell_id")), "cell_id"))
    return bins.join(full, "bin", "left_semi").withColumn("place", place).where(F.col("place") <= per_bin).select("cell_id", "bin")


def drawn_values(expr: DataFrame, coords: DataFrame, genes: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, gene, x, y, value): some genes of (some) cells, zeros included, with the cells' first two axes.

    genes: a short table (gene); cells: (cell_id).
    """
    rows = coords if cells is None else coords.join(cells.select("cell_id"), "cell_id", "left_semi")
    wanted = few(genes.select("gene").distinct())
    own = expr.join(wanted, "gene", "left_semi")
    every = rows.select("cell_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y")).crossJoin(wanted)
    return every.join(own, ["cell_id", "gene"], "left").select("cell_id", "gene", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"))


def variable_genes(expr: DataFrame, raw: DataFrame, n_cells: int, min_mean: float = 0.0125, max_mean: float = 3.0, min_dispersion: float = 0.5, min_cells: int = 0, genes: DataFrame | None = None) -> DataFrame:
    """(gene, mean, dispersion, detected): genes within the limits; genes: a list (gene) to keep to, such as regulators."""
    from .stats import dispersion

    seen = raw.where("value > 0").groupBy("gene").agg(F.count("*").alias("cells"))
    rows = dispersion(expr, n_cells).join(seen, "gene")
    rows = rows.where((F.col("mean") > min_mean) & (F.col("mean") < max_mean) & (F.col("dispersion") > min_dispersion) & (F.col("cells") >= min_cells))
    rows = rows.select("gene", "mean", "dispersion", F.col("cells").alias("detected"))
    return rows if genes is None else rows.join(genes.select("gene").distinct(), "gene", "left_semi")


def centroids(coords: DataFrame, labels: DataFrame) -> DataFrame:
    """(grp, x, y): the medians of the first two axes. labels: (cell_id, grp)."""
    rows = coords.select("cell_id", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y")).join(labels, "cell_id")
    return rows.groupBy("grp").agg(F.median("x").alias("x"), F.median("y").alias("y"))

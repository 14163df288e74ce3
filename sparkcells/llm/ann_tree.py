"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors; every vector of the table is then put in
the leaf that it descends to. Leaves that hold too many rows of the table are grown on by trees of
their own, each fitted on a bounded sample of the leaf's rows, so that leaves stay small however
large the table is (up to NODES nodes; from there on they grow with it). A query walks the tree
best bin first: a priority queue holds nodes by their distance to the query, the nearest is
popped, an inner node pushes its children and a leaf is visited. The number of leaves to visit is
widened until the recall on sample queries, against brute force over the whole table, reaches the
target; a query goes on beyond it while its leaves hold too few rows. Leaves lie in pages of bounded size; a task searches, for the queries
that visit a page, the rows of the visited leaves, by exact cosines in double precision on the
original vectors, and returns k rows a query and page.

Of rows with one and the same vector only the k + 1 smallest ids are kept in the leaves. The
result is the same: any other copy has k smaller ids with an equal score before it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import cut, discard

#: Vectors at most from which the tree is fitted, and on which recall is calibrated.
SAMPLE = 20_000
CALIBRATION = 256
BRANCH = 8
LEAF = 48
RECALL = 0.97
#: Rows of a leaf above which it is grown on, rows that one leaf's tree is fitted on, and nodes of all, about.
LEAF_ROWS, LEAF_SAMPLE, NODES = 4096, 2048, 100_000
#: Rows of one page of leaves, and queries that meet it, at most.
BLOCK = 2048
CHUNK = 65_536


@dataclass
class Tree:
    """Nodes in arrays; children of node i are first[i] .. first[i] + n[i] - 1, none for a leaf."""

    centres: np.ndarray
    first: np.ndarray
    n: np.ndarray
    visits: int = 1

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.n == 0)

    def descend(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        at = np.zeros(len(unit), np.int64)
        while True:
            inner = np.flatnonzero(self.n[at] > 0)
            if not len(inner):
                return at
            for node in np.unique(at[inner]):
                own = inner[at[inner] == node]
                low, high = self.first[node], self.first[node] + self.n[node]
                at[own] = low + np.argmin(_distance(unit[own], self.centres[low:high]), 1)

    def walk(self, unit: np.ndarray, visits: int, held: dict[int, int] | None = None, least: int = 0) -> list[list[int]]:
        """Leaves of each query, best bin first: ``visits`` of them, or more until they hold ``least`` rows."""
        found = []
        for low in range(0, len(unit), 1024):
            for far in _distance(unit[low : low + 1024], self.centres):
                queue, own, rows = [(float(far[0]), 0)], [], 0
                while queue and (len(own) < visits or rows < least):
                    _, node = heapq.heappop(queue)
                    if not self.n[node]:
                        if held is None or held.get(node):
                            own.append(node)
                            rows += held[node] if held else 0
                        continue
                    for child in range(int(self.first[node]), int(self.first[node] + self.n[node])):
                        heapq.heappush(queue, (float(far[child]), child))
                found.append(own)
        return found


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (y * y).sum(1)[None, :] - 2 * (x @ y.T)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), np.int64)
    for step in range(rounds):
        new = np.argmin(_distance(x, centres), 1)
        if step and (new == own).all():
            break
        own = new
        for j in range(k):
            if (own == j).any():
                centres[j] = x[own == j].mean(0)
    return own


def build(unit: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 11) -> Tree:
    """A tree over unit vectors; without any, one leaf."""
    rng = np.random.default_rng(seed)
    dim = unit.shape[1] if unit.ndim == 2 else 1
    centres, first, n = [unit.mean(0) if len(unit) else np.zeros(dim)], [0], [0]
    todo = [(0, np.arange(len(unit)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= leaf or len(rows) < branch:
            continue
        own = _kmeans(unit[rows].copy(), branch, rng)
        groups = [rows[own == j] for j in range(branch) if (own == j).any()]
        if len(groups) < 2:
            continue
        first[node], n[node] = len(centres), len(groups)
        for group in groups:
            todo.append((len(centres), group))
            centres.append(unit[group].mean(0))
            first.append(0)
            n.append(0)
    return Tree(np.array(centres), np.array(first), np.array(n))


def grown(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """The tree with other trees in the places of some of its leaves."""
    centres, first, n = [tree.centres], [tree.first.copy()], [tree.n.copy()]
    size = len(tree.n)
    for leaf, part in sorted(parts.items()):
        if len(part.n) > 1:  # its root is the leaf itself
            first[0][leaf], n[0][leaf] = size + part.first[0] - 1, part.n[0]
            centres.append(part.centres[1:])
            first.append(np.where(part.n[1:] > 0, size + part.first[1:] - 1, 0))
            n.append(part.n[1:])
            size += len(part.n) - 1
    return Tree(np.concatenate(centres), np.concatenate(first), np.concatenate(n))


def calibrate(tree: Tree, unit: np.ndarray, leaves: list[np.ndarray], held: dict[int, int], recall: float = RECALL) -> int:
    """The least number of leaves (from a geometric widening) with the wanted recall.

    unit: queries; leaves: for each the leaves of its true neighbours; held: the leaves that hold rows.
    """
    n_leaves = max(1, len(held))
    order = tree.walk(unit, n_leaves, held)
    needed = [own.index(leaf) if leaf in own else n_leaves for own, near in zip(order, leaves, strict=True) for leaf in near.tolist()]
    visits = 1
    while needed and visits < n_leaves and np.mean(np.array(needed) < visits) < recall:
        visits = max(visits + 1, int(visits * 1.15))
    return min(visits, n_leaves)


def paged(tree: Tree, held: dict[int, int], block: int = BLOCK) -> dict[int, tuple[int, int]]:
    """(first page, number of pages) of each leaf that holds rows.

    Leaves that are near in the tree share a page of at most ``block`` rows; a larger leaf has
    several pages of its own.
    """
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        if tree.n[node]:
            stack += range(int(tree.first[node]), int(tree.first[node] + tree.n[node]))
        elif held.get(node):
            order.append(node)
    found, page, filled = {}, 0, 0
    for node in order:
        if filled and filled + held[node] > block:
            page, filled = page + 1, 0
        n = -(-held[node] // block)
        found[node] = (page, n)
        page, filled = (page + n, 0) if n > 1 else (page, filled + held[node])
    return found


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _placed(kept: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """(leaf, id, vector), written."""
    model = kept.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = model.value.descend(_unit(_matrix(batch.column("vector"), dim)))
                yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), batch.column("id"), batch.column("vector")], names=["leaf", "id", "vector"])

    return cut(shipped(kept).mapInArrow(place, "leaf int, id long, vector array<double>"))


def _parts(placed: DataFrame, large: dict[int, int], upto: int, dim: int) -> dict[int, Tree]:
    """A tree for each large leaf, fitted where about LEAF_SAMPLE of its rows, chosen by hash, meet."""
    spread = 1 << 30
    share = F.create_map(*[F.lit(x) for leaf, n in large.items() for x in (leaf, int(spread * min(1.0, LEAF_SAMPLE / n)) + 1)])
    some = placed.where(F.pmod(F.xxhash64("id", "vector"), F.lit(spread)) < F.coalesce(F.element_at(share, F.col("leaf")), F.lit(0)))

    def fit(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        unit = _unit(_matrix(table.column("vector"), dim))
        unit = unit[np.lexsort(unit.T)]  # whatever order the rows came in
        own = build(unit, leaf=max(1, len(unit) * upto // (2 * large[leaf])))
        return pa.table({"leaf": pa.array(np.full(len(own.n), leaf, np.int32)), "node": pa.array(np.arange(len(own.n), dtype=np.int32)), "first": pa.array(own.first.astype(np.int32)), "n": pa.array(own.n.astype(np.int32)), "centre": pa.array(list(own.centres), pa.list_(pa.float64()))})

    found = shipped(some).groupBy("leaf").applyInArrow(fit, "leaf int, node int, first int, n int, centre array<double>").toArrow().sort_by([("leaf", "ascending"), ("node", "ascending")])
    leaves, parts = found.column("leaf").to_numpy(), {}
    first, n, centres = found.column("first").to_numpy().astype(np.int64), found.column("n").to_numpy().astype(np.int64), _matrix(found.column("centre"), dim)
    for leaf in np.unique(leaves).tolist():
        own = leaves == leaf
        parts[leaf] = Tree(centres[own], first[own], n[own])
    return parts


def _true_leaves(placed: DataFrame, ids: np.ndarray, unit: np.ndarray, k: int, dim: int) -> list[np.ndarray]:
    """The leaves of the k nearest rows (of other ids) of each query, by brute force over all rows."""
    asked = placed.sparkSession.sparkContext.broadcast((ids, unit))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = asked.value
        for batch in batches:
            if batch.num_rows:
                near = own @ _unit(_matrix(batch.column("vector"), dim)).T
                other, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
                near[own_ids[:, None] == other[None, :]] = -np.inf
                top = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
                score = np.take_along_axis(near, top, 1)
                q, j = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(other[top[q, j]]), pa.array(leaf[top[q, j]]), pa.array(score[q, j])], names=["query", "id", "leaf", "score"])

    found = shipped(placed).mapInArrow(best, "query int, id long, leaf int, score double")
    once = found.groupBy("query", "id").agg(F.max(F.struct("score", "leaf")).alias("own")).select("query", "id", "own.*")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    rows = once.withColumn("place", place).where(F.col("place") <= k).select("query", "leaf").toPandas()  # k for each query
    return [rows["leaf"].to_numpy()[rows["query"].to_numpy() == q] for q in range(len(ids))]


def nearest(vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, sample: int = SAMPLE, recall: float = RECALL, leaf: int = LEAF, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that ``queries`` selects.

    Candidates are all rows with another id; nearness is the cosine; ties go to the smaller id.
    Rows with a null id, an unusable vector (null, zero, or with a null or non-finite component) or
    another dimension than most, which no cosine is defined with, take no part. Rows that repeat an
    id count once, by their best score; other columns aren't read. An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), queries.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    # one row for each length of vector
    most = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = most["dim"] if most else 1
    rows = rows.where(F.size("vector") == dim)
    copies = Window.partitionBy("vector").orderBy("id")
    kept = cut(rows.select("id", "vector").distinct().withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))
    fitted = kept.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "vector").toArrow()
    unit = _unit(_matrix(fitted.column("vector"), dim)) if fitted.num_rows else np.zeros((0, dim))
    tree = build(unit, leaf=leaf)
    placed = _placed(kept, tree, dim)
    counts = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    upto = max(leaf_rows, sum(counts.values()) * 8 // NODES)
    if any(x > upto for x in counts.values()):
        tree = grown(tree, _parts(placed, {k: x for k, x in counts.items() if x > upto}, upto, dim))
        before, placed = placed, _placed(kept, tree, dim)
        discard(before)
    counts = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).collect()  # a row for each leaf
    held = {r["leaf"]: r["ids"] for r in counts}
    pages = paged(tree, {r["leaf"]: r["n"] for r in counts})
    if len(unit):
        asked = np.unique(np.linspace(0, len(unit) - 1, min(CALIBRATION, len(unit))).astype(int))
        near = _true_leaves(placed, fitted.column("id").to_numpy()[asked], unit[asked], k, dim)
        tree.visits = calibrate(tree, unit[asked], near, held, recall)
    model = spark.sparkContext.broadcast(tree)  # bounded by the samples and NODES
    asking = rows.where("asks").select("id", "vector").distinct()
    chunks = max(1, -(-asking.count() // CHUNK))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                own = model.value.walk(_unit(_matrix(some.column("vector"), dim)), model.value.visits, held, 2 * k + 2)
                place, page, leaves = [], [], []
                for i, nodes in enumerate(own):
                    here: dict[int, list[int]] = {}
                    for node in nodes:
                        for x in range(pages[node][0], sum(pages[node])):
                            here.setdefault(x, []).append(node)
                    place += [i] * len(here)
                    page += here
                    leaves += here.values()
                take = pa.array(place, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), some.column("id").take(take), some.column("vector").take(take), pa.array(leaves, pa.list_(pa.int32()))], names=["page", "id", "vector", "leaves"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
            x, y = _matrix(left.column("vector"), dim), _matrix(right.column("vector"), dim)
            unit_x, unit_y = _unit(x), _unit(y)
            own, at = np.unique(right.column("leaf").to_numpy(), return_inverse=True)
            leaves = left.column("leaves").to_pylist()
            by_id = np.argsort(b, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(b[by_id]) != 0))
            for low in range(0, len(a), 128):
                near = unit_x[low : low + 128] @ unit_y.T
                open_ = np.zeros((len(near), len(own)), bool)
                for i, nodes in enumerate(leaves[low : low + 128]):
                    open_[i, np.searchsorted(own, np.intersect1d(nodes, own))] = True
                near[~open_[:, at] | (a[low : low + 128, None] == b[None, :])] = -np.inf
                best = np.maximum.reduceat(near[:, by_id], first, axis=1)  # of each id
                kth = np.partition(best, max(0, len(first) - k), axis=1)[:, max(0, len(first) - k)]
                i, j = np.nonzero((near >= (kth - 1e-9)[:, None]) & (near > -np.inf))
                score = cosine(x[low + i], y[j])
                order = np.lexsort((-score, b[j], a[low + i]))  # a query and an id once, by their best score
                i, j, score = i[order], j[order], score[order]
                once = np.append(True, (np.diff(a[low + i]) != 0) | (np.diff(b[j]) != 0))[: len(i)]
                i, j, score = i[once], j[once], score[once]
                i = np.searchsorted(a_own := np.unique(a[low : low + 128]), a[low + i])
                order = np.lexsort((b[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                for whole, new in zip(found, (a_own[i[top]], b[j[top]], score[top]), strict=True):
                    whole.append(new)
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"query_id": join(found[0], pa.int64()), "vec_id": join(found[1], pa.int64()), "score": join(found[2], pa.float64())})

    place_of = F.create_map(*[F.lit(x) for node, (first, n) in pages.items() for x in (node, first * 65536 + n)]) if pages else F.create_map(F.lit(0), F.lit(1))
    code = F.element_at(place_of, F.col("leaf"))
    cells = placed.withColumn("page", (F.floor(code / 65536) + F.pmod(F.xxhash64("id"), code % 65536)).cast("int"))
    cells = cells.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    visits = shipped(asking).mapInArrow(visit, "page int, id long, vector array<double>, leaves array<int>").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    found = shipped(visits).groupBy("page", "chunk").cogroup(cells.groupBy("page", "chunk")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y, each pair summed by itself, so equal vectors score alike anywhere."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))

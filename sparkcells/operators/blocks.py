"""Tables packed into blocks, and the meeting of all pairs of blocks without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import shipped

#: Points of one block.
BLOCK = 4096
#: Points that the places of blocks are learned from, and parts of one group at most.
SAMPLE, PARTS = 50_000, 1 << 20


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


class Tree:
    """Splits at medians of the widest axis, so that each leaf holds about as many points; points alike stay together."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.axis, self.at, self.down, self.sizes = [], [], [], []
        self._grow(x, max(1.0, len(x) / leaves))
        self.axis, self.at, self.down = np.array(self.axis), np.array(self.at, float), np.array(self.down).reshape(-1, 2)

    def _grow(self, x: np.ndarray, most: float) -> int:
        """The node's number, or -1 - leaf."""
        if len(x) > 1.5 * most and np.ptp(x, 0).max(initial=0.0) > 0:
            axis = int(np.argmax(np.var(x, 0)))
            at = np.partition(x[:, axis], (len(x) - 1) // 2)[(len(x) - 1) // 2]
            left = x[:, axis] <= at
            if left.all():  # the median is the largest value
                left = x[:, axis] < at
                at = x[left, axis].max(initial=-np.inf)
            if left.any():
                node = len(self.axis)
                self.axis.append(axis)
                self.at.append(at)
                self.down.append(None)
                self.down[node] = (self._grow(x[left], most), self._grow(x[~left], most))
                return node
        self.sizes.append(len(x))
        return -len(self.sizes)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.axis) else -1)
        while (open_ := np.flatnonzero(node >= 0)).size:
            own = node[open_]
            node[open_] = self.down[own, (x[open_, self.axis[own]] > self.at[own]).astype(int)]
        return -1 - node


def some(points: DataFrame, n: int, sample: int = SAMPLE) -> np.ndarray:
    """The finite vectors of about ``sample`` points, by hash."""
    share = max(1, int((1 << 30) * min(1.0, sample / max(n, 1))))
    held = points.where(F.pmod(F.xxhash64("cell_id"), F.lit(1 << 30)) < share).select(F.col("vec").cast("array<double>")).toArrow()
    x = vectors(held.column(0)) if held.num_rows else np.zeros((0, 1))
    return x[np.isfinite(x).all(1)]


def by_place(points: DataFrame, n: int, block: int = BLOCK) -> Callable[[np.ndarray], np.ndarray] | None:
    """The block of each row of an array, by a tree fitted on some points; None where one block holds all."""
    if n <= block or not len(x := some(points, n)):
        return None
    tree = Tree(x, -(-n // block))
    return spread(tree.leaf, np.array(tree.sizes) * (n / len(x)), block)


def spread(leaf: Callable[[np.ndarray], np.ndarray], sizes: np.ndarray, block: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The same leaves, each in as many blocks by a hash as its size asks for."""
    parts = np.maximum(1, np.ceil(sizes / (1.5 * block))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])

    def place(x: np.ndarray, mark: np.ndarray) -> np.ndarray:
        at = leaf(x)
        return first[at] + mark % parts[at]

    return place


def packed(points: DataFrame, place: Callable | None, block: int = BLOCK) -> DataFrame:
    """(i, names, x): blocks of about ``block`` points (cell_id, vec), written; names ascending, x as bytes.

    Points without finite values are in no block.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors(batch.column("vec"))
                fine = np.isfinite(x).all(1)
                at = np.zeros(len(x), np.int64)
                if place is not None:
                    at[fine] = place(x[fine], batch.column("mark").to_numpy()[fine])
                yield pa.RecordBatch.from_arrays([batch.column("cell_id"), batch.column("vec"), pa.array(at)], names=["cell_id", "vec", "at"]).filter(pa.array(fine))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell_id")
        names, x, at = rows.column("cell_id").combine_chunks(), vectors(rows.column("vec")), rows.column("at")[0].as_py()
        parts = -(-len(x) // (2 * block))
        cuts = np.linspace(0, len(x), parts + 1).astype(int)
        ends = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({
            "i": pa.array([at * PARTS + k for k in range(parts)], pa.int64()),
            "names": pa.array([names[a:b].to_pylist() for a, b in ends], pa.list_(pa.string())),
            "x": pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()),
        })

    rows = points.select("cell_id", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("cell_id", F.lit(3)), F.lit(1 << 30)).alias("mark"))
    placed = shipped(rows).mapInArrow(own, "cell_id string, vec array<double>, at long")
    return cut(placed.groupBy("at").applyInArrow(pack, "i long, names array<string>, x binary"))


def paired(left: DataFrame, right: DataFrame, tasks: int, key: str, when: Column | None = None) -> DataFrame:
    """All pairs of rows of two written tables, those of a left row in one task, and nothing is dealt but the left table once.

    A task holds its left rows (a block, as a rule) and reads the right table row by row past them,
    so its memory doesn't grow with either; wherever a store's files are, pairs of a row stay together.
    """
    dealt = left.repartitionByRange(tasks, key) if tasks > 1 else left.coalesce(1)
    # the second side of such a join is held by part, the first is read as it goes on: that part is a few left rows
    whole = right.select(*[F.col(c).alias(c) for c in right.columns]).coalesce(1)
    both = whole.crossJoin(dealt.hint("shuffle_replicate_nl"))
    return both if when is None else both.where(when)

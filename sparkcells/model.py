"""The data model: a long expression table with its side tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dataset:
    """expr(cell_id, gene, value) holds non-zero values only; obs has a row for each cell.

    raw: a second expression table; coords(cell_id, vec); knn(src, dst, weight); var(gene, ...).
    """

    expr: DataFrame
    obs: DataFrame
    raw: DataFrame | None = None
    coords: DataFrame | None = None
    knn: DataFrame | None = None
    var: DataFrame | None = None

    def with_raw(self) -> Dataset:
        """The same data with a raw table: its own, or else the expression itself."""
        return self if self.raw is not None else replace(self, raw=self.expr)


class GroupKeyError(KeyError):
    """A label column is missing."""


class NotComputedError(ValueError):
    """A result has no rows to go on with."""


class MissingGraphError(ValueError):
    """A group graph is needed and not given."""

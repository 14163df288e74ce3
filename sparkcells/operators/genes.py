"""Gene sets and gene filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GeneFilter:
    """Keeps or drops genes by category and name.

    sets: a table (category, gene). A gene goes if "." is among ``name_exclude`` and its name has
    one, if its name begins with any other entry, if it is in an excluded category, or if
    ``include`` is given and it is in none of those categories.
    """

    def __init__(self, sets: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = (), name_exclude: Sequence[str] = (), dots: bool = False):
        self.sets = sets
        self.exclude, self.include = list(exclude), list(include)
        self.prefixes = [x for x in name_exclude if x != "."]
        self.dots = dots or "." in name_exclude
        if self.exclude or self.include:
            unknown = sorted({*self.exclude, *self.include} - set(self.categories()))
            if unknown:
                raise ValueError(f"unknown categories: {', '.join(unknown)}")

    def categories(self) -> list[str]:
        return sorted(r["category"] for r in self.sets.select("category").distinct().collect())  # a row for each category

    def by_name(self, gene: Column) -> Column:
        keep = ~gene.contains(".") if self.dots else F.lit(True)
        for prefix in self.prefixes:
            keep = keep & ~gene.startswith(prefix)
        return keep

    def _members(self, names: list[str]) -> DataFrame:
        return self.sets.where(F.col("category").isin(*names)).select("gene").distinct()

    def filter(self, rows: DataFrame, column: str = "gene") -> DataFrame:
        """The rows whose gene stays; columns and any rank column are kept."""
        found = rows.where(self.by_name(F.col(column)))
        if self.exclude:
            own = self._members(self.exclude).withColumnRenamed("gene", "_gene")
            found = found.join(own, found[column] == own["_gene"], "left_anti")
        if self.include:
            own = self._members(self.include).withColumnRenamed("gene", "_gene")
            found = found.join(own, found[column] == own["_gene"], "left_semi")
        return found

    def __call__(self, gene: str) -> bool:
        one = self.sets.sparkSession.createDataFrame([(gene,)], "gene string")
        return self.filter(one).limit(1).count() == 1

    def __repr__(self) -> str:
        return f"GeneFilter(exclude={self.exclude}, include={self.include}, name_exclude={self.prefixes + ['.'] * self.dots})"


def remove(expr: DataFrame, genes: DataFrame) -> DataFrame:
    """expr without the listed genes (gene)."""
    return expr.join(genes.select("gene").distinct(), "gene", "left_anti")


def keep(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(genes.select("gene").distinct(), "gene", "left_semi")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The genes that both tables have."""
    return a.select("gene").intersect(b.select("gene"))


def over_common(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = common(a, b)
    return keep(a, both), keep(b, both)

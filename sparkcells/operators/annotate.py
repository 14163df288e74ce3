"""Labels of cells: updates, transfers between datasets, learned labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import comma_list, portable_hash

UNKNOWN = "unknown"


class Annotator:
    """Builds a label column on obs, step by step; every step gives a new annotator."""

    def __init__(self, obs: DataFrame, label: str, copy_from: str | None = None, _made: bool = False):
        self.label = label
        self.obs = obs if _made else obs.withColumn(label, F.col(copy_from).cast("string") if copy_from else F.lit(UNKNOWN))

    def update(self, key: str, select: str | Sequence, label: str, unknown_only: bool = False) -> Annotator:
        """Label the cells whose ``key`` is selected: one value, a comma list or a list; the last update wins."""
        chosen = comma_list(select) if isinstance(select, str) else [str(x) for x in (select if isinstance(select, (list, tuple, set)) else [select])]
        return self.update_mask(F.coalesce(F.col(key).cast("string").isin(*chosen), F.lit(False)), label, unknown_only)

    def update_mask(self, mask: Column, label: str, unknown_only: bool = False) -> Annotator:
        hit = mask & (F.col(self.label) == UNKNOWN) if unknown_only else mask
        return Annotator(self.obs.withColumn(self.label, F.when(hit, F.lit(label)).otherwise(F.col(self.label))), self.label, _made=True)

    def summary(self) -> DataFrame:
        return self.obs.groupBy(self.label).agg(F.count("*").alias("n"))


def update_label(obs: DataFrame, label: str, other: DataFrame, other_label: str, include: Sequence[str] = (), exclude: Sequence[str] = (), unknown_only: bool = False) -> DataFrame:
    """obs with ``label`` taken from the same cells of another table, where it has one.

    include and exclude keep to or leave out labels of the other table.
    """
    new = other.select("cell_id", F.col(other_label).cast("string").alias("_new")).where("_new is not null")
    if include:
        new = new.where(F.col("_new").isin(*include))
    if exclude:
        new = new.where(~F.col("_new").isin(*exclude))
    rows = obs.join(new, "cell_id", "left")
    take = F.col("_new").isNotNull() & (F.col(label) == UNKNOWN) if unknown_only else F.col("_new").isNotNull()
    return rows.withColumn(label, F.when(take, F.col("_new")).otherwise(F.col(label))).select(*obs.columns)


def major(obs: DataFrame, label: str, cut: int = 20) -> DataFrame:
    """With <label>_major: "none" for labels of fewer than ``cut`` cells. Counts are folded, then joined."""
    sizes = obs.groupBy(F.col(label).alias("_own")).agg(F.count("*").alias("_n"))
    rows = obs.join(sizes.where(F.col("_n") >= cut), F.col(label) == F.col("_own"), "left")
    return rows.withColumn(f"{label}_major", F.coalesce("_own", F.lit("none"))).select(*obs.columns, f"{label}_major")


def fill_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the other's missing columns, as "nan"."""
    add = lambda x, y: x.withColumns({c: F.lit("nan") for c in y.columns if c not in x.columns})
    return add(a, b), add(b, a)


def predict_high(proba: DataFrame, classes: Sequence[str], p: float = 0.9) -> DataFrame:
    """(cell_id, label): the class whose probability exceeds p, the last of ``classes`` if several do, else "None".

    proba: (cell_id, class, p).
    """
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    hit = F.when((F.col("p") > p) & F.col("class").isin(*classes), F.struct(place.alias("place"), F.col("class").alias("own")))
    return proba.groupBy("cell_id").agg(F.coalesce(F.max(hit)["own"], F.lit("None")).alias("label"))


#: Cells of a class that its draws are taken from, for each draw.
POOL = 64


def class_sample(obs: DataFrame, label: str, n: int = 200, exclude: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(draw, grp, cell_id): n draws of each class with replacement, seeded.

    Draws are hashes of class and number. They are taken from the whole class or, in a class of
    more than POOL * n cells, from about so many that a hash of the cell picks, so that no task
    numbers a whole large class.
    """
    rows = obs.where(F.col(label).isNotNull()).select("cell_id", F.col(label).cast("string").alias("grp"))
    rows = rows.where(~F.col("grp").isin(*exclude)) if exclude else rows
    mark = portable_hash(F.lit(str(seed)), F.col("cell_id"))
    share = F.least(F.lit(1.0), F.lit(float(POOL * n)) / F.col("n"))
    pool = rows.join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp").where(mark < share * F.lit(float(1 << 60))).select("grp", "cell_id", mark.alias("mark"))
    sizes = pool.groupBy("grp").agg(F.count("*").alias("n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.select("grp", "draw", (portable_hash(F.lit(str(seed)), F.col("grp"), F.col("draw").cast("string")) % F.col("n") + 1).alias("place"))
    numbered = pool.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("mark", "cell_id")))
    return draws.join(numbered, ["grp", "place"]).select("draw", "grp", "cell_id")


def select_groups(obs: DataFrame, label: str, groups: str | Sequence[str] | None = None, exclude: str | Sequence[str] = ()) -> DataFrame:
    """The cells of the named groups, or of all but the excluded; comma lists are allowed."""
    listed = lambda x: comma_list(x) if isinstance(x, str) else [str(y) for y in x]
    name = F.col(label).cast("string")
    return obs.where(name.isin(*listed(groups))) if groups else obs.where(~name.isin(*listed(exclude))) if exclude else obs

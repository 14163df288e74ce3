"""Learned label transfer: multinomial logistic regression on sampled cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalar import portable_hash
from ..lineage import bounded, cut
from .annotate import class_sample

#: Ranges of probabilities that running sums are first taken over.
RANGES = 1024


def vectors(expr: DataFrame, genes: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell_id, features): sparse vectors of all ``cells``. genes: (gene, place), places from 0.

    Rows of one cell are gathered; a cell holds at most a value for each gene.
    """
    genes = cut(genes)
    size = genes.count()
    rows = expr.join(bounded(genes, 1_000_000), "gene").groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("x"))
    none = F.array().cast("array<struct<place:int,value:double>>")
    every = cells.select("cell_id").distinct().join(rows, "cell_id", "left").withColumn("x", F.coalesce("x", none))
    # a vector's own layout, written and read as vectors
    own = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"), F.transform("x", lambda e: e["place"].cast("int")).alias("indices"), F.transform("x", lambda e: e["value"]).alias("values"))
    return cut(every.select("cell_id", own.alias("features")), StructType([every.schema["cell_id"], StructField("features", VectorUDT())]))


def gene_places(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(gene, place) of the genes that both have, by name."""
    genes = a.select("gene").distinct() if b is None else a.select("gene").intersect(b.select("gene"))
    return genes.withColumn("place", F.row_number().over(Window.orderBy("gene")) - 1)  # genes fit one task


class LabelModel:
    """A fitted transfer: label names, genes and the regression."""

    def __init__(self, names: StringIndexerModel, model: LogisticRegressionModel, genes: DataFrame):
        self.names, self.model, self.genes = names, model, genes

    def proba(self, expr: DataFrame, cells: DataFrame) -> DataFrame:
        """(cell_id, class, p), a row for each class."""
        found = self.model.transform(vectors(expr, self.genes, cells)).select("cell_id", F.posexplode(vector_to_array("probability")).alias("k", "p"))
        return found.select("cell_id", F.get(F.array(*[F.lit(x) for x in self.names.labels]), F.col("k")).alias("class"), "p")

    def predict(self, expr: DataFrame, cells: DataFrame) -> DataFrame:
        """(cell_id, label, p): the most likely class, ties by name."""
        best = self.proba(expr, cells).groupBy("cell_id").agg(F.min(F.struct((-F.col("p")).alias("away"), F.col("class"))).alias("x"))
        return best.select("cell_id", F.col("x.class").alias("label"), (-F.col("x.away")).alias("p"))


def fit(expr: DataFrame, obs: DataFrame, label: str, genes: DataFrame | None = None, sparsity: float = 0.2, max_iter: int = 100, n: int = 200, exclude: Sequence[str] = (), seed: int = 0) -> LabelModel:
    """Fit on ``n`` draws of each class. The penalty is 1 / (sparsity * rows), on unscaled features."""
    genes = gene_places(expr) if genes is None else genes
    drawn = cut(class_sample(obs, label, n, exclude, seed))
    rows = drawn.join(vectors(expr.join(drawn.select("cell_id").distinct(), "cell_id", "left_semi"), genes, drawn), "cell_id")
    return _learned(rows, genes, sparsity, max_iter)


def _learned(rows: DataFrame, genes: DataFrame, sparsity: float, max_iter: int) -> LabelModel:
    names = StringIndexer(inputCol="grp", outputCol="target", stringOrderType="alphabetAsc").fit(rows)
    count = rows.count()
    learner = LogisticRegression(featuresCol="features", labelCol="target", family="multinomial", elasticNetParam=0.0, regParam=1.0 / (sparsity * max(count, 1)), standardization=False, maxIter=max_iter)
    return LabelModel(names, learner.fit(names.transform(rows)), genes)


def held_out(cells: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The cells that a seeded hash holds out, about ``fraction`` of them."""
    return cells.where(portable_hash(F.lit(str(seed)), F.col("cell_id")) < F.lit(int(fraction * (1 << 60))))


def logistic_model(expr: DataFrame, cells: DataFrame, sparsity: float = 0.2, fraction: float = 0.2, max_iter: int = 100, seed: int = 0) -> tuple[DataFrame, DataFrame, LabelModel]:
    """(proba, truth, model): a model of all cells (cell_id, grp) but about ``fraction`` held out, whose probabilities and labels are returned."""
    genes = gene_places(expr)
    truth = cut(held_out(cells, fraction, seed))
    train = cells.join(truth, "cell_id", "left_anti")
    model = _learned(train.join(vectors(expr.join(train.select("cell_id"), "cell_id", "left_semi"), genes, train), "cell_id"), genes, sparsity, max_iter)
    return model.proba(expr.join(truth.select("cell_id"), "cell_id", "left_semi"), truth), truth, model


def transfer(expr: DataFrame, obs: DataFrame, label: str, new_expr: DataFrame, new_obs: DataFrame, out: str, **options) -> DataFrame:
    """new_obs with the labels that a model of the first dataset gives its cells."""
    model = fit(expr, obs, label, gene_places(expr, new_expr), **options)
    found = model.predict(new_expr, new_obs).select("cell_id", F.col("label").alias(out))
    return new_obs.drop(out).join(found, "cell_id", "left")


def _before(rows: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """rows (keys, p, counts) with before_<count>: the sum over smaller p of the same keys.

    First over ranges of p, of which there are few, then inside of a range.
    """
    rows = rows.withColumn("own_range", F.floor(F.col("p") * RANGES))
    sums = rows.groupBy(*keys, "own_range").agg(*[F.sum(c).alias(f"sum_{c}") for c in counts])
    along = Window.partitionBy(*keys).orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "own_range", *[F.coalesce(F.sum(f"sum_{c}").over(along), F.lit(0)).alias(f"low_{c}") for c in counts])
    inside = Window.partitionBy(*keys, "own_range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({f"in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in counts}).join(sums, [*keys, "own_range"])
    return found.select(*keys, "p", *counts, *[(F.col(f"in_{c}") + F.col(f"low_{c}")).alias(f"before_{c}") for c in counts])


def _hits(proba: DataFrame, truth: DataFrame) -> DataFrame:
    """(class, p, hits, misses): ties are folded."""
    rows = proba.join(truth, "cell_id").select("class", "p", (F.col("grp") == F.col("class")).cast("int").alias("hit"))
    return rows.groupBy("class", "p").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


def auc(proba: DataFrame, truth: DataFrame) -> DataFrame:
    """(class, auc): one class against the rest, by ranks with ties halved. truth: (cell_id, grp)."""
    each = _before(_hits(proba, truth), ["class"], ["hits", "misses"])
    won = each.withColumn("won", F.col("hits") * (F.col("before_misses") + F.col("misses") / 2))
    sums = won.groupBy("class").agg(F.sum("won").alias("won"), F.sum("hits").alias("p"), F.sum("misses").alias("q"))
    return sums.select("class", F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("won") / (F.col("p") * F.col("q"))).alias("auc"))


def min_auc(proba: DataFrame, truth: DataFrame) -> float | None:
    """The least AUC of a class."""
    return auc(proba, truth).agg(F.min("auc").alias("least")).first()["least"]


def roc(proba: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    """(threshold, fpr, tpr) of one class, a row for each distinct probability."""
    each = _before(_hits(proba.where(F.col("class") == name), truth), ["class"], ["hits", "misses"])
    total = each.agg(F.sum("hits").alias("all_hits"), F.sum("misses").alias("all_misses"))
    found = each.crossJoin(F.broadcast(total))  # one row
    rate = lambda x: (F.col(f"all_{x}") - F.col(f"before_{x}")) / F.greatest(F.lit(1), F.col(f"all_{x}"))
    return found.select(F.col("p").alias("threshold"), rate("misses").alias("fpr"), rate("hits").alias("tpr"))


def pca(expr: DataFrame, cells: DataFrame, k: int = 50, genes: DataFrame | None = None, shift: DataFrame | None = None) -> DataFrame:
    """(cell_id, vec): principal components, for up to a few thousand genes.

    shift: (gene, value) that every cell has besides its own; it moves all cells alike.
    """
    from pyspark.ml.feature import PCA

    genes = gene_places(expr) if genes is None else genes
    genes = cut(genes)
    rows = vectors(expr, genes, cells)
    model = PCA(k=k, inputCol="features", outputCol="vec").fit(rows)
    vec = vector_to_array("vec")
    if shift is not None:
        held = {r["place"]: r["value"] for r in genes.join(shift, "gene").collect()}
        moved = model.pc.toArray().T @ [held.get(j, 0.0) for j in range(model.pc.numRows)]
        vec = F.zip_with(vec, F.array(*[F.lit(float(x)) for x in moved]), lambda a, b: a + b)
    return model.transform(rows).select("cell_id", vec.alias("vec"))

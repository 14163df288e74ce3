"""Test tables bound to the expression model; see FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..model import Dataset
from .tables import read

TOKEN = "^[a-zà-ÿ]{2,12}\\z"
#: Bytes of text whose tokens one task counts.
TEXT = 8 << 20


def normalised(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """(cell_id, gene, value): ln(1 + target * n / total of the cell); totals are folded before they are joined.

    The counts are read twice: give them written.
    """
    total = counts.groupBy("cell_id").agg(F.sum("n").alias("total"))
    return counts.select("cell_id", "gene", "n").join(total, "cell_id").select("cell_id", "gene", F.log1p(F.lit(target) * F.col("n") / F.col("total")).alias("value"))


def document_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(cell_id, gene, n, total): the tokens of each document and all that it has of them.

    Texts are dealt by document once, and tokens and totals are both counted where they then lie. A
    task's memory follows the tokens that it holds, so there are as many tasks as the texts' size asks for.
    """
    docs = read(spark, folder, "documents").where("doc_id is not null").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.repartition(max(1, -(-size // TEXT), min(spark.sparkContext.defaultParallelism, size >> 20)), "doc_id")
    tokens = docs.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("gene"))
    counts = tokens.where(F.col("gene").rlike(TOKEN)).groupBy("doc_id", "gene").agg(F.count("*").cast("double").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    return counts.select(F.col("doc_id").cast("string").alias("cell_id"), "gene", "n", "total")


def documents(spark: SparkSession, folder: str, min_cells: int = 20) -> Dataset:
    """D: documents are cells, tokens are genes, languages are groups, sources are batches.

    The texts are split once: their counts are written, and frequencies of genes and values read those.
    """
    counts = cut(document_counts(spark, folder))
    value = F.log1p(F.lit(1e4) * F.col("n") / F.col("total")).alias("value")
    common = counts.groupBy("gene").agg(F.count("*").alias("cells")).where(F.col("cells") >= min_cells).select("gene")
    return Dataset(counts.join(common, "gene", "left_semi").select("cell_id", "gene", value), document_obs(spark, folder))


def document_obs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").where("doc_id is not null").select(
        F.col("doc_id").cast("string").alias("cell_id"), F.col("lang").alias("lang"), F.col("source").alias("source"),
        F.concat("lang", F.lit("_"), (F.substring("source", 4, 9).cast("int") % 3).cast("string")).alias("lang3"),
    )


def embeddings(spark: SparkSession, folder: str) -> Dataset:
    """E: vectors are cells, dimensions are genes (negative values are no expression)."""
    rows = read(spark, folder, "embeddings")
    cell = F.col("vec_id").cast("string").alias("cell_id")
    long = rows.select(cell, F.posexplode("embedding").alias("k", "x"))
    expr = long.where("x > 0").select("cell_id", F.format_string("d%02d", "k").alias("gene"), F.col("x").cast("double").alias("value"))
    obs = rows.select(
        cell, F.col("vec_id"), F.col("label").cast("string").alias("label"), (F.col("label") % 2).cast("string").alias("l0"),
        (F.col("label") % 5).cast("string").alias("l1"), (F.col("vec_id") % 5).cast("string").alias("batch"),
    )
    coords = rows.select(cell, F.col("embedding").cast("array<double>").alias("vec"))
    return Dataset(expr, obs, coords=coords)


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    items = read(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = read(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").cast("string").alias("cell_id"), "gene").agg(F.sum("l_quantity").alias("n"))


def line_items(spark: SparkSession, folder: str) -> Dataset:
    """L: customers are cells, brands are genes, nations are groups, segments are batches."""
    obs = read(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return Dataset(normalised(cut(line_counts(spark, folder))), obs)


def events(spark: SparkSession, folder: str) -> Dataset:
    """V: users are cells, event types are genes."""
    rows = read(spark, folder, "events")
    expr = rows.groupBy(F.col("user_id").cast("string").alias("cell_id"), F.col("event_type").alias("gene")).agg(F.log1p(F.sum("value")).alias("value"))
    obs = rows.select("user_id").distinct().select(F.col("user_id").cast("string").alias("cell_id"), (F.col("user_id") % 6).cast("string").alias("cluster"))
    return Dataset(expr, obs)

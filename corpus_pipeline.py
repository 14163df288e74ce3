"""From raw documents to packed training sequences, in stages that each write and reread a table.

1 quality: a learned decision list rejects documents; 2 toxicity: a factorization machine rejects
documents; 3 line_dedup: lines that several documents hold stay in one of them; 4 near_dedup: one
document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays;
5 packing: the remaining documents become sequences of bounded size.

All stages but the last return the columns of ``documents``. Nulls in any column, empty texts,
repeated rows and empty tables pass as the operators define it: a null or empty text fails the
base checks of the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcells.llm import line_dedup, packing, quality_rules, simhash, toxicity
from sparkcells.llm.common import cut, free, id_crc, table
from sparkcells.llm.queries import VOCABULARY, vocabulary


#: Documents of a sequence at most, and the sum of its pieces' squared lengths (but for longer single pieces).
DOCUMENTS, ATTENTION = 8, 0.9 * packing.TOKENS**2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.fit_texts(docs, table(spark, sf_dir, "labels")))


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.pmod(id_crc("doc_id"), F.lit(5)) != 0)
    name = free("_own_score", docs)
    return toxicity.score(docs, machine, docs.columns, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free("_own_bitmap", docs)
    found = line_dedup.apply(docs, line_dedup.dropped(docs), bitmap=name)
    lost = F.col(name).isNotNull()
    text = F.when(lost, line_dedup.kept_text(F.col("text"), F.col(name))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = cut(packing.pieces(docs, vocabulary(VOCABULARY)))
    return packing.pack(made, documents=DOCUMENTS, attention=ATTENTION).select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", nontoxic), ("line_dedup", fresh_lines), ("near_dedup", near_dedup), ("packing", pack)]

#: SQL can't express the learned stages; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written to and reread from the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

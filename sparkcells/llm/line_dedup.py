"""Line deduplication with range-partitioned hashes and per-document keep bitmaps.

Every line becomes a 128-bit hash of its key, its document and its position; no text is moved.
The hashes are range-partitioned together with a salt of the document and sorted by document and
position, so a line that a third of all documents hold is many ranges, and each range is streamed
once for its first occurrence (the largest document) and its number of documents. Those heads,
one for each hash and range, are folded to one row for each repeated hash. Only lines of repeated
hashes come back, as a run-length bitmap for each document: the runs of dropped line positions.
All of it is DataFrame operations.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, row_key

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCUMENTS = 3
SALTS = 1024


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_column: str, text_column: str, min_chars: int, salts: int) -> DataFrame:
    """(h1, h2, salt, id, key, at): every line long enough, range-partitioned by hash and salt, the largest id first."""
    rows = docs.select(F.col(id_column).alias("id"), row_key(id_column, text_column).alias("key"), F.posexplode(lines_of(F.col(text_column))).alias("at", "line"))
    keyed = rows.select("id", "key", "at", line_key(F.col("line")).alias("line")).where(F.char_length("line") >= min_chars)
    hashed = keyed.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "id", "key", "at")
    # written once: the range partitioning samples its input, and two branches read it
    return cut(hashed).repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.col("id").desc_nulls_last(), "at")


def dropped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, salts: int = SALTS) -> DataFrame:
    """(id, key, bitmap): the lines that a row of ``docs`` loses, as runs (first, length) of line positions.

    Lines whose key has at least ``min_chars`` code points and stands in at least ``min_documents``
    documents are lost everywhere except in the largest id holding them. Rows with one id count as
    one document; rows without an id are one document, the smallest. A null text is one empty line.
    Rows that lose nothing aren't returned. key is a hash of id and text that tells rows apart.
    """
    found = occurrences(docs, id_column, text_column, min_chars, salts)
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("id").desc_nulls_last())
    heads = found.withColumn("documents", F.dense_rank().over(stream)).groupBy("h1", "h2", "salt").agg(F.max("documents").alias("documents"), F.max("id").alias("id"))
    repeated = heads.groupBy("h1", "h2").agg(F.sum("documents").alias("documents"), F.max("id").alias("keeper")).where(F.col("documents") >= min_documents).drop("documents")
    # back to the ranges of each repeated hash, so that the lines of a frequent one meet it by salt, not in one task
    keepers = heads.select("h1", "h2", "salt").join(repeated, ["h1", "h2"])
    lost = found.join(keepers, ["h1", "h2", "salt"]).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "key", "at").distinct()
    along = Window.partitionBy("id", "key").orderBy("at")
    runs = lost.withColumn("run", F.col("at") - F.row_number().over(along)).groupBy("id", "key", "run").agg(F.min("at").alias("first"), F.count("*").cast("int").alias("length"))
    return runs.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("first", "length"))).alias("bitmap"))


def n_dropped(bitmap: Column) -> Column:
    return F.coalesce(F.aggregate(bitmap, F.lit(0).cast("long"), lambda total, run: total + run["length"]), F.lit(0).cast("long"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The lines outside of the bitmap's runs, joined by line feeds, in time linear in lines and runs."""
    text = F.coalesce(text, F.lit(""))
    lines = lines_of(text)
    n = F.size(bitmap)

    def stretch(i: Column) -> Column:
        before, after = F.get(bitmap, i - 1), F.get(bitmap, i)
        first = F.coalesce(before["first"] + before["length"], F.lit(0))
        last = F.coalesce(after["first"], F.size(lines))
        return F.slice(lines, first + 1, last - first)

    rest = F.concat_ws("\n", F.flatten(F.transform(F.sequence(F.lit(0), n), stretch)))
    return F.when(bitmap.isNull(), text).otherwise(rest)


def apply(docs: DataFrame, bitmaps: DataFrame, id_column: str = "doc_id", text_column: str = "text", bitmap: str = "bitmap") -> DataFrame:
    """The rows of ``docs`` with the column ``bitmap`` (null: nothing is lost).

    Repeated rows lose the same lines; columns of any other names are kept as they are.
    """
    key = free("_row_key", docs)
    keyed = docs.withColumn(key, row_key(id_column, text_column))
    own = bitmaps.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("bitmap").alias("_bitmap"))
    same = (keyed[key] == own["_key"]) & keyed[id_column].eqNullSafe(own["_id"])
    return keyed.join(own, same, "left").select(*[keyed[c] for c in docs.columns], own["_bitmap"].alias(bitmap))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import bounded, cut, discard  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def row_key(id_column: str, text_column: str) -> Column:
    """A key that tells rows apart even where ids are null or repeated."""
    return F.xxhash64(F.col(id_column), F.col(text_column))


def id_crc(id_column: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Cut record batches to about ``most`` bytes of text each (one long text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(column).cast(pa.binary())
        ends = np.cumsum(_lengths(sizes))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def _lengths(values: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)

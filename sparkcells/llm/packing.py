"""Vector best-fit packing of token sequences.

Texts become token ids; longer ones are cut into pieces of a full sequence, the first of which
may be shorter. A piece asks for a vector of resources (tokens, documents, attention cost, which
is its length squared) and a sequence has a capacity of each. Full pieces are sequences by
themselves. The others are dealt by a hash of their row over groups of bounded size, and each
group is packed by itself: longest first, into the open sequence that fits under every constraint
and is tightest, by the weighted dot product of its residual with the request ("dot") or by the
weighted norm of the residual that would remain ("norm"). A piece over a capacity by itself has a
sequence of its own. A group's last open sequences are its only
loss, so the loss doesn't depend on the size of the table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from ..shipping import shipped
from .common import parts, texts_of

END = 2
TOKENS = 1024
#: Short pieces packed together by one task.
GROUP = 16_000


def pieces(docs: DataFrame, path: str, tokens: int = TOKENS, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, key, piece, start, length, ids_crc32[, ids]) of every row; a null text is empty.

    Rows with the same or a null id stay apart, repeated rows are packed each; key is a hash of id
    and text. Other columns of ``docs`` aren't read, and an empty table gives no piece.
    """
    full = ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in parts(batches, "text", 1 << 22):
            ids, counts = encode(texts_of(batch, "text"))
            sizes = counts + 1
            ends = np.cumsum(sizes)
            own = np.full(int(ends[-1]), END, "<u4")
            own[np.delete(np.arange(len(own)), ends - 1)] = ids
            n = -(-sizes // tokens)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            lead = sizes - (n - 1) * tokens
            start = np.where(piece == 0, 0, lead[row] + (piece - 1) * tokens)
            length = np.where(piece == 0, lead[row], tokens)
            begin = (ends - sizes)[row] + start
            data = memoryview(own.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), length.tolist(), strict=True)]
            take = pa.array(row)
            columns = [batch.column("id").take(take), batch.column("key").take(take), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(own)).astype(np.int32)), pa.array(own.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.col(id_column), F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    return shipped(rows).mapInArrow(run, f"id long, key long, piece int, start long, length long, ids_crc32 long{full}")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> np.ndarray:
    """The bin of each item (longest first, ties by place), under every capacity.

    Items of one length ask for the same vector, so bins with equal residuals are alike and open
    bins are kept by their residual.
    """
    cap = np.array(capacity, float)
    w = np.array(weights, float)
    bins = np.empty(len(lengths), np.int64)
    residual = np.empty((1024, 3))
    number = np.empty(1024, np.int64)  # of the open bins
    opened = alive = 0
    least = float(lengths.min()) if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        room = residual[:alive]
        at = np.flatnonzero((room >= need).all(1))
        if len(at):
            rest = (room[at] - need) / cap
            score = (room[at] / cap * (need / cap) * w).sum(1) if rule == "dot" else (rest * rest * w).sum(1)
            k = int(at[np.argmin(score)])
        else:
            if alive == len(residual):
                residual, number = np.concatenate([residual, np.empty_like(residual)]), np.concatenate([number, np.empty_like(number)])
            residual[alive], number[alive] = cap, opened
            k, opened, alive = alive, opened + 1, alive + 1
        bins[i] = number[k]
        residual[k] -= need
        if residual[k, 0] < least or residual[k, 1] < 1 or residual[k, 2] < least * least:
            alive -= 1
            residual[k], number[k] = residual[alive], number[alive]
    return bins


def pack(
    cut: DataFrame,
    tokens: int = TOKENS,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    group: int = GROUP,
    rows: int | None = None,
) -> DataFrame:
    """Add sequence_id (any numbers) and offset to the pieces that :func:`pieces` made.

    documents and attention cap the pieces of a sequence and the sum of their squared lengths
    (none: as many as the tokens allow). rows, if known, is the number of documents. The pieces
    are read more than once: give them written. Repeated rows have one key, so the place of a row
    in the written table deals it, and no number of copies meets in one group.
    """
    caps = (float(tokens), float(documents or tokens), float(attention or tokens * tokens))
    if rows is None:
        rows = cut.where("piece = 0").count()
    groups = max(1, -(-rows // group))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # Ties never depend on the order of arrival: a task that is run again packs alike.
        frame = frame.sort_values(["key", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        length = frame["length"].to_numpy()
        bins = best_fit(length, caps, weights, rule)
        order = np.lexsort((np.arange(len(bins)), bins))
        filled = np.cumsum(length[order])
        head = np.flatnonzero(np.append(True, np.diff(bins[order]) != 0)) if len(bins) else np.zeros(0, int)
        base = np.repeat((filled - length[order])[head], np.diff(np.append(head, len(bins))))
        offset = np.empty(len(bins), np.int64)
        offset[order] = filled - length[order] - base
        return frame.assign(sequence_id=(frame["bucket"].to_numpy() << 32) + bins, offset=offset).drop(columns="bucket")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    short = cut.where(F.col("length") < tokens).withColumn("bucket", F.pmod(F.xxhash64("key", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    # Full pieces need no partner: ids below zero, one each.
    whole = cut.where(F.col("length") >= tokens).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return shipped(short).groupBy("bucket").applyInPandas(run, schema).unionByName(whole)

"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-cased words, the first bytes of its longer words, and either of them
again where it stands twice or more, each hashed to a fixed number of places. The machine adds to
a linear score the dot products of the terms' latent vectors, so a pair of terms can count for
more (or less) than both alone. Training (numpy, AdaGrad) takes a bounded sample of labelled rows;
all places that enough rows hold are in the model, but while it learns, those that the sample alone
hardly relates to the label enter with a smaller value, which holds their noise down.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import parts, texts_of
from .textbytes import LETTER, U, mix, words

#: Labelled rows of each class at most from which the machine learns.
SAMPLE = 8_000
PLACES = 1 << 18
FACTORS = 8
PREFIX = 6


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of the terms of each text: (text number, place), sorted."""
    own = words(texts, LETTER, prefix=PREFIX)
    owners = own.owners
    long = own.sizes > PREFIX
    who = np.concatenate([owners, owners[long]])
    what = np.concatenate([own.hashes, own.prefixes[long]]) % U(PLACES)
    key, times = np.unique(who.astype(U) * U(PLACES) + what, return_counts=True)
    again = key[times > 1]
    more = again - again % U(PLACES) + mix(again % U(PLACES) + U(PLACES)) % U(PLACES)
    key = np.unique(np.concatenate([key, more]))
    return (key // U(PLACES)).astype(np.int64), (key % U(PLACES)).astype(np.int64)


@dataclass
class Machine:
    """places: sorted; score = sigmoid(bias + sum of weights + half of (square of sums - sum of squares) of factors)."""

    places: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        who, what = terms(texts)
        at = np.searchsorted(self.places, what)
        at[at == len(self.places)] = 0
        known = self.places[at] == what if len(self.places) else np.zeros(len(at), bool)
        return _sigmoid(self._raw(who[known], at[known], len(texts)))

    def _raw(self, who: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(who, self.weights[at], n)
        for k in range(self.factors.shape[1]):
            v = self.factors[at, k]
            total += 0.5 * (np.bincount(who, v, n) ** 2 - np.bincount(who, v * v, n))
        return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(who: np.ndarray, what: np.ndarray, label: np.ndarray, prior: float | None = None, factors: int = FACTORS, epochs: int = 40, batch: int = 256, rate: float = 0.3, decay: float = 1e-3, least: int = 4, z: float = 2.5, weak: float = 0.4, seed: int = 7) -> Machine:
    """Fit to rows of (row, place), sorted by row. prior: the share of label 1 where it is applied.

    A place in ``least`` rows or more takes part. Its value is 1 if its marginal relation to the
    label is ``z`` deviations or more, else ``weak``.
    """
    n = len(label)
    label = label.astype(float)
    rate_1 = label.mean() if n else 0.0
    if not n or rate_1 in (0.0, 1.0):  # one class, or nothing: a constant
        return Machine(np.zeros(0, np.int64), 4.0 if rate_1 == 1.0 and n else -4.0, np.zeros(0), np.zeros((0, factors)))
    seen = np.bincount(what, minlength=PLACES)
    toxic = np.bincount(what[label[who] > 0], minlength=PLACES)
    strength = np.abs(toxic - seen * rate_1) / np.sqrt(np.maximum(seen, 1) * rate_1 * (1 - rate_1))
    places = np.flatnonzero(seen >= least)
    value = np.where(strength[places] >= z, 1.0, weak)
    place_of = np.full(PLACES, -1, np.int32)
    place_of[places] = np.arange(len(places))
    known = seen[what] >= least
    who, at = who[known], place_of[what[known]]
    starts = np.searchsorted(who, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(len(places)), rng.normal(0, 0.02, (len(places), factors)), float(np.log(rate_1 / (1 - rate_1)))
    square_w, square_v, square_b = np.full(len(places), 1e-2), np.full((len(places), factors), 1e-2), 1e-2
    held, back_of = np.zeros(len(places), bool), np.zeros(len(places), np.int32)
    for _ in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, batch):
            rows = order[low : low + batch]
            size = starts[rows + 1] - starts[rows]
            own = np.repeat(np.arange(len(rows)), size)
            pick = np.repeat(starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            held[at[pick]] = True
            index = np.flatnonzero(held)
            held[index] = False
            back_of[index] = np.arange(len(index))
            back, x = back_of[at[pick]], value[at[pick]]
            vectors = v[index][back] * x[:, None]
            sums = np.stack([np.bincount(own, vectors[:, k], len(rows)) for k in range(factors)], 1)
            squares = np.bincount(own, (vectors * vectors).sum(1), len(rows))
            raw = b + np.bincount(own, w[index][back] * x, len(rows)) + 0.5 * ((sums * sums).sum(1) - squares)
            error = (_sigmoid(raw) - label[rows]) / len(rows)
            grad_w = np.bincount(back, error[own] * x, len(index)) + decay / n * w[index] * batch
            inner = (error[own] * x)[:, None] * (sums[own] - vectors)
            grad_v = np.stack([np.bincount(back, inner[:, k], len(index)) for k in range(factors)], 1) + decay / n * v[index] * batch
            square_w[index] += grad_w**2
            square_v[index] += grad_v**2
            square_b += error.sum() ** 2
            w[index] -= rate * grad_w / np.sqrt(square_w[index])
            v[index] -= 0.3 * rate * grad_v / np.sqrt(square_v[index])
            b -= rate * error.sum() / np.sqrt(square_b)
    if prior is not None and 0 < prior < 1:
        b += float(np.log(prior / (1 - prior)) - np.log(rate_1 / (1 - rate_1)))
    return Machine(places, b, w * value, v * value[:, None])


def fit(docs: DataFrame, labels: DataFrame, learns: Column | None = None, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", sample: int = SAMPLE, **options) -> Machine:
    """Learn from at most ``sample`` labelled rows of each class, chosen by a hash of their ids.

    learns: a condition on the id column of ``labels`` for the rows that may be learned from. The
    classes' true shares among those rows set the bias. Ids with both labels count as toxic; an id
    of several rows counts once, by its least terms.
    """
    pool = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    pool = pool if learns is None else pool.where(learns)
    pool = pool.groupBy(F.col(id_column).alias("own_id")).agg((F.max(label) > 0).cast("int").alias("own_label"))
    shares = {r["own_label"]: r["n"] for r in pool.groupBy("own_label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not shares:
        return train(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    prior = shares.get(1, 0) / sum(shares.values())
    chosen = None
    for k in shares:
        some = pool.where(F.col("own_label") == k).orderBy(F.xxhash64("own_id"), "own_id").limit(sample)
        chosen = some if chosen is None else chosen.union(some)
    rows = docs.select(F.col(id_column).alias("own_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "own_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", 1 << 22):
            who, what = terms(texts_of(batch, "text"))
            offsets = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), batch.column("own_label"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(what.astype(np.int32)))], names=["id", "label", "terms"])

    kind = docs.schema[id_column].dataType.simpleString()
    # an id counts once, so these are at most 2 * sample rows
    each = shipped(rows).mapInArrow(run, f"id {kind}, label int, terms array<int>")
    found = each.groupBy("id").agg(F.min(F.struct("label", "terms")).alias("own")).select("id", "own.*").toArrow()
    if not found.num_rows:
        return train(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    found = found.sort_by("id")
    column = found.column("terms").combine_chunks()
    what = column.flatten().to_numpy()
    who = np.repeat(np.arange(found.num_rows, dtype=np.int32), column.value_lengths().to_numpy())
    return train(who, what, found.column("label").to_numpy(), prior, **options)


def score(docs: DataFrame, machine: Machine, keep: list[str], text_column: str = "text", name: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of each whole text (null is empty: the bias alone).

    Repeated rows score alike, other columns of ``docs`` aren't read, an empty table gives none.
    """
    fields = [docs.schema[x] for x in keep]
    inner = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(x).alias(y) for x, y in zip(keep, inner, strict=True)], F.col(text_column).alias("own_text"))
    model = docs.sparkSession.sparkContext.broadcast(machine)  # its size is bounded by PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "own_text", 1 << 22):
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in inner], pa.array(model.value.scores(texts_of(batch, "own_text")))], names=[*keep, name])

    return shipped(rows).mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` double"]))

"""Language identification with a byte convolutional network.

A text is read in windows of a fixed number of bytes (with the few bytes after them, so that no
byte sequence is lost between two). Each window goes through byte embeddings, filters of several
widths, max pooling and softmax; a text's probabilities are the mean of its windows'. The network
is trained in numpy with hand-written gradients on a bounded sample of labelled windows. For
application the embeddings are multiplied into the filters, which leaves table lookups by byte
pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import bounded, cut, parts, texts_of
from .textbytes import FOLD

#: Labelled texts of each language, about, and windows of each text at most, from which the network learns.
SAMPLE = 1_000
WINDOWS = 4
#: Labelled texts at most of all languages, but for one of each.
TOTAL = 100_000
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TAIL = max(WIDTHS) - 1
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows(text: bytes) -> np.ndarray:
    """The windows of a text, zero-padded: (n, LENGTH + TAIL)."""
    n = max(1, -(-len(text) // LENGTH))
    own = np.zeros(n * LENGTH + TAIL, np.uint8)
    own[: len(text)] = FOLD[np.frombuffer(text, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(own, LENGTH + TAIL)[::LENGTH]


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore"))


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, EMBEDDING, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _pairs: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_pairs": {}}

    def tables(self) -> dict:
        """Filters times embeddings, by pairs of bytes (an even part of a width) and single bytes."""
        if not self._pairs:
            for w, f in self.filters.items():
                single = [(self.embedding @ f[j]).astype(np.float32) for j in range(w)]
                pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
                self._pairs[w] = (pairs, single[-1] if w % 2 else None)
        return self._pairs

    def pooled(self, x: np.ndarray, block: int = 64) -> np.ndarray:
        """The largest answer of every filter in each window."""
        found = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        tables = self.tables()
        for low in range(0, len(x), block):
            own = np.ascontiguousarray(x[low : low + block]).astype(np.int32)
            pair = own[:, :-1] * 256 + own[:, 1:]
            for k, w in enumerate(WIDTHS):
                pairs, last = tables[w]
                total = pairs[0].take(pair[:, :LENGTH], axis=0)
                for j, more in enumerate(pairs[1:], 1):
                    total += more.take(pair[:, 2 * j : 2 * j + LENGTH], axis=0)
                if last is not None:
                    total += last.take(own[:, w - 1 : w - 1 + LENGTH], axis=0)
                found[low : low + block, k * FILTERS : (k + 1) * FILTERS] = total.max(1) + self.bias[w]
        return found

    def windows_of(self, x: np.ndarray) -> np.ndarray:
        raw = np.maximum(self.pooled(x), 0) @ self.out + self.out_bias
        raw = np.exp(raw - raw.max(1, keepdims=True))
        return raw / raw.sum(1, keepdims=True)

    def texts(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language and its probability for each text; texts without a letter: und, 0."""
        known = [k for k, x in enumerate(texts) if has_letter(x)]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known or not self.languages:
            return names, scores
        own = [windows(texts[k]) for k in known]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        chance = self.windows_of(np.concatenate(own))
        mean = np.add.reduceat(chance, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        best = mean.argmax(1)
        for k, b in zip(known, best, strict=True):
            names[k] = self.languages[b]
        scores[known] = np.clip(mean[np.arange(len(best)), best], 0, 1)
        return names, scores


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> Network:
    """Adam on the cross entropy of windows; each window is also shown cut to a random shorter length."""
    rng = np.random.default_rng(seed)
    n_out = len(languages)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)), {w: rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS},
        {w: np.zeros(FILTERS) for w in WIDTHS}, rng.normal(0, 0.2, (FILTERS * len(WIDTHS), n_out)), np.zeros(n_out),
    )
    net.embedding[0] = 0
    if not len(x) or n_out < 2:
        return net
    params = [net.embedding, *net.filters.values(), *net.bias.values(), net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for low in range(0, len(order), batch):
            rows = order[low : low + batch]
            own, label = x[rows].copy(), y[rows]
            short = rng.random(len(rows)) < 0.5
            keep = np.where(short, rng.integers(6, LENGTH, len(rows)), LENGTH + TAIL)
            own[np.arange(LENGTH + TAIL)[None, :] >= keep[:, None]] = 0
            grads = [np.zeros_like(p) for p in params]
            pooled, at = [], []
            embedded = net.embedding[own]
            for w in WIDTHS:
                seen = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1)[:, :LENGTH]  # (n, LENGTH, EMBEDDING, w)
                answer = seen.transpose(0, 1, 3, 2).reshape(len(rows) * LENGTH, w * EMBEDDING) @ net.filters[w].reshape(w * EMBEDDING, FILTERS)
                answer = answer.reshape(len(rows), LENGTH, FILTERS)
                at.append(answer.argmax(1))
                pooled.append(answer.max(1) + net.bias[w])
            hidden = np.concatenate(pooled, 1)
            active = np.maximum(hidden, 0)
            raw = active @ net.out + net.out_bias
            chance = np.exp(raw - raw.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            chance[np.arange(len(rows)), label] -= 1
            chance /= len(rows)
            grads[-2], grads[-1] = active.T @ chance, chance.sum(0)
            back = (chance @ net.out.T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                own_back = back[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + len(WIDTHS) + k] = own_back.sum(0)
                for j in range(w):
                    codes = own[np.arange(len(rows))[:, None], at[k] + j]  # (n, FILTERS): only the winning places learn
                    grads[1 + k][j] = np.einsum("nfe,nf->ef", net.embedding[codes], own_back)
                    np.add.at(grads[0], codes.ravel(), (own_back[:, :, None] * net.filters[w][j].T[None]).reshape(-1, EMBEDDING))
            grads[0][0] = 0
            step += 1
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, learns: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "lang", sample: int = SAMPLE, total: int = TOTAL, **options) -> Network:
    """Learn from about ``sample`` texts of each language (rows that ``learns`` selects), chosen by a hash of id and text.

    Every language is learned, from fewer texts each where they are so many that ``total`` would
    be passed. Rows without a label or text aren't learned from, repeated rows count once.
    """
    pool = docs.where(learns & F.col(label).isNotNull() & F.col(text_column).isNotNull())
    shares = cut(pool.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")))  # a row for each language
    n_languages = shares.count()
    if not n_languages:
        return train(np.zeros((0, LENGTH + TAIL), np.uint8), np.zeros(0, np.int64), [])
    spread, each = 1 << 30, max(1, min(sample, total // n_languages))
    limits = shares.select("label", F.least(F.lit(spread), F.floor(F.lit(float(spread * each)) / F.col("n")) + 1).alias("upto"))
    rows = pool.select(F.xxhash64(F.col(id_column), F.col(text_column)).alias("order"), F.col(label).alias("label"), F.col(text_column).alias("text"))
    rows = rows.join(bounded(limits), "label").where(F.pmod(F.xxhash64(F.lit("fit"), "order"), F.lit(spread)) < F.col("upto")).select("order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", 1 << 22):
            place, found = [], []
            for k, text in enumerate(texts_of(batch, "text")):
                own = windows(text)
                some = np.unique(np.linspace(0, len(own) - 1, WINDOWS).astype(int)) if has_letter(text) else []
                place += [k] * len(some)
                found += [own[i].tobytes() for i in some]
            take = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("order").take(take), batch.column("label").take(take), pa.array(found, pa.binary())], names=["order", "label", "window"])

    found = shipped(rows).mapInArrow(run, "order long, label string, window binary").distinct().toPandas().sort_values(["order", "label", "window"])
    languages = sorted(set(found["label"]))
    x = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, LENGTH + TAIL)
    return train(x, np.searchsorted(languages, found["label"].to_numpy()) if len(found) else np.zeros(0, np.int64), languages, **options)


def predict(docs: DataFrame, net: Network, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score of each whole text; und and 0 if null or without a letter.

    Repeated rows are predicted alike, other columns of ``docs`` aren't read, an empty table gives none.
    """
    fields = [docs.schema[x] for x in keep]
    inner = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(x).alias(y) for x, y in zip(keep, inner, strict=True)], F.col(text_column).alias("own_text"))
    model = docs.sparkSession.sparkContext.broadcast(net)  # its size is fixed but for the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "own_text", 1 << 20):
            names, scores = model.value.texts(texts_of(batch, "own_text"))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in inner], pa.array(names, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return shipped(rows).mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"]))

"""Quality rules: a learned decision list over text statistics.

Sequential covering learns rules for rejection from labelled statistics: each rule is grown
condition by condition on two thirds of what is left (FOIL's gain), pruned from its end on the
other third, and kept if it is precise enough; the rows that it covers are then taken away. The
list is ordered and each rule is a conjunction of thresholds, so it is applied as one Spark
CASE expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import shipped
from .common import parts, texts_of
from .textbytes import INK, words

#: Labelled rows at most from which the list is learned.
SAMPLE = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks", "n_capitals", "n_chars_text")
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_lines_a_line": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "marks_a_word": ("n_marks", "n_words"),
    "capitals_a_char": ("n_capitals", "word_chars"),
}
FEATURES = ("n_words", *RATIOS)
_SYMBOL, _MARK, _CAPITAL = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK[list(b"!?")] = True
_CAPITAL[65:91] = True


def statistics(docs: DataFrame, keep: list[str], text_column: str = "text", prefix: str = "") -> DataFrame:
    """The columns ``keep`` and counts of each text, named prefix + count; a null text counts as empty.

    Every row has its own counts, repeated ones too; texts of any length are counted whole.
    """
    names = [prefix + x for x in COUNTS]
    fields = [docs.schema[x] for x in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{x}` long" for x in names])
    inner = [f"c{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(x).alias(y) for x, y in zip(keep, inner, strict=True)], F.col(text_column).alias("own_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "own_text", 1 << 22):
            found = count(texts_of(batch, "own_text"))
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in inner] + [pa.array(found[x]) for x in COUNTS], names=keep + names)

    return shipped(rows).mapInArrow(run, schema)


def _sums(texts: list[bytes], *tables: np.ndarray) -> list[np.ndarray]:
    found = [np.zeros(len(texts), np.int64) for _ in tables]
    for k, text in enumerate(texts):
        if text:
            codes = np.frombuffer(text, np.uint8)
            for own, marks in zip(found, tables, strict=True):
                own[k] = np.count_nonzero(marks[codes])
    return found


def count(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of each text, in arrays."""
    own = words(texts, INK, fold=False)
    lead = INK.copy()
    lead[0x80:0xC0] = False  # bytes that go on with a character
    chars, symbols, marks, capitals = _sums(texts, lead, _SYMBOL, _MARK, _CAPITAL)
    owners = own.owners
    salt = own.hashes + owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    distinct = np.zeros(len(texts), np.int64)
    if len(salt):
        order = np.argsort(salt)
        head = np.append(True, salt[order][1:] != salt[order][:-1])
        distinct = np.bincount(owners[order[head]], minlength=len(texts))
    grams, at = own.windows(3)
    twice = np.zeros(len(owners) + 1, np.int64)
    if len(grams):
        back, often = _often(grams, owners[at])
        again = at[often[back] > 1]
        np.add.at(twice, again, 1)
        np.add.at(twice, again + 3, -1)
    covered = np.cumsum(twice)[:-1] > 0
    dup, lines = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        split = text.split(b"\n")
        lines[k] = len(split)
        if len(split) > 1:
            inked = [x for x in split if x and not x.isspace()]
            dup[k] = len(inked) - len(set(inked))
    return {
        "n_words": own.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": np.bincount(owners[covered], minlength=len(texts)),
        "n_lines": lines, "n_distinct": distinct, "n_marks": marks, "n_capitals": capitals, "n_chars_text": np.fromiter(map(len, texts), np.int64, len(texts)),
    }


def _often(grams: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each window stands in its own text."""
    key = grams + owners.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    _, back, often = np.unique(key, return_inverse=True, return_counts=True)
    return back, often


def ratios(prefix: str = "") -> dict[str, Column]:
    """The features that rules compare, as expressions of the counts; 0 where there is nothing to divide by."""
    col = lambda x: F.col(prefix + x)
    return {"n_words": col("n_words").cast("double")} | {x: F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0)) for x, (a, b) in RATIOS.items()}


@dataclass(frozen=True)
class Rule:
    """Reject where all conditions (feature, above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, above, limit in self.conditions:
            hit &= x[name].to_numpy() >= limit if above else x[name].to_numpy() < limit
        return hit

    def column(self, features: dict[str, Column]) -> Column:
        hit = F.lit(True)
        for name, above, limit in self.conditions:
            hit = hit & (features[name] >= F.lit(limit) if above else features[name] < F.lit(limit))
        return hit

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>=' if above else '<'} {limit:.6g}" for name, above, limit in self.conditions)


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], most: int) -> list[tuple[str, bool, float]]:
    rule: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        best: tuple[float, tuple[str, bool, float] | None] = (1e-9, None)
        for name, limits in cuts.items():
            values = x[name].to_numpy()
            place = np.searchsorted(limits, values, "right")  # limits at or below the value
            hit_p = np.bincount(place[inside & bad], minlength=len(limits) + 1)
            hit_n = np.bincount(place[inside & ~bad], minlength=len(limits) + 1)
            below_p, below_n = np.cumsum(hit_p)[:-1], np.cumsum(hit_n)[:-1]
            for above, a, b in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(a > 0, a * (np.log2(a / (a + b)) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, above, float(limits[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return rule


def learn(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.95, least: int = 5, most_rules: int = 24, most_conditions: int = 4, n_cuts: int = 64) -> list[Rule]:
    """An ordered list of rejection rules from features ``x`` and a label that is true for rejected rows.

    No labelled row, or one class only, gives an empty list, which rejects nothing.
    """
    rules: list[Rule] = []
    x, bad = x.reset_index(drop=True), np.asarray(bad, bool)
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (left & bad).sum() >= least and (left & ~bad).any():
        cuts = {name: np.unique(np.concatenate([np.quantile(x[name][left], np.linspace(0, 1, n_cuts)), np.quantile(x[name][left & bad], np.linspace(0, 1, n_cuts))])) for name in x.columns}
        grow = left & ~third
        own = _grow(x[grow], bad[grow], cuts, most_conditions)
        prune = left & third
        worth = []
        for n in range(1, len(own) + 1):
            hit = Rule(tuple(own[:n])).covers(x[prune])
            p, q = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            worth.append((p - q) / (p + q) if p + q else -1)
        if not worth:
            break
        rule = Rule(tuple(own[: int(np.argmax(worth)) + 1]))
        hit = rule.covers(x) & left
        p = int((hit & bad).sum())
        if p < least or p < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """0 if no rule rejects the row, else the number (from 1) of the first rule that does."""
    features = ratios(prefix)
    chain = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        chain = F.when(rule.column(features), F.lit(k)).otherwise(chain)
    return chain


def base_failed(prefix: str = "") -> Column:
    col = lambda x: F.col(prefix + x)
    return (col("n_words") < 50) | (100 * col("n_repeat_words") > 50 * col("n_words"))


def chosen(labels: DataFrame, id_column: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(own_id, own_label) of at most ``sample`` labelled ids, by a hash of the ids; the lowest label of an id."""
    return (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("own_id")).agg(F.min(label).alias("own_label"))
        .orderBy(F.xxhash64("own_id"), "own_id").limit(sample)
    )


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "quality", sample: int = SAMPLE, prefix: str = "", **options) -> list[Rule]:
    """Learn from the chosen labelled rows of ``stats`` (label 0: reject); an id counts once, by its least features."""
    some = stats.select(F.col(id_column).alias("own_id"), *[c.alias(n) for n, c in ratios(prefix).items()])
    rows = some.join(F.broadcast(chosen(labels, id_column, label, sample)), "own_id")
    once = rows.groupBy("own_id").agg(F.min(F.struct(*FEATURES, "own_label")).alias("own")).select("own_id", "own.*", F.xxhash64("own_id").alias("order"))
    found = once.toPandas().sort_values(["order", *FEATURES], ignore_index=True)  # at most ``sample`` rows
    return learn(found[list(FEATURES)], (found["own_label"] == 0).to_numpy(), **options) if len(found) else []


def fit_texts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample: int = SAMPLE, **options) -> list[Rule]:
    """Learn from the chosen labelled texts, whose statistics alone are counted."""
    some = docs.select(F.col(id_column).alias("own_id"), F.col(text_column).alias("text")).join(F.broadcast(chosen(labels, id_column, label, sample)), "own_id", "left_semi")
    return fit(statistics(some, ["own_id"]), labels.withColumnRenamed(id_column, "own_id"), "own_id", label, sample, **options)


def keep(docs: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base checks and that no rule rejects, as they were."""
    own = "_own_stat_"
    while any(c.startswith(own) for c in docs.columns):
        own = "_" + own
    return statistics(docs, docs.columns, text_column, own).where(~base_failed(own) & (verdict(rules, own) == 0)).select(*docs.columns)

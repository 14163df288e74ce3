"""Scalar expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-3
#: Bins of fold changes.
FC_BINS = (0.0, 3.0, 4.0, 5.0, 6.0)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null; never NaN."""
    return F.when(b != 0, a / b)


def no_nan(x: Column) -> Column:
    """Undefined numbers are null, so that they sort last and compare as unknown."""
    return F.when(~F.isnan(x), x)


def stable(x: Column) -> Column:
    """x without the last bits, which depend on the order of a sum: what ranks are taken on."""
    return F.round(x, 9)


def fold_change(high: Column, low: Column, eps: float = EPS) -> Column:
    return (high + F.lit(eps)) / (low + F.lit(eps))


def local_score(max_fc: Column, max_delta: Column, coverage: Column, rest: Column, neighbor: Column) -> Column:
    """log1p(fc) * log1p(delta) * sqrt(coverage) * max(0, log of coverage over the others' mean)."""
    others = 0.5 * rest + 0.5 * neighbor
    return F.log1p(max_fc) * F.log1p(max_delta) * F.sqrt(coverage) * F.greatest(F.lit(0.0), F.log((coverage + 1e-9) / (others + 1e-9)))


def global_score(gap: Column, n_low: Column, n_grey: Column, n_high: Column) -> Column:
    return (1 + gap) * (1 + F.log1p(n_low)) / ((1 + n_high) * (1 + 0.5 * n_grey) + 1e-9)


def weight(local: Column, total: Column, a: float = 1.0, b: float = 0.5) -> Column:
    """local^a * global^b; null where that is undefined."""
    return no_nan(F.pow(local, F.lit(float(a))) * F.pow(total, F.lit(float(b))))


def edge_name(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit("->"), end)


def edge_ends(edge: Column) -> tuple[Column, Column]:
    """Both ends of "start->end", without what stands before a node's last "@"."""
    split = F.split(edge, "->", 2)
    strip = lambda x: F.element_at(F.split(x, "@"), -1)
    return strip(F.get(split, F.lit(0))), strip(F.get(split, F.lit(1)))


def path_name(levels: Sequence[str], columns: Sequence[Column]) -> Column:
    """level0@a|level1@b|..., null if any label is."""
    tagged = [F.concat(F.lit(f"{name}@"), col.cast("string")) for name, col in zip(levels, columns, strict=True)]
    return F.concat(*[x for pair in zip(tagged, [F.lit("|")] * len(tagged), strict=True) for x in pair][:-1])


def fc_bin(fc: Column, bins: Sequence[float] = FC_BINS) -> Column:
    """The last bin whose lower edge is at most fc, from 0."""
    found = F.lit(0)
    for k, edge in enumerate(bins[1:], 1):
        found = F.when(fc >= edge, F.lit(k)).otherwise(found)
    return found


def portable_hash(*parts: Column) -> Column:
    """A whole number below 2 ** 60 from the parts' MD5, which any SQL engine computes alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def comma_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


def linspace(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced values, both ends included."""
    return [low] if n == 1 else [low + (high - low) * k / (n - 1) for k in range(n - 1)] + [high]


def numeric_order(name: Column) -> tuple[Column, Column]:
    """Sort keys that put whole numbers first, by value, and other names after them."""
    number = F.when(name.rlike("^[0-9]+$"), name).try_cast("long")
    return number.asc_nulls_last(), name.asc()

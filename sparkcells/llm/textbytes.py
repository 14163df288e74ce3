"""Vectorised word hashing over UTF-8 bytes.

A word is a run of bytes that a lookup table marks. All bytes of a multi-byte character have the
same mark, so a byte table expresses any word class that treats the characters above 0x7F alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


CODES = mix(np.arange(1, 257, dtype=U) * U(BASE))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Words of the licence scan: all but controls, punctuation and blanks of ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Words between ASCII blanks.
INK = np.ones(256, bool)
INK[list(SPACES)] = False
#: Letters: ASCII letters and whatever is above ASCII.
LETTER = ALNUM.copy()
LETTER[0x30:0x3A] = False

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, SLICE + 4096), base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some texts, one after the other: how many each text has, their hashes, their bytes."""

    counts: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray
    prefixes: np.ndarray | None = None

    @property
    def firsts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def places(self) -> np.ndarray:
        return np.arange(len(self.hashes)) - np.repeat(self.firsts, self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of k words that lie in one text, and the index of their first word."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        rolled = np.full(n - k + 1, k, U)
        for j in range(k):
            rolled = rolled * U(BASE) + self.hashes[j : n - k + 1 + j]
        left = np.repeat(self.counts, self.counts) - self.places
        at = np.flatnonzero(left[: n - k + 1] >= k)
        return mix(rolled[at]), at


def _pieces(texts: list[bytes], marks: np.ndarray):
    """Slices of about SLICE bytes: lists of (text number, bytes), long texts cut between words."""
    own: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        while len(text) > SLICE:
            codes = np.frombuffer(text, np.uint8)
            gaps = np.flatnonzero(~marks[codes[:SLICE]])
            at = int(gaps[-1]) if len(gaps) else SLICE + int(np.argmin(np.append(marks[codes[SLICE:]], False)))
            if own:
                yield own
                own, size = [], 0
            yield [(i, text[:at])]
            text = text[at + 1 :]
        own.append((i, text))
        size += len(text) + 1
        if size > SLICE:
            yield own
            own, size = [], 0
    if own:
        yield own


def words(texts: list[bytes], marks: np.ndarray, fold: bool = True, prefix: int = 0) -> Words:
    """Hash the words of ``texts``; ``prefix`` adds hashes of the first so many bytes of longer words."""
    table = CODES[FOLD] if fold else CODES
    counts = np.zeros(len(texts), np.int64)
    hashes, sizes, prefixes = [], [], []
    for piece in _pieces(texts, marks):
        blob = b" ".join([b"", *(x for _, x in piece), b""])
        codes = np.frombuffer(blob, np.uint8)
        inside = marks[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        lengths = np.fromiter((len(x) + 1 for _, x in piece), np.int64, len(piece))
        upto = np.searchsorted(starts, 1 + np.cumsum(lengths))
        counts += np.bincount([i for i, _ in piece], np.diff(upto, prepend=0), len(texts)).astype(np.int64)
        if not len(starts):
            continue
        up, down = powers(len(codes))
        sums = np.add.accumulate(table[codes] * up[: len(codes)])
        hashes.append(mix((sums[ends - 1] - sums[starts - 1]) * down[starts]))
        sizes.append(ends - starts)
        if prefix:
            short = np.minimum(ends, starts + prefix)
            prefixes.append(mix((sums[short - 1] - sums[starts - 1]) * down[starts] + U(prefix)))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return Words(counts, join(hashes, U), join(sizes, np.int64), join(prefixes, U) if prefix else None)

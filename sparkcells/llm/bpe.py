"""Byte-level BPE ids of many texts at once.

The pre-tokeniser's pattern is applied to whole slices of text as array operations on character
classes; each distinct pre-token is then encoded once and its ids are gathered for all its places.
Texts with characters outside the table of stable classes, or with the string of a special token,
are encoded by the tokeniser itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .textbytes import BASE, SLICE, U, mix, powers

# The pre-tokeniser's pattern and Unicode's White_Space below U+0530.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = [*range(9, 14), 32, 133, 160]
STABLE = 0x0530
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CACHE = 200_000

_classes = np.full(STABLE, OTHER, np.uint8)
for _c in range(STABLE):
    _k = unicodedata.category(chr(_c))[0]
    _classes[_c] = LETTER if _k == "L" else NUMBER if _k == "N" else OTHER
_classes[WHITE] = SPACE
#: Unassigned characters may become letters in another Unicode version.
_stable = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(STABLE)])
_char_codes = mix(np.arange(1, STABLE + 1, dtype=U) * U(BASE))


def byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Encoder:
    """Ids of texts under a byte-level BPE vocabulary file (the ``tokenizers`` JSON format)."""

    def __init__(self, path: str, cache: int = CACHE):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        back = byte_of()
        self.path, self.special = path, [x["content"] for x in held.get("added_tokens", [])]
        ranks = {bytes(back[c] for c in token): i for token, i in held["model"]["vocab"].items() if all(c in back for c in token) and token not in self.special}
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.plain._core_bpe.encode_single_piece
        self.most = cache
        self._clear()

    def _exact(self, text: str) -> list[int]:
        """The tokeniser's own ids: special tokens' strings are those tokens."""
        from tokenizers import Tokenizer

        if not hasattr(self, "_tokenizer"):
            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        """An empty table of pre-tokens: two places by hash for each, ids in one flat array."""
        self.slots = np.zeros(1 << 20, U)
        self.numbers = np.zeros(1 << 20, np.int32)
        self.n = 0
        self.sizes, self.origins, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _known(self, hashes: np.ndarray, begin: np.ndarray, finish: np.ndarray, blob: str) -> np.ndarray:
        """The table's number of each pre-token; new ones are encoded and added."""
        one, two = (hashes >> U(44)).astype(np.int64), (hashes >> U(20)).astype(np.int64) & 0xFFFFF
        in_one, in_two = self.slots[one] == hashes, self.slots[two] == hashes
        which = np.where(in_one, self.numbers[one], np.where(in_two, self.numbers[two], -1)).astype(np.int64)
        lost = np.flatnonzero(which < 0)
        if not len(lost):
            return which
        distinct, first, back = np.unique(hashes[lost], return_index=True, return_inverse=True)
        at = lost[first]
        found = [self.piece(blob[a:b].encode()) for a, b in zip(begin[at].tolist(), finish[at].tolist(), strict=True)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter((x for own in found for x in own), np.int32, int(sizes.sum()))
        base = self.n
        self.sizes, self.origins = self.sizes[:base], self.origins[:base]
        kept = int(self.origins[-1] + self.sizes[-1]) if base else 0
        origins = kept + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat = np.concatenate([self.flat[:kept], new])
        self.sizes, self.origins = np.concatenate([self.sizes, sizes]), np.concatenate([self.origins, origins])
        if base < self.most:
            number = np.arange(base, base + len(found), dtype=np.int32)
            self.n = base + len(found)
            for slot in ((distinct >> U(44)).astype(np.int64), (distinct >> U(20)).astype(np.int64) & 0xFFFFF):
                free = (self.slots[slot] == 0) & (self.slots[(distinct >> U(44)).astype(np.int64)] != distinct)
                self.slots[slot[free]] = distinct[free]
                self.numbers[slot[free]] = number[free]
        which[lost] = base + back
        return which

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        ids, counts, own, size = [], [], [], 0
        for text in [*texts, None]:
            if own and (text is None or size + len(text) > SLICE):
                a, b = self._slice(own)
                ids.append(a)
                counts.append(b)
                own, size = [], 0
            if text is not None:
                own.append(text)
                size += len(text)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        decoded = [x.decode("utf-8", "replace") for x in texts]
        blob = "\n".join(["", *decoded, ""])
        codes = np.frombuffer(blob.encode("utf-32-le"), "<u4")
        strange: dict[int, str] = {}
        if any(s in blob for s in self.special):
            strange = {k: x for k, x in enumerate(decoded) if any(s in x for s in self.special)}
        if codes.max() >= STABLE or not _stable[codes].all():
            strange |= {k: x for k, x in enumerate(decoded) if not x.isascii() and (ord(max(x)) >= STABLE or not _stable[[ord(c) for c in set(x)]].all())}
        if strange:
            for k in strange:
                decoded[k] = ""
            blob = "\n".join(["", *decoded, ""])
            codes = np.frombuffer(blob.encode("utf-32-le"), "<u4")
        kinds = _classes[codes]
        lengths = np.fromiter(map(len, decoded), np.int64, len(decoded))
        ends = np.cumsum(lengths + 1)  # the line feed that follows each text
        kinds[0] = kinds[ends] = 4
        change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        cut = np.zeros(len(codes) + 1, bool)
        cut[change] = True
        # runs of blanks before something else: the last blank joins what follows if it is a space
        starts = np.append(0, change)
        stops = np.append(change, len(codes))
        blank = kinds[starts] == SPACE
        end = stops[blank]
        inner = kinds[end] != 4
        cut[end[inner] - 1] = True
        cut[end[inner & (codes[np.maximum(end - 1, 0)] == 32)]] = False
        # contractions
        tick = np.flatnonzero(codes == 39)
        if len(tick):
            tick = tick[cut[tick] & (kinds[tick + 1] == LETTER)]
            one, two = codes[tick + 1], codes[np.minimum(tick + 2, len(codes) - 1)]
            pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            single = np.isin(one, [115, 116, 109, 100])
            for at, n in ((tick[single], 1), (tick[pair], 2)):
                cut[at + 1] = False
                if len(at):
                    cut[at + 1 + n] = True
        begin = np.flatnonzero(cut[: len(codes)])
        begin = begin[kinds[begin] != 4]
        finish = np.flatnonzero(cut[: len(codes)])
        finish = finish[np.searchsorted(finish, begin, "right")] if len(begin) else begin
        up, down = powers(len(codes))
        sums = np.add.accumulate(_char_codes[codes] * up[: len(codes)])
        hashes = mix((sums[finish - 1] - sums[begin - 1]) * down[begin])
        which = self._known(hashes, begin, finish, blob)
        each, origin = self.sizes[which], self.origins[which]
        total = np.cumsum(each)
        ids = self.flat[np.repeat(origin - (total - each), each) + np.arange(total[-1] if len(total) else 0)]
        upto = np.concatenate([[0], total])[np.searchsorted(begin, ends)]
        counts = np.diff(upto, prepend=0)
        if strange:
            split = np.split(ids, np.cumsum(counts)[:-1])
            for k, text in strange.items():
                own = self._exact(text) if any(s in text for s in self.special) else self.plain.encode_ordinary(text)
                split[k] = np.array(own, np.int32)
            counts = np.fromiter(map(len, split), np.int64, len(split))
            ids = np.concatenate(split)
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

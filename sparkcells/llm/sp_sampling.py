"""Sampled segmentations without replacement over a SentencePiece vocabulary.

The segmentations of a text are the paths of a lattice, with probabilities proportional to the
exponential of their pieces' scores. Gumbel top-k draws k distinct ones: each path's log
probability gets Gumbel noise and the k largest are taken, without enumerating them. The search
is A* from the lattice's start: a queue holds sets of paths that share a prefix, with the exact
maximum of the set's perturbed values as bound (a Gumbel at the set's log mass, truncated by its
parent's maximum, since the lattice's backward sums are known). Taking the best set fixes one
path by sampling its edges and leaves, at each node, the set of the path's untaken siblings.

All rows of a batch are searched at a time. A text falls into stretches wherever no piece holds the
two characters beside a place. Lattices are built once for each distinct stretch, found by its hash
and compared character by character, and kept in flat arrays, the most used ones longest; paths are
walked one edge of every open stretch a step, each edge noted at its place in the batch's text; and a
row's queue is the bounds of its paths' edges, of which the largest is taken. Bounds are worked out
only for edges that can still be among the k largest of their path, which stand near its start.

Random numbers are hashes of the row's key, the number of the sample and the place in the text, so
a row is sampled alike in any batch and task.
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
from .textbytes import BASE, SLICE, U, mix, powers

SPACE = "▁"
SAMPLES = 3
#: Weight of the vocabulary's scores, which for BPE vocabularies are negative merge ranks.
WEIGHT = 2e-4
#: Edges of the lattices that are kept between batches.
KEPT = 3_000_000
#: Chances left below this count as none.
TINY = 1e-12
#: Chances are whole numbers of 2 ** -BITS where paths are walked, and of 2 ** -FINE where they are
#: summed, so that no sum depends on what else is in a batch.
BITS, FINE = 38, 52
#: An edge's word is its running chance, LAST if it ends its stretch, and its length in characters.
LAST, SHIFT = 1 << 23, 24
#: No two perturbations -log(-log(u)) of a u of 53 bits are farther apart.
SPREAD = 42.0
#: Stands for the end of a stretch among its characters.
_END = np.uint32(0xFFFFFFFF)
#: Stands for a literal block that isn't a space (a private code point of a lone surrogate).
_LITERAL = "\udc81"


class Vocabulary:
    """Pieces of a SentencePiece model file, with byte fallback, and the lattices of the stretches met so far.

    Nodes of all lattices are numbered one after the other, a stretch of n characters has n + 1;
    code has the character after each. The edges of node i are first[i] .. first[i + 1] - 1, the
    likeliest first, with running chance (in 2 ** -BITS) and length (hop, a word), log chance given
    the node (log, in 2 ** -32), the log of the others' (rest) and id (number; below zero: the
    character -1 - number, spelt in bytes). Stretch i begins at node[i], has length[i] characters
    and was met used[i] times; keys are the stretches' hashes in order, slots their numbers.
    """

    def __init__(self, path: str, weight: float = WEIGHT, kept: int = KEPT):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[int, float]] = {}
        self.byte: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.score[piece] = (i, weight * model.get_score(i))
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.unknown = min((s for _, s in self.score.values()), default=0.0) - 1.0
        self._table()
        self.kept = kept
        sizes = np.fromiter(map(len, self.surface), np.int64, len(self.surface))
        self._surface = _Lists(np.uint8)
        self._surface.add(np.frombuffer(b"".join(self.surface), np.uint8), sizes)
        self._clear()

    def _table(self) -> None:
        """Hashes of the pieces, in order, a filter for them, and how long pieces are by their first character."""
        text = list(self.score)
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        codes = np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4")
        up, down = powers(len(codes) + 1)
        sums = np.append(U(0), np.add.accumulate(_char(codes) * up[: len(codes)]))
        begin = np.cumsum(sizes) - sizes
        hashes = (sums[begin + sizes] - sums[begin]) * down[begin]
        order = np.argsort(hashes)
        self._hashes, self._numbers = np.append(hashes[order], U(0)), np.array([self.score[text[k]][0] for k in order.tolist()] + [0], np.int64)
        # 1: pieces may begin so, 2: it may be a piece; what is set by chance only costs time
        self._filter = np.zeros(1 << 22, np.uint8)
        heads = np.repeat(begin, sizes)
        self._filter[((sums[1:] - sums[heads]) * down[heads]) >> U(42)] = 1
        self._filter[hashes >> U(42)] = 3
        self._scores = np.zeros(len(self.surface))
        for number, score in self.score.values():
            self._scores[number] = score
        # places where two characters stand beside each other in a piece; what is set by chance only joins stretches
        self._joined = np.zeros(1 << 22, bool)
        inner = np.setdiff1d(np.arange(len(codes) - 1), begin[1:] - 1)
        self._joined[_pair(codes[inner], codes[inner + 1])] = True
        self._reach = np.zeros(int(codes.max(initial=0)) + 2, np.int64)
        np.maximum.at(self._reach, codes[begin], sizes)

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, U), np.zeros(0, np.int64)
        self.node, self.length, self.used = (_Array(np.int64) for _ in range(3))
        self.code, self.first = _Array(np.uint32), _Array(np.int32)
        self.first.add(np.zeros(1, np.int32))
        self.hop, self.log, self.rest, self.number = _Array(np.int64), _Array(np.int64), _Array(float), _Array(np.int32)

    def segments(self, text: str) -> list[str]:
        """Stretches of the text that no piece crosses; a space is put before it, as the encoder does."""
        codes, ends, _ = self.stretches([text])
        blob = codes.tobytes().decode("utf-32-le", "surrogatepass")
        return [blob[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The characters of all texts, one after the other, where each stretch ends, and how many each text has."""
        marked = [SPACE + x.replace(SPACE, _LITERAL).replace(" ", SPACE) if x else "" for x in texts]
        blob = "".join(marked)
        codes = np.frombuffer(blob.encode("utf-32-le", "surrogatepass"), "<u4")
        if not blob:
            return codes, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        split = np.append(~self._joined.take(_pair(codes[:-1], codes[1:])), True)
        split[ends[ends > 0] - 1] = True
        upto = np.flatnonzero(split) + 1
        return codes, upto, np.diff(np.searchsorted(upto, ends, "right"), prepend=0)

    def _bytes(self, char: str) -> tuple[int, ...]:
        raw = (SPACE if char == _LITERAL else char).encode("utf-8", "replace")
        return tuple(self.byte[x] for x in raw)

    def learn(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first node of each stretch; new ones get a lattice. The stretches follow one another without gaps."""
        if len(self.hop) > self.kept:
            self._forget()
        hashes = self._hashed(codes, begin, sizes)
        which = self._find(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            keys, at = np.unique(hashes[new], return_index=True)
            numbers = self._build(codes, begin[new[at]], sizes[new[at]])
            place = np.searchsorted(self.keys, keys)
            self.keys, self.slots = np.insert(self.keys, place, keys), np.insert(self.slots, place, numbers)
            which[new] = self._find(hashes[new])
        # characters are compared, so that no result rests on a hash
        at = np.arange(len(codes)) + np.repeat(self.node[which] - begin, sizes)
        unlike = self.code.held[: len(self.code)].take(at, mode="clip") != codes
        other = self.length[which] != sizes
        if unlike.any() or other.any():
            wrong = np.flatnonzero(other | np.logical_or.reduceat(unlike, begin))
            which[wrong] = self._build(codes, begin[wrong], sizes[wrong])
        self.used.held[: len(self.used)] += np.bincount(which, minlength=len(self.used))
        return self.node[which]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the stretch with each hash; -1 if there is none."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[place] == hashes, self.slots[place], -1)

    @staticmethod
    def _hashed(codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A hash of each stretch."""
        found = [np.zeros(0, U)]
        cuts = [0, *(np.flatnonzero(np.diff(begin // SLICE)) + 1).tolist(), len(begin)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            start = begin[a:b] - begin[a]
            own = codes[begin[a] : begin[b - 1] + sizes[b - 1]]
            up, down = powers(len(own) + 1)
            sums = np.append(U(0), np.add.accumulate(_char(own) * up[: len(own)]))
            found.append(mix((sums[start + sizes[a:b]] - sums[start]) * down[start]))
        return np.concatenate(found)

    def _forget(self) -> None:
        """Keep the lattices met most, and more than once, up to half of the edges to keep."""
        used, node, length = self.used[self.slots], self.node[self.slots], self.length[self.slots]
        begin, end = self.first[node].astype(np.int64), self.first[node + length].astype(np.int64)
        order = np.argsort(-used, kind="stable")
        fits = (np.cumsum((end - begin)[order]) <= self.kept // 2) & (used[order] > 1)
        stay = np.sort(order[fits])
        node, length, begin, end = node[stay], length[stay], begin[stay], end[stay]
        nodes, edges = _ranges(node, node + length + 1), _ranges(begin, end)
        degree = self.first[nodes + 1] - self.first[nodes]
        self.keys, self.slots = self.keys[stay], np.arange(len(stay))
        for own in (self.hop, self.log, self.rest, self.number):
            own.keep(edges)
        self.code.keep(nodes)
        for own, kept in ((self.first, np.append(0, np.cumsum(degree))), (self.node, np.cumsum(length + 1) - length - 1), (self.length, length), (self.used, used[stay] // 2)):
            own.n = 0
            own.add(kept)

    def _pieces(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, id) of every piece that stands at a place of the stretches, and of every
        character that is none, by place, shorter pieces first; and how many a place has. left: characters to the stretch's end."""
        up, down = powers(len(codes) + 1)
        sums = np.append(U(0), np.add.accumulate(_char(codes) * up[: len(codes)]))
        down = down[: len(codes)]
        at = np.arange(len(codes))
        longest = np.minimum(left, self._reach[np.minimum(codes, len(self._reach) - 1)])
        runs = []
        for size in range(1, int(longest.max(initial=0)) + 1):
            at = at[longest[at] >= size]
            hashes = (sums[at + size] - sums[at]) * down[at]  # characters are mixed already
            kind = self._filter.take((hashes >> U(42)).view(np.int64))
            maybe = np.flatnonzero(kind > 1)
            sought = hashes[maybe]
            place = np.minimum(np.searchsorted(self._hashes[:-1], sought), len(self._hashes) - 1)
            hit = self._hashes[place] == sought
            runs.append((at[maybe[hit]], size, self._numbers[place[hit]]))
            at = at[kind > 0]
        single = np.zeros(len(codes), bool)
        if runs:
            single[runs[0][0]] = True
        spelt = np.flatnonzero(~single)  # characters that are no piece, as bytes
        runs.append((spelt, 1, -1 - codes[spelt].astype(np.int64)))
        degree = np.zeros(len(codes), np.int64)
        for own, _, _ in runs:
            degree[own] += 1  # a place stands once in a run
        upto = np.cumsum(degree)
        free = upto - degree
        total = int(upto[-1])
        length, ids = np.empty(total, np.int64), np.empty(total, np.int64)
        for own, size, numbers in runs:
            into = free[own]
            length[into], ids[into] = size, numbers
            free[own] += 1
        return np.repeat(np.arange(len(codes)), degree), length, ids, degree

    def _build(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Lattices of new stretches: all pieces by rolling hashes, then log masses from the ends on. The stretches' numbers."""
        codes = codes[_ranges(begin, begin + sizes)]
        n = len(begin)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(n), sizes)
        left = ends[owner] - np.arange(len(codes))
        at, length, number, many = self._pieces(codes, left)
        score = np.where(number < 0, self.unknown, self._scores[np.maximum(number, 0)])
        node = at + owner[at]  # a stretch has a node more than characters
        to = node + length
        log = np.zeros(len(at))
        mass = np.zeros(len(codes) + n)
        # edges of places nearer to the end come first; every place has an edge
        rounds = np.argsort(left.astype(np.int16) if left.max() < 1 << 15 else left, kind="stable")
        head = np.cumsum(many) - many
        cuts = np.append(0, np.cumsum(np.bincount(left)[1:]))
        edges = _ranges(head[rounds], (head + many)[rounds])
        at_edge = np.append(0, np.cumsum(many[rounds]))
        held, goal = score[edges], to[edges]
        logs = np.empty(len(edges))
        starts = rounds + owner[rounds]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, y = at_edge[a], at_edge[b]
            if x == y:
                continue
            weight = held[x:y] + mass[goal[x:y]]
            own, first = many[rounds[a:b]], at_edge[a:b] - x
            top = np.maximum.reduceat(weight, first)
            total = top + np.log(np.add.reduceat(np.exp(weight - np.repeat(top, own)), first))
            mass[starts[a:b]] = total
            logs[x:y] = np.minimum(0.0, weight - np.repeat(total, own))
        log[edges] = logs
        best = np.flatnonzero(log == np.repeat(np.maximum.reduceat(log, head), many))
        best = best[np.append(True, node[best[1:]] != node[best[:-1]])]
        for own in (length, number, log):  # the likeliest first
            own[head], own[best] = own[best], own[head]
        chance = np.exp(log)
        running = np.cumsum(np.minimum(np.rint(chance * 2.0**BITS).astype(np.int64), 1 << BITS))
        final = head + many - 1
        inside = running - np.repeat(np.append(0, running[final])[:-1], many)
        inside = np.minimum(inside, 1 << BITS)
        inside[final] = 1 << BITS
        nodes = len(self.first) - 1
        degree = np.zeros(len(mass), np.int64)
        degree[node[head]] = many
        code = np.full(len(mass), _END)
        code[node[head]] = codes
        self.first.add(len(self.hop) + np.cumsum(degree))
        self.hop.add((inside << SHIFT) + length + np.where(length == left[at], LAST, 0))
        self.number.add(number)
        with np.errstate(divide="ignore"):
            others = -np.expm1(log)
            self.rest.add(np.where(others > TINY, np.log(others), -np.inf))
        self.log.add(np.rint(log * 2.0**32).astype(np.int64))
        self.code.add(code)
        self.node.add(nodes + ends - sizes + np.arange(n))
        self.length.add(sizes)
        self.used.add(np.zeros(n, np.int64))
        return np.arange(len(self.node) - n, len(self.node))

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; the space that the encoder puts before it is left out."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def _walk(self, path: np.ndarray, at: np.ndarray, shift: np.ndarray, base: np.ndarray) -> None:
        """Sample edges from the places ``at`` to their stretches' ends and note them in ``path``, by place.

        shift: what a place's node is more than the place; base: of the random numbers, those of place 0.
        """
        while len(at):
            edge = self.first.held.take(at + shift).astype(np.int64)
            point = _mixed(base + at.view(U) * U(BASE))
            point >>= U(64 - BITS)
            point += U(1)
            point <<= U(SHIFT)
            point = point.view(np.int64)
            word = self.hop.held.take(edge)
            late = np.flatnonzero(word < point)  # the likeliest edge is the first
            while len(late):
                edge[late] += 1
                word[late] = more = self.hop.held.take(edge[late])
                late = late[more < point[late]]
            path[at] = edge
            open_ = np.flatnonzero((word & LAST) == 0)
            at = at.take(open_) + (word.take(open_) & (LAST - 1))
            shift, base = shift.take(open_), base.take(open_)

    def samples(self, texts: list[str], seeds: np.ndarray, k: int) -> list["Drawn"]:
        """The first to the k-th of at most k distinct segmentations of each text, the largest perturbed first."""
        n = len(texts)
        codes, ends, size = self.stretches(texts)
        lengths = np.diff(ends, prepend=0)
        before = ends - lengths
        shift = self.learn(codes, before, lengths) - before
        row = np.repeat(np.arange(n), size)
        last = np.cumsum(size)  # of a row's stretches, plus one
        upto = np.append(0, ends)
        text_begin, text_end = upto[last - size], upto[last]
        seeds = seeds.astype(np.int64).view(U)
        pool = _Pool()
        drawn: list[Drawn] = []

        def base(rows: np.ndarray, number: int) -> np.ndarray:
            """Of the random numbers of the rows' paths, by place in the batch."""
            return _stream(seeds[rows], number, 0) + (U(1) - text_begin[rows].view(U)) * U(BASE)

        def add(top: np.ndarray, rows: np.ndarray, path: np.ndarray, given: np.ndarray, number: int) -> None:
            """The rows' paths are drawn, and the bounds of untaken siblings at each edge queued; none before the first ``given`` edges."""
            place = np.flatnonzero(path >= 0)
            edges = path[place].astype(np.int64)
            begin = np.searchsorted(place, text_begin[rows])
            sizes = np.searchsorted(place, text_end[rows]) - begin
            log = self.log.held.take(edges)
            upto = np.append(0, np.cumsum(log))
            drawn.append(Drawn(rows, sizes, edges, (upto[begin + sizes] - upto[begin]) * 2.0**-32, top))
            # A set's bound falls with the log chances before it, which only fall along a path, and the k
            # first edges with siblings bound the k-th largest: what lies beyond it by all that chance can do isn't needed.
            many = np.append(0, np.cumsum(log < 0))
            few = many[begin + sizes] - many[begin + given] < k
            reach = np.zeros(len(rows))
            some = np.flatnonzero(~few)
            for j in range(1, k + 1):
                at = np.searchsorted(many, many[(begin + given)[some]] + j) - 1
                reach[some] = np.maximum(reach[some], (upto[begin[some]] - upto[at]) * 2.0**-32 - self.rest[edges[at]])
            far = np.searchsorted(-upto, np.ceil((reach + SPREAD) * 2.0**32).astype(np.int64) - upto[begin], "right") - begin
            kept = np.where(few, sizes, np.minimum(far, sizes))
            near = _ranges(begin, begin + kept)
            row = np.repeat(np.arange(len(rows)), kept)
            step = near - begin[row]
            total = (upto[near] - upto[begin][row]) * 2.0**-32
            rest = self.rest[edges[near]]
            at = np.flatnonzero((rest > -np.inf) & (step >= given[row]))
            found, row = np.full(len(near), -np.inf), row[at]
            noise = -np.log(_uniform(_stream(seeds[rows], number, 1)[row], step[at]))
            found[at] = -np.logaddexp(-top[row], np.log(noise) - (total[at] + rest[at]))
            pool.add(rows, kept, edges[near], place[near], found, total)

        # the first path of every row
        rows = np.arange(n)
        path = np.full(len(codes), -1, np.int32)
        self._walk(path, before, shift, base(rows, 0)[row])
        top = -np.log(-np.log(_uniform(_stream(seeds, 0, 2), np.zeros(n, np.int64))))
        top[size == 0] = 0.0
        add(top, rows, path, np.zeros(n, np.int64), 0)
        for number in range(1, k):
            rows, at, value = pool.best(n)  # the best set of each row that has one
            if not len(rows):
                break
            old, here = pool.edges[at], pool.place[at]
            occ = np.searchsorted(before, here, "right") - 1
            node = here + shift[occ]
            own = _ranges(self.first[node], self.first[node + 1])
            degree = (self.first[node + 1] - self.first[node]).astype(np.int64)
            group = np.repeat(np.arange(len(rows)), degree)
            weight = np.rint(np.exp(self.log[own] * 2.0**-32) * 2.0**FINE).astype(U)
            for taken in [old, *pool.taken(at)]:
                weight[own == taken[group]] = 0
            running = np.cumsum(weight)  # may wrap, its differences don't
            begin = np.cumsum(degree) - degree
            inside = running - np.repeat(running[begin] - weight[begin], degree)
            left = inside[begin + degree - 1].astype(float)
            point = np.floor(left * _uniform(_stream(seeds[rows], number, 3), np.zeros(len(rows), np.int64)))
            beyond = np.where(inside.astype(float) > point[group], np.arange(len(own)), len(own))
            first = np.minimum.reduceat(beyond, begin)
            pick, more = own[first], (left - weight[first].astype(float)) * 2.0**-FINE
            # what is left at this node, below the same bound
            noise = -np.log(_uniform(_stream(seeds[rows], number, 4), np.zeros(len(rows), np.int64)))
            stays = more > TINY
            again = np.full(len(rows), -np.inf)
            again[stays] = -np.logaddexp(-value[stays], np.log(noise[stays]) - (pool.before[at[stays]] + np.log(more[stays])))
            pool.replace(at, pick, again)
            # the prefix, the edge and a fresh walk of what follows
            begin = pool.begin(at)
            path = np.full(len(codes), -1, np.int32)
            prefix = _ranges(begin, at)
            path[pool.place[prefix]], path[here] = pool.edges[prefix], pick
            fresh = _ranges(occ, last[rows])
            many = last[rows] - occ
            own = np.repeat(np.arange(len(rows)), many)
            from_ = before[fresh]
            from_[np.cumsum(many) - many] = here + (self.hop[pick] & (LAST - 1))
            open_ = np.flatnonzero(from_ < ends[fresh])
            self._walk(path, from_[open_], shift[fresh[open_]], base(rows, number)[own[open_]])
            add(value, rows, path, at - begin + 1, number)
        limit = np.full(n, -np.inf)
        rows, _, value = pool.best(n)
        limit[rows] = value
        for own in drawn:
            own.inclusion = -np.expm1(-np.exp(np.minimum(50.0, own.logs - limit[own.rows])))
            own.ids, own.n_ids = self._ids(own.edges, own.sizes)
        return drawn

    def _ids(self, edges: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some edges, and how many each group of so many edges has."""
        number = self.number[edges]
        spelt = np.flatnonzero(number < 0)
        if not len(spelt):
            return number, groups
        chars, which = np.unique(-1 - number[spelt], return_inverse=True)
        bytes_ = _Lists()
        raw = [self._bytes(chr(x)) for x in chars.tolist()]
        bytes_.add(np.array([x for own in raw for x in own], np.int32), np.array([len(x) for x in raw], np.int32))
        count = np.ones(len(number), np.int64)
        count[spelt] = bytes_.sizes[which]
        upto = np.append(0, np.cumsum(count))
        ids = np.repeat(number, count)
        ids[_ranges(upto[spelt], upto[spelt + 1])] = bytes_.take(which, np.ones(len(which), np.int64))[0]
        ends = np.cumsum(groups)
        return ids, upto[ends] - upto[ends - groups]

    def sample(self, text: str, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
        """At most k distinct segmentations of one text: (ids, log probability, perturbed, inclusion score).

        The inclusion score is the probability that the segmentation is among the k, given the
        perturbed value of the next one; 1 if there is no other.
        """
        found = self.samples([text], np.array([seed], np.int64), k)
        return [(own.ids.tolist(), float(own.logs[0]), float(own.perturbed[0]), float(own.inclusion[0])) for own in found]


@dataclass
class Drawn:
    """One segmentation of some rows: how many edges each has, the edges, log probabilities and perturbed values."""

    rows: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray
    logs: np.ndarray
    perturbed: np.ndarray
    inclusion: np.ndarray | None = None
    ids: np.ndarray | None = None
    n_ids: np.ndarray | None = None


class _Array:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.held.take(at)

    def add(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.held):
            more = np.zeros(max(len(self.held) * 5 // 4, self.n + len(new)), self.held.dtype)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(new)] = new
        self.n += len(new)

    def keep(self, at: np.ndarray) -> None:
        """Only what stands at these places, which rise, stays."""
        self.held[: len(at)] = self.held.take(at)
        self.n = len(at)


class _Lists:
    """Short lists in one flat array."""

    def __init__(self, kind=np.int32):
        self.flat, self.begin, self.sizes = _Array(kind), _Array(np.int64), _Array(np.int32)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.begin.add(len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.flat.add(flat)

    def take(self, which: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists ``which``, one after the other, and how long each group of so many of them is."""
        begin, sizes = self.begin[which], self.sizes[which]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ends = np.cumsum(groups)
        return self.flat[_ranges(begin, begin + sizes)], upto[ends] - upto[ends - groups]


class _Pool:
    """The edges of all paths drawn so far, as far as they are needed, and the bound of the untaken siblings at each."""

    def __init__(self):
        self.edges, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bound, self.before = np.zeros(0), np.zeros(0)
        self.heads, self.owners = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.picked: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, sizes: np.ndarray, edges: np.ndarray, place: np.ndarray, bound: np.ndarray, before: np.ndarray) -> None:
        some = sizes > 0
        self.heads = np.concatenate([self.heads, len(self.edges) + (np.cumsum(sizes) - sizes)[some]])
        self.owners = np.concatenate([self.owners, rows[some]])
        self.edges, self.place = np.concatenate([self.edges, edges]), np.concatenate([self.place, place])
        self.bound, self.before = np.concatenate([self.bound, bound]), np.concatenate([self.before, before])

    def best(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, bound) of the largest bound of each row that has one."""
        if not len(self.edges):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        value = np.maximum.reduceat(self.bound, self.heads)
        top = np.full(n, -np.inf)
        np.maximum.at(top, self.owners, value)
        sizes = np.diff(np.append(self.heads, len(self.edges)))
        chosen = (value == top[self.owners]) & (value > -np.inf)
        near = _ranges(self.heads[chosen], self.heads[chosen] + sizes[chosen])
        owner = np.repeat(self.owners[chosen], sizes[chosen])
        hit = self.bound[near] == top[owner]
        rows, first = np.unique(owner[hit], return_index=True)
        return rows, near[hit][first], top[rows]

    def begin(self, at: np.ndarray) -> np.ndarray:
        """Where the path of each place begins."""
        return self.heads[np.searchsorted(self.heads, at, "right") - 1]

    def taken(self, at: np.ndarray) -> list[np.ndarray]:
        """What was picked before at each place; -1 for nothing."""
        found = []
        for places, picks in self.picked:
            where = np.minimum(np.searchsorted(places, at), len(places) - 1)
            found.append(np.where(places[where] == at, picks[where], -1))
        return found

    def replace(self, at: np.ndarray, pick: np.ndarray, bound: np.ndarray) -> None:
        order = np.argsort(at)
        self.picked.append((at[order], pick[order]))
        self.bound[at] = bound


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A place of 2 ** 22 for two characters."""
    return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) >> np.uint32(10)


def _char(codes: np.ndarray) -> np.ndarray:
    return mix((codes.astype(U) + U(1)) * U(BASE))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0] .. end[0] - 1, begin[1] .. end[1] - 1, and so on."""
    sizes = end - begin
    upto = np.cumsum(sizes, dtype=np.int64)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - (upto - sizes), sizes)


def _stream(seeds: np.ndarray, number: int, use: int) -> np.ndarray:
    """The base of a stream of random numbers for each seed."""
    return mix(seeds + U((8 * number + use + 1) * BASE % (1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _bits(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(base + (place.astype(U) + U(1)) * U(BASE))


def _uniform(base: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number between 0 and 1, neither included, for each base and place."""
    return ((_bits(base, place) >> U(11)).astype(float) + 0.5) * 2.0**-53


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, weight: float = WEIGHT) -> Vocabulary:
    """One vocabulary a process, path and weight."""
    if (path, weight) not in _vocabularies:
        _vocabularies[path, weight] = Vocabulary(path, weight)
    return _vocabularies[path, weight]


def sampled(rows: DataFrame, path: str, key: list[Column], keep: list[str], text_column: str = "text", k: int = SAMPLES, weight: float = WEIGHT) -> DataFrame:
    """For each row: the columns ``keep`` and, for each of at most k distinct segmentations,
    sample (from 1), ids, log_prob, perturbed, inclusion and round_trip (its decoding is the text).

    key: what seeds a row (nulls allowed); rows with equal keys and texts are sampled alike. A
    null or empty text has one segmentation without pieces. Texts of any length are taken whole;
    repeated rows give repeated results, other columns aren't read and an empty table gives none.
    """
    fields = [rows.schema[x] for x in keep]
    inner = [f"c{i}" for i in range(len(keep))]
    chosen = rows.select(*[F.col(x).alias(y) for x, y in zip(keep, inner, strict=True)], F.xxhash64(*key).alias("own_seed"), F.col(text_column).alias("own_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path, weight)
        for batch in parts(batches, "own_text", 1 << 18):
            raw = texts_of(batch, "own_text")
            seeds = batch.column("own_seed").to_numpy()
            for number, drawn in enumerate(own.samples([x.decode("utf-8", "replace") for x in raw], seeds, k), 1):
                ends = np.cumsum(drawn.n_ids)
                text, sizes = own._surface.take(drawn.ids, drawn.n_ids)
                bytes_, upto = memoryview(text.tobytes()), np.cumsum(sizes)
                same = [bytes_[a + 1 if raw[i] else a : b] == raw[i] for i, a, b in zip(drawn.rows.tolist(), (upto - sizes).tolist(), upto.tolist(), strict=True)]
                take = pa.array(drawn.rows)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(drawn.ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(x).take(take) for x in inner], pa.array(np.full(len(drawn.rows), number, np.int32)), ids, pa.array(drawn.logs), pa.array(drawn.perturbed), pa.array(drawn.inclusion), pa.array(same, pa.bool_())],
                    names=[*keep, "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip"],
                )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return shipped(chosen).mapInArrow(run, ", ".join([*kinds, "sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean"]))

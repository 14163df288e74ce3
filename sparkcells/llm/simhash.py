"""SimHash near-duplicates: pivot distance tables, verification, components.

A fingerprint has a bit for each position of a shingle hash, set if over half of the text's hashes
have it set. Equal fingerprints are folded to one row first, so a group of copies of any size is
one row from there on.

Small distances are linked by a pivot table, written once: the Hamming distances of every
fingerprint to REFERENCES. They are one fingerprint, the same with each block of two bits
complemented, and some at random. The distances to the first ones tell how many bits of a block
are unlike the reference's, and fingerprints at most ``bits`` apart differ in at most ``bits`` of
these counts. So of ``bits + 1`` groups of blocks one has equal counts, and of the blocks outside
of it again one of ``bits + 1`` groups: these are the cells in which pairs are looked for. In a
cell a pair is discarded if any distance of the table differs by more than ``bits``, and the
survivors are verified. A cell of many fingerprints is split into overlapping slabs of its
distances to the random references, which lose no pair.

A similarity has cells of sampled bits over a fingerprint of several lanes, as many as find a pair
at the wanted similarity with the wanted recall; their width grows with the number of
fingerprints. There the distance only proposes: it is so wide that hardly a pair at the similarity
lies outside of it. Rows are folded by their sets of shingles, and inside of a component of
candidates the sets are compared: all with the component's first, and what isn't alike with all.

A cell returns a star for each local component instead of its pairs, and the stars are joined to
components in rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..shipping import shipped
from .common import bounded, cut, discard, free, parts, row_key, texts_of
from .textbytes import BASE, U, mix

SEED = 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LANES = 4
_LANE = mix(np.arange(1, LANES + 1, dtype=U))
#: Two-bit blocks of a fingerprint, and references beside the first one and its complemented blocks.
BLOCKS, EXTRA = 32, 15
_RANDOM = mix(np.arange(1001, 1002 + EXTRA, dtype=U) * U(BASE))
REFERENCES = np.concatenate([_RANDOM[:1], _RANDOM[0] ^ (U(3) << np.arange(0, 64, 2, dtype=U)), _RANDOM[1:]])
#: Words of the pivot table, eight distances each.
WORDS = [f"t{k}" for k in range(len(REFERENCES) // 8)]
#: Cells of more fingerprints are split into slabs, of so many distances each, by so many references.
HOT, SLAB, SPLIT = 4096, 4, 3
#: Cells of so many fingerprints at most are searched together.
SMALL = 48
#: Candidates of one component that are compared at a time.
BLOCK = 1024
#: Places of the filter that tells which rows are candidates.
PLACES = 1 << 24


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hash of every run of ``words`` words, or of all words where there are fewer; no word: none."""
    found = text.translate(LOWER).split()
    if not found:
        return np.zeros(0, "<u8")
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[min(words, len(found)) - 1 :]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], "<u8")


def _name(values: np.ndarray) -> int:
    return _signed(xxh64_intdigest(values.tobytes(), SEED))


def fingerprint(text: bytes, words: int = 3, lanes: int = 1) -> np.ndarray:
    """The fingerprint of one text, a signed 64-bit integer for each lane; no word: zeros.

    The first lane's bits are the shingle hashes' own, other lanes mix them anew.
    """
    return fingerprint_of(shingles(text, words), lanes)


def fingerprint_of(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    n = len(hashes)
    if not n:
        return np.zeros(lanes, np.int64)
    total = np.zeros(64 * lanes, np.int64)
    for k in range(0, n, 1 << 14):
        own = hashes[k : k + (1 << 14), None]
        if lanes > 1:
            own = np.concatenate([own, mix(own + _LANE[None, 1:lanes])], 1)
        total += np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n, bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3, lanes: int = 1, sets: bool = False) -> DataFrame:
    """(id, key, node, fp0, fp1, ...) of every row; a null text is empty.

    key is a hash of id and text; node names the fingerprint: itself, or a hash of its lanes. sets:
    a shingle counts once however often a text has it, and node names the set of shingles.
    """
    names = [f"fp{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            found, nodes = np.zeros((batch.num_rows, lanes), np.int64), np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(texts_of(batch, "text")):
                own = np.unique(shingles(text, words)) if sets else shingles(text, words)
                found[k], nodes[k] = fingerprint_of(own, lanes), _name(own) if sets else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(nodes), *[pa.array(np.ascontiguousarray(found[:, k])) for k in range(lanes)]], names=["id", "key", "node", *names])

    found = shipped(_keyed(docs, id_column, text_column)).mapInArrow(run, "id long, key long, node long, " + ", ".join(f"{x} long" for x in names))
    return found if sets else found.withColumn("node", F.xxhash64(*names) if lanes > 1 else F.col("fp0"))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("id"), row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text"))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(node, fp0, t0, t1, ...): the distances to REFERENCES, a byte each, of every fingerprint."""
    words = []
    for low in range(0, len(REFERENCES), 8):
        far = [F.bit_count(F.col("fp0").bitwiseXOR(F.lit(_signed(int(r))))).cast("long") for r in REFERENCES[low : low + 8]]
        words.append(reduce(Column.bitwiseOR, [F.shiftleft(x, 8 * k) for k, x in enumerate(far)]))
    return distinct.select("node", "fp0", *[x.alias(n) for x, n in zip(words, WORDS, strict=True)])


def _far(k: int) -> Column:
    """The distance to reference k, from the table."""
    return F.shiftright(WORDS[k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255))


def _unlike(k: int) -> Column:
    """How many bits of block k are unlike the first reference's: 0, 1 or 2."""
    return F.shiftright(_far(0) - _far(1 + k) + F.lit(2), 1)


def exact_cells(bits: int) -> list[list[int]]:
    """Groups of blocks: fingerprints at most ``bits`` apart have equal counts in all blocks of some group."""
    found = []
    for one in np.array_split(np.arange(BLOCKS), bits + 1):
        rest = np.setdiff1d(np.arange(BLOCKS), one)
        found += [[*one.tolist(), *two.tolist()] for two in np.array_split(rest, bits + 1)]
    return found


def _slabs(cells: Column, k: int, width: int, bits: int) -> Column:
    """Each cell once for each slab of the distance to reference k that the row is in."""
    slab = F.floor(_far(k) / width)
    own = F.when(_far(k) % width < bits, F.array(slab, slab - 1)).otherwise(F.array(slab))
    return F.flatten(F.transform(cells, lambda cell: F.transform(own, lambda x: F.xxhash64(cell, F.lit(k), x))))


def celled(table: DataFrame, bits: int, hot: int = HOT) -> DataFrame:
    """(cell, node, fp0, t0, ...): every fingerprint in its cells; two at most ``bits`` apart share one.

    A cell of more than ``hot`` fingerprints is split by their distances to random references: a
    row is in the slab of its distance, and in the slab below if it is within ``bits`` of that.
    """
    keys = [F.xxhash64(F.lit(n), reduce(Column.bitwiseOR, [F.shiftleft(_unlike(k), 2 * i) for i, k in enumerate(group)])) for n, group in enumerate(exact_cells(bits))]
    keyed = table.select("node", "fp0", *WORDS, F.explode(F.array(*keys)).alias("cell"))
    full = cut(keyed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("cell", F.lit(True).alias("full")))
    parts = reduce(lambda cells, k: _slabs(cells, k, max(SLAB, bits), bits), range(1 + BLOCKS, 1 + BLOCKS + SPLIT), F.array(F.col("cell")))
    dealt = keyed.join(bounded(full), "cell", "left").withColumn("cell", F.explode(F.when(F.col("full"), parts).otherwise(F.array(F.col("cell")))))
    return dealt.select("cell", "node", "fp0", *WORDS)


def flip_rate(similarity: float) -> float:
    """The chance that a bit differs, for texts with this Jaccard similarity of shingles."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_bits(similarity: float, lanes: int = LANES) -> int:
    """Six deviations over the expected distance at ``similarity``."""
    rate, n = flip_rate(similarity), 64 * lanes
    return int(np.ceil(rate * n + 6 * np.sqrt(rate * (1 - rate) * n)))


def sampled_bands(rows: int, similarity: float, lanes: int = LANES, recall: float = 0.999, seed: int = 3) -> list[tuple[int, ...]]:
    """Masks of sampled bits: a pair at ``similarity`` agrees on some mask with chance ``recall``.

    A mask has so many bits that about 16 of ``rows`` unrelated fingerprints agree on it.
    """
    width = max(10, int(np.ceil(np.log2(max(rows, 2)))) - 4)
    hit = (1 - flip_rate(similarity)) ** width
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(int(np.ceil(np.log(1 - recall) / np.log1p(-hit)))):
        chosen = rng.choice(64 * lanes, width, replace=False).tolist()
        found.append(tuple(sum(1 << (k % 64) for k in chosen if k // 64 == lane) for lane in range(lanes)))
    return found


def sampled(distinct: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(cell, node, fp0, ...): every fingerprint in a cell for each mask, with all that agree on its bits."""
    names = [f"fp{k}" for k in range(len(masks[0]))]
    keys = [F.xxhash64(F.lit(k), *[F.col(n).bitwiseAND(F.lit(_signed(m))) for n, m in zip(names, mask, strict=True)]) for k, mask in enumerate(masks)]
    return distinct.select("node", *names, F.explode(F.array(*keys)).alias("cell")).select("cell", "node", *names)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray | int, j: np.ndarray, bits: int) -> np.ndarray:
    """Whether rows i and j are at most ``bits`` apart: discarded by the largest difference of their
    distances in the table, if there is one, then verified."""
    found = np.ones(len(j), bool)
    if table.shape[1]:
        found = np.abs(table[i].astype(np.int16) - table[j].astype(np.int16)).max(-1) <= bits
    at = np.flatnonzero(found)
    found[at] = _apart(fps[i if np.isscalar(i) else i[at]], fps[j[at]]) <= bits
    return found


def components_within(fps: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The smallest index linked with each fingerprint of one cell (uint64, a row each)."""
    free = np.arange(1, len(fps))
    label = np.arange(len(fps))
    for seed in range(len(fps)):
        if label[seed] != seed or not len(free):
            continue
        free = free[free != seed]
        front = [seed]
        while front and len(free):
            hit = near(fps, table, front.pop(), free, bits)
            own = free[hit]
            label[own] = seed
            front += own.tolist()
            free = free[~hit]
    return label


def links(celled: DataFrame, bits: int) -> DataFrame:
    """Star edges (a, b) between nodes of (cell, node, fp0, ..., t0, ...).

    The stars have the components of all pairs at most ``bits`` apart that share a cell.
    """
    prints = [x for x in celled.columns if x.startswith("fp")]
    tables = [x for x in celled.columns if x.startswith("t")]
    columns = ["cell", "node", *prints, *tables]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros((0, len(columns)), np.int64)
        for batch in _then_none(batches):
            if batch is not None:
                keep = np.concatenate([keep, np.stack([batch.column(x).to_numpy() for x in columns], 1)])
            if not len(keep):
                continue
            edges = np.flatnonzero(np.append(True, np.diff(keep[:, 0]) != 0))
            done = len(keep) if batch is None else int(edges[-1])  # the last cell may go on
            fps = np.ascontiguousarray(keep[:done, 2 : 2 + len(prints)]).view(U)
            table = np.ascontiguousarray(keep[:done, 2 + len(prints) :]).view(np.uint8)
            a, b = _stars(keep[:done, 1], fps, table, edges[edges < done], bits)
            keep = keep[done:]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    # cells of one fingerprint link nothing and don't go to Python
    own = Window.partitionBy("cell").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = celled.withColumn("_n", F.count("*").over(own)).where("_n > 1").select(*columns)
    return shipped(shared).mapInArrow(run, "a long, b long").distinct()


def _then_none(items):
    yield from items
    yield None


def _stars(nodes: np.ndarray, fps: np.ndarray, table: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    end = len(nodes)
    sizes = np.diff(np.append(starts, end))
    cell = np.repeat(np.arange(len(sizes)), sizes)
    hit = sizes > SMALL
    left = np.flatnonzero(sizes[cell] <= SMALL)
    for step in range(1, SMALL):  # pairs of small cells, by how far apart they stand
        left = left[left + step < end]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            break
        hit[cell[left[near(fps, table, left, left + step, bits)]]] = True
    tails, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(hit):
        own = slice(starts[k], starts[k] + sizes[k])
        label = components_within(fps[own], table[own], bits)
        at = np.flatnonzero(label != np.arange(len(label)))
        tails.append(nodes[own][label[at]])
        heads.append(nodes[own][at])
    return np.concatenate(tails), np.concatenate(heads)


def sets_of(docs: DataFrame, keys: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """(node, shingles, n) of at least the rows with one of ``keys`` (key); a node is there once.

    The sets are made anew from the texts; a filter of fixed size finds the rows, so that hardly
    another text or set is dealt.
    """
    marks = keys.select(F.pmod("key", F.lit(PLACES)).alias("at"))
    filled = marks.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    places = np.zeros(PLACES // 64, np.int64)
    places[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(places.view(U))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("key").to_numpy() % PLACES
            batch = batch.filter(pa.array((held.value[at // 64] >> (at % 64).astype(U)) & U(1) == U(1)))
            for some in parts([batch], "text"):
                sets = [np.unique(shingles(x, words)) for x in texts_of(some, "text")]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in sets], pa.int64()), own], names=["node", "shingles"])

    found = shipped(_keyed(docs, id_column, text_column)).mapInArrow(make, "node long, shingles array<long>")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles")).withColumn("n", F.size("shingles"))


def alike(shared: Column, n: Column, m: Column, similarity: float) -> Column:
    return (1 + similarity) * shared >= similarity * (n + m) - 1e-9


def with_first(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(root, node, shingles, n, alike) of (root, node, shingles, n): whether a node's set is alike its root's.

    The root's own set meets the others in blocks, so that a large component is many tasks.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    first = members.where("node = root").join(sizes, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("shingles").alias("own"), F.col("n").alias("m"))
    dealt = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    both = dealt.join(first, ["root", "block"])
    same = alike(F.size(F.array_intersect("shingles", "own")), F.col("n"), F.col("m"), similarity)
    return both.select("root", "node", "shingles", "n", ((F.col("node") == F.col("root")) | same).alias("alike"))


def others(members: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Star edges (a, b) between each node of (root, node, shingles, n, alike) that isn't alike and all of its root's.

    Blocks of what isn't alike meet blocks of all, as many as a root has.
    """
    each = lambda x: F.greatest(F.lit(1), F.ceil(x / block)).cast("int")
    sizes = members.groupBy("root").agg(each(F.count_if(~F.col("alike"))).alias("tall"), each(F.count("*")).alias("wide"), F.count_if(~F.col("alike")).alias("open"))
    dealt = members.join(sizes.where("open > 0").drop("open"), "root")
    place = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    cells = dealt.select("root", "node", "shingles", "alike", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("i"), place("wide").alias("j"))
    asking = dealt.where(~F.col("alike")).select("root", "node", "shingles", "alike", F.lit(True).alias("asks"), place("tall").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"))
    dealt = cells.unionByName(asking).select(F.xxhash64("root", "i", "j").alias("part"), "node", "shingles", "alike", "asks")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[pa.RecordBatch] = []
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                keep.append(batch)
            if not keep or batch is not None and not batch.num_rows:
                continue
            table = pa.Table.from_batches(keep).combine_chunks()
            part = table.column("part").to_numpy()
            edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            done = len(part) if batch is None else int(edges[-1])  # the last part may go on
            tails, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
                if high <= done:
                    some = table.slice(low, high - low)
                    lists = some.column("shingles").combine_chunks()
                    offsets = lists.offsets.to_numpy()
                    a, b = _linked(some.column("node").to_numpy(), lists.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets), some.column("alike").to_numpy(), some.column("asks").to_numpy(), similarity)
                    tails.append(a)
                    heads.append(b)
            keep = table.slice(done).to_batches() if done < len(part) else []
            if sum(map(len, tails)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tails)), pa.array(np.concatenate(heads))], names=["a", "b"])

    return shipped(dealt.repartition("part").sortWithinPartitions("part", "asks", "node")).mapInArrow(link, "a long, b long").distinct()


def _linked(nodes: np.ndarray, values: np.ndarray, sizes: np.ndarray, is_alike: np.ndarray, asks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """An edge from every asking set to one alike set and to each other set that it is linked with.

    values: the sets one after the other, of these sizes. The alike sets are one component already.
    """
    have = np.flatnonzero(~asks)
    tails, heads = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    distinct, what = np.unique(values, return_inverse=True)
    own = np.split(what, np.cumsum(sizes)[:-1])
    place = np.full(len(nodes), -1)
    place[have] = np.arange(len(have))
    owner = place[np.repeat(np.arange(len(nodes)), sizes)]
    what, owner = what[owner >= 0], owner[owner >= 0]
    mark = np.zeros(len(distinct), bool)
    n = sizes[have]
    for i in np.flatnonzero(asks).tolist():
        mark[own[i]] = True
        shared = np.bincount(owner, mark[what], len(have))
        mark[own[i]] = False
        hit = have[(1 + similarity) * shared >= similarity * (n + sizes[i]) - 1e-9]
        one = hit[is_alike[hit]][:1]
        hit = np.concatenate([one, hit[~is_alike[hit]]])
        hit = hit[nodes[hit] != nodes[i]]
        tails.append(np.repeat(nodes[i], len(hit)))
        heads.append(nodes[hit])
    return np.concatenate(tails), np.concatenate(heads)


def verified(docs: DataFrame, distinct: DataFrame, roots: DataFrame, similarity: float, id_column: str, text_column: str, words: int, block: int = BLOCK) -> DataFrame:
    """Star edges (a, b) whose components are those of all pairs with this Jaccard similarity in a component of candidates.

    distinct: (node, key), the key of one row of each node. roots: (node, root) of the candidates.
    """
    inside = roots.select("root").distinct().select("root", F.col("root").alias("node")).unionByName(roots.select("root", "node"))
    keys = inside.select("node").distinct().join(distinct, "node").select("key")
    members = inside.join(sets_of(docs, keys, id_column, text_column, words), "node")
    known = cut(with_first(cut(members.select("root", "node", "shingles", "n")), similarity, block))
    star = known.where("alike AND node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return star.unionByName(others(known, similarity, block))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node with an edge but the root itself.

    Alternating star contraction: each round hangs larger neighbours on the smallest one, then
    smaller ones; the depth halves, so rounds grow with the logarithm of a component's diameter,
    and go on until nothing changes. Every round is written to the shared folder, the one before
    it is deleted.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, edges = edges, cut(hung.select("e.a", "e.b").where("a <> b").distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, similarity: float | None = 0.8, bits: int | None = None) -> DataFrame:
    """Per row of ``docs``: id, key, fingerprint (16 hex digits a lane), component_id, component.

    bits: link 64-bit fingerprints at most so many bits apart, all of them. Else similarity: link
    texts with at least this Jaccard similarity of their sets of shingles, compared exactly; the
    cells of LANES lanes find a pair at the similarity itself with a chance of 0.999. component_id
    is the smallest non-null id reachable (null only if all are), component its name. A null or
    empty text has fingerprint zero and links like any other; repeated rows give repeated results
    and have one key; other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    lanes = 1 if bits is not None else LANES
    names = [f"fp{k}" for k in range(lanes)]
    found = cut(fingerprints(docs, id_column, text_column, words, lanes, sets=bits is None))
    distinct = found.groupBy("node").agg(F.min("id").alias("least"), F.min("key").alias("key"), *[F.first(x).alias(x) for x in names])
    if bits is not None:
        edges = links(celled(cut(pivot_table(distinct)), bits), bits)
    else:
        distinct = cut(distinct)
        masks = sampled_bands(distinct.count(), similarity, lanes)
        roots = components(links(sampled(distinct, masks), wide_bits(similarity, lanes)))
        edges = verified(docs, distinct.select("node", "key"), roots, similarity, id_column, text_column, words)
    roots = components(edges)
    named = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.select("node", "root").join(ids, "root")
    return found.join(known, "node").select(
        F.col("id").alias(id_column), "key",
        F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in names])).alias("fingerprint"),
        "component_id", F.col("root").alias("component"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the smallest id, once.

    Among rows that share that id (or all lack one) the smallest key stays; of repeated rows one.
    """
    found = near_duplicates(docs, id_column, text_column, **options)
    first = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("key").alias("key")))
    stay = found.groupBy("component").agg(first.alias("own")).select(F.col("own.key").alias("_key"), F.col("own.id").alias("_id"))
    name = free("_row_key", docs)
    keyed = docs.withColumn(name, row_key(id_column, text_column))
    same = (keyed[name] == stay["_key"]) & keyed[id_column].cast("long").eqNullSafe(stay["_id"])
    return keyed.join(stay, same).select(*[keyed[c] for c in keyed.columns]).dropDuplicates([name]).select(*docs.columns)

"""Exact n-gram Jaccard join with signature trees.

Two documents link when the Jaccard similarity of their shingle sets reaches
``numerator / denominator``.  No link is lost:

1. Equal sets are one class, represented by its smallest id.
2. Sets whose sizes can link differ in at most ``k`` shingles, with ``k`` known from the
   size band.  The hash range is cut into more than ``k`` parts, so two linked sets agree
   in at least one whole part.  The hashes of the parts are the keys by which sets meet.
   Some parts more let every set leave out that many keys, those of its first empty parts,
   by which sets would meet that have nothing in common.  Keys with the same members are
   one group.
3. In groups of several blocks (over ``BLOCK_SETS`` and ``SMALL_GROUP`` sets) every set is
   compared with the smallest one.  Groups whose members thereby are one component are done,
   and only sets outside the component of the smallest one are copied to several blocks.
4. In all groups left signature trees find the pairs: a node holds the OR-combined bitmaps
   of its sets, their range of sizes and their label if it is one.  Two trees are descended
   together; a pair of nodes is left when the largest overlap that its bitmaps and sizes
   allow is too small, or when both have one and the same label.  Sets of a pair take one
   label, so that a group gives fewer pairs than it has sets, whatever the number of
   its pairs.
5. Sets connected by these pairs are a cluster; linked sets are in one.  The texts of a
   cluster meet once, and a tree over finer bitmaps finds its links on whole texts.
6. Clusters over ``CLUSTER_SHINGLES`` shingles do not meet in one task: their groups are
   searched again with finer bitmaps, first for pairs that connect, which are checked on
   whole texts, then for all pairs that are not connected by links so far.

A null or blank text has an empty set and links with nothing.  Rows that repeat an id are
one document with several sets; rows without an id keep a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.components import components
from lexweave.llm.shingles import WordHasher, mix, shingle_sets
from lexweave.llm.tables import bounded_batches, partitions
from lexweave.operators.rows import small_side
from lexweave.storage import materialize

BAND_RATIO = 1.5
BLOCK_SETS = 1024
SMALL_GROUP = 8
FAN_OUT = 8
CHUNK_SHINGLES = 500_000
CLUSTER_SHINGLES = 4_000_000
# Bits for a shingle in the bitmaps of groups, while a bitmap stays within ``GROUP_WIDTH`` bits.
GROUP_BITS = 2
GROUP_WIDTH = 2048
# Bits for a shingle in the bitmaps of clusters, and bytes of all bitmaps of one.
FINE_BITS = 8
CLUSTER_BYTES = 1 << 26
# Labels that a task holds.
HELD_LABELS = 1 << 20
BATCH_KEYS = 1 << 15
# The trees of a group that a row belongs to.
HOME, OUT, BOTH = 0, 1, 2


class Bands:
    """Size bands, each with the number of parts its sets are cut into."""

    def __init__(self, numerator: int, denominator: int):
        self.p, self.q = numerator, denominator
        ratio = max(BAND_RATIO, 1.05 * denominator / numerator)
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * ratio))))
        self.lows = np.array(lows, np.int64)

    def differences(self, total: int) -> int:
        """Most shingles in which two linked sets of this total size differ."""
        return (self.q - self.p) * total // (self.q + self.p)

    def of(self, n: int) -> list[int]:
        """The bands in which a set of this size can meet a different set."""
        if not self.differences(n + n * self.q // self.p):
            return []
        own = int(np.searchsorted(self.lows, n, side="right")) - 1
        return [own] + ([own + 1] if n * self.q // self.p >= self.lows[own + 1] else [])

    def parts(self, band: int) -> tuple[int, int]:
        """(number of parts, how many of them two linked sets share at least, less one).

        The latter is what the smallest sets of the band are expected to leave empty, and two
        standard deviations."""
        k = self.differences(2 * (int(self.lows[band + 1]) - 1))
        smallest = int(self.lows[band]) * self.p // self.q
        empty = (k + 1) * np.exp(-smallest / (k + 1))
        spare = max(1 if k < 8 else 2, int(np.ceil(empty + 2 * np.sqrt(empty))))
        return k + 1 + spare, spare


def part_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a sorted set: one for each part but its first ``spare`` empty ones.

    Linked sets share more than ``spare`` parts. With all empty parts in one order before all
    others, the last part that two sets share is none of the first ``spare`` of either.
    """
    keys = []
    sums = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mix(found + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    for band in bands.of(len(found)):
        parts, spare = bands.parts(band)
        edges = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
        at = np.concatenate(([0], np.searchsorted(found, edges), [len(found)]))
        names = mix((np.uint64(band) << np.uint64(40)) + np.arange(parts, dtype=np.uint64))
        some = np.ones(parts, bool)
        some[np.flatnonzero(at[1:] == at[:-1])[:spare]] = False
        keys.append(mix((sums[at[1:]] - sums[at[:-1]]) ^ names)[some])
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def bitmap(found: np.ndarray, width: int = 0) -> bytes:
    """Bits at the low end of each hash: ``width`` of them, or ``GROUP_BITS`` for each shingle,
    and at least one where that is more than ``GROUP_WIDTH``."""
    least = max(64, 1 << (len(found) - 1).bit_length())
    width = width or max(least, min(GROUP_BITS * least, GROUP_WIDTH))
    bits = np.zeros(width, bool)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def set_name(found: np.ndarray) -> tuple[int, int]:
    """128 bits that, with the size, stand for a set."""
    halves = (mix(found ^ np.uint64(s)).sum(dtype=np.uint64) for s in (0xA5A5A5A5, 0x5A5A5A5A5A))
    return tuple(int(h.astype(np.int64)) for h in halves)


def _features(batches, size: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        n, first, second, bits = [], [], [], []
        for found in shingle_sets(batch.column("text"), size, hasher):
            h1, h2 = set_name(found)
            n.append(len(found))
            first.append(h1)
            second.append(h2)
            bits.append(bitmap(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n, pa.int64()),
                pa.array(first, pa.int64()),
                pa.array(second, pa.int64()),
                pa.array(bits, pa.binary()),
            ],
            names=["doc_id", "n", "h1", "h2", "bits"],
        )


def _keys(batches, size: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """(key, node) for every part key of every text, some ``BATCH_KEYS`` at a time."""
    hasher = WordHasher()
    nodes, keys, held = [], [], 0

    def rows():
        repeats = [len(k) for k in keys]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(keys).view(np.int64)),
                pa.array(np.repeat(np.array(nodes, np.int64), repeats)),
            ],
            names=["key", "node"],
        )

    for batch in batches:
        sets = shingle_sets(batch.column("text"), size, hasher)
        for node, found in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
            nodes.append(node)
            keys.append(part_keys(found, bands))
            held += len(keys[-1])
            if held >= BATCH_KEYS:
                yield rows()
                nodes, keys, held = [], [], 0
    if held:
        yield rows()


def _key_groups(docs: DataFrame, sets: DataFrame, reps: DataFrame, size: int, bands: Bands):
    """(key, node, rep, g) of sets that meet, written; ``rep`` is the smallest node of a group
    and ``g`` its size.

    Keys are taken from the texts once more instead of being kept with the sets, so that
    the exchange by key is the one place they are written.  Groups of the same members
    take the name of their members, which leaves one of them.
    """
    copies = small_side(
        sets.where("doc_id is not null")
        .select("doc_id")
        .distinct()
        .join(reps.select(F.col("node").alias("doc_id")), "doc_id", "left_anti"),
        "copies",
        200_000,
    )
    keys = _keys
    keyed = (
        docs.where("doc_id is not null")
        .join(copies, "doc_id", "left_anti")
        .mapInArrow(lambda b: keys(b, size, bands), "key long, node long")
    )
    same_key = Window.partitionBy("key")
    return materialize(
        keyed.select(
            "node",
            F.min("node").over(same_key).alias("rep"),
            # Halves of the hashes, so that the sum of a group of any size holds.
            F.sum(F.shiftright(F.xxhash64("node"), 32)).over(same_key).alias("name"),
            F.count(F.lit(1)).over(same_key).alias("g"),
        )
        .where("g > 1")
        .select(
            F.xxhash64("rep", "name", "g").alias("key"),
            "node",
            "rep",
            "g",
        )
        .distinct(),
        "key-groups",
    )


class SignatureTree:
    """Levels of nodes over sets: OR-combined bitmaps, sizes, bitmap slack and labels."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack, label, label)]
        while len(self.levels[-1][1]) > FAN_OUT:
            b, low, high, s, first, last = self.levels[-1]
            at = np.arange(0, len(low), FAN_OUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(b, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(s, at),
                    np.minimum.reduceat(first, at),
                    np.maximum.reduceat(last, at),
                )
            )

    def relabel(self, label: np.ndarray) -> None:
        first = last = label
        for k, level in enumerate(self.levels):
            if k:
                at = np.arange(0, len(first), FAN_OUT)
                first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels[k] = (*level[:4], first, last)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, child) of all children one level below."""
        end = np.minimum((nodes + 1) * FAN_OUT, len(self.levels[level - 1][1]))
        count = end - nodes * FAN_OUT
        at = np.repeat(np.arange(len(nodes)), count)
        step = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, nodes[at] * FAN_OUT + step


def _possible(one, i, two, j, p: int, q: int) -> np.ndarray:
    """Which pairs of nodes may hold a link between sets of different labels."""
    bits, low, high, slack, first, last = (x[i] for x in one)
    bits2, low2, high2, slack2, first2, last2 = (x[j] for x in two)
    overlap = np.bitwise_count(bits & bits2).sum(axis=1, dtype=np.int64)
    overlap += np.minimum(slack, slack2)
    most = np.minimum(np.minimum(high, high2), overlap)
    alike = (first == last2) & (last == first2) & (first == last)
    return (most * (p + q) >= p * (low + low2)) & ~alike


def dual_traversal(a: SignatureTree, b: SignatureTree, p: int, q: int) -> Iterator[tuple]:
    """Blocks of leaf pairs (i, j) whose bitmaps and sizes allow a link.

    Of a tree with itself every pair is met once.  Labels may change between blocks."""
    top, other = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.meshgrid(
        np.arange(len(a.levels[top][1])), np.arange(len(b.levels[other][1])), indexing="ij"
    )
    stack = [(top, other, i.ravel(), j.ravel())]
    while stack:
        la, lb, i, j = stack.pop()
        if a is b and la == lb:
            i, j = i[i <= j], j[i <= j]
        step = max(1, (1 << 18) // max(1, a.levels[0][0].shape[1]))
        if len(i) > step:
            stack += [(la, lb, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
            continue
        open_pairs = _possible(a.levels[la], i, b.levels[lb], j, p, q)
        i, j = i[open_pairs], j[open_pairs]
        if not len(i):
            continue
        if la == lb == 0:
            yield i, j
        elif la >= lb:
            at, i = a.children(la, i)
            stack.append((la - 1, lb, i, j[at]))
        else:
            at, j = b.children(lb, j)
            stack.append((la, lb - 1, i[at], j))


def _tree(rows: list[tuple], width: int) -> tuple[SignatureTree, np.ndarray]:
    """Tree over (node, n, label, bits); bitmaps are folded to ``width`` bytes."""
    rows = sorted(rows, key=lambda r: (r[2], r[3][:8], r[1]))
    folded = np.zeros((len(rows), width // 8), np.uint64)
    for k, row in enumerate(rows):
        folded[k] = np.bitwise_or.reduce(
            np.frombuffer(row[3], np.uint64).reshape(-1, width // 8), axis=0
        )
    n = np.array([r[1] for r in rows], np.int64)
    label = np.array([r[2] for r in rows], np.int64)
    return SignatureTree(folded, n, label), np.array([r[0] for r in rows], np.int64)


def _trees(home: list[tuple], others: list[tuple], p: int, q: int) -> Iterator[tuple]:
    """Pairs of trees with the nodes of their leaves, between which all links are.

    A tree holds sets of one width of bitmaps.  Sets are folded only to meet those of half
    their width and a linking size: folded to the smallest of the group, bitmaps fill up and
    tell nothing.
    """
    alone = home == others
    own, rest = _by_width(home), _by_width(others)
    for w, left in own.items():
        for v, right in rest.items():
            if w == v:
                one = _tree(left, w)
                yield one + (one if alone else _tree(right, w))
            elif not alone or w < v:
                small, large = (left, right) if w < v else (right, left)
                most, least = max(r[1] for r in small) * q, min(r[1] for r in large) * p
                near = [r for r in small if r[1] * q >= least]
                far = [r for r in large if r[1] * p <= most]
                if near and far:
                    fold = min(w, v)
                    yield _tree(near if w < v else far, fold) + _tree(far if w < v else near, fold)


def _by_width(rows: list[tuple]) -> dict[int, list[tuple]]:
    widths = {}
    for row in rows:
        widths.setdefault(len(row[3]), []).append(row)
    return widths


def _pairs_of_group(home: list[tuple], others: list[tuple], p: int, q: int):
    for a, ids_a, b, ids_b in _trees(home, others, p, q):
        for i, j in dual_traversal(a, b, p, q):
            yield ids_a[i], ids_b[j]


class Labels:
    """Labels that became one, under the smallest of them."""

    def __init__(self):
        self.under: dict[int, int] = {}

    def of(self, label: int) -> int:
        passed = []
        while (over := self.under.get(label, label)) != label:
            passed.append(label)
            label = over
        for x in passed:
            self.under[x] = label
        return label

    def join(self, x: int, y: int) -> None:
        x, y = self.of(x), self.of(y)
        if x != y:
            self.under[max(x, y)] = min(x, y)

    def of_all(self, label: np.ndarray) -> np.ndarray:
        return np.array([self.of(x) for x in label.tolist()], np.int64)


def connecting(a: SignatureTree, b: SignatureTree, p: int, q: int, labels: Labels, links=None):
    """Blocks of leaf pairs (i, j), one for each two labels that they make one.

    All pairs that the bitmaps allow, and ``links`` if given, are connected by those found.
    """
    names_a, names_b = a.levels[0][4], b.levels[0][4]
    a.relabel(labels.of_all(names_a))
    if b is not a:
        b.relabel(labels.of_all(names_b))
    for i, j in dual_traversal(a, b, p, q):
        chosen = []
        named = zip(names_a[i].tolist(), names_b[j].tolist(), strict=True)
        for at, (x, y) in enumerate(named):
            if labels.of(x) != labels.of(y) and (links is None or links(i[at], j[at])):
                labels.join(x, y)
                chosen.append(at)
        if chosen:
            yield i[chosen], j[chosen]
            a.relabel(labels.of_all(names_a))
            if b is not a:
                b.relabel(labels.of_all(names_b))


def _connections(home: list[tuple], others: list[tuple], p: int, q: int, labels: Labels):
    for a, ids_a, b, ids_b in _trees(home, others, p, q):
        for i, j in connecting(a, b, p, q, labels):
            yield ids_a[i], ids_b[j]


def _traverse(batches, p: int, q: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each (key, gi, uj) group, every one or those that connect all;
    rows come sorted by group."""
    labels = Labels()

    def found(home, others):
        if every:
            pairs = _pairs_of_group(home, others, p, q)
        else:
            if len(labels.under) > HELD_LABELS:
                labels.under.clear()
            pairs = _connections(home, others, p, q, labels)
        for x, y in pairs:
            keep = x != y
            low, high = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    group, home, others = None, [], []
    for batch in batches:
        for key, gi, uj, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, gi, uj) != group:
                yield from found(home, others)
                group, home, others = (key, gi, uj), [], []
            if side != OUT:
                home.append(tuple(row))
            if side != HOME:
                others.append(tuple(row))
    yield from found(home, others)


def _cluster_links(batches, size: int, p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Links that connect all linked sets of a cluster; rows (cluster, node, label, text)
    come sorted by cluster."""
    hasher = WordHasher()

    def found(nodes, names, sets):
        longest = max((len(s) for s in sets), default=0)
        width = 1 << (max(8, longest) * FINE_BITS - 1).bit_length()
        while width > 64 and width // 8 * len(sets) > CLUSTER_BYTES:
            width //= 2
        rows = [
            (at, len(s), name, bitmap(s, width))
            for at, (name, s) in enumerate(zip(names, sets, strict=True))
            if len(s)
        ]
        if len(rows) < 2:
            return
        tree, place = _tree(rows, width // 8)

        def links(i, j):
            one, two = sets[place[i]], sets[place[j]]
            both = len(np.intersect1d(one, two, assume_unique=True))
            return both * (p + q) >= p * (len(one) + len(two))

        ids = np.array(nodes, np.int64)[place]
        for i, j in connecting(tree, tree, p, q, Labels(), links):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    cluster, nodes, names, sets = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cluster", "node", "label")]
        texts = shingle_sets(batch.column("text"), size, hasher)
        for of, node, label, shingles in zip(*columns, texts, strict=True):
            if of != cluster:
                yield from found(nodes, names, sets)
                cluster, nodes, names, sets = of, [], [], []
            nodes.append(node)
            names.append(label)
            sets.append(shingles)
    yield from found(nodes, names, sets)


def _fine(batches, size: int) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        n, bits = [], []
        for found in shingle_sets(batch.column("text"), size, hasher):
            n.append(len(found))
            width = 1 << (max(8, len(found)) * FINE_BITS - 1).bit_length()
            bits.append(bitmap(found, width) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(n, pa.int64()), pa.array(bits, pa.binary())],
            names=["node", "n", "bits"],
        )


def _checked(batches, size: int, p: int, q: int) -> Iterator[pa.RecordBatch]:
    """Pairs that link; rows (a, chunk, doc, text) come sorted with a's own texts first."""
    hasher = WordHasher()
    group, own = None, []
    for batch in batches:
        a, chunk, doc = (batch.column(c).to_pylist() for c in ("a", "chunk", "doc"))
        left, right = [], []
        sets = shingle_sets(batch.column("text"), size, hasher)
        for x, c, y, found in zip(a, chunk, doc, sets, strict=True):
            if (x, c) != group:
                group, own = (x, c), []
            if x == y:
                own.append(found)
                continue
            for mine in own:
                least = p * (len(mine) + len(found))
                if min(len(mine), len(found)) * (p + q) < least:
                    continue
                if len(np.intersect1d(mine, found, assume_unique=True)) * (p + q) >= least:
                    left.append(x)
                    right.append(y)
                    break
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
        )


def _verified(pairs: DataFrame, docs: DataFrame, sizes: DataFrame, size: int, p: int, q: int):
    """The pairs (a, b) whose whole texts link, written.  A hot ``a`` is cut into chunks."""
    spark = docs.sparkSession
    sized = pairs.join(
        sizes.groupBy(F.col("node").alias("b")).agg(F.max("n").alias("n")), "b"
    )
    chunks = sized.groupBy("a").agg(
        F.ceil(F.sum("n") / F.lit(CHUNK_SHINGLES)).cast("long").alias("chunks")
    )
    dealt = pairs.join(chunks, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("doc")
    )
    dealt = materialize(
        dealt.unionByName(dealt.select("a", "chunk", F.col("a").alias("doc")).distinct()),
        "pairs-to-check",
    )
    wanted = small_side(dealt.select(F.col("doc").alias("doc_id")).distinct(), "texts", 200_000)
    texts = docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "text")
    rows = (
        dealt.join(texts, "doc")
        .select("a", "chunk", "doc", "text")
        .repartition(partitions(spark), "a", "chunk")
        .sortWithinPartitions("a", "chunk", F.col("doc") != F.col("a"))
    )
    check = _checked
    return materialize(
        rows.mapInArrow(lambda b: check(b, size, p, q), "a long, b long").distinct(), "links"
    )


def _tree_pairs(rows: DataFrame, reps: DataFrame, p: int, q: int, every: bool) -> DataFrame:
    """Pairs (a, b) that the trees leave, every one or those that connect all; ``rows`` are
    (key, gi, uj, side, node), and ``side`` says which of the two trees of a group
    (key, gi, uj) hold a row.  Labels come with the bitmaps of ``reps``."""
    groups = (
        rows.join(reps.select("node", "n", "label", "bits"), "node")
        .select("key", "gi", "uj", "side", "node", "n", "label", "bits")
        .repartition(partitions(rows.sparkSession), "key", "gi", "uj")
        .sortWithinPartitions("key", "gi", "uj")
    )
    traverse = _traverse
    return groups.mapInArrow(lambda b: traverse(b, p, q, every), "a long, b long").distinct()


def _blocks(sets: str) -> Column:
    return F.ceil(F.col(sets) / F.lit(BLOCK_SETS)).cast("long")


def _each_block(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def _has_star() -> Column:
    return F.col("g") > max(SMALL_GROUP, BLOCK_SETS)


def _star_pairs(members: DataFrame, reps: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of the smallest set of a group of several blocks with its other sets."""
    large = members.where(_has_star())
    first = F.lit(0).cast("long").alias("uj")
    home = large.where("node <> rep").select(
        "key",
        F.pmod(F.xxhash64("node"), _blocks("g")).alias("gi"),
        first, F.lit(HOME).alias("side"), "node",
    )
    smallest = large.where("node = rep").select(
        "key", _each_block(_blocks("g")).alias("gi"), first, F.lit(OUT).alias("side"), "node"
    )
    reps = reps.withColumn("label", F.col("node"))
    return _tree_pairs(home.unionByName(smallest), reps, p, q, every=True)


def _remaining_pairs(
    members: DataFrame, labels: DataFrame, reps: DataFrame, p: int, q: int, every: bool
) -> DataFrame:
    """Pairs of sets in one group that have different labels and were not compared with the
    smallest one, every pair or those that connect all."""
    rest = members.where(~_has_star() | (F.col("node") != F.col("rep")))
    # Few sets have a label, and rows of a group are many: labels are joined to the sets, once
    # each, and to the rows of groups of several blocks.
    marked = (
        rest.join(labels, "node")
        .groupBy("key")
        .agg(F.count("*").alias("marked"), F.min("label").alias("low"), F.max("label").alias("high"))
    )
    several = (
        rest.groupBy("key")
        .agg(F.count("*").alias("g"))
        .where("g > 1")
        .join(marked, "key", "left")
        .where("marked is null or marked < g or low <> high")
        .select("key", "g")
    )
    open_rows = materialize(
        rest.drop("g").join(several, "key").select("key", "rep", "node", "g"), "open-groups"
    )
    # Where one block holds the group, a row travels once for both trees.
    whole = F.col("g") <= BLOCK_SETS
    zero = F.lit(0).cast("long")
    one_block = open_rows.where(whole).select(
        "key",
        zero.alias("gi"),
        zero.alias("uj"),
        F.lit(BOTH).alias("side"),
        "node",
    )
    of_rep = labels.select(F.col("node").alias("rep"), F.col("label").alias("main"))
    # Written, as it is read three times.
    blocks = materialize(
        open_rows.where(~whole)
        .join(labels, "node", "left")
        .join(of_rep, "rep", "left")
        .select(
            "key",
            "node",
            "g",
            (F.coalesce("label", "node") != F.coalesce("main", "rep")).alias("is_out"),
        ),
        "open-blocks",
    )
    outside = blocks.where("is_out").groupBy("key").agg(F.count("*").alias("u"))
    sized, block = blocks.join(outside, "key"), F.xxhash64("node")
    home = sized.select(
        "key",
        F.pmod(block, _blocks("g")).alias("gi"),
        _each_block(_blocks("u")).alias("uj"),
        F.lit(HOME).alias("side"),
        "node",
    )
    others = sized.where("is_out").select(
        "key",
        _each_block(_blocks("g")).alias("gi"),
        F.pmod(block, _blocks("u")).alias("uj"),
        F.lit(OUT).alias("side"),
        "node",
    )
    reps = reps.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return _tree_pairs(one_block.unionByName(home).unionByName(others), reps, p, q, every)


def _links_in_clusters(
    docs: DataFrame, members: DataFrame, named: DataFrame, labels: DataFrame,
    sizes: DataFrame, size: int, p: int, q: int,
) -> DataFrame:
    """Links (a, b) that connect all linked sets; ``named`` has the cluster of a node."""
    of = F.col("cluster")
    rows = (
        named.select("node", F.col("label").alias("cluster"))
        .join(labels, "node", "left")
        .select("node", "cluster", F.coalesce("label", "node").alias("label"))
        .join(sizes.groupBy("node").agg(F.sum("n").alias("n")), "node")
    )
    clusters = rows.groupBy("cluster").agg(
        F.sum("n").alias("total"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    rows = materialize(
        rows.join(clusters.where("low <> high"), "cluster").select(
            "cluster", "node", "label", (F.col("total") > CLUSTER_SHINGLES).alias("large")
        ),
        "clusters",
    )
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    small = small_side(rows.where("not large").select("cluster", "node", "label"), "small", 200_000)
    met = (
        texts.join(small, "node")
        .select("cluster", "node", "label", "text")
        .repartition(partitions(docs.sparkSession), of)
        .sortWithinPartitions(of)
    )
    search = _cluster_links
    links = materialize(
        met.mapInArrow(lambda b: search(b, size, p, q), "a long, b long"), "cluster-links"
    )
    large = rows.where("large").select("node")
    if large.isEmpty():
        return links
    fine = _fine
    wanted = small_side(large, "large", 200_000)
    reps = materialize(
        texts.join(wanted, "node", "left_semi").mapInArrow(
            lambda b: fine(b, size), "node long, n long, bits binary"
        ),
        "fine-bitmaps",
    ).where("n > 0")
    members = materialize(members.join(wanted, "node", "left_semi"), "large-clusters")
    pairs = materialize(_remaining_pairs(members, labels, reps, p, q, False), "connections")
    more = _verified(pairs, docs, sizes, size, p, q)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    pairs = materialize(_remaining_pairs(members, labels, reps, p, q, True), "pairs")
    return links.unionByName(more).unionByName(_verified(pairs, docs, sizes, size, p, q))


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    numerator: int = 90,
    denominator: int = 100,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    bounded_batches(df.sparkSession)
    bands, p, q = Bands(numerator, denominator), numerator, denominator
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = _features
    sets = materialize(
        docs.mapInArrow(
            lambda b: features(b, size), "doc_id long, n long, h1 long, h2 long, bits binary"
        ),
        "shingle-sets",
    )
    reps = materialize(
        sets.where("n > 0 and doc_id is not null")
        .groupBy("n", "h1", "h2")
        .agg(F.min("doc_id").alias("node"), F.min_by("bits", "doc_id").alias("bits")),
        "classes",
    )
    members = _key_groups(docs, sets, reps, size, bands)
    sizes = reps.select("node", "n")
    star = materialize(_star_pairs(members, reps, p, q), "pairs-with-smallest")
    links = star if star.isEmpty() else _verified(star, docs, sizes, size, p, q)
    labels = components(links)
    pairs = materialize(_remaining_pairs(members, labels, reps, p, q, False), "connections")
    if not pairs.isEmpty():
        named = components(links.unionByName(pairs))
        more = _links_in_clusters(docs, members, named, labels, sizes, size, p, q)
        labels = components(links.unionByName(more))
    named = (
        reps.select("n", "h1", "h2", "node")
        .join(labels, "node", "left")
        .select("n", "h1", "h2", F.coalesce("label", "node").alias("component_id"))
    )
    return sets.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias(
            "component_id"
        ),
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """One document of each component stays, the one with the smallest id."""
    found = jaccard_components(df, id_col, **settings)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    # A row travels as a struct, so that its columns' names meet no others.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("own"),
    )
    return rows.join(gone, F.col("own") == F.col("gone"), "left_anti").select("row.*")

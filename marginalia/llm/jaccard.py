"""Components of documents whose shingle sets have a high Jaccard similarity, found with signature trees.

A set's signature is a bitmap of its shingles' digests. A signature tree joins near sets under nodes that hold the OR of their
signatures and the range of their sizes; two trees, or one with itself, are walked together, and a pair of
nodes is left when the largest overlap its members could have is less than their sizes ask for.

Which sets meet in a tree is settled without loss: two sets that link differ in few shingles, so of enough
parts of the digest space one holds the same shingles of both. Sets are joined by the content of their parts, and
the components of that are the groups for which trees are built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.ordering import top_k
from marginalia.llm.components import components
from marginalia.llm.idfilter import Bitmaps, digests_in, id_bitmap, maybe_in, slot_columns, slots_in
from marginalia.llm.registry import query, table
from marginalia.llm.textbytes import chunks, flat, lower, mixed, prefix, stretch_digests, words
from marginalia.session import cut_lineage

WIDTH = 3
PERCENT = 90
LEAST_PERCENT = 60
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
SKETCH_BITS = 256  # at least, of the signatures that go to every part a set shares
SKETCHED_SETS = 256  # sets in a part that are compared by signature before they are grouped
PART_BYTES = 1 << 19  # of text whose parts are worked out at once
PIVOTS = 8
FAN_OUT = 4
_GROWTH = 1.6


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct shingles of every text, ascending, and where each text's begin (n + 1 places)."""
    data, offsets = flat(column)
    data, n = lower(data), len(offsets) - 1
    starts, ends, cut = words(data, offsets)
    digest = stretch_digests(prefix(data), starts, ends)
    count = np.diff(cut)
    row = np.repeat(np.arange(n), count)
    m = len(digest) - width + 1
    keys, rows = [], []
    if m > 0:
        key = digest[:m].copy()
        for k in range(1, width):
            key = mixed(key) + digest[k : m + k]
        inside = row[:m] == row[width - 1 :]
        keys.append(mixed(key[inside]))
        rows.append(row[:m][inside])
    for length in range(1, width):
        short = np.flatnonzero(count == length)
        key = np.full(len(short), length, np.uint64)
        for k in range(length):
            key = mixed(key) + digest[cut[short] + k]
        keys.append(mixed(key))
        rows.append(short)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    if len(key):
        first = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
        key, row = key[first], row[first]
    return key, np.searchsorted(row, np.arange(n + 1))


class Parts:
    """Digests of the parts of sets, such that two sets that link have one in common.

    If the smaller set of a linked pair has a shingles, the two differ in a · (100 - percent) / percent at most. Sizes are dealt into
    classes; a class splits the digest space into more parts than its sets may differ in. A set stands in its own class and in
    those below that a smaller partner may be in.

    A part that is empty in both says little. A class has some parts to spare, so that sets with no more holes than
    that agree in a part that is none. A set with more holes also stands under each hole with the parts of a second split of all its
    shingles: sets that agree in a hole agree in one of these."""

    def __init__(self, percent: int = PERCENT):
        if percent < LEAST_PERCENT:
            raise ValueError(f"below {LEAST_PERCENT} % a set would stand under thousands of parts for each of its shingles")
        self.percent = percent
        self.lows = [1]
        self._counts: dict[int, tuple[int, int]] = {}

    def _class(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * _GROWTH)))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def count(self, number: int) -> tuple[int, int]:
        """Parts of a class and how many of them are to spare; no parts if the class links equal sets alone.

        Small sets leave many parts empty however many there are, so no more are to spare than the sets may differ in: any
        number is right, for a set with more holes stands under them too."""
        apart = (self.lows[number + 1] - 1) * (100 - self.percent) // self.percent
        if not apart:
            return 0, 0
        if number not in self._counts:
            spare = 0
            while True:  # more parts have more holes: as many to spare as the smallest sets of the class will hardly exceed
                parts = apart + 1 + spare
                holes = parts * (1 - 1 / parts) ** self.lows[number]
                more = min(int(np.ceil(holes + 2.5 * np.sqrt(holes))) if holes > 0.05 else 0, apart)
                if more <= spare:
                    break
                spare = more
            self._counts[number] = parts, spare
        return self._counts[number]

    def keys(self, held: np.ndarray) -> np.ndarray:
        size = len(held)
        top = self._class(size)
        out = []
        for number in range(self._class(-(-size * self.percent // 100)), top + 1):
            parts, spare = self.count(number)
            if parts:
                out.append(self._split(held, number, parts, spare))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _contents(self, held: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every part: the sum of its shingles' digests, each spread anew, and how many there are."""
        spread = mixed(held ^ np.uint64(seed))
        part = ((spread >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=parts)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(spread[order]))])
        ends = np.cumsum(count)
        return sums[ends] - sums[ends - count], count

    def _split(self, held: np.ndarray, number: int, parts: int, spare: int) -> np.ndarray:
        sums, count = self._contents(held, parts, 0x51F15EED)
        label = np.uint64(number) << np.uint64(40)
        at = np.arange(parts, dtype=np.uint64)
        key = mixed(sums + mixed(label + at))
        holes = np.flatnonzero(count == 0)
        out = [key[count > 0]]
        if len(holes) > spare:
            again, _ = self._contents(held, parts, 0x2C0FFEE)
            for hole in holes:
                out.append(mixed(again + mixed(mixed(label + at) + np.uint64(hole + 1))))
        return np.concatenate(out)


class Tree:
    """Levels of nodes over sets, leaves first; every level's arrays hold OR-combined signatures, least and largest size,
    and the most shingles that a member's signature hides behind others."""

    def __init__(self, signs: np.ndarray, sizes: np.ndarray, near: np.ndarray):
        self.order = np.lexsort((sizes, near))
        signs, sizes = signs[self.order], sizes[self.order]
        self.levels = [(signs, sizes, sizes, sizes - np.bitwise_count(signs).sum(1))]
        while len(self.levels[-1][0]) > 1:
            signs, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(signs), FAN_OUT)
            self.levels.append(
                (np.bitwise_or.reduceat(signs, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at))
            )


def signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A bitmap per set: the low bits of its digests, as rows of 64-bit words."""
    flags = np.zeros((len(sets), bits), bool)
    flags[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def sketch_bits(size: int) -> int:
    """How long a set's signature is: at most every fourth bit is set, so sets of any size can be told apart by it."""
    return max(SKETCH_BITS, 1 << (4 * size - 1).bit_length())


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A signature per set, each as long as the set asks for."""
    bits, out = [sketch_bits(len(s)) for s in sets], [b""] * len(sets)
    for length in set(bits):
        places = [k for k, b in enumerate(bits) if b == length]
        for k, sign in zip(places, signatures([sets[k] for k in places], length), strict=True):
            out[k] = sign.tobytes()
    return out


def folded(held: list[bytes]) -> np.ndarray:
    """Signatures of several lengths as rows of the least: a longer one's bits fall where that length puts them."""
    words = min(map(len, held)) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in held])


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that two sets of that many shingles together need to link."""
    return -(-percent * sizes // (100 + percent))


def _children(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    first = nodes * FAN_OUT
    count = np.minimum(first + FAN_OUT, below) - first
    return first, count


def dual_walk(left: Tree, right: Tree, left_part: np.ndarray, right_part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (places in the trees' orders) that may link and are in different components. Trees of one block may be the same object."""
    depth = max(len(left.levels), len(right.levels)) - 1
    same = left is right
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def level(tree: Tree, d: int) -> int:
        return min(d, len(tree.levels) - 1)

    def uniform(tree: Tree, part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = [(part, part)]
        for _ in tree.levels[1:]:
            a, b = out[-1]
            at = np.arange(0, len(a), FAN_OUT)
            out.append((np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)))
        return out

    parts_l, parts_r = uniform(left, left_part), uniform(right, right_part)
    for d in range(depth, -1, -1):
        a, b = level(left, d), level(right, d)
        signs_l, low_l, high_l, hidden_l = left.levels[a]
        signs_r, low_r, high_r, hidden_r = right.levels[b]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 4096):
            x, y = i[at : at + 4096], j[at : at + 4096]
            overlap = np.bitwise_count(signs_l[x] & signs_r[y]).sum(1).astype(np.int64) + np.minimum(hidden_l[x], hidden_r[y])
            overlap = np.minimum(overlap, np.minimum(high_l[x], high_r[y]))
            fits = (100 * high_l[x] >= percent * low_r[y]) & (100 * high_r[y] >= percent * low_l[x])
            one = (parts_l[a][0][x] == parts_l[a][1][x]) & (parts_r[b][0][y] == parts_r[b][1][y]) & (parts_l[a][0][x] == parts_r[b][0][y])
            keep[at : at + 4096] = fits & ~one & (overlap >= _needed(low_l[x] + low_r[y], percent))
        i, j = i[keep], j[keep]
        if d == 0 or not len(i):
            break
        # A shorter tree waits at its root until the other has come down to the same level.
        first_l, count_l = _children(i, len(left.levels[a - 1][0])) if level(left, d - 1) < a else (i, np.ones_like(i))
        first_r, count_r = _children(j, len(right.levels[b - 1][0])) if level(right, d - 1) < b else (j, np.ones_like(j))
        pairs = count_l * count_r
        base = np.repeat(np.arange(len(i)), pairs)
        k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = first_l[base] + k // count_r[base], first_r[base] + k % count_r[base]
        if same:
            i, j = i[i <= j], j[i <= j]
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


class Links:
    """Components of the sets of one task."""

    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        first = np.full(self.up.max() + 1, len(labels))
        np.minimum.at(first, self.up, np.arange(len(labels)))
        self.up = first[self.up]

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def all(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 · intersection >= percent · union, exactly."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link_block(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """For every set the place of the first set of its component. ``labels``: components known before.
    ``side``: None to join all sets with one another, or two kinds of sets of which only pairs of both are asked for."""
    bits = 64
    while bits < 2 * max(len(s) for s in sets) and bits < 1 << 15:
        bits *= 2
    links = Links(labels)
    places = [np.arange(len(sets))] if side is None else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    if any(not len(p) for p in places):
        return links.all()
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.array([s[0] for s in sets], np.uint64)  # sets that share their least digest are likely near
    signs = signatures(sets, bits)
    trees = [Tree(signs[p], sizes[p], least[p]) for p in places]
    ids = [p[t.order] for p, t in zip(places, trees, strict=True)]

    def join(x: int, y: int) -> None:
        a, b = links.root(x), links.root(y)
        if a != b and similar(sets[x], sets[y], percent):
            links.up[max(a, b)] = min(a, b)

    if side is None:  # neighbours first: whole branches are then one component, and pairs of them are left
        for x, y in zip(ids[0], ids[0][1:], strict=False):
            join(int(x), int(y))
    part = links.all()
    i, j = dual_walk(trees[0], trees[-1], part[ids[0]], part[ids[-1]], percent)
    for x, y in zip(ids[0][i].tolist(), ids[-1][j].tolist(), strict=True):
        join(x, y)
    return links.all()


def _set_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (a digest of the set; null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                digests, cuts = shingle_sets(batch.column("text"), width)
                nodes = [int(node_of(digests[a:b])) if b > a else None for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(cuts).astype(np.int64)), pa.array(nodes, pa.int64())],
                    ["doc_id", "n_shingles", "node"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, node bigint")


def _part_rows(
    docs: DataFrame, percent: int, width: int, asked: tuple[np.ndarray, np.ndarray] | None = None,
    copied: tuple[np.ndarray, np.ndarray] | None = None, of_copies: bool = True,
) -> DataFrame:
    """key, node: the parts of every set, once per batch for equal sets. ``asked``: bitmaps over the keys that matter and over the
    doc_id of one text of each set. ``copied``: bitmaps over doc_id, of the texts whose set others have too and of one text of each set; texts
    in both are taken, or (``of_copies`` false) those not in the first. Tasks look ids up themselves, so that a task has one Python worker."""
    wanted, firsts = asked or (None, None)
    ids, firsts = copied or (None, firsts)
    sent = docs.sparkSession.sparkContext.broadcast(Bitmaps(wanted, ids, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (wanted, ids, firsts) = Parts(percent), sent.value.held
        for whole in batches:
            seen: set[int] = set()
            for batch in chunks(whole, most=PART_BYTES):
                if ids is not None:
                    batch = batch.filter(pa.array(slots_in(ids, batch) == of_copies))
                if firsts is not None:
                    batch = batch.filter(pa.array(slots_in(firsts, batch)))
                digests, cuts = shingle_sets(batch.column("text"), width)
                nodes, keys = [], []
                for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    node = int(node_of(digests[a:b])) if b > a else None
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    keys.append(parts.keys(digests[a:b]))
                if not keys:
                    continue
                key, node = np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
                if wanted is not None:
                    some = digests_in(wanted, key)
                    key, node = key[some], node[some]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

    columns = slot_columns(F.col("doc_id")) if asked is not None or copied is not None else []
    return docs.select("text", *columns).mapInArrow(run, "key bigint, node bigint")


def node_of(held: np.ndarray) -> np.int64:
    """A digest of a whole set."""
    total = np.add.reduce(mixed(held ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64) + np.uint64(len(held))
    return mixed(np.array([total], np.uint64)).view(np.int64)[0]


def _sets_of(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                digests, cuts = shingle_sets(batch.column("text"), width)
                held = [digests[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                nodes = [int(node_of(h)) if len(h) else None for h in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], ["node", "held"]
                )

    return docs.select("text").mapInArrow(run, "node bigint, held binary")


def _sketches_of(docs: DataFrame, width: int, firsts: np.ndarray, asked: np.ndarray) -> DataFrame:
    """node, sketch, size of the texts in a bitmap over doc_id whose set is in one over digests of sets."""
    sent = docs.sparkSession.sparkContext.broadcast(Bitmaps(firsts, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nodes = sent.value.held
        for whole in batches:
            for batch in chunks(whole):
                batch = batch.filter(pa.array(slots_in(ids, batch)))
                digests, cuts = shingle_sets(batch.column("text"), width)
                held = [digests[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False) if b > a]
                node = np.array([node_of(h) for h in held], np.int64)
                some = np.flatnonzero(digests_in(nodes, node))
                held = [held[k] for k in some]
                if held:
                    columns = [node[some], sketches(held), [len(h) for h in held]]
                    types = (pa.int64(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["node", "sketch", "size"])

    return docs.select("text", *slot_columns(F.col("doc_id"))).mapInArrow(run, "node bigint, sketch binary, size bigint")


def _by_block(finish, columns: list[str]):
    """Runs ``finish`` over the rows of each block; rows come sorted by block, and a block may reach over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).to_pydict()
            sides = rows.get("side") or [None] * len(rows["node"])  # a set may stand on both, once on each
            at = sorted({key: k for k, key in enumerate(zip(rows["node"], sides, strict=True))}.values())
            return finish({c: [rows[c][k] for k in at] for c in columns})

        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if current is not None and block[a] != current:
                    yield out()
                    held = []
                current = block[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return run


def _forest(nodes: list[int], root: np.ndarray) -> pa.RecordBatch:
    ids, moved = np.array(nodes, np.int64), root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])


def _sketch_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join the sets of a block which may link as far as their signatures tell. ``rows``: block, node, sketch, size."""

    def finish(c: dict) -> pa.RecordBatch:
        signs = folded(c["sketch"])
        tree = Tree(signs, np.array(c["size"], np.int64), signs[:, 0])
        links = Links(np.arange(len(signs)))
        i, j = dual_walk(tree, tree, np.arange(len(signs)), np.arange(len(signs)), percent)
        for x, y in zip(tree.order[i].tolist(), tree.order[j].tolist(), strict=True):
            a, b = links.root(x), links.root(y)
            links.up[max(a, b)] = min(a, b)
        return _forest(c["node"], links.all())

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_by_block(finish, ["node", "sketch", "size"]), "a bigint, b bigint")


def _link_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between sets of one component of a block. ``rows``: block (a digest), node, label, side (null: all pairs), held."""

    def finish(c: dict) -> pa.RecordBatch:
        sets = [np.frombuffer(x, np.uint64) for x in c["held"]]
        side = None if c["side"][0] is None else np.array(c["side"])
        return _forest(c["node"], link_block(sets, np.array(c["label"], np.int64), side, percent))

    spread = rows.repartition("block").sortWithinPartitions("block")
    return spread.mapInArrow(_by_block(finish, ["node", "held", "label", "side"]), "a bigint, b bigint")


def candidate_edges(docs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """Edges (a, b) between digests of sets, such that sets that link are in one component. ``sets``: doc_id, node of all ``docs``.

    Equal parts gather sets, each once however many texts hold it. Parts with the same sets count once; their sets are joined where their signatures, walked as a
    tree, let them link. In parts of very many sets all are joined to the least.

    A set that one text holds has its parts once, and they are counted before they travel. Of a set with several texts one is read, but
    bitmaps let a few others pass: their parts are made distinct first, for a repeat would change the count and cancel in the sum."""
    first = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("_n"))
    firsts = id_bitmap(first, "doc_id")
    copied = id_bitmap(sets.join(first.filter("_n > 1").select("node"), "node"), "doc_id"), firsts
    parts = _part_rows(docs, percent, width, None, copied, False).unionAll(_part_rows(docs, percent, width, None, copied, True).distinct())
    shared = cut_lineage(
        parts.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n"), F.bit_xor("node").alias("x"))
        .filter("n > 1").groupBy("leader", "n", "x").agg(F.min("key").alias("key"))
    )
    # Two sets of a part are known by now. Parts with more are few: only their rows are dealt out once more.
    other = F.col("x").bitwiseXOR(F.col("leader"))
    two = shared.filter("n = 2").select(F.col("key").alias("block"), F.explode(F.array("leader", other)).alias("node"))
    more = shared.filter("n > 2").select("key", "leader", "n")
    rows = cut_lineage(_part_rows(docs, percent, width, (id_bitmap(more, "key", digest=True), firsts)).join(more, "key"))
    small = two.unionAll(rows.filter(F.col("n") <= SKETCHED_SETS).select(F.col("key").alias("block"), "node")).distinct()
    nodes = small.select("node").distinct()
    # Texts are read again for the sets that share a part; their rows alone are dealt out.
    signs = _sketches_of(docs, width, firsts, id_bitmap(nodes, "node", digest=True)).join(nodes, "node", "left_semi").dropDuplicates(["node"])
    edges = _sketch_blocks(small.join(signs, "node"), percent)
    star = rows.filter(F.col("n") > SKETCHED_SETS).select("leader", "node").distinct()
    low = star.groupBy("node").agg(F.min("leader").alias("low"))
    to_low = star.join(low, "node").select(F.col("leader").alias("a"), F.col("low").alias("b")).distinct()
    return edges.unionAll(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).unionAll(to_low).distinct()


def link_similar(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text): documents link when 100 · intersection >=
    percent · union of their sets of ``width``-word shingles (A-Z lower-cased), and component_id is the least doc_id reached by links.

    A text with fewer words is one shingle; null, empty and blank texts have none, link with nothing and are their own component, as is any row
    whose doc_id is null. Rows that repeat an id are documents each. An empty table gives none.

    Equal sets are one node from the start. A large group of near sets is dealt into blocks with some pivots (the sets that
    agree in most parts) in each, so well linked groups are joined by work in proportion to their size; what is then in more than one
    component is walked, block of the smaller components by block of all, so no link is lost."""
    sets = cut_lineage(_set_table(docs, width))
    near_edges = cut_lineage(candidate_edges(docs, sets, percent, width))
    groups = components(near_edges)

    # The sets of all nodes in groups: one document of each node is read again.
    found = sets.join(groups, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("label").alias("group"))
    popular = near_edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("met"))
    found = cut_lineage(found.join(popular, "node"))
    near = docs.select("doc_id", "text").filter(maybe_in(id_bitmap(found, "doc_id"), F.col("doc_id")))
    held = _sets_of(near, width).join(found, "node").dropDuplicates(["node"])
    size = found.groupBy("group").agg(F.count("*").alias("_n"), F.sum("size").alias("_s"))
    blocks = F.greatest(F.ceil(F.col("_n") / block_sets), F.ceil(F.col("_s") / BLOCK_SHINGLES))
    size = size.select("group", blocks.cast("bigint").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pivots = top_k(found.join(size.filter("blocks > 1"), "group"), ["group"], [F.col("met").desc(), F.col("node")], PIVOTS)
    placed = held.join(size, "group").join(pivots.select("node", F.lit(True).alias("_pivot")), "node", "left")
    all_blocks = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    placed = cut_lineage(
        placed.select("group", "node", "held", "size", "blocks", own.alias("own"), F.when(F.col("_pivot"), all_blocks).otherwise(F.array(own)).alias("at"))
    )
    rows = placed.select(
        F.explode("at").alias("k"), "group", "node", F.col("node").alias("label"), F.lit(None).cast("int").alias("side"), "held"
    ).select(F.xxhash64("group", "k").alias("block"), "node", "label", "side", "held")
    edges = cut_lineage(_link_blocks(rows, percent))
    labels = components(edges)

    # Groups of several blocks that are not one component yet: every smaller component's sets meet all blocks.
    large = placed.filter("blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held_by = large.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    main = top_k(held_by, ["group"], [F.col("n").desc(), F.col("label")], 1).select("group", F.col("label").alias("main"))
    minor = held_by.join(main, "group").filter("label <> main").groupBy("group", "main").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    minor = cut_lineage(
        minor.select("group", "main", F.greatest(F.ceil(F.col("_n") / block_sets), F.ceil(F.col("_s") / BLOCK_SHINGLES)).cast("bigint").alias("minors"))
    )
    if not minor.isEmpty():
        open_ = large.join(minor, "group")
        across = F.sequence(F.lit(0).cast("bigint"), F.col("minors") - 1)
        down = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
        every = open_.select("group", F.col("own").alias("v"), F.explode(across).alias("u"), "node", "label", F.lit(0).alias("side"), "held")
        some = open_.filter("label <> main").select(
            "group", F.explode(down).alias("v"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("minors")).alias("u"), "node", "label", F.lit(1).alias("side"), "held"
        )
        pairs = every.unionAll(some).select(F.xxhash64("group", "u", "v").alias("block"), "node", "label", "side", "held")
        edges = edges.unionAll(cut_lineage(_link_blocks(pairs, percent)))
        labels = components(edges)

    joined = sets.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("part")
    )
    first = joined.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("first"))
    return joined.join(first, "part", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id: one document of each group stays."""
    linked = cut_lineage(link_similar(docs, **options).select(F.col("doc_id").alias("_id"), (F.col("doc_id") != F.col("component_id")).alias("_gone")))
    gone = linked.filter("_gone")
    # A text whose id no document that stays has is gone; only those that may be either are dealt out.
    left = id_bitmap(linked.filter("_gone IS NOT TRUE"), "_id")
    marked = docs.withColumns({"_suspect": maybe_in(id_bitmap(gone, "_id"), F.col("doc_id")), "_left": maybe_in(left, F.col("doc_id"))})
    sure = marked.filter("not _suspect").drop("_suspect", "_left")
    rest = marked.filter("_suspect and _left").drop("_suspect", "_left").join(gone, F.col("doc_id") == F.col("_id"), "left_anti")
    return sure.unionAll(rest)


#: Over a relation ``documents``; also a stage of the pipeline. Components by least reachable id.
def jaccard_cte(name: str, percent: int = PERCENT, source: str = "documents") -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
{name}_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS ws FROM {source}),
{name}_sets AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM {name}_words)),
{name}_sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM {name}_sets GROUP BY doc_id),
{name}_links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM {name}_sets a JOIN {name}_sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN {name}_sizes na ON na.doc_id = a.doc_id JOIN {name}_sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {percent} * (na.n + nb.n - count(*))),
{name}_reach(a, b) AS (SELECT a, b FROM {name}_links UNION SELECT r.a, l.b FROM {name}_reach r JOIN {name}_links l ON r.b = l.a),
{name}_least AS (SELECT a AS doc_id, min(b) AS low FROM {name}_reach GROUP BY a)"""


JACCARD_SQL = f"""WITH RECURSIVE {jaccard_cte('jac')}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN jac_sizes USING (doc_id) LEFT JOIN jac_least USING (doc_id)"""


@query("op6_link_similar", JACCARD_SQL)
def op6_link_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_similar(table(spark, sf_dir, "documents"))

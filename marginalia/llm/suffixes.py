"""Removal of repeated strings with sorted suffixes: every byte in a 200-byte string that also starts elsewhere goes.

A string of ``span`` bytes holds an anchor: the place in it whose gram has the least digest. Equal strings have it
at the same offset, so a repeated string shows as two anchors with the same gram, whose surroundings
agree far enough to either side. Only the suffixes at such anchors (and, for what is before them, the
reversed prefixes) need sorting: a sparse suffix array over the repeated places of the corpus.

Sorting is deep-shallow: multikey quicksort down to a shallow depth, then a blind trie for each range of
suffixes that are still alike there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.idfilter import id_bitmap, maybe_in
from marginalia.llm.registry import query, table
from marginalia.llm.textbytes import chunks, flat, mixed, prefix, stretch_digests
from marginalia.session import scratch_path

SPAN = 200
GRAM = 80
SHALLOW = 32
GROUP = 256  # contexts of one gram that are sorted together; larger groups go by their strings' digests
SORTED_AT_ONCE = 2_000
HASHED_AT_ONCE = 256  # contexts whose strings, up to 200 each, go out in one message
ANCHOR_BYTES = 1 << 18  # of text whose anchors are found at once: some 25 numbers a byte are held meanwhile


# ---- deep-shallow sorting


class BlindTrie:
    """Strings by the places where they part. A walk looks at these places alone; one comparison with the
    string it ends at then tells where a new string really parts from those held."""

    def __init__(self):
        self.root: list | None = None  # leaf: [None, key, places]; branch: [depth, {byte or -1 at an end: node}]

    @staticmethod
    def _at(key: bytes, depth: int) -> int:
        return key[depth] if depth < len(key) else -1

    def add(self, key: bytes, place: int) -> None:
        if self.root is None:
            self.root = [None, key, [place]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._at(key, node[0])) or next(iter(node[1].values()))
        held, depth = node[1], 0
        if held == key:
            node[2].append(place)
            return
        least = min(len(held), len(key))
        low, high = 0, least  # the first difference, by halving
        while low < high:
            middle = (low + high + 1) // 2
            if held[:middle] == key[:middle]:
                low = middle
            else:
                high = middle - 1
        depth = low
        leaf = [None, key, [place]]
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = (node, self._at(key, node[0])), node[1][self._at(key, node[0])]
        if node[0] == depth:
            node[1][self._at(key, depth)] = leaf
            return
        branch = [depth, {self._at(held, depth): node, self._at(key, depth): leaf}]
        if above is None:
            self.root = branch
        else:
            above[0][1][above[1]] = branch

    def sorted(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out.extend(node[2])
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the rows of ``strings`` (bytes, filled up with zeros) by group, then string.

    Multikey quicksort over characters of eight bytes: a range is parted by its next character, and only ranges of
    several rows go on to the one after. At ``shallow`` bytes what is left of each range is put in order by a blind trie."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    characters = padded.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    range_of = np.concatenate([[0], np.cumsum(np.diff(group[order]) != 0)]) if n else np.zeros(0, np.int64)
    for depth in range(shallow // 8):
        size = np.bincount(range_of, minlength=1)
        open_ = np.flatnonzero(size[range_of] > 1)
        if not len(open_):
            break
        rows = order[open_]
        by = np.lexsort((characters[rows, depth], range_of[open_]))
        order[open_] = rows[by]
        key = characters[order[open_], depth]
        parted = np.zeros(n, np.int64)
        # Open ranges are runs of open places, so a change within one is a change between neighbours.
        new = np.flatnonzero((key[1:] != key[:-1]) & (range_of[open_][1:] == range_of[open_][:-1])) + 1
        parted[open_[new]] = 1
        edges = np.concatenate([[0], (np.diff(range_of) != 0).astype(np.int64)])
        range_of = np.cumsum(np.maximum(edges, parted))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(range_of)) + 1, [n]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a > 1:
            trie = BlindTrie()
            for row in order[a:b].tolist():
                trie.add(strings[row, : lengths[row]].tobytes(), row)
            order[a:b] = trie.sorted()
    return order


def neighbour_lcp(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in the order the common prefix with the row before; nothing across groups."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        differ = strings[a] != strings[b]
        first = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
        out[1:] = np.where(group[a] == group[b], np.minimum(first, np.minimum(lengths[a], lengths[b])), 0)
    return out


def repeated_offsets(
    left: list[bytes], right: list[bytes], group: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, span: int = SPAN
) -> list[list[int]]:
    """For every context the offsets d between ``low`` and ``high`` such that the ``span`` bytes from d before its anchor occur
    again: in another context of its group, or because the context itself occurs more than once (``count``).

    Two contexts share the string at d if they agree in d bytes before and span - d bytes from the anchor on. Either is a range of
    one of the two sorted orders, cut where the common prefix of neighbours is shorter."""
    n = len(left)

    def table_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(r) for r in rows], np.int64)
        out = np.zeros((n, max(1, int(lengths.max(initial=1)))), np.uint8)
        out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.frombuffer(b"".join(rows), np.uint8)
        return out, lengths

    orders = []
    for rows in (right, [r[::-1] for r in left]):
        strings, lengths = table_of(rows)
        order = deep_shallow(strings, lengths, group)
        orders.append((order, neighbour_lcp(strings, lengths, group, order), np.concatenate([[True], np.diff(group[order]) != 0])))
    found: list[list[int]] = [[] for _ in range(n)]
    for d in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        asked = (low <= d) & (d <= high)
        sides = []
        for (order, lcp, first), needed in zip(orders, (span - d, d), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum((lcp < needed) | first)
            sides.append(number)
        rows = np.flatnonzero(asked)
        key = sides[0][rows] * (n + 1) + sides[1][rows]
        _, inverse = np.unique(key, return_inverse=True)
        times = np.bincount(inverse, weights=count[rows])
        for row in rows[times[inverse] > 1].tolist():
            found[row].append(d)
    return found


# ---- anchors


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """For the rows of one run of bytes: row, place, gram digest, context digest, and the least and largest distance to the
    starts of the strings that have their anchor there. Ties go to the first place, which is the same in equal strings."""
    n, wide = len(data), span - gram + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < span:
        return empty
    sums = prefix(data)
    at = np.arange(n - gram + 1)
    digest = stretch_digests(sums, at, at + gram)
    bits = np.uint64(max(22, int(n).bit_length()))
    key = ((digest >> bits) << bits) | at.astype(np.uint64)
    full = -(-len(key) // wide) * wide
    rows = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(key)] = key
    rows = rows.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.arange(n - span + 1)
    place = (np.minimum(behind[starts], ahead[starts + wide - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + span <= offsets[row + 1]
    starts, place, row = starts[inside], place[inside], row[inside]
    if not len(starts):
        return empty
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    a, r = place[new], row[new]
    begin, end = np.maximum(offsets[r], a - (wide - 1)), np.minimum(offsets[r + 1], a + span)
    context = mixed(stretch_digests(sums, begin, end) + (a - begin).astype(np.uint64))
    return r, a - offsets[r], digest[a].view(np.int64), context.view(np.int64), a - starts[last], a - starts[new]


def _anchor_table(docs: DataFrame, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, most=ANCHOR_BYTES):
                row, at, h, context, low, high = anchors(*flat(batch.column("text")), span, gram)
                rid = batch.column("rid").to_numpy(zero_copy_only=False)[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(context), pa.array(rid), pa.array(at.astype(np.int32)), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16))],
                    ["h", "context", "rid", "at", "low", "high"],
                )

    return docs.select("rid", "text").mapInArrow(run, "h bigint, context bigint, rid bigint, at int, low smallint, high smallint")


def _context_bytes(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """h, context, n, low, high and the bytes on either side of the anchor, for ``wanted`` (h, context, n, low, high, rid, at)."""
    by_row = wanted.groupBy("rid").agg(F.collect_list(F.struct("at", "h", "context", "n", "low", "high")).alias("places"))
    near = docs.select("rid", "text").filter(maybe_in(id_bitmap(by_row, "rid"), F.col("rid"))).dropDuplicates(["rid"])

    # Native, for the tasks that hash strings go on from here: they have one Python worker then.
    at, before = F.col("at"), span - gram
    left = F.substring("raw", F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before)))
    cut = near.join(by_row, "rid").select(F.col("text").cast("binary").alias("raw"), F.inline("places"))
    return cut.select("h", "context", "n", "low", "high", left.alias("left"), F.substring("raw", at + 1, F.lit(span)).alias("right"))


_FOUND = "h bigint, context bigint, offsets array<int>"


def _found_batch(h: list, context: list, offsets: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.int64()), pa.array(context, pa.int64()), pa.array(offsets, pa.list_(pa.int32()))], ["h", "context", "offsets"]
    )


def _sort_groups(rows: DataFrame, span: int) -> DataFrame:
    """Offsets of repeated strings per context, by sorting the contexts of each gram. Groups come whole and in turn, several at once."""

    def finish(parts: list[dict]) -> pa.RecordBatch:
        c = {k: [x for p in parts for x in p[k]] for k in parts[0]}
        number = np.unique(np.array(c["h"], np.int64), return_inverse=True)[1]
        low, high, n = (np.array(c[k], np.int64) for k in ("low", "high", "n"))
        return _found_batch(c["h"], c["context"], repeated_offsets(c["left"], c["right"], number, n, low, high, span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            # A group may go on in the next batch: what is held is sorted at a change of group only.
            cuts = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if size >= SORTED_AT_ONCE and held[-1]["h"][-1] != h[a]:
                    yield finish(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a).to_pydict())
                size += b - a
        if held:
            yield finish(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, _FOUND)


def _hash_groups(rows: DataFrame, span: int) -> DataFrame:
    """The same for groups too large to sort in one task: a row per string of a context, counted by digest. Contexts that occur
    several times take part in the counts and get no offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, HASHED_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, HASHED_AT_ONCE)):
            c = batch.to_pydict()
            out = [[], [], [], [], []]
            for k in range(batch.num_rows):
                raw = np.frombuffer(c["left"][k] + c["right"][k], np.uint8)
                d = np.arange(c["low"][k], c["high"][k] + 1)
                starts = len(c["left"][k]) - d
                key = stretch_digests(prefix(raw), starts, starts + span).view(np.int64)
                for column, values in zip(out, (key, d, np.full(len(d), c["h"][k]), np.full(len(d), c["context"][k]), np.full(len(d), c["n"][k])), strict=True):
                    column.append(values)
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "d", "h", "context", "n"])

    windows = rows.mapInArrow(run, "key bigint, d bigint, h bigint, context bigint, n bigint")
    again = windows.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1").select("key")
    # A context that occurs twice is repeated throughout: its strings are counted, but nobody asks which of them repeat.
    return windows.filter("n = 1").join(again, "key", "left_semi").groupBy("h", "context").agg(F.collect_list(F.col("d").cast("int")).alias("offsets"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """rid and spans (arrays of start, end in bytes; they may overlap) for the rows of ``docs`` (rid, text) with repeated strings."""
    table_ = _stored(_anchor_table(docs, span, gram), "anchors")
    seen = table_.groupBy("h").agg(F.count("*").alias("times"), F.min("context").alias("c0"), F.max("context").alias("c1")).filter("times > 1")
    places = _stored(table_.join(seen.select("h", (F.col("c0") < F.col("c1")).alias("several")), "h"), "places")
    contexts = _stored(
        places.filter("several").groupBy("h", "context").agg(
            F.count("*").alias("n"), F.min(F.struct("rid", "at", "low", "high")).alias("p")
        ), "contexts",
    )
    # A context that occurs twice is repeated throughout; a gram all of whose contexts are needs no sorting.
    grams = contexts.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("size")).filter("least = 1")
    wanted = contexts.join(grams.select("h", "size"), "h").select("h", "context", "n", "p.*", "size")
    small = _context_bytes(docs, wanted.filter(F.col("size") <= group), span, gram)
    large = _context_bytes(docs, wanted.filter(F.col("size") > group), span, gram)
    found = _stored(_sort_groups(small, span).unionAll(_hash_groups(large, span)), "offsets")
    whole = F.array(F.struct((F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + span).alias("end")))
    alone = places.filter("not several").select("rid", whole.alias("spans"))
    verdict = contexts.join(found, ["h", "context"], "left").filter("n > 1 or size(offsets) > 0").select("h", "context", "n", "offsets")
    single = F.transform("offsets", lambda d: F.struct((F.col("at") - d).alias("start"), (F.col("at") - d + span).alias("end")))
    mixed_ = places.filter("several").join(verdict, ["h", "context"]).select("rid", F.when(F.col("n") > 1, whole).otherwise(single).alias("spans"))
    return alone.unionAll(mixed_).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs as arrays of start, end in bytes) and kept (the remaining bytes) for every
    row of ``docs`` (doc_id, text; other columns are ignored).

    Every byte goes that is covered by a string of ``span`` bytes that also starts at another place, in the same text or another; all strings
    are judged on the input. Null text counts as empty. Repeated rows are texts each, so their strings repeat. An empty table gives none. Rows are told apart by a 64-bit
    digest of id and text, grams and contexts found by 64-bit digests; what is sorted is compared byte by byte."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    spans = _stored(repeated_spans(keyed, span, gram, group), "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole)):
            out = []
            for key, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, runs, at, kept = text.encode(), merged(found or []), 0, []
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                out.append((key, len(raw), sum(e - s for s, e in runs), [{"start": s, "end": e} for s, e in runs], b"".join(kept)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
            )

    marked = keyed.withColumn("_near", maybe_in(id_bitmap(spans, "rid"), F.col("rid")))
    touched = marked.filter("_near").join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    whole = marked.filter("not _near").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept"),
    )
    return touched.unionAll(whole)


@query("op4_remove_repeats")
def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )

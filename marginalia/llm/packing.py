"""Best-fit packing of tokenised documents into sequences by bin completion.

Only lengths matter for packing, and there are no more lengths than tokens in a
sequence. So documents are counted by length, one branch and bound search completes
bins for the counts, and the documents of a length are dealt to its places by rank:
the search sees a table of at most ``capacity`` rows, whatever the number of documents."""

from __future__ import annotations

import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table
from marginalia.llm.skew import running_total
from marginalia.llm.textbytes import chunks
from marginalia.session import cut_lineage

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 1_000_000  # of either generation
SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
LONGEST_SIGNS, CACHE_SIGNS = 8, 10_000
SEARCH_NODES = 20_000
FILLINGS = 24

_encoders: dict[str, _Encoder] = {}


class _Encoder:
    """Token ids of texts as little-endian bytes, by words: the tokenizer drops white space, so a text's ids are those of
    its blank-separated words in turn. A Latin word with signs behind it is that word in lower case and those signs, for
    the tokenizer lower-cases and cuts there itself. Two generations of a bounded store keep the ids of words met before."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.signs: dict[str, bytes] = {"": b""}

    def _one(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _signs(self, found: set[str]) -> dict[str, bytes]:
        if len(self.signs) + len(found) > CACHE_SIGNS:
            self.signs = {"": b""}
        self.signs.update((x, self._one(x)) for x in found - self.signs.keys())
        return self.signs

    def _learn_latin(self, stems: list[str]) -> None:
        """Words of letters alone are one run of tokens each, so many are encoded in one go and cut behind the last tokens."""
        groups = [stems[k : k + 200] for k in range(0, len(stems), 200)]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(some):
                raw, at = ids.tobytes(), 0
                for word, end in zip(some, (4 * ends).tolist(), strict=True):
                    self.known[word] = raw[at:end]
                    at = end
            else:
                self.known.update((word, self._one(word)) for word in some)

    def _learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        back = new & old.keys()
        known.update(zip(back, map(old.__getitem__, back), strict=True))
        words = list(new - back)
        stems = [w.rstrip(SIGNS) for w in words]
        tails = [w[len(s) :] for w, s in zip(words, stems, strict=True)]
        latin = [s.isalpha() and (s.isascii() or max(s) < "\u0130") and len(t) <= LONGEST_SIGNS for s, t in zip(stems, tails, strict=True)]
        signs = self._signs({t for t, ok in zip(tails, latin, strict=True) if ok})
        stems = [s.lower() if ok else s for s, ok in zip(stems, latin, strict=True)]
        missing = {s for s, ok in zip(stems, latin, strict=True) if ok} - known.keys()
        back = missing & old.keys()
        known.update(zip(back, map(old.__getitem__, back), strict=True))
        self._learn_latin(list(missing - back))
        known.update((w, known[s] + signs[t]) for w, s, t, ok in zip(words, stems, tails, latin, strict=True) if ok)
        rest = [w for w, ok in zip(words, latin, strict=True) if not ok]
        for word, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[word] = np.asarray(found.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        asked = set().union(*split)
        self._learn(asked if len(asked) + len(self.known) > CACHE_WORDS else asked - self.known.keys())
        ids = self.known.__getitem__
        for parts in split:
            yield b"".join(map(ids, parts))


def encoder(path: str) -> _Encoder:
    """One per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document: its ids, then the end id, cut every ``capacity`` ids.
    Null text counts as empty and is one piece of the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([END_ID], "<u4").tobytes()
        for whole in batches:
            for batch in chunks(whole):
                out: list[tuple] = []
                keys = batch.column("doc_id").to_pylist()
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for key, ids in zip(keys, encoder(tokenizer_path)(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        held = ids[at : at + 4 * capacity]
                        out.append((key, piece, at // 4, len(held) // 4, zlib.crc32(held)))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                types = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


class BinCompletion:
    """Bins for a table of counts by length, by completing the bin of the largest length left.

    A filling is what goes beside the largest. One filling dominates another if the other fits into its places piece by
    piece, so only undominated ones are tried: those that leave less room than any length left would
    take, and of two with the same number of pieces not the one that is nowhere larger. Fillings are tried best fit first; the
    first descent is the incumbent. A branch is cut when the waste it has already left, added to the
    lengths still to be packed, needs as many bins as the incumbent has. A filling is used as often as
    the counts allow in one step, so a search is no longer than the table.

    ``nodes`` bounds the search; when it is spent, the incumbent stands. It is optimal if its bins reach the bound."""

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = SEARCH_NODES):
        self.capacity, self.nodes = capacity, nodes
        self.counts = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] = n
        self.total = int((self.counts * np.arange(capacity + 1)).sum())
        self.bound = max(-(-self.total // capacity), int(self.counts[capacity // 2 + 1 :].sum()))
        self.best: list[tuple[int, tuple[int, ...]]] | None = None
        self.best_bins = sys.maxsize

    def fillings(self, room: int) -> list[tuple[int, ...]]:
        """Undominated fillings of ``room`` from the lengths left, the fullest and then those of fewest pieces first."""
        left = self.counts
        lengths = np.flatnonzero(left[: room + 1])
        if not len(lengths):
            return [()]
        found: list[tuple[int, ...]] = []
        if left[room]:
            return [(room,)]  # a piece that fits exactly dominates all else
        least = int(lengths[0])
        # Two pieces: for each first piece the largest second that fits beside it.
        floor = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
        first = lengths[lengths >= room - lengths] if 2 * least <= room else lengths[:0]
        second = floor[room - first] if len(first) else first
        for a, b in zip(first[::-1].tolist(), second[::-1].tolist(), strict=True):
            if b and (a != b or left[a] > 1):
                found.append((a, b))
        largest = int(lengths[-1])
        found.append((largest,))
        # More pieces: down from the largest, then best fit for the rest.
        for start in lengths[::-1][:FILLINGS].tolist():
            parts, rest = [start], room - start
            while rest >= least:
                piece = int(floor[rest])
                while piece and parts.count(piece) >= left[piece]:
                    piece = int(floor[piece - 1])
                if not piece:
                    break
                parts.append(piece)
                rest -= piece
            found.append(tuple(parts))
        full: dict[tuple[int, ...], int] = {}
        for parts in found:
            rest = room - sum(parts)
            used = {p: parts.count(p) for p in parts}
            if any(n > left[p] for p, n in used.items()):
                continue
            # Maximal ones only: a filling with room for one more piece is dominated by the one that has it.
            more = int(floor[rest]) if rest > 0 else 0
            while more and used.get(more, 0) >= left[more]:
                more = int(floor[more - 1])
            if not more:
                full[tuple(sorted(parts, reverse=True))] = rest
        ranked = sorted(full, key=lambda p: (full[p], len(p), [-x for x in p]))
        kept: list[tuple[int, ...]] = []
        for parts in ranked:
            if not any(len(k) == len(parts) and all(a >= b for a, b in zip(k, parts, strict=True)) for k in kept):
                kept.append(parts)
            if len(kept) == FILLINGS:
                break
        return kept

    def solve(self) -> list[tuple[int, tuple[int, ...]]]:
        """Bins as (how often, lengths), the largest length first."""
        chosen: list[tuple[int, tuple[int, ...]]] = []
        state = {"bins": 0, "waste": 0}
        stack: list[tuple[Iterator[tuple[int, ...]], int]] = []

        def enter() -> None:
            lengths = np.flatnonzero(self.counts)
            if not len(lengths):
                if state["bins"] < self.best_bins:
                    self.best, self.best_bins = list(chosen), state["bins"]
                return
            least_bins = -(-(self.total + state["waste"]) // self.capacity)
            if max(least_bins, self.bound) >= self.best_bins:
                return
            top = int(lengths[-1])
            self.counts[top] -= 1
            options = self.fillings(self.capacity - top)
            self.counts[top] += 1
            stack.append((iter(options), len(chosen)))

        def undo(depth: int) -> None:
            while len(chosen) > depth:
                times, lengths = chosen.pop()
                for x in lengths:
                    self.counts[x] += times
                state["bins"] -= times
                state["waste"] -= times * (self.capacity - sum(lengths))

        enter()
        nodes = 0
        while stack:
            options, depth = stack[-1]
            undo(depth)
            if self.best_bins == self.bound or nodes > self.nodes and self.best is not None:
                break
            parts = next(options, None)
            if parts is None:
                stack.pop()
                continue
            nodes += 1
            top = int(np.flatnonzero(self.counts)[-1])
            bin_ = (top, *parts)
            times = min(int(self.counts[x]) // bin_.count(x) for x in set(bin_))
            for x in bin_:
                self.counts[x] -= times
            chosen.append((times, bin_))
            state["bins"] += times
            state["waste"] += times * (self.capacity - sum(bin_))
            enter()
        undo(0)
        return self.best or []


def _places(bins: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its ranks pass from one kind of bin to the next, and there the first sequence, the number
    of pieces of that length in a bin, and the offset of the first of them."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    done: dict[int, int] = {}
    first = 0
    for times, lengths in bins:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            n = lengths.count(x)
            rows.setdefault(x, []).append((done.get(x, 0), first, n, offset))
            done[x] = done.get(x, 0) + n * times
            offset += n * x
        first += times
    return {x: tuple(np.asarray(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, nodes: int = SEARCH_NODES
) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Sequences hold ``capacity`` tokens at most; only documents longer
    than that are cut.

    Null and empty texts are pieces of one id. Repeated rows are packed as often as they occur. An empty table gives none. Pieces
    of a length are ranked by a digest dealt into buckets (``running_total``), so a length shared by a third of all rows is
    many tasks. The counts (at most ``capacity`` rows) go to the driver; the bins go to the tasks: kinds of bins, not bins, of
    which there are at most about two per length."""
    pieces = cut_lineage(token_pieces(docs, tokenizer_path, capacity))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(BinCompletion(counts, capacity, nodes).solve())
    ranked = running_total(
        pieces.withColumn("_one", F.lit(1)), ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"),
        ["doc_id", "piece", "ids_crc32"], "_one", "_rank",
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for some in np.split(order, cuts) if len(order) else []:
                x = int(length[some[0]])
                begins, first, n, at = places[x]
                k = np.searchsorted(begins, rank[some], "right") - 1
                within = rank[some] - begins[k]
                sequence[some] = first[k] + within // n[k]
                offset[some] = at[k] + within % n[k] * x
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        deal, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def word_bpe() -> str:
    """The vocabulary file of the production query, where the installed package keeps it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_pack_documents")
def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_bpe())

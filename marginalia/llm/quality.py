"""Document quality by Bradley-Terry ranking.

A document's strength is linear in features of its whole text. Pairs of a good and a bad labelled document say which is
preferred; the weights are those that make the preferred one of every pair win with the highest
likelihood: the logistic loss on the difference of the features. Documents are then kept from a
quantile of the scores on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table
from marginalia.llm.textbytes import chunks, flat, mixed, prefix, stretch_digests, words
from marginalia.session import cut_lineage

SAMPLE_ROWS = 20_000
BINS = 10
PAIRS = 60_000
SEED = 11


def _marks(*signs: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for s in signs:
        out[list(s.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _marks("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marks("abcdefghijklmnopqrstuvwxyz"), _marks("0123456789")
_SYMBOL, _BAR, _BANG, _STOP, _COMMA = _marks("#*$%&<>"), _marks("|"), _marks("!"), _marks(".?"), _marks(",;:")
_HIGH = np.arange(256) >= 128
_NEWLINE = _marks("\n")
FEATURES = (
    "log_words", "word_length", "symbols", "bars", "bangs", "upper", "digits", "stops", "commas", "high", "distinct_words",
    "same_next", "repeated_triples", "repeated_eights", "lines", "line_ends", "long_words",
)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of features per text; a text without words has zeros but for what its bytes say."""
    data, offsets = flat(column)
    n = len(offsets) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.float64)

    starts, ends, cut = words(data, offsets)
    count = np.diff(cut).astype(np.float64)
    size, some = np.maximum(np.diff(offsets), 1).astype(np.float64), np.maximum(count, 1)
    upper, lower = per_row(_UPPER[data]), per_row(_LOWER[data])
    sums = prefix(data)
    digest = stretch_digests(sums, starts, ends)
    row = np.repeat(np.arange(n), np.diff(cut))
    lengths = ends - starts

    def by_row(flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=flags, minlength=n) if len(rows) else np.zeros(n)

    def distinct(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(n)
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        return by_row(first.astype(np.float64), r)

    def grams(width: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(digest) - width + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key = digest[:m].copy()
        for k in range(1, width):
            key = mixed(key) + digest[k : m + k]
        inside = row[:m] == row[width - 1 :]
        return key[inside], row[:m][inside]

    repeats = []
    for width in (3, 8):
        keys, rows = grams(width)
        held = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n)
        repeats.append(1 - distinct(keys, rows) / np.maximum(held, 1) * (held > 0) - (held == 0))
    same = by_row((digest[1:] == digest[:-1]).astype(np.float64) * (row[1:] == row[:-1]), row[1:]) if len(row) > 1 else np.zeros(n)
    newline = _NEWLINE[data]
    line_end = np.zeros(len(data), bool)
    if len(data):
        line_end[:-1] = newline[1:]
        line_end[offsets[1:][np.diff(offsets) > 0] - 1] = True
    lines = per_row(newline) + 1
    columns = [
        np.log1p(count), by_row(lengths.astype(np.float64), row) / some, per_row(_SYMBOL[data]) / some, per_row(_BAR[data]) / some,
        per_row(_BANG[data]) / some, upper / np.maximum(upper + lower, 1), per_row(_DIGIT[data]) / size, per_row(_STOP[data]) / some,
        per_row(_COMMA[data]) / some, per_row(_HIGH[data]) / size, distinct(digest, row) / some, same / some, repeats[0], repeats[1],
        lines / some, per_row(line_end & (_STOP[data] | _BANG[data])) / lines, by_row((lengths > 24).astype(np.float64), row) / some,
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Ranking:
    """A fitted strength: bin edges per feature, weights per bin, and the scale that turns strengths into chances."""

    edges: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def spread(self, features: np.ndarray) -> np.ndarray:
        """Each feature as places within its bins: how far into every bin it reaches, so strength is piecewise linear."""
        low, high = self.edges[:, :-1], self.edges[:, 1:]
        wide = np.where(high > low, high - low, 1.0)
        x = np.clip((features[:, :, None] - low) / wide, 0, 1)
        return np.where(high > low, x, 0.0).reshape(len(features), -1)

    def score(self, features: np.ndarray) -> np.ndarray:
        strength = self.spread(features) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * strength + self.shift, -30, 30)))


def fit_ranking(features: np.ndarray, preferred: np.ndarray, pairs: int = PAIRS, bins: int = BINS, seed: int = SEED) -> Ranking:
    """Weights from ``pairs`` random pairs of a preferred and another row. Without both kinds there is nothing to prefer: every
    score is then the smoothed share of preferred rows."""
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    share = (len(good) + 1) / (len(preferred) + 2)
    at = np.linspace(0, 1, bins + 1)
    edges = np.quantile(features, at, axis=0).T if len(features) else np.zeros((len(FEATURES), bins + 1))
    blank = Ranking(edges, np.zeros(edges.shape[0] * bins), 1.0, float(np.log(share / (1 - share))))
    if not len(good) or not len(bad):
        return blank
    # Rare marks are nothing in most texts: their bins lie between the values that are not.
    for f in range(features.shape[1]):
        own = features[:, f][features[:, f] > features[:, f].min()]
        if len(own):
            edges[f] = np.concatenate([[features[:, f].min()], np.quantile(own, np.linspace(0, 1, bins))])
    model = Ranking(edges, blank.weights, 1.0, 0.0)
    x = model.spread(features).astype(np.float32)
    rng = np.random.default_rng(seed)
    left, right = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v = (np.zeros(x.shape[1], np.float64) for _ in range(3))
    for t in range(1, 601):
        some = rng.integers(0, pairs, 4096)
        apart = x[left[some]] - x[right[some]]
        lost = 1 / (1 + np.exp(np.clip(apart @ w, -30, 30)))
        g = -(lost @ apart) / len(some) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    strength, y = x @ w, preferred.astype(np.float64)
    middle, scale = strength.mean(), max(strength.std(), 1e-9)
    z = (strength - middle) / scale
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(50):  # Newton's steps for the chance of a label given the strength
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [((y - p) * z).sum(), (y - p).sum()])
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    return Ranking(edges, w, a / scale, b - a * middle / scale)


def feature_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                values = text_features(batch.column("text"))
                flat_values = pa.array(values.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat_values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, features array<double>")


def rank_quality(
    docs: DataFrame, labels: DataFrame, keep_share: float | None = None, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, score (0 to 1, higher: preferred) and selected for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, preferred boolean) names the labelled documents to learn from; at most ``sample_rows`` of them are fitted, those
    with the least digest of their id. selected is true from the quantile of all scores on that keeps ``keep_share`` of the
    documents, by default the preferred share of the labels; ties at the quantile are selected.

    Null labels are left out, null text counts as empty; repeated rows get repeated results, an empty table none.
    Texts are read once: their features are written to the shared folder, then joined with the labels and scored."""
    features = cut_lineage(feature_table(docs))
    known = labels.filter(F.col("preferred").isNotNull()).select(F.col("doc_id").alias("_id"), "preferred")
    sample = (
        features.join(known, F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        .select("features", "preferred").toArrow()
    )
    x = np.asarray(sample.column("features").combine_chunks().flatten()).reshape(sample.num_rows, len(FEATURES))
    y = np.asarray(sample.column("preferred").to_pylist(), bool)
    model = fit_ranking(x, y)
    share = keep_share if keep_share is not None else (float(y.mean()) if len(y) else 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.asarray(batch.column("features").flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(held))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = features.mapInArrow(run, f"doc_id {kind}, score double")
    # The least of the scores that make up the share from above.
    cut = scored.agg((-F.percentile_approx(-F.col("score"), share, 10_000)).alias("cut")).first()["cut"] if share < 1 else 0.0
    return scored.withColumn("selected", F.col("score") >= F.lit(cut if cut is not None else 0.0))


@query("op1_rank_quality")
def op1_rank_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", (F.col("quality") == 1).alias("preferred"))
    ranked = rank_quality(table(spark, sf_dir, "documents"), labels)
    return ranked.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "selected"
    )

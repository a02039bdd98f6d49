"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their stems, hashed. Beside a weight per term the machine learns a short vector per
term; the inner product of two terms' vectors is the weight of their meeting in one text, so an
insult weighs more beside a mention of a group than the two do apart."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table
from marginalia.llm.textbytes import chunks, flat, lower, mixed, prefix, stretch_digests, words

SLOTS = 1 << 22
SAMPLE_TOXIC, SAMPLE_OTHER = 4_000, 8_000
TERMS = 4_096  # hashed terms that take part, those that tell the labels apart best
COMMON = 1_024  # most frequent terms whose pairs are looked at, so that terms that tell by meeting alone take part too
PAIR_ERRORS = 6  # standard errors by which a pair's share must differ between the labels
FACTORS = 8
STEM_BYTES = 5
EPOCHS = 60
SEED = 7

# Words are runs of letters and digits of any script: all ASCII signs lie between words.
_BETWEEN = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of every text (words, and the first bytes of longer ones as a stem), ascending, and where each text's begin (n + 1 places)."""
    data, offsets = flat(column)
    data = lower(data)
    starts, ends, cut = words(data, offsets, _BETWEEN)
    sums, stems = prefix(data), starts + STEM_BYTES
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(cut))
    whole, long = stretch_digests(sums, starts, ends), stems < ends
    stem = mixed(stretch_digests(sums, starts[long], stems[long]))
    slot = (np.concatenate([whole, stem]) % np.uint64(SLOTS)).astype(np.int64)
    both = np.unique(np.concatenate([row, row[long]]) * SLOTS + slot)
    return both % SLOTS, np.searchsorted(both // SLOTS, np.arange(len(offsets)))


@dataclass(frozen=True)
class Machine:
    """place: per slot the number of its term, or the count of terms if it takes no part. The last weight and vector are nothing."""

    place: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, terms: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Log odds per text, by the identity: sum over pairs = (square of the sum - sum of the squares) / 2."""
        number = self.place[terms]
        row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        taken = number < len(self.weights) - 1
        number, row, n = number[taken], row[taken], len(cuts) - 1
        out = self.bias + np.bincount(row, self.weights[number], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[number, f]
            out += (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n)) / 2
        return out

    def score(self, terms: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, cuts), -30, 30)))


def meeting_terms(every: np.ndarray, rows: np.ndarray, toxic: np.ndarray, times: np.ndarray, common: int = COMMON) -> np.ndarray:
    """Of the most frequent terms those that meet one another far more or less often in toxic texts than in others, whatever
    each tells alone. ``every``: the terms of all texts in turn; ``rows``: their texts; ``times``: texts per term."""
    n = len(toxic)
    frequent = np.argsort(-np.where(times < n, times, 0), kind="stable")[:common]
    frequent = np.sort(frequent[(times[frequent] >= 2) & (times[frequent] < n)])
    if not len(frequent):
        return frequent
    at = np.minimum(np.searchsorted(frequent, every), len(frequent) - 1)
    held = np.zeros((n, len(frequent)), np.float32)
    hit = frequent[at] == every
    held[rows[hit], at[hit]] = 1
    n1, n0 = toxic.sum(), n - toxic.sum()
    both1, both0 = held[toxic].T @ held[toxic], held[~toxic].T @ held[~toxic]
    p = (both1 + both0) / n
    apart = np.abs(both1 / n1 - both0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    # A pair tells something of its own where it is further apart than either term alone.
    alone = np.diag(apart)
    own = (apart > PAIR_ERRORS) & (apart > 1.5 * np.maximum(alone[:, None], alone[None, :]))
    np.fill_diagonal(own, False)
    return frequent[own.any(1)]


def fit_machine(
    texts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, terms: int = TERMS, factors: int = FACTORS,
    epochs: int = EPOCHS, seed: int = SEED,
) -> Machine:
    """Weighted logistic loss by Adam over small batches. ``weight`` undoes the sample's shares of the labels. Without both labels
    the machine is a bias alone."""
    share = float(np.clip((weight * toxic).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(texts) else 1e-3
    bias, place = float(np.log(share / (1 - share))), np.zeros(SLOTS, np.int32)
    if not len(texts) or toxic.all() or not toxic.any():
        return Machine(place, bias, np.zeros(1), np.zeros((1, factors)))
    every = np.concatenate(texts)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    with_ = np.bincount(every[toxic[rows]], minlength=SLOTS).astype(np.float64)
    without = np.bincount(every[~toxic[rows]], minlength=SLOTS).astype(np.float64)
    n1, n0 = toxic.sum(), (~toxic).sum()
    # How far a term's share among the toxic texts is from that among the others, in standard errors.
    p = (with_ + without) / (n1 + n0)
    apart = np.abs(with_ / n1 - without / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    apart[with_ + without < 2] = 0
    chosen = np.argsort(-apart, kind="stable")[:terms]
    meeting = meeting_terms(every, rows, toxic, with_ + without)
    chosen = np.union1d(chosen[apart[chosen] > 2], meeting)
    m = len(chosen)
    place[:] = m
    place[chosen] = np.arange(m)
    number = place[every]
    taken = number < m
    number, rows = number[taken], rows[taken]
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    params = {"b": np.array([bias]), "w": np.zeros(m + 1), "v": rng.normal(0, 0.05, (m + 1, factors))}
    params["v"][m] = 0
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in params.items()}
    y, step = toxic.astype(np.float64), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            lengths = cuts[some + 1] - cuts[some]
            index = np.repeat(cuts[some] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            t, r = number[index], np.repeat(np.arange(len(some)), lengths)
            v = params["v"][t]
            sums = np.stack([np.bincount(r, v[:, f], len(some)) for f in range(factors)], 1)
            squares = np.stack([np.bincount(r, v[:, f] ** 2, len(some)) for f in range(factors)], 1)
            raw = params["b"][0] + np.bincount(r, params["w"][t], len(some)) + (sums**2 - squares).sum(1) / 2
            d = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) * weight[some] / weight[some].sum()
            grads = {"b": np.array([d.sum()]), "w": np.bincount(t, d[r], m + 1) + 2e-5 * params["w"]}
            dv = d[r][:, None] * (sums[r] - v)
            grads["v"] = np.stack([np.bincount(t, dv[:, f], m + 1) for f in range(factors)], 1) + 2e-5 * params["v"]
            step += 1
            for k, g in grads.items():
                a, b = moments[k]
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                params[k] -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            params["w"][m], params["v"][m] = 0, 0
    return Machine(place, float(params["b"][0]), params["w"], params["v"])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_other: int = SAMPLE_OTHER
) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic boolean) names the documents to learn from; at most ``sample_toxic`` and ``sample_other`` of
    either label are fitted, those with the least digest of their id, weighted back to the labels' own shares. Null labels are left out.
    Null and empty texts score the bias. Repeated rows get repeated results, an empty table none. All terms of a text count; rows are scored alone,
    without a shuffle. The sample (its size is bounded) is broadcast to find its texts."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), "toxic").dropDuplicates(["_id"])
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [
        known.filter(F.col("toxic") == is_toxic).orderBy(F.xxhash64("_id"), "_id").limit(most)
        for is_toxic, most in ((True, sample_toxic), (False, sample_other))
    ]
    sample = parts[0].unionAll(parts[1])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                terms, cuts = hashed_terms(batch.column("text"))
                held = [terms[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column("toxic")], ["terms", "toxic"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    fitted = chosen.mapInArrow(gather, "terms binary, toxic boolean").toArrow()
    # The rows come in the order of the tasks; theirs is fixed here, so that reruns fit alike.
    rows = sorted(zip(fitted.column("terms").to_pylist(), fitted.column("toxic").to_pylist(), strict=True))
    toxic = np.array([t for _, t in rows], bool)
    share = {t: counts.get(t, 0) / max(int((toxic == t).sum()), 1) for t in (True, False)}
    machine = fit_machine([np.frombuffer(x, "<i4") for x, _ in rows], toxic, np.where(toxic, share[True], share[False]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                values = machine.score(*hashed_terms(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


@query("op10_score_toxicity")
def op10_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    scored = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Exact top-k search by inner product with a pivot table.

Distances from every vector to a set of pivots are worked out once. For a query q and a candidate x the
largest difference of their distances to a pivot is a lower bound of their own distance, and so bounds their
inner product from above: q·x = (|q|² + |x|² - |q - x|²) / 2. Candidates are scored in the order of that
bound, best first, and a query stops where the next bound is below its k-th score: nothing after can enter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.registry import query, table
from marginalia.session import cut_lineage

K = 20
PIVOTS = 16
PIVOT_SAMPLE = 4096
BLOCK_ROWS = 4096
QUERY_ROWS = 512
STEP = 128


def whole_vectors(embeddings: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and the vector as whole numbers, floor(scale · x) each. Rows whose id or vector is null, or whose vector holds
    null or a non-finite number, are left out."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("bigint"))
    return embeddings.filter(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), whole.alias("vector")
    )


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors far from one another: each next one has the largest distance to those chosen before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _packed(rows: DataFrame, size: int, pivots: dict[int, np.ndarray], block: Column) -> DataFrame:
    """Blocks of about ``size`` rows of one dimension: ids, vectors and the pivot table as bytes."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids = frame["vec_id"].to_numpy(np.int64)
        vectors = np.stack([np.asarray(v, np.float64) for v in frame["vector"]])
        return pd.DataFrame(
            {"dim": [vectors.shape[1]], "block": [int(frame["block"].iloc[0])], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]}
        )

    return rows.withColumn("dim", F.size("vector")).withColumn("block", block).groupBy("dim", "block").applyInPandas(
        pack, "dim int, block bigint, ids binary, vectors binary"
    )


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if not len(pivots):
        return np.zeros((len(vectors), 0))
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search_block(
    qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The best k of one block for every query: query ids, ids, scores, and how many scores were worked out.

    Whole numbers in doubles are exact below 2**53. The rounding of the distances, in proportion to
    them, is taken off the bounds."""
    q_table = _distances(queries, pivots).astype(np.float32)
    x_table = np.ascontiguousarray(_distances(vectors, pivots).T, np.float32)
    q_square, x_square = (queries**2).sum(1), (vectors**2).sum(1)
    if len(queries) and len(vectors) and q_square.max() * x_square.max() < 2.0**48:
        queries, vectors = queries.astype(np.float32), vectors.astype(np.float32)  # sums stay below 2**24: exact
    out, scored = [], 0
    for a, q in enumerate(queries):
        apart = np.abs(x_table - q_table[a][:, None]).max(0) if len(x_table) else np.zeros(len(vectors))
        slack = 1e-6 * (apart + q_table[a].max(initial=0)) + 1e-3
        apart = np.maximum(apart - slack, 0)
        bound = (q_square[a] + x_square - apart * apart) / 2 + 1
        bound[ids == qids[a]] = -np.inf
        best_s, best_i = np.zeros(0, vectors.dtype), np.zeros(0, np.int64)
        left, step = np.ones(len(vectors), bool), max(STEP, 2 * k)
        while True:
            # Of what is left only bounds that reach the k-th score count, and of these the highest come first.
            least = best_s[-1] if len(best_s) >= k else -np.inf
            some = np.flatnonzero(left & (bound >= least) & (bound > -np.inf))
            if not len(some):
                break
            if len(some) > step:
                some = some[np.argpartition(-bound[some], step - 1)[:step]]
            left[some] = False
            # A product with the whole block is cheaper than one with most of its rows picked out.
            scores = (vectors @ q)[some] if 4 * len(some) > len(vectors) else vectors[some] @ q
            scored += len(some)
            good = scores >= least
            best_s, best_i = np.concatenate([best_s, scores[good]]), np.concatenate([best_i, ids[some[good]]])
            if len(best_s) > k:
                top = best_s >= np.partition(best_s, len(best_s) - k)[len(best_s) - k]
                best_s, best_i = best_s[top], best_i[top]
            keep = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[keep], best_i[keep]
            step *= 16
        out.append((np.full(len(best_i), qids[a]), best_i, best_s.astype(np.int64)))
    parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return *parts, scored


def top_k_search(candidates: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query among the candidates with another id, ties to
    the smaller id; all of them, if there are fewer. Both inputs hold vec_id and vector (array of bigint).

    Vectors of another dimension than the query's do not meet it. Rows that repeat an id are candidates each, and a repeated query
    is asked once. Empty inputs give no rows.

    Candidates are packed into blocks of about ``block_rows`` by a digest of their id, queries into smaller ones; a task
    searches one block for one block of queries, and the blocks' best are merged by a window that limits every task to k rows
    per query first. Pivots come from a bounded sample; they change the bounds, never the result."""
    spark = candidates.sparkSession
    rows = cut_lineage(candidates.select("vec_id", "vector"))
    asked = queries.select("vec_id", "vector").dropDuplicates(["vec_id"])
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).collect()
    tables: dict[int, np.ndarray] = {}
    for dim in sizes:
        held = [r["vector"] for r in sample if len(r["vector"]) == dim]
        tables[dim] = choose_pivots(np.asarray(held, np.float64).reshape(len(held), dim), pivots)
    total = sum(sizes.values())
    n_candidates = max(1, -(-total // block_rows))
    n_queries = max(1, -(-asked.count() // QUERY_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("bigint")
    left = _packed(asked, QUERY_ROWS, tables, deal(n_queries)).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors", "block": "q_block"})
    right = _packed(rows, block_rows, tables, deal(n_candidates)).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_queries - 1).cast("bigint")))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                read = lambda raw, d: np.frombuffer(raw, np.float64).reshape(-1, d)
                q, i, s, n = search_block(
                    np.frombuffer(row.q_ids, np.int64), read(row.q_vectors, row.dim),
                    np.frombuffer(row.ids, np.int64), read(row.vectors, row.dim), tables[row.dim], k,
                )
                yield pd.DataFrame({"query_id": q, "vec_id": i, "score": s, "scored": np.int64(n)})

    # Pairs of blocks, not of rows: as many as the query set against all rows has.
    pairs = right.join(left, ["dim", "q_block"]).repartition(max(1, n_candidates * n_queries), "q_block", "block")
    found = pairs.mapInPandas(search, "query_id bigint, vec_id bigint, score bigint, scored bigint")
    from marginalia.functions.ordering import top_k

    best = top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k, rank="rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOPK_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


@query("op2_pivot_search", TOPK_SQL)
def op2_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k_search(whole, whole.filter(F.col("vec_id") % 20 == 0))

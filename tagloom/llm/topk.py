"""Exact top-k search by block-at-a-time pruning.

Each component x of a vector is floor(256 x), x as double. A term is a component with a sign: a query's positive
part meets a block's largest values, its negative part the smallest, so the summed maxima bound every score in a
block of consecutive vectors. A query reads blocks in the order of their bounds, through the block's forward index
(its vectors), until a bound falls below its k-th score.

Vectors and queries are dealt into groups of bounded size, and each pair of groups is one task's work; a query's
best of each group are then ranked. Nulls, and null or non-finite components, take a vector out; so do vectors of a
length that differs from the query's (they have no inner product). Ties go to the smaller vec_id. A query isn't
its own candidate, by row: other rows with its id are. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import saved, table

K, QUERY_EVERY, BLOCK, GROUP_ROWS, GROUP_QUERIES = 5, 50, 256, 16384, 4096


def quantized(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and v (array of long), of the vectors that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e300))
    parts = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    return parts.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"), F.size("embedding").alias("dim"))


def search(q: np.ndarray, q_rows: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, place in x, score) of each query's k best in x, blocks pruned by their bounds. ids ascend."""
    n = len(x)
    starts = np.arange(0, n, BLOCK)
    high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best, places = np.full((len(q), k), np.iinfo(np.int64).min), np.full((len(q), k), n)
    alive = np.arange(len(q))
    for step in range(len(starts)):
        alive = alive[bounds[alive, order[alive, step]] >= best[alive, -1]]
        if not len(alive):
            break
        turn = order[alive, step]
        for b in np.unique(turn).tolist():
            mine = alive[turn == b]
            block = slice(b * BLOCK, min(n, (b + 1) * BLOCK))
            scores = q[mine] @ x[block].T
            scores[q_rows[mine][:, None] == rows[block][None, :]] = np.iinfo(np.int64).min
            s = np.concatenate([best[mine], scores], axis=1)
            p = np.concatenate([places[mine], np.broadcast_to(np.arange(block.start, block.stop), scores.shape)], axis=1)
            top = np.lexsort((p, -s), axis=1)[:, :k]
            best[mine], places[mine] = np.take_along_axis(s, top, 1), np.take_along_axis(p, top, 1)
    number, at = np.nonzero((places < n) & (best > np.iinfo(np.int64).min))
    return number, places[number, at], best[number, at]


def exact_top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each vector whose id is divisible by `every`."""
    parts = saved(quantized(vectors))
    counts = parts.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    groups, packs = max(1, -(-counts["n"] // GROUP_ROWS)), max(1, -(-counts["q"] // GROUP_QUERIES))
    # A seeded hash of the row deals evenly, whatever the ids and lengths are.
    rows = parts.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))).withColumn("is_query", F.lit(False))
    queries = parts.filter(F.col("vec_id") % every == 0).withColumn("c", F.pmod(F.xxhash64("row"), F.lit(packs))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("is_query", F.lit(True))

    def best(t: pa.Table) -> pa.Table:
        is_query = t["is_query"].to_numpy()
        row, ids, v = t["row"].to_numpy(), t["vec_id"].to_numpy(), t["v"].combine_chunks()
        x = v.values.to_numpy().reshape(len(row), -1)[:] if len(row) else np.empty((0, 0), np.int64)
        qs, xs = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(qs) and len(xs) and x.shape[1]:
            xs = xs[np.lexsort((row[xs], ids[xs]))]
            # Doubles hold the sums exactly below 2**53, and are multiplied faster.
            small = float(np.abs(x).max()) ** 2 * x.shape[1] < 2**53
            kind = np.float64 if small else np.int64
            number, place, score = search(x[qs].astype(kind), row[qs], x[xs].astype(kind), row[xs], ids[xs], k)
            found = qs[number], ids[xs][place], score.astype(np.int64)
        return pa.table([pa.array(row[found[0]]), pa.array(ids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["query_row", "query_id", "vec_id", "score"])

    schema = "query_row long, query_id long, vec_id long, score long"
    by_group = rows.unionByName(queries).filter("dim > 0").groupBy("g", "c", "dim").applyInArrow(best, schema)
    ranked = by_group.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS query_row, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.r <> x.r AND len(q.v) = len(x.v) WHERE q.vec_id % {QUERY_EVERY} = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= {K}"""

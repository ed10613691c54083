"""Exact search for the largest inner products by columnar branch and bound.

Vectors are stored dimension by dimension. Scores grow by one block of dimensions at a time; after each, the norms
of what is left of query and candidate bound the rest of the score, and candidates that can no longer
be among the best are dropped by compacting the columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIMENSIONS = 16
#: Rows that one task compares: so many queries with so many candidates, on average.
QUERIES = 512
CANDIDATES = 8_192


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = DIMENSIONS):
    """For each query (row of integers) the ``k`` best candidates other than its own id, as (query id, id, score) arrays."""
    dims = vectors.shape[1]
    most = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(dims, 1)
    if most >= 1 << 53:
        # beyond the exact integers of doubles: whole scores in exact arithmetic
        vectors, queries = vectors.astype(object), queries.astype(object)
        starts = [0]
    else:
        vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
        starts = list(range(0, dims, block)) or [0]
    columns = np.ascontiguousarray(vectors.T)
    size = block if len(starts) > 1 else max(dims, 1)
    rest = [np.sqrt((columns[at + size :].astype(np.float64) ** 2).sum(axis=0)) for at in starts]
    out: tuple[list, list, list] = ([], [], [])
    for q, own in zip(queries, query_ids):
        alive = np.flatnonzero(ids != own)
        score = np.zeros(len(alive), dtype=columns.dtype)
        for at, left in zip(starts, rest):
            score = score + q[at : at + size] @ columns[at : at + size, alive]
            if at == starts[-1] or len(alive) <= k:
                continue
            # rounding of the norms never cuts off a true candidate
            bound = math.sqrt(float((q[at + size :] ** 2).sum())) * left[alive] * (1 + 1e-9) + 1e-6
            least = np.partition(score - bound, len(alive) - k)[len(alive) - k]
            keep = score + bound >= least
            alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        out[0].append(np.full(len(order), own))
        out[1].append(ids[alive[order]])
        out[2].append(np.clip(score[order], -(1 << 63), (1 << 63) - 1).astype(np.int64) if len(order) else np.zeros(0, np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy() if len(column) else np.zeros(0, np.int64)
    return flat.reshape(len(column), -1 if len(flat) else 0)


def integer_top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, queries_per_task: int = QUERIES, candidates_per_task: int = CANDIDATES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` best rows for each row where ``is_query`` holds.

    ``vectors`` has ``vec_id`` and ``embedding``; components count as floor(scale * x). Rows with a null id,
    a null vector, or a null or non-finite component take no part. Vectors are compared with those of their own length. Rows of the query's own id
    are no candidates. Repeated equal rows count once. Ties go to the smaller id. Scores outside 64 bits are cut to them.

    Queries and candidates meet in a grid of tasks of bounded size, every pair once; each task returns
    ``k`` rows per query, which are ranked again.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("q")).distinct()
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    down, across = max(1, math.ceil(asked / queries_per_task)), max(1, math.ceil(n / candidates_per_task))
    place = F.xxhash64("vec_id", F.lit(3))
    dim = F.size("v").alias("dim")
    left = rows.where("q").select("vec_id", "v", dim, F.pmod(place, F.lit(down).cast("long")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("j"))
    right = rows.select("vec_id", "v", dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("i"), F.pmod(place, F.lit(across).cast("long")).alias("j"))

    def compared(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = candidates["vec_id"].to_numpy() if candidates.num_rows else np.zeros(0, np.int64)
        if not len(ids) or not queries.num_rows:
            found = (np.zeros(0, np.int64),) * 3
        else:
            found = best_of_block(_matrix(queries["v"]), queries["vec_id"].to_numpy(), _matrix(candidates["v"]), ids, k)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    keys = ["dim", "i", "j"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compared, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integer_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

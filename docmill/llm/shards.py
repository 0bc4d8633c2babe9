"""Vector searches of a stated query set against all rows, in shards and query blocks.

Rows are dealt into shards of about ``SHARD_ROWS`` by a hash of their id, queries into blocks of about
``BLOCK_QUERIES``; each (shard, block) tile is one bounded group, whatever vectors are common. Of
rows with one and the same vector only the k + 1 smallest ids can be among a query's k nearest
(one may be the query itself), so more are left out first; Spark limits each group before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
BLOCK_QUERIES = 2048


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite components, as doubles."""
    finite = F.forall(F.col(vec_col), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def search(rows: DataFrame, is_query, k: int, score_type: str, within: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """rows: (id, v). within(ids, X, query_ids, Q, k) gives (query index, row index, score) with each
    query's k best rows of the tile at least, ties included, its own id left out. Vectors of unequal length do not meet.
    Returns query_id, rank, vec_id, score."""
    ranked = Window.partitionBy("v").orderBy("id")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    kept = rows.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1).drop("_r")
    queries = rows.where(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    shards, blocks = max(1, math.ceil(n_rows / SHARD_ROWS)), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    dim = F.size("v").alias("dim")
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = kept.select("id", "v", dim, deal(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("id", "v", dim, deal(blocks, 2).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    kind = pa.float64() if score_type == "double" else pa.int64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def tile(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        d = key[0].as_py()
        ids, qids = (np.asarray(t.column("id").to_numpy(), np.int64) for t in (a, b))
        order = np.argsort(ids)
        q, r, s = within(ids[order], matrix(a.column("v"), d)[order], qids, matrix(b.column("v"), d), k)
        return pa.table([pa.array(qids[q]), pa.array(ids[order][r]), pa.array(s, kind)], schema=schema)

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(tile, f"query_id bigint, vec_id bigint, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def keep_best(q: np.ndarray, r: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, row, score) triples, repeats allowed: each query's k best, and what ties with the last, by row order."""
    order = np.lexsort((r, -s, q))
    q, r, s = q[order], r[order], s[order]
    if len(q):
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1])
        q, r, s = q[new], r[new], s[new]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < k
        q, r, s = q[top], r[top], s[top]
    return q, r, s

"""Approximate nearest neighbours by cross-polytope hashing (operator 2).

In each table three rounds of random signs and a fast Hadamard transform rotate the unit vectors,
and a vector's bucket is the nearest signed axis. A query probes the ``PROBES`` nearest axes of every
table, the rows in those buckets are its candidates, and candidates are ranked by the exact inner product
in double precision. Rows live in bounded shards (docmill.llm.shards), each with its own tables, so that
no bucket of a common direction becomes one large group. Recall against brute force is in the README.

Cases: rows without id, null, zero or empty vectors and vectors with null or non-finite components take
no part; repeated rows count once, and an id with several vectors takes part with the least of them; ties go to the smaller id; fewer candidates than k give
fewer results; vectors are hashed by direction, whatever their length; no queries or an empty table give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base, shards

TABLES = 12
PROBES = 10
SEED = 7


def rotate(x: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """A pseudo-random rotation of the rows of x, padded to a power of two."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((x.shape[0], d))
    y[:, : x.shape[1]] = x
    signs = np.random.RandomState(seed * 1000 + table).choice([-1.0, 1.0], (3, d))
    for s in signs:
        y *= s
        h = 1
        while h < d:
            z = y.reshape(-1, d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(-1, d)
            h *= 2
        y /= np.sqrt(d)
    return y


def within(ids, x, qids, q, k, tables: int = TABLES, probes: int = PROBES):
    """Candidates of one tile from all tables, ranked exactly (see shards.search)."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    ux, uq = unit(x), unit(q)
    none = np.zeros(0, np.int64)
    best = (none, none, np.zeros(0))
    spare = k + 9  # itself, and some that rounding may put in another order than the exact scores
    worst = np.full(len(q), -np.inf)
    for t in range(tables):
        rx, rq = rotate(ux, t), rotate(uq, t)
        d = rx.shape[1]
        axis = np.abs(rx).argmax(axis=1)
        bucket = np.where(rx[np.arange(len(rx)), axis] >= 0, axis, axis + d)
        near = np.argsort(-np.concatenate([rq, -rq], axis=1), axis=1, kind="stable")[:, :probes]
        members = np.argsort(bucket, kind="stable")
        from_ = np.searchsorted(bucket[members], np.arange(2 * d + 1))
        probing = np.argsort(near.ravel(), kind="stable")
        asked = np.searchsorted(near.ravel()[probing], np.arange(2 * d + 1))
        who = probing // near.shape[1]
        met = [best]
        for b in np.flatnonzero((np.diff(from_) > 0) & (np.diff(asked) > 0)):
            rows, qs = members[from_[b] : from_[b + 1]], who[asked[b] : asked[b + 1]]
            score = q[qs] @ x[rows].T
            i, c = np.nonzero(score >= worst[qs][:, None])
            met.append((qs[i], rows[c], score[i, c]))
        i, c, score = (np.concatenate(m) for m in zip(*met, strict=True))
        pair, first = np.unique(i * len(x) + c, return_index=True)  # a row met in several tables counts once
        best = shards.keep_best(pair // len(x), pair % len(x), score[first], spare)
        last = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= spare)
        worst[last] = best[2][np.searchsorted(best[0], last, side="right") - 1]
        worst[last] -= 1e-9 * (1 + np.abs(worst[last]))
    i, c = best[0], best[1]
    other = qids[i] != ids[c]
    i, c = i[other], c[other]
    # one order of summation for every pair, so that equal vectors tie exactly
    return shards.keep_best(i, c, np.einsum("ij,ij->i", q[i], x[c]), k)


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a predicate on column id)."""
    rows = shards.usable(df, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    return shards.search(rows, is_query, k, "double", within)


def op2_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(_base.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)

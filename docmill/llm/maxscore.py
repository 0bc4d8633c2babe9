"""Exact top-k search by MaxScore (operator 9).

Components are the terms and floor(scale * x) their weights. In each shard every term has a bound, the
most that it can add to a score. Terms whose bounds together cannot reach the k-th
best score known so far are non-essential: a row that gains from none of the others cannot be among the best. The
postings of the essential terms are traversed, strongest first, and the rows met are probed in the remaining
terms only while their score so far plus the bounds of what is left can still compete. The best of all shards are
merged. Sums are exact: doubles as long as they hold every partial sum, Python integers beyond.

Cases: rows without id, null vectors and vectors with null or non-finite components take no part; zero vectors do;
repeated rows count once, and an id with several vectors takes part with the least of them; ties go to the smaller id; fewer candidates than k give fewer results; no
queries or an empty table give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base, shards

SCALE = 256
#: Terms probed between two looks at who can still compete.
STEP = 8


def within(ids, x, qids, q, k):
    """Each query's k best rows of one tile (see shards.search)."""
    if x.size and q.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= 2.0**53:
        x, q = (np.array([[int(v) for v in row] for row in m], object) for m in (x, q))
    n = len(x)
    postings = np.ascontiguousarray(x.T)
    most, least = postings.max(axis=1, initial=0), postings.min(axis=1, initial=0)
    out = []
    for j in range(len(q)):
        w = q[j]
        bound = np.maximum(w * most, w * least)
        terms = np.argsort(-bound.astype(np.float64), kind="stable")
        terms = terms[w[terms] != 0]
        own = np.searchsorted(ids, qids[j])
        own = own if own < n and ids[own] == qids[j] else -1
        floor_ = None
        if len(terms) and n > 4 * k:  # a first threshold: rows with the strongest postings of the strongest term
            first = np.argpartition(-(w[terms[0]] * postings[terms[0]]).astype(np.float64), 3 * k)[: 3 * k]
            first = first[first != own]
            sample = np.sort((x[first] * w).sum(axis=1))
            floor_ = sample[-k] if len(sample) >= k else None
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # rest[i]: bounds of terms i and later
        essential = int(np.searchsorted(-rest, -floor_, side="right")) if floor_ is not None and floor_ > 0 else len(terms)
        if floor_ is not None and floor_ > 0:
            gains = np.zeros(n, bool)
            for t in terms[:essential]:
                gains |= (postings[t] > 0) if w[t] > 0 else (postings[t] < 0)
                if gains.all():
                    break
            rows = np.flatnonzero(gains)
        else:
            rows = np.arange(n)
        rows = rows[rows != own]
        score = np.zeros(len(rows), x.dtype)
        for i in range(0, len(terms), STEP):
            part = terms[i : i + STEP]
            score = score + w[part] @ postings[part][:, rows]
            if floor_ is not None:
                alive = score + rest[min(i + STEP, len(terms))] >= floor_
                rows, score = rows[alive], score[alive]
        if len(rows) > k:
            top = score >= np.sort(score)[-k]
            rows, score = rows[top], score[top]
        out.append((np.full(len(rows), j), rows, score))
    q_at, r_at, s = (np.concatenate(c) for c in zip(*out, strict=True))
    return shards.keep_best(q_at, r_at, s.astype(np.int64), k)


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each row for which is_query."""
    rows = shards.usable(df, id_col, vec_col).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return shards.search(rows, is_query, k, "bigint", within)


def op9_maxscore(spark, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose id is divisible by 50."""
    return top_k(_base.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

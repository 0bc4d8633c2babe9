"""Toxicity by cumulative-link ordinal regression (operator 10).

A document's sparse features are its lower-cased words and, for their inflected and compounded forms, word
beginnings with a class of word length, hashed into ``BUCKETS`` and weighted by log(1 + count). One weight vector is
shared by all ordered thresholds: P(grade > j) = logistic(w . x - threshold_j). The output is the expected
severity, sum over j of P(grade > j). The grades are those of the label column, 0 to the largest found.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents (those of the smallest hashes of
their ids, and never ids whose crc32 mod 5 is 0, which are held out); documents are scored in one pass without a shuffle.

Cases: null and empty texts have no features and get the base severity; labels that are null or negative are
left out; several labels of one id count as the largest; without any labels (or with one grade only) every severity is
that grade, or 0; empty tables give empty results; columns that clash with outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base, optim

BUCKETS = 1 << 19
SAMPLE = 8000
#: Bytes of text that the sample may have.
SAMPLE_BYTES = 64 << 20
LEAST_DOCS = 5
L2 = 0.002
THRESHOLD = 0.2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_GAP = np.ones(256, bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _IS_GAP[list(_r)] = False
#: Word beginnings of so many bytes are features, with the class of the word's length.
BEGINNINGS = (4, 6, 7)
LENGTH_CLASSES = np.array([6, 9, 12, 16])


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of each non-zero feature, rows in order."""
    data, begins = _base.concat_texts(texts)
    starts, ends = _base.spans(_IS_GAP[data])
    row = np.searchsorted(begins, starts, side="right") - 1
    folded = _FOLD[data]
    n = ends - starts
    kind = np.searchsorted(LENGTH_CLASSES, n, side="right").astype(np.uint64)
    hashes, rows = [_base.word_hashes(folded, starts, ends)], [row]
    for k in BEGINNINGS:
        long = np.flatnonzero(n > k)
        h = _base.word_hashes(folded, starts[long], starts[long] + k)
        hashes.append(_base.mix64(h + np.uint64(k << 32) + kind[long]))
        rows.append(row[long])
    key = np.concatenate(rows).astype(np.uint64) * np.uint64(buckets) + np.concatenate(hashes) % np.uint64(buckets)
    key, count = np.unique(key, return_counts=True)
    return (key // np.uint64(buckets)).astype(np.int64), (key % np.uint64(buckets)).astype(np.int64), np.log1p(count)


@dataclass
class Ordinal:
    weights: np.ndarray  # by bucket, float32
    thresholds: np.ndarray  # ascending; none: one grade only
    base: float = 0.0  # severity without a model

    def severity(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.thresholds):
            return np.full(len(texts), self.base)
        row, bucket, weight = features(texts, len(self.weights))
        score = np.bincount(row, self.weights[bucket] * weight, minlength=len(texts))
        return _logistic(score[:, None] - self.thresholds[None, :]).sum(axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: np.ndarray, buckets_of: np.ndarray, weights_of: np.ndarray, grades: np.ndarray, buckets: int = BUCKETS, l2: float = L2) -> Ordinal:
    """Penalised maximum likelihood; features of fewer than LEAST_DOCS documents get no weight."""
    levels = int(grades.max()) if len(grades) else 0
    if levels < 1 or len(np.unique(grades)) < 2:
        return Ordinal(np.zeros(buckets, np.float32), np.zeros(0), float(grades.max()) if len(grades) else 0.0)
    docs = np.bincount(buckets_of, minlength=buckets)
    used = np.flatnonzero(docs >= LEAST_DOCS)
    place = np.full(buckets, -1, np.int64)
    place[used] = np.arange(len(used))
    keep = place[buckets_of] >= 0
    r, c, v = rows[keep].astype(np.int64), place[buckets_of[keep]], weights_of[keep].astype(np.float32)
    del rows, buckets_of, weights_of, keep
    n = len(grades)
    share = np.array([(grades > j).mean() for j in range(levels)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    start = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    at = np.arange(n)

    def loss(p):
        w, gaps = p[: len(used)], np.exp(p[len(used) + 1 :])
        t = p[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(r, w[c] * v, minlength=n)
        above = np.column_stack([np.ones(n), _logistic(s[:, None] - t), np.zeros(n)])  # P(grade > j - 1)
        here = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        slope = above * (1 - above)
        up, down = slope[at, grades], slope[at, grades + 1]
        ds = -(up - down) / here
        dt = np.zeros((n, levels + 2))
        dt[at, grades] += up / here
        dt[at, grades + 1] -= down / here
        dt = dt.sum(axis=0)[1:-1]
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([np.bincount(c, ds[r] * v, minlength=len(used)) + l2 * n * w / 100, tail[:1], tail[1:] * gaps])
        return -np.log(here).sum() + 0.5 * l2 * n / 100 * (w @ w), grad

    p = optim.minimise(loss, start, 100)
    weights = np.zeros(buckets, np.float32)
    weights[used] = p[: len(used)]
    return Ordinal(weights, p[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def held_out(id_col):
    """Whether an id is kept for testing: crc32 of its text mod 5 is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Ordinal:
    """Fit on a sample of at most so many labelled documents and so many bytes of text; its features, not its texts, come to the driver."""
    graded = labels.where((F.col(grade_col) >= 0) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(grade_col).cast("int").alias("_grade"))
    chosen = graded.orderBy(F.xxhash64(F.col(id_col), F.lit(1)), id_col).limit(sample)
    texts = _base.sampled(docs, chosen, id_col, text_col, sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, "_text"):
            row, bucket, weight = features(_base.texts_bytes(batch.column(1)))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.float32)))], ["g", "b", "w"])

    got = texts.mapInArrow(run, "g int, b array<int>, w array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0), np.zeros(0, np.int64))
    lists = got.column("b").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lambda name: pa.concat_arrays([c.flatten() for c in got.column(name).chunks]).to_numpy(zero_copy_only=False)
    buckets, weights, grades = flat("b"), flat("w"), got.column("g").to_numpy().astype(np.int64)
    del got, lists  # the driver's memory holds one form of the sample at a time
    return fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), buckets, weights, grades)


def score(docs: DataFrame, model: Ordinal, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with severity (0 to the highest grade) and is_toxic (severity is at least the threshold)."""
    outputs = ("severity", "is_toxic")
    kept = [c for c in docs.columns if c not in outputs]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, text_col):
            severity = sent.value.severity(_base.texts_bytes(batch.column(batch.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(severity), pa.array(severity >= threshold)], [*kept, *outputs])

    return docs.select(*kept).mapInArrow(run, f"{types}, severity double, is_toxic boolean")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _base.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "is_toxic")

"""Document quality by a linear-chain conditional random field over lines (operator 8).

Every line with a word gets a label, good or bad, from features of its own and of its neighbouring lines; the chain's
transition weights tie neighbours together. Forward-backward gives each line's marginal probability of
being good, and the document's score is their mean, weighted by the lines' lengths in words. There are no line labels to learn
from, so each line takes its document's label (0 bad, 1 good) while fitting.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents (those of the smallest hashes of their
ids, and never ids whose crc32 mod 5 is 0, which are held out); documents are scored in one pass without a shuffle.

Cases: null and empty texts, and texts without a word, have one empty line; very long texts are scored whole; labels that are
null or not 0 or 1 are left out; several labels of one id count as the least; with no labels, or only one kind, every score is 0.5,
or that label; empty tables give empty results; columns that clash with outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base, optim

SAMPLE = 6000
#: Bytes of text that the sample may have.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3
L2 = 1e-3
_CLASS = np.zeros(256, np.uint8)  # 0 white space or control, 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 other ASCII sign, 6 beyond ASCII
_CLASS[33:127] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
OWN = 16


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines with words (or one empty line for a text without): features, words, and lines per text."""
    data, begins = _base.concat_texts(texts)
    starts, ends = _base.spans(_base.IS_SPACE[data])
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, starts)  # a text's end is a break too
    new = np.ones(len(starts), bool)
    new[1:] = line_of[1:] != line_of[:-1]
    first = np.flatnonzero(new)  # first word of each line
    n = np.diff(np.append(first, len(starts)))
    text_of = np.searchsorted(begins, starts[first], side="right") - 1 if len(first) else np.zeros(0, np.int64)
    per_text = np.bincount(text_of, minlength=len(texts))
    a, b = (starts[first], ends[first + n - 1]) if len(first) else (first, first)
    size = np.maximum(b - a, 1).astype(np.float64)
    kinds = _CLASS[data]
    share = []
    for c in (1, 2, 3, 4, 5, 6):
        total = np.concatenate([[0], np.cumsum(kinds == c)])
        share.append((total[b] - total[a]) / size)
    words = _base.word_hashes(_FOLD[data], starts, ends)
    length = (ends - starts).astype(np.float64)
    last_sign = (kinds[ends - 1] == 5).astype(np.float64) if len(ends) else length
    again = np.zeros(len(words))
    if len(words):
        again[1:] = (words[1:] == words[:-1]) & ~new[1:]
    sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
    of_line = np.repeat(np.arange(len(first)), n)
    pairs = np.lexsort((words, of_line))
    distinct = np.ones(len(words))
    if len(words):
        same = (of_line[pairs][1:] == of_line[pairs][:-1]) & (words[pairs][1:] == words[pairs][:-1])
        distinct[pairs[1:][same]] = 0
    whole = _base.range_hashes(words, first, first + n) if len(first) else np.zeros(0, np.uint64)
    key = np.lexsort((whole, text_of))
    repeat = np.zeros(len(first))
    if len(first):
        same = (text_of[key][1:] == text_of[key][:-1]) & (whole[key][1:] == whole[key][:-1])
        repeat[key[1:][same]] = 1
        repeat[key[:-1][same]] = 1
    mean_length = sums(length) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(sums(length**2) / np.maximum(n, 1) - mean_length**2, 0))
    pipes = np.concatenate([[0], np.cumsum(data == 124)])
    own = np.column_stack([
        np.ones(len(first)), np.log1p(n), mean_length / 10, spread / 5, share[0], share[1], share[2] * 3, share[3] * 5, share[4] * 5, share[5],
        sums(last_sign) / np.maximum(n, 1) * 2, sums(again) / np.maximum(n, 1) * 3, 1 - sums(distinct) / np.maximum(n, 1), (kinds[b - 1] == 4).astype(float) if len(first) else n, repeat, (pipes[b] - pipes[a]) / size * 10,
    ]) if len(first) else np.zeros((0, OWN))
    own = np.clip(own, -5, 5)
    if (per_text == 0).any():  # texts without a word: one empty line each
        order = np.argsort(np.concatenate([text_of, np.flatnonzero(per_text == 0)]), kind="stable")
        empty = np.zeros((int((per_text == 0).sum()), OWN))
        empty[:, 0] = 1
        own = np.concatenate([own, empty])[order]
        n = np.concatenate([n, np.zeros(len(empty), np.int64)])[order]
        per_text = np.maximum(per_text, 1)
    begin = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begin] = 0  # without even the constant: a text's first and last lines know that they are
    after[begin + per_text - 1] = 0
    return np.concatenate([own, before, after], axis=1), n, per_text


def _order(per_text: np.ndarray):
    """Texts longest first, so that step t of the chains is a prefix of them."""
    longest_first = np.argsort(-per_text, kind="stable")
    begin = (np.cumsum(per_text) - per_text)[longest_first]
    ascending = per_text[longest_first][::-1]
    active = [len(per_text) - int(np.searchsorted(ascending, t, side="right")) for t in range(int(per_text.max(initial=0)))]
    return begin, active, per_text[longest_first]


def forward_backward(emit: np.ndarray, move: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Line marginals (n, 2), summed pair marginals (2, 2) and the sum of log partition functions. emit: (n, 2) scores."""
    begin, active, length = _order(per_text)
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    for t, k in enumerate(active):
        at = begin[:k] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            x = alpha[at - 1][:, :, None] + move[None]
            alpha[at] = np.logaddexp(x[:, 0], x[:, 1]) + emit[at]
    for t in range(len(active) - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        x = move[None] + (emit[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    both = alpha + beta
    z = np.logaddexp(both[:, 0], both[:, 1])
    marginal = np.exp(both - z[:, None])
    has_next = np.ones(len(emit), bool)
    has_next[begin + length - 1] = False
    i = np.flatnonzero(has_next)
    pair = np.exp(alpha[i][:, :, None] + move[None] + (emit[i + 1] + beta[i + 1])[:, None, :] - z[i][:, None, None]).sum(axis=0) if len(i) else np.zeros((2, 2))
    return marginal, pair, float(z[begin].sum())


@dataclass
class LineCrf:
    weights: np.ndarray | None  # of a line being good rather than bad; None: no model
    move: np.ndarray | None
    base: float = 0.5

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        x, n, per_text = line_features(texts)
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ self.weights
        good = forward_backward(emit, self.move, per_text)[0][:, 1]
        weight = np.maximum(n, 1).astype(np.float64)
        begin = np.cumsum(per_text) - per_text
        return (np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)).clip(0, 1)


def fit(x: np.ndarray, words: np.ndarray, per_text: np.ndarray, label: np.ndarray, l2: float = L2) -> LineCrf:
    """Penalised conditional likelihood; each document counts once, however many lines it has."""
    if not len(label) or len(np.unique(label)) < 2:
        return LineCrf(None, None, float(label[0]) if len(label) else 0.5)
    y = np.repeat(label, per_text)
    d, n = x.shape[1], len(label)
    has_next = np.ones(len(x), bool)
    has_next[np.cumsum(per_text) - 1] = False
    i = np.flatnonzero(has_next)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[i], y[i + 1]), 1)
    seen = x.T @ y

    def loss(p):
        w, move = p[:d], np.array([[p[d], 0.0], [0.0, p[d + 1]]])
        emit = np.zeros((len(x), 2))
        emit[:, 1] = x @ w
        marginal, pair, z = forward_backward(emit, move, per_text)
        ll = emit[np.arange(len(y)), y].sum() + (seen_pairs * move).sum() - z
        g = np.concatenate([seen - x.T @ marginal[:, 1], [seen_pairs[0, 0] - pair[0, 0], seen_pairs[1, 1] - pair[1, 1]]])
        return -ll / n + 0.5 * l2 * (p @ p), -g / n + l2 * p

    p = optim.minimise(loss, np.zeros(d + 2), 80)
    return LineCrf(p[:d], np.array([[p[d], 0.0], [0.0, p[d + 1]]]))


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> LineCrf:
    """Fit on a sample of at most so many labelled documents and so many bytes of text; its features, not its texts, come to the driver."""
    marked = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    chosen = marked.orderBy(F.xxhash64(F.col(id_col), F.lit(2)), id_col).limit(sample)
    texts = _base.sampled(docs, chosen, id_col, text_col, sample_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, "_text"):
            x, words, per_text = line_features(_base.texts_bytes(batch.column(1)))
            x = x[:, :OWN].astype(np.float32)  # neighbours are put back together on the driver
            ends = np.cumsum(per_text)
            lists = lambda flat, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.ravel(), ends * OWN), lists(words.astype(np.int32), ends)], ["g", "x", "n"])

    got = texts.mapInArrow(run, "g int, x array<float>, n array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return LineCrf(None, None)
    flat = lambda name: pa.concat_arrays([c.flatten() for c in got.column(name).chunks]).to_numpy(zero_copy_only=False)
    per_text = np.concatenate([np.diff(c.offsets.to_numpy()) for c in got.column("n").chunks]).astype(np.int64)
    own = flat("x").reshape(-1, OWN).astype(np.float64)
    begin = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begin] = 0
    after[begin + per_text - 1] = 0
    return fit(np.concatenate([own, before, after], axis=1), flat("n"), per_text, got.column("g").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: LineCrf, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if the score is at least the threshold)."""
    outputs = ("score", "predicted")
    kept = [c for c in docs.columns if c not in outputs]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, text_col):
            s = sent.value.score(_base.texts_bytes(batch.column(batch.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*kept, *outputs])

    return docs.select(*kept).mapInArrow(run, f"{types}, score double, predicted int")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _base.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""LM scoring by subword lattice likelihood (operator 5).

Pieces come from an existing public vocabulary. Its scores weight all segmentations: they give each piece its starting weight, and as
``PRIOR`` counts they stay part of the weights after ``ROUNDS`` of expectation and maximisation over all training tokens (every distinct word, as
often as it occurs). A word's probability is the sum over all its segmentations, by a forward recursion in log space over its
bytes: a piece that begins a word, then continuing pieces (single bytes among them, so that any word has a segmentation), then a stop. A
text is words until its end: each token is the end with its relative frequency, else a word. A document's log10 probability is the sum over its words and its
end. Every word, seen in training or not, is scored by the lattice; vocabulary_score is the same with the vocabulary's own weights alone.

Counts cover all training documents. Words are looked up in two ways: the most frequent ones (at most ``HEAD_WORDS``) of at most ``HEAD_BYTES`` bytes
(a proven bound) are sent to all tasks; what a document has besides is joined by word.

Cases: null text counts as empty and has the end token only; words of any length are scored, long ones in segments of ``SEGMENT`` bytes with the last forward values carried over (learning from
one keeps a forward value a byte); documents without id count as
training documents; repeated rows count and are returned as often as they are there; without training documents N and V are 0 and only
the vocabulary's own weights score (an end token then has probability one half); empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base

HEAD_WORDS = 300_000
HEAD_BYTES = 64
#: Distinct words a task counts before it hands them on.
COUNTED_WORDS = 400_000
#: So many counts are dealt among the pieces by the vocabulary's scores, beside those from the corpus.
PRIOR = 1000.0
ROUNDS = 2
#: Longer words are worked on in segments.
SEGMENT = 1 << 14
MARK = "▁".encode()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces as a trie over bytes, as arrays. Pieces 0..255 are the single bytes."""

    _loaded: dict[str, "Pieces"] = {}

    @classmethod
    def load(cls, path: str) -> "Pieces":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [bytes([b]) for b in range(256)]
        weights = [1e-6] * 256
        known = set(names)
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).encode()
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or piece.rfind(MARK) > 0 or piece in known:
                if len(piece) == 1:
                    weights[piece[0]] = 1.0 / (1.0 + abs(model.get_score(i)))
                continue
            known.add(piece)
            names.append(piece)
            weights.append(1.0 / (1.0 + abs(model.get_score(i))))
        self.names = names
        self.most = max(map(len, names))
        self.begins = np.array([n.startswith(MARK) for n in names])
        self.start_weights = np.array(weights)
        used = sorted({b for n in names for b in n})
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(len(used))
        width = len(used)
        nodes: list[dict[int, int]] = [{}]
        piece_at = [-1]
        for k, name in enumerate(names):
            at = 0
            for b in name:
                to = nodes[at].get(b)
                if to is None:
                    to = nodes[at][b] = len(nodes)
                    nodes.append({})
                    piece_at.append(-1)
                at = to
            piece_at[at] = k
        self.width = width
        self.next = np.full(len(nodes) * width, -1, np.int32)
        for at, children in enumerate(nodes):
            for b, to in children.items():
                self.next[at * width + self.symbol[b]] = to
        self.piece_at = np.array(piece_at, np.int32)

    def log_weights(self, counts: np.ndarray | None = None, words: float = 0.0) -> tuple[np.ndarray, float, float]:
        """Log probability of each piece among its kind (beginning or continuing), and of going on and stopping."""
        if counts is None:
            counts, stop = self.start_weights, 0.25
        else:
            stop = (words + 1) / (words + 2 + counts[~self.begins].sum())
            counts = counts + PRIOR * self.start_weights / self.start_weights.sum()
        out = np.log(counts)
        for kind in (self.begins, ~self.begins):
            out[kind] -= np.log(counts[kind].sum())
        return out, float(np.log1p(-stop)), float(np.log(stop))


def _logsumexp(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[:, None]).sum(axis=1)) + safe


def _matches(pieces: Pieces, data: np.ndarray, offset: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces in the rows of data (words of one length, marked, from place offset on): row, begin, end, piece. Beginning pieces only at 0, others elsewhere."""
    n, length = data.shape
    symbols = pieces.symbol[data].ravel()
    begin = np.tile(np.arange(length), n)
    at = np.flatnonzero((begin + offset == 0) | (begin + offset >= len(MARK)))
    state = np.zeros(len(at), np.int64)
    found = []
    step = 0
    while len(at):
        state = pieces.next[state * pieces.width + symbols[at + step]].astype(np.int64)
        live = state >= 0
        at, state = at[live], state[live]
        step += 1
        piece = pieces.piece_at[state]
        hit = np.flatnonzero(piece >= 0)
        hit = hit[pieces.begins[piece[hit]] == (begin[at[hit]] + offset == 0)]
        found.append((at[hit] // length, begin[at[hit]] + offset, begin[at[hit]] + offset + step, piece[hit]))
        inside = begin[at] + step < length
        at, state = at[inside], state[inside]
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def _forward(row, begin, end, weight, n: int, length: int) -> np.ndarray:
    """Log sums over all paths from 0 to each place."""
    most = int((end - begin).max())
    arcs = np.full((n, length + 1, most + 1), -np.inf)
    arcs[row, end, end - begin] = weight
    alpha = np.full((n, length + 1), -np.inf)
    alpha[:, 0] = 0
    for j in range(len(MARK), length + 1):
        k = min(j, most)
        alpha[:, j] = _logsumexp(alpha[:, j - k : j][:, ::-1] + arcs[:, j, 1 : k + 1])
    return alpha


def _backward(row, begin, end, weight, n: int, length: int) -> np.ndarray:
    most = int((end - begin).max())
    arcs = np.full((n, length + 1, most + 1), -np.inf)
    arcs[row, begin, end - begin] = weight
    beta = np.full((n, length + 1), -np.inf)
    beta[:, length] = 0
    for i in range(length - 1, -1, -1):
        k = min(length - i, most)
        beta[:, i] = _logsumexp(beta[:, i + 1 : i + k + 1] + arcs[:, i, 1 : k + 1])
    return beta


def _segment(pieces: Pieces, data: np.ndarray, lo: int, hi: int):
    """Matches (begin, end, piece) of one long word that end after lo, at hi at most."""
    from_ = max(0, lo - pieces.most)
    _, begin, end, piece = _matches(pieces, data[None, from_:hi], from_)
    good = end > lo
    return begin[good], end[good], piece[good]


def _long_forward(pieces: Pieces, data: np.ndarray, log_p: np.ndarray, go: float, all_: bool = False) -> np.ndarray:
    """The forward values of one long word: all of them, or the last ones only."""
    most, length = pieces.most, len(data)
    carried = np.full(most, -np.inf)  # the values at lo - most + 1 .. lo
    carried[-1] = 0
    kept = [carried[-1:]]
    for lo in range(0, length, SEGMENT):
        hi = min(length, lo + SEGMENT)
        begin, end, piece = _segment(pieces, data, lo, hi)
        arcs = np.full((hi - lo, most), -np.inf)
        arcs[end - lo - 1, most - (end - begin)] = log_p[piece] + np.where(begin > 0, go, 0.0)
        alpha = np.concatenate([carried, np.full(hi - lo, -np.inf)])
        for j in range(hi - lo):
            if lo + j + 1 >= len(MARK):
                x = alpha[j : j + most] + arcs[j]
                top = x.max()
                if top > -np.inf:
                    alpha[j + most] = np.log(np.exp(x - top).sum()) + top
        carried = alpha[-most:]
        if all_:
            kept.append(alpha[most:])
    return np.concatenate(kept) if all_ else carried[-1:]


def _long_counts(pieces: Pieces, data: np.ndarray, log_p: np.ndarray, go: float) -> np.ndarray:
    """Expected uses of each piece in one long word, from its last segment to the first."""
    most, length = pieces.most, len(data)
    alpha = _long_forward(pieces, data, log_p, go, True)
    out = np.zeros(len(pieces.names))
    beta = np.full(length + 1 + most, -np.inf)
    beta[length] = 0
    for lo in range((length - 1) // SEGMENT * SEGMENT, -1, -SEGMENT):  # arcs that begin at lo .. hi - 1
        hi = min(length, lo + SEGMENT)
        _, begin, end, piece = _matches(pieces, data[None, lo : min(length, hi + most)], lo)
        good = begin < hi
        begin, end, piece = begin[good], end[good], piece[good]
        weight = log_p[piece] + np.where(begin > 0, go, 0.0)
        arcs = np.full((hi - lo, most), -np.inf)
        arcs[begin - lo, end - begin - 1] = weight
        for i in range(hi - 1, lo - 1, -1):
            x = beta[i + 1 : i + 1 + most] + arcs[i - lo]
            top = x.max()
            if top > -np.inf:
                beta[i] = np.log(np.exp(x - top).sum()) + top
        out += np.bincount(piece, np.exp(alpha[begin] + weight + beta[end] - alpha[length]), minlength=len(out))
    return out


def _by_length(words: list[bytes]):
    """Groups of words of one length: indices and the marked bytes, in pieces of bounded size."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        if not len(group):
            continue
        size = int(sizes[group[0]])
        step = max(1, 60_000 // (size + len(MARK)))
        for at in range(0, len(group), step):
            part = group[at : at + step]
            data = np.frombuffer(b"".join(MARK + words[i] for i in part.tolist()), np.uint8).reshape(len(part), size + len(MARK))
            yield part, data


Weights = tuple[np.ndarray, float, float]


def word_scores(pieces: Pieces, words: list[bytes], *weights: Weights) -> list[np.ndarray]:
    """Natural log of each word's probability, over all segmentations, under each of the weights."""
    out = [np.zeros(len(words)) for _ in weights]
    for part, data in _by_length(words):
        if data.shape[1] > SEGMENT:
            for scores, (log_p, go, stop) in zip(out, weights, strict=True):
                scores[part] = [_long_forward(pieces, one, log_p, go)[0] + stop for one in data]
            continue
        row, begin, end, piece = _matches(pieces, data)
        for scores, (log_p, go, stop) in zip(out, weights, strict=True):
            scores[part] = _forward(row, begin, end, log_p[piece] + np.where(begin > 0, go, 0.0), len(part), data.shape[1])[:, -1] + stop
    return out


def expected_counts(pieces: Pieces, words: list[bytes], counts: np.ndarray, weights: Weights) -> np.ndarray:
    """Expected number of times that each piece is used in these words, each counted so many times."""
    log_p, go, _ = weights
    out = np.zeros(len(pieces.names))
    for part, data in _by_length(words):
        n, length = data.shape
        if length > SEGMENT:
            for i, one in zip(part.tolist(), data, strict=True):
                out += counts[i] * _long_counts(pieces, one, log_p, go)
            continue
        row, begin, end, piece = _matches(pieces, data)
        weight = log_p[piece] + np.where(begin > 0, go, 0.0)
        alpha, beta = _forward(row, begin, end, weight, n, length), _backward(row, begin, end, weight, n, length)
        share = np.exp(alpha[row, begin] + weight + beta[row, end] - alpha[row, -1])
        out += np.bincount(piece, share * counts[part][row], minlength=len(out))
    return out


def held_out(id_col):
    """Whether an id is not learned from: crc32 of its text mod 5 is 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 1, F.lit(False))


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_base.LOWER).split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c, a) from (_text, _held): how often a token is in training documents and in all; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter = Counter()
        other: Counter = Counter()

        def out():
            words = list(learned.keys() | other.keys())
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                c = np.array([learned[w] for w in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array(c), pa.array(c + np.array([other[w] for w in part], np.int64))], ["word", "c", "a"])

        for batch in _base.chunks(batches, "_text"):
            for text, held in zip(_base.texts_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counter = other if held else learned
                counter.update(_tokens(text))
                counter[b""] += 1
            if len(learned) + len(other) > COUNTED_WORDS:
                yield from out()
                learned.clear()
                other.clear()
        yield from out()

    return docs.mapInArrow(run, "word string, c bigint, a bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def _expected(words: DataFrame, path: str, weights: Weights) -> DataFrame:
    """(piece, n): how often each piece is expected in these words (word, c); piece -1 counts the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        out, seen = np.zeros(len(pieces.names)), 0.0
        for batch in _base.chunks(batches, "word", 1 << 18):
            counts = batch.column(1).to_numpy().astype(np.float64)
            out += expected_counts(pieces, _base.texts_bytes(batch.column(0)), counts, weights)
            seen += counts.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(out))), pa.array(np.concatenate([[seen], out]))], ["piece", "n"])

    return words.mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n"))


#: What is known of a word and added up over a document.
_TERMS = ("known", "base", "lp", "fixed")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score) of every document."""
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    text, id_ = _base.text_or_empty(text_col), F.col(f"`{id_col}`")
    keyed = docs.select(text.alias("_text"), held_out(id_).alias("_held"), id_.alias("_id"), F.xxhash64(text).alias("_th"))
    words = _base.settle(count_words(keyed.select("_text", "_held")), "lm-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = int(total["n"]), int(total["v"]), int(total["ends"])
    log_end, log_word = (float(np.log((x + 0.5) / (n + 1))) for x in (ends, n - ends))

    pieces = Pieces.load(path)
    fixed = weights = pieces.log_weights()
    for _ in range(ROUNDS if n else 0):
        counted = np.zeros(len(pieces.names) + 1)  # one row for each piece reaches the driver
        for r in _expected(words.where("c > 0 and word != ''").select("word", "c"), path, weights).toArrow().to_pylist():
            counted[r["piece"] + 1] = r["n"]
        weights = pieces.log_weights(counted[1:], counted[0])

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(path)
        for batch in _base.chunks(batches, "word", 1 << 18):
            w, c = _base.texts_bytes(batch.column(0)), batch.column(1).to_numpy().astype(np.float64)
            plain = np.array([len(x) > 0 for x in w])
            lp = [np.full(len(w), log_end), np.full(len(w), log_end)]
            for all_, found in zip(lp, word_scores(pieces, [x for x in w if x], weights, fixed), strict=True):
                all_[plain] = found + log_word
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((c > 0).astype(np.float64)), pa.array(base), *(pa.array(x / np.log(10)) for x in lp), batch.column(2)], ["word", *_TERMS, "a"])

    doubles = ", ".join(f"{x} double" for x in _TERMS)
    priced = _base.settle(words.mapInArrow(price, f"word string, {doubles}, a bigint"), "lm-priced")
    short = priced.where(F.octet_length("word") <= HEAD_BYTES)
    head = short.where(F.col("a") >= _least_count(short)).select("word", *_TERMS).toArrow().combine_chunks()
    terms = np.column_stack([head.column(x).to_numpy(zero_copy_only=False) for x in _TERMS]).reshape(-1, len(_TERMS))
    sent, key = spark.sparkContext.broadcast((head.column("word").cast(pa.binary()).combine_chunks(), terms)), uuid.uuid4().hex
    id_type = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms = sent.value
        place = _head_places(key, names)
        terms = np.vstack([terms, np.zeros(len(_TERMS))])
        none = len(names)
        for batch in _base.chunks(batches, "_text"):
            rows, rare, tf, sums = [], [], [], []
            for i, text in enumerate(_base.texts_bytes(batch.column(0))):
                tokens = _tokens(text)
                tokens.append(b"")
                at = np.fromiter(map(place.get, tokens, [none] * len(tokens)), np.int64, len(tokens))
                missing = Counter([tokens[k] for k in np.flatnonzero(at == none).tolist()])
                rows.append(i)
                rare.append(None)
                tf.append(len(tokens))
                sums.append(terms[at].sum(axis=0))
                for w, k in missing.items():
                    rows.append(i)
                    rare.append(w)
                    tf.append(k)
                    sums.append(np.zeros(len(_TERMS)))
            at, sums = pa.array(rows, pa.int64()), np.array(sums)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), pa.array(rare, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), *(pa.array(sums[:, k]) for k in range(len(_TERMS)))], ["_id", "_th", "word", "tf", *_TERMS])

    parts = _base.settle(keyed.mapInArrow(read, f"_id {id_type}, _th bigint, word string, tf bigint, {doubles}"), "lm-parts")
    rare = parts.where("word is not null").select("_id", "_th", "word", "tf").join(priced.select("word", *_TERMS), "word")
    rare = rare.groupBy("_id", "_th").agg(*[F.sum(F.col("tf") * F.col(x)).alias(x) for x in _TERMS])
    whole = parts.where("word is null").groupBy("_id", "_th").agg(F.count("*").alias("m"), F.first("tf").alias("n_tokens"), *[F.first(x).alias(x) for x in _TERMS])
    joined = whole.alias("w").join(rare.alias("r"), F.col("w._id").eqNullSafe(F.col("r._id")) & (F.col("w._th") == F.col("r._th")), "left")
    add = lambda x: F.col(f"w.{x}") + F.coalesce(F.col(f"r.{x}") / F.col("m"), F.lit(0.0))  # noqa: E731  m equal rows were added up
    out = joined.select(F.col("w._id").alias(id_col), held_out(F.col("w._id")).alias("held_out"), "n_tokens", F.round(add("known")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), add("base").alias("base_score"), add("lp").alias("score"), add("fixed").alias("vocabulary_score"), F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("_m"))
    return out.drop("_m")


def _least_count(words: DataFrame) -> int:
    """The count from which at most HEAD_WORDS words occur so often: from a histogram of a few hundred steps, so that no task sorts the words."""
    step = F.floor(F.log2(F.col("a").cast("double")) * 8).cast("int")
    room, least = HEAD_WORDS, 1 << 62
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("a").alias("a")).orderBy(F.col("s").desc()).collect():
        if r["n"] > room:
            break
        room, least = room - r["n"], r["a"]
    return least


_places: dict = {}


def _head_places(key, names: pa.Array) -> dict[bytes, int]:
    """The word list as a dictionary, made once in each worker process."""
    if key not in _places:
        _places.clear()
        _places[key] = {w: i for i, w in enumerate(names.to_pylist())}
    return _places[key]


def op5_lattice(spark, sf_dir: str) -> DataFrame:
    """Scores of every whole document."""
    return score(_base.table(spark, sf_dir, "documents").select("doc_id", "text"))

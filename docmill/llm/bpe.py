"""Byte-level BPE encoding and decoding (operator 4), by speculation and verification.

A text is cut into words by the vocabulary's own split pattern. For each distinct word a greedy
longest match over the vocabulary proposes tokens. The proposal is the exact BPE result if and only
if every adjacent pair of tokens is compatible, i.e. the pair is itself the encoding of its joined
bytes; those tests run vectorised over all pairs of all new words of a chunk against a sorted
table of known pairs. Only words with a failing pair are merged exactly. Distinct words are kept in
a bounded memo per worker; texts are assembled from it with array gathers.

Cases: null text counts as empty and gives no tokens; texts of any length are encoded whole;
repeated rows give repeated results; empty tables give empty tables; other columns are untouched
by ``encode``/``decode`` (a column that already has the output's name is replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import _base

#: The split pattern of the byte-level vocabularies (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words that a worker remembers; beyond it the memo starts afresh.
MEMO_WORDS = 350_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by the format's rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Codec:
    """One vocabulary, with the memo of words and pairs. Loaded once in each worker process."""

    _loaded: dict[str, "Codec"] = {}

    @classmethod
    def load(cls, path: str) -> "Codec":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        if max(self.ids.values()) >= 1 << 17:
            raise ValueError("ids of 131072 and more do not fit the pair keys")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {}  # (left << 17 | right): (rank << 17 | merged), so that values order by rank
        for r, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            self.rank[self.ids[a] << 17 | self.ids[b]] = r << 17 | self.ids[a + b]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        table: list[bytes] = [b""] * size
        for k, v in self.ids.items():
            table[v] = k
        for k, v in self.special.items():
            table[v] = k.encode()
        self.token_bytes = table
        self.token_len = np.array([len(t) for t in table], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_data = np.frombuffer(b"".join(table), np.uint8)
        written = [b"%d," % i for i in range(size)]
        self.text_len = np.array([len(t) for t in written], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.text_data = np.frombuffer(b"".join(written), np.uint8)
        self.reach: dict[bytes, int] = {}  # length of the longest token with these first four bytes
        for k in self.ids:
            if len(k) >= 4 and self.reach.get(k[:4], 0) < len(k):
                self.reach[k[:4]] = len(k)
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.exact_words = self.words_seen = 0
        self.good = np.zeros(0, np.int64)  # sorted keys of compatible and of other pairs
        self.bad = np.zeros(0, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.at: list[int] = []
        self.n: list[int] = []

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, reach, out, at, end = self.ids.get, self.reach.get, [], 0, len(word)
        while at < end:
            to = at + reach(word[at : at + 4], 3)
            if to > end:
                to = end
            while (t := ids(word[at:to])) is None:
                to -= 1
            out.append(t)
            at = to
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left. O(n log n)."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(a << 17 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = (new := best & 0x1FFFF,)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 17 | new, none)
            if i < len(ranks):
                ranks[i] = rank(new << 17 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r & 0x1FFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get(ids[x] << 17 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """For each pair key, whether the pair is the encoding of its own bytes."""
        distinct, back = np.unique(keys, return_inverse=True)
        known_good = np.isin(distinct, self.good, assume_unique=True)
        unknown = distinct[~known_good & ~np.isin(distinct, self.bad, assume_unique=True)]
        if len(unknown):
            table = self.token_bytes
            fits = np.array([self.merge_exactly(table[k >> 20] + table[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF] for k in unknown.tolist()], bool)
            keep = lambda old, new: np.union1d(old, new) if len(old) < 2_000_000 else np.sort(new)
            self.good, self.bad = keep(self.good, unknown[fits]), keep(self.bad, unknown[~fits])
            known_good = np.isin(distinct, self.good, assume_unique=True)
        return known_good[back]

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words into the memo."""
        if not words:
            return
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [self.propose(w) for w in raw]
        n = np.array([len(t) for t in tokens], np.int64)
        flat = np.array([t for ts in tokens for t in ts], np.int64)
        ends = np.cumsum(n)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        left = np.flatnonzero(inner)
        if len(left):
            fails = left[~self.compatible((flat[left] << 20) | flat[left + 1])]
            failing = np.unique(np.searchsorted(ends, fails, side="right"))
            for i in failing.tolist():
                tokens[i] = self.merge_exactly(raw[i])
            self.exact_words += len(failing)
            if len(failing):
                n = np.array([len(t) for t in tokens], np.int64)
                flat = np.array([t for ts in tokens for t in ts], np.int64)
        self.words_seen += len(words)
        self._remember(words, flat, n)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and the number of each text."""
        words: list[str] = []
        counts: list[int] = []
        special = self.special
        for text in texts:
            before = len(words)
            if special and any(s in text for s in special):
                for part in self.special_split.split(text):
                    words.extend([part] if part in special else self.split.findall(part))
            else:
                words.extend(self.split.findall(text))
            counts.append(len(words) - before)
        flat, lengths = self._encode_words(words)
        total = np.concatenate([[0], np.cumsum(lengths)])
        counted = np.array(counts, np.int64)
        ends = np.cumsum(counted)
        return flat, total[ends] - total[ends - counted]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after the other, and the number of each word."""
        new = [w for w in set(words) if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self._forget()
            new = list(set(words))
            if len(new) > max(1, MEMO_WORDS):  # one chunk with more distinct words than the memo holds: in parts
                half = len(words) // 2
                (a, n), (b, m) = self._encode_words(words[:half]), self._encode_words(words[half:])
                return np.concatenate([a, b]), np.concatenate([n, m])
        self.learn([w for w in new if w not in self.special])
        for w in new:
            if w in self.special:
                self._remember([w], np.array([self.special[w]]), np.ones(1, np.int64))
        which = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        lengths = np.array(self.n, np.int64)[which]
        flat = self.flat[_base.ragged(np.array(self.at, np.int64)[which], lengths)] if len(words) else np.zeros(0, np.int32)
        return flat, lengths

    def _remember(self, words: list[str], flat: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        first = len(self.at)
        self.memo.update(zip(words, range(first, first + len(words)), strict=True))
        self.at.extend((self.used + np.cumsum(n) - n).tolist())
        self.n.extend(n.tolist())
        self.used += len(flat)

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from its ids."""
        return self._gather(self.token_data, self.token_at, self.token_len, ids, counts)

    def written(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by commas."""
        return [x[:-1] for x in self._gather(self.text_data, self.text_at, self.text_len, ids, counts)]

    @staticmethod
    def _gather(data, at, lengths, ids, counts) -> list[bytes]:
        n = lengths[ids]
        out = data[_base.ragged(at[ids], n)].tobytes()
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _chunk_texts(batch: pa.RecordBatch, field: str) -> list[str]:
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(field)).to_pylist()]


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in df.columns if c != name]
    return kept, T.StructType([*(df.schema[c] for c in kept), T.StructField(name, kind)])


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """df with the token ids of each whole text as an array of int."""
    path = vocabulary or default_vocabulary()
    kept, schema = _with_column(df, ids_col, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in _base.chunks(batches, text_col):
            ids, counts = codec.encode(_chunk_texts(batch, text_col))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), column], [*kept, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """df with the text that each array of ids stands for (null ids: empty)."""
    path = vocabulary or default_vocabulary()
    kept, schema = _with_column(df, text_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col)).fill_null([]) if batch.num_rows else []
            texts = []
            for at in range(0, batch.num_rows, 256):
                part = lists[at : at + 256]
                counts = np.array([len(x) for x in part], np.int64)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts += [b.decode("utf-8", "replace") for b in codec.decode_bytes(ids, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both; one Arrow pass, no shuffle."""
    path = vocabulary or default_vocabulary()
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in _base.chunks(batches, text_col):
            ids, counts = codec.encode(_chunk_texts(batch, text_col))
            id_sha = [hashlib.sha256(x).hexdigest() for x in codec.written(ids, counts)]
            back = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in codec.decode_bytes(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sha, pa.string()), pa.array(back, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every whole document's ids and of its decoded text."""
    return round_trip(_base.table(spark, sf_dir, "documents"))

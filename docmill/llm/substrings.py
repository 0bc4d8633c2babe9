"""Substring deduplication (operator 6) with a log-structured fingerprint index.

A passage is a window of ``WINDOW`` consecutive words of one document. Equal windows have equal least
fingerprints among the hashes of their runs of ``GRAM`` words, so only those least ones (some
8 % of all positions) enter the index. An entry (document, fingerprint, hash of all the windows that it is least in) stands for some dozen window hashes.

The index is log-structured. Each batch of documents becomes an immutable run: its entries, and a directory of its fingerprints with the number
of their entries, sorted by fingerprint. The directory of a new run is merge-joined with those of the earlier runs, which gives the
fingerprints that repeat within the batch or between it and history; more than ``MAX_RUNS`` runs are compacted into one. The index can stay on disk and go on with
later batches: ``deduplicate(new, index=index, history=old)``; of the old documents only those are read again whose windows decide about new ones.

Entries that agree in fingerprint and window hash repeat each other whole (128 bits agree). Where entries of one fingerprint differ, as at the
ends of a passage, one document of each kind sends the hashes of the entry's windows once, those of two places at least are
verified (fingerprint and an independent hash of all words: 128 bits), and each document gets the verified ones among its own. So what is sent
grows with the entries, however many documents share a passage. Covered words are removed.

Texts are shuffled compressed, and only those that something was found in, where these are few enough to tell all tasks (``_base.SENT_ROWS``).

Cases: null and empty texts have no words and stay empty; texts shorter than a window are
kept; repeated rows (equal id and text) count as separate places, so each covers the other; a window may
repeat in its own document; ids may be null or shared by different texts (rows are told apart by id
and text); empty tables give empty results; other columns are kept as they are, whatever their names, but columns named like an output are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm import _base

WINDOW = 35
GRAM = 12
BATCHES = 2
MAX_RUNS = 4


def _words(texts: list[bytes]):
    """Words of all texts: data, starts, ends, and for each text its first word (one more entry: the end)."""
    data, begins = _base.concat_texts(texts)
    starts, ends = _base.spans(_base.IS_SPACE[data])
    return data, starts, ends, np.searchsorted(starts, begins)


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of `width` entries."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[:-done], out[done:])
        done *= 2
    return op(out[: len(out) - (width - done)], out[width - done :]) if width > done else out


def _windows(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of every text: its text, its first word in it, its least fingerprint, and an independent hash of all its words."""
    data, starts, ends, first = _words(texts)
    n = np.diff(first)
    none = np.zeros(0, np.uint64)
    has = np.flatnonzero(n >= window)
    if not len(has):
        return none.view(np.int64), none.view(np.int64), none, none
    words = _base.word_hashes(data, starts, ends)
    at = np.arange(len(words) - gram + 1)
    grams = _base.range_hashes(words, at, at + gram)
    least = np.concatenate([_slide(grams[first[i] : first[i] + n[i] - gram + 1], window - gram + 1, np.minimum) for i in has.tolist()])
    counts = n[has] - window + 1
    place = _base.ragged(np.zeros(len(has), np.int64), counts)
    at = np.repeat(first[has], counts) + place
    return np.repeat(has, counts), place, least, _base.range_hashes(_base.word_hashes(data, starts, ends, 1), at, at + window)


def _entries(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text and least fingerprint: the text, the fingerprint, one hash of all windows that it is least in, and whether one of these occurs twice."""
    owner, _, least, h = _windows(texts, window, gram)
    order = np.lexsort((h, least, owner))
    owner, least, h = owner[order], least[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] = ~new[1:] & (h[1:] == h[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return owner, least, h, twice
    return owner[at], least[at], np.add.reduceat(_base.mix64(h), at), np.logical_or.reduceat(twice, at)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, _text): rows are told apart by id and a hash of the text."""
    text = _base.text_or_empty(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))


def _same_key(a: str, b: str):
    return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._th") == F.col(f"{b}._th"))


def _packed(df: DataFrame) -> DataFrame:
    """df with its column _text as compressed bytes, for the shuffle that follows."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "_text" else f for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in _base.chunks(batches, "_text"):
            at = batch.schema.get_field_index("_text")
            packed = pa.array([pack(t) if t is not None else None for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, schema)


def _unpacked(batches: Iterator[pa.RecordBatch]):
    """(batch, texts as bytes or None) in pieces of bounded size."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in _base.chunks(batches, "_text", _base.CHUNK_BYTES // 4):
        yield batch, [unpack(t) if t is not None else None for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]


def document_entries(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _th, fp, hs, twice): the index entries of each document."""
    schema = T.StructType([keyed.schema["_id"], *(T.StructField(c, T.LongType()) for c in ("_th", "fp", "hs")), T.StructField("twice", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, "_text"):
            owner, prints, hs, twice = _entries(_base.texts_bytes(batch.column(2)), window, gram)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(_base.as_signed(prints)), pa.array(_base.as_signed(hs)), pa.array(twice)], schema.names)

    return keyed.mapInArrow(run, schema)


class FingerprintIndex:
    """Immutable runs under one folder: entries (_id, _th, fp, hs, twice), and a directory (fp, n) sorted by fp. n counts the entries
    of a fingerprint; one that covers some window twice in one document counts twice."""

    def __init__(self, spark: SparkSession, path: str, runs: list[str] | None = None, max_runs: int = MAX_RUNS):
        self.spark, self.path, self.max_runs = spark, path.rstrip("/"), max_runs
        self.runs = list(runs or [])
        self._next = 1 + max([int(r.rsplit("-", 1)[1]) for r in self.runs], default=0)

    @classmethod
    def fresh(cls, spark: SparkSession) -> "FingerprintIndex":
        return cls(spark, f"{_base.scratch_root(spark)}/docmill-lsm-{uuid.uuid4().hex}")

    def _write(self, entries: DataFrame, directory) -> str:
        run = f"{self.path}/run-{self._next}"
        self._next += 1
        entries.write.parquet(f"{run}/entries")
        directory(f"{run}/entries").sortWithinPartitions("fp").write.parquet(f"{run}/directory")
        return run

    def entries(self, runs: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{r}/entries" for r in runs or self.runs])

    def directory(self, runs: list[str] | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{r}/directory" for r in runs or self.runs])

    def add(self, entries: DataFrame) -> DataFrame:
        """A batch's entries become a run. Returns (fp): its fingerprints that repeat, within it or with earlier runs. Too many runs are compacted."""
        counted = F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")
        run = self._write(entries, lambda path: self.spark.read.parquet(path).groupBy("fp").agg(counted))
        new = self.directory([run])
        found = new.where("n > 1").select("fp")
        if self.runs:
            found = found.unionByName(new.where("n = 1").hint("merge").join(self.directory().select("fp"), "fp", "left_semi").select("fp"))
        found = _base.settle(found, "repeating")
        self.runs.append(run)
        if len(self.runs) > self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """One run of all: entries are copied, directories added up."""
        old = self.directory()
        self.runs = [self._write(self.entries(), lambda _: old.groupBy("fp").agg(F.sum("n").alias("n")))]


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Packed (_text, and keys' other columns) of the documents of these keys. keys is a written table."""
    sent = keys.select("_id", "_th")
    n = keys.count()
    if n <= _base.SENT_ROWS:
        docs = docs.alias("d").join(F.broadcast(sent).alias("k"), _same_key("d", "k"), "left_semi")
    return _packed(docs).alias("d").join(keys.alias("k"), _same_key("d", "k")).select(*[F.col(f"k.{c}") for c in keys.columns], "d._text")


def repeated_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(_id, _th, fps, hashes): for each text with windows that also start anywhere else, the fingerprints whose windows
    all do, and the hashes of others that do. keyed documents are added to the index in batches; history holds the
    documents of its earlier runs."""
    index = index or FingerprintIndex.fresh(keyed.sparkSession)
    found = None
    for b in range(batches):
        one = index.add(document_entries(keyed.where(F.pmod(F.col("_th"), F.lit(batches)) == b), window, gram))
        found = one if found is None else found.unionByName(one)
    everything = keyed.unionByName(history) if history is not None else keyed
    found = _base.settle(found.distinct(), "repeating")  # plain tables, so that a common fingerprint's entries can be split
    met = _base.settle(index.entries().join(found.hint("merge"), "fp"), "entries")
    kinds = met.groupBy("fp", "hs").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("_id", "_th")).alias("one"))
    kinds = _base.settle(kinds, "kinds")
    several = _base.settle(kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.max("twice").alias("any")).where("kinds > 1 or any").select("fp"), "several")
    whole = _base.settle(kinds.where("n > 1").select("fp", "hs"), "whole")
    by_print = met.join(whole.hint("merge"), ["fp", "hs"]).groupBy("_id", "_th").agg(F.collect_set("fp").alias("fps"))

    asked = kinds.join(several.hint("merge"), "fp").select("one._id", "one._th", F.struct("fp", (F.col("n") == 1).alias("own")).alias("e"))
    asked = _base.settle(asked.groupBy("_id", "_th").agg(F.collect_list("e").alias("es")), "asked")
    schema = T.StructType([keyed.schema["_id"], *(T.StructField(c, T.LongType()) for c in ("_th", "fp", "h", "n")), T.StructField("own", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            owner, _, least, h = _windows(texts, window, gram)
            es = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), es.value_lengths().to_numpy())
            fp, own = (es.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("fp", "own"))
            fp = fp.astype(np.int64).view(np.uint64)
            order = np.lexsort((fp, row))
            row, fp, own = row[order], fp[order], own[order]
            at = np.zeros(len(owner), np.int64)
            for i in range(batch.num_rows):
                here, (lo, hi) = slice(*np.searchsorted(owner, [i, i + 1])), np.searchsorted(row, [i, i + 1])
                at[here] = lo + np.searchsorted(fp[lo:hi], least[here])
                at[here] = np.where((at[here] < hi) & (fp[np.minimum(at[here], len(fp) - 1)] == least[here]), at[here], -1)
            hit = np.flatnonzero(at >= 0)
            at, h = at[hit], h[hit]
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1])])) if len(at) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(at)))
            at, h = at[new], h[new]
            who = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(_base.as_signed(fp[at])), pa.array(_base.as_signed(h)), pa.array(np.where(own[at], counts, counts + 1)), pa.array(own[at])], schema.names)

    sent = _base.settle(_texts_of(everything, asked).mapInArrow(run, schema), "windows")
    verified = _base.settle(sent.groupBy("fp", "h").agg(F.sum("n").alias("n")).where("n > 1").select("fp", "h"), "verified")
    by_hash = sent.where("own").join(verified.hint("merge"), ["fp", "h"]).groupBy("_id", "_th").agg(F.collect_set("h").alias("hashes"))
    none = F.array().cast("array<bigint>")
    both = by_print.select("_id", "_th", "fps", none.alias("hashes")).unionByName(by_hash.select("_id", "_th", none.alias("fps"), "hashes"))
    return both.groupBy("_id", "_th").agg(F.flatten(F.collect_list("fps")).alias("fps"), F.flatten(F.collect_list("hashes")).alias("hashes"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """docs with kept_text (kept words joined by one space), n_words and n_removed. With an index of earlier
    batches, history are those batches' documents; only docs are returned."""
    outputs = ("kept_text", "n_words", "n_removed")
    kept = [c for c in docs.columns if c not in outputs]
    old = _keyed(history, id_col, text_col) if history is not None else None
    marks = _base.settle(repeated_windows(_keyed(docs, id_col, text_col), window, gram, batches, index, old), "marks")
    rest = F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col])
    whole = docs.select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(_base.text_or_empty(text_col)).alias("_th"), rest.alias("rest"), F.col(f"`{text_col}`").alias("_text"))
    schema = T.StructType([whole.schema["rest"], T.StructField("_text", T.StringType()), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def out(batch: pa.RecordBatch, texts: list, lefts: list, n_words: list) -> pa.RecordBatch:
        columns = [batch.column(batch.schema.get_field_index("rest")), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([b" ".join(w) for w in lefts], pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array([n - len(w) for n, w in zip(n_words, lefts, strict=True)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, "_text"):
            texts = batch.column(batch.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()
            words = [(t or b"").split() for t in texts]
            yield out(batch, texts, words, [len(w) for w in words])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _unpacked(batches):
            fps, hashes = (batch.column(batch.schema.get_field_index(c)) for c in ("fps", "hashes"))
            lefts, n_words = [], []
            for i, text in enumerate(texts):
                words = (text or b"").split()
                n_words.append(len(words))
                if len(words) >= window and fps[i].is_valid:
                    _, place, least, h = _windows([text], window, gram)
                    wanted = [x[i].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (fps, hashes)]
                    hits = place[np.isin(least, wanted[0]) | np.isin(h, wanted[1])]
                    depth = np.zeros(len(words) + 1, np.int64)
                    depth[hits] += 1
                    depth[hits + window] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
                lefts.append(words)
            yield out(batch, texts, lefts, n_words)

    marked = marks.count()
    plain = None
    if marked <= _base.SENT_ROWS:
        keys = F.broadcast(marks.select("_id", "_th")).alias("m")
        plain = whole.alias("d").join(keys, _same_key("d", "m"), "left_anti").select("rest", "_text").mapInArrow(untouched, schema)
        whole = whole.alias("d").join(keys, _same_key("d", "m"), "left_semi")
    joined = _packed(whole).alias("d").join(marks.alias("m"), _same_key("d", "m"), "left").select("rest", "_text", "fps", "hashes")
    done = joined.mapInArrow(cut, schema)
    done = done if plain is None else plain.unionByName(done)
    return done.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in kept], *outputs)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of every whole document."""
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = r"""
with w as (
  select row_number() over () as row_id, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
), g as (
  select row_id, p, md5(array_to_string(words[p : p + 34], ' ')) as h
  from (select row_id, words, unnest(range(1, len(words) - 33)) as p from w where len(words) >= 35)
), twice as (
  select h from g group by h having count(*) > 1
), covered as (
  select distinct row_id, p + k as p from g semi join twice using (h), (select unnest(range(0, 35)) as k)
), each as (
  select row_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w
), kept as (
  select row_id, count(*) as n, string_agg(word, ' ' order by p) as t from each anti join covered using (row_id, p) group by row_id
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (row_id)
"""

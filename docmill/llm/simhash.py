"""SimHash near-duplicates (operator 7), by a byte-position inverted index with count filtering.

Each document's shingles vote on a 64-bit fingerprint. Two fingerprints that differ in at most
``max_bits`` bits differ in at most that many of their 8 bytes, so they share at least
``8 - max_bits`` bytes at the same positions: the guaranteed minimum of matches. Then they share at least one less of the first
seven positions, so distinct fingerprints are posted under every choice of that many of the seven (21 choices of five for two bits). For each
posting list the bytes that two members share are tallied over all eight positions, pairs that reach the minimum are verified bit
by bit, and only a spanning star of each list's verified links leaves it. A list's members differ in at most
``max_bits + 1`` bytes, which bounds it whatever the input; a list of more than ``LONG_LIST`` members is split by one byte more, since partners share
one more. Equal documents meet in one fingerprint before the index. Components follow from the stars.

Cases: null and empty texts have fingerprint zero and link like any other; texts shorter than a
shingle have one shingle, all their words; repeated rows share fingerprint and component; a null id
takes part, but never names a component that has another id; empty tables give empty results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base, components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Longer posting lists fall apart by one byte more.
LONG_LIST = 2048
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles' hashes, one text after the other, and the number of each text."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(_base.LOWER).split()
        before = len(hashes)
        if len(words) <= shingle:
            if words:
                hashes.append(digest(b" ".join(words), SEED))
        else:
            hashes.extend([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))])
        counts[i] = len(hashes) - before
    return np.array(hashes, np.uint64), counts


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as uint64."""
    return _majority(*_shingle_hashes(texts, shingle))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bit set if set in over half of a text's hashes. Eight byte-wide counters add up in one word, for at most 255 hashes at a time."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts)
    parts = -(-counts[full] // 255)
    begins = np.repeat(ends[full] - counts[full], parts) + 255 * _base.ragged(np.zeros(len(full), np.int64), parts)
    first_part = np.cumsum(parts) - parts
    half = counts[full]
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begins)
        votes = np.add.reduceat(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8).astype(np.int64), first_part, axis=0)
        won = (2 * votes > half[:, None]).astype(np.uint64)
        out[full] |= (won << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs without the text, with the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c not in (text_col, out)]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, text_col):
            prints = fingerprints_of(_base.texts_bytes(batch.column(batch.schema.get_field_index(text_col))), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(_base.as_signed(prints))], [*kept, out])

    return docs.select(*kept, text_col).mapInArrow(run, f"{types}{', ' if types else ''}{out} bigint")


def _tallied(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of members that share the least number of bytes and then differ in at most max_bits bits, in blocks of rows."""
    out = []
    for at in range(0, len(prints), 256):
        both = prints[at : at + 256, None] ^ prints[None, at + 1 :]
        shared = (both.view(np.uint8).reshape(*both.shape, 8) == 0).sum(axis=2, dtype=np.int8)
        i, j = np.nonzero(shared >= 8 - max_bits)
        good = (j >= i) & (np.bitwise_count(both[i, j]) <= max_bits)
        out.append((i[good] + at, j[good] + at + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _star(prints: np.ndarray, max_bits: int, taken: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For one posting list of distinct fingerprints, which share the bytes at the places `taken`: (member, least member
    linked to it through the list). Partners share one byte more than these, so that a long list falls apart by the others."""
    prints = np.sort(prints)
    n = len(prints)
    if n <= LONG_LIST:
        a, b = _tallied(prints, max_bits)
    else:
        found = []
        for place in set(range(8)) - set(taken):
            byte = (prints >> np.uint64(8 * place)) & np.uint64(255)
            order = np.argsort(byte, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(byte[order])) + 1):
                i, j = _tallied(prints[part], max_bits)
                found.append((part[i], part[j]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    label = np.arange(n)
    while True:  # least label over the links, until nothing changes
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if np.array_equal(before, label):
            break
    far = np.flatnonzero(label < np.arange(n))
    return prints[far], prints[label[far]]


def links(distinct: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v), u > v, that connect whatever distinct fingerprints are within max_bits (at most 4) of one another."""
    if not 0 <= max_bits <= 4:
        raise ValueError("max_bits must be 0 to 4")
    choices = list(itertools.combinations(range(7), 7 - max_bits))
    masks = [sum(0xFF << (8 * p) for p in c) for c in choices]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    posts = F.array(*[F.struct(F.lit(i).cast("byte").alias("place"), F.col(fp).bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    postings = distinct.select(fp, F.explode(posts).alias("p")).groupBy("p.place", "p.key").agg(F.collect_list(fp).alias("members")).where(F.size("members") > 1).select("place", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for place, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u, v = _star(members.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), max_bits, choices[place])
                us.append(u)
                vs.append(v)
            if us:
                u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return postings.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id): each row's fingerprint and the smallest id reachable over links."""
    printed = _base.settle(fingerprints(docs.select(id_col, text_col), text_col, "fp", shingle), "simhash-prints")
    return label(printed, id_col, max_bits)


def label(printed: DataFrame, id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """The same, from rows with their fingerprints."""
    least = _base.settle(printed.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = components.components(links(least.select("fp"), "fp", max_bits), "simhash-cc")
    rooted = least.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    moved = rooted.where("fp != root")  # few: fingerprints that have a different neighbour
    minima = moved.groupBy("root").agg(F.min("least").alias("m"))
    named = least.join(minima, F.col("fp") == F.col("root"), "left").select(F.col("fp").alias("r"), F.least("least", "m").alias("component_id"))
    by_print = rooted.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    return printed.join(by_print, F.col("fp") == F.col("f")).drop("f")


SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
#: Keys of two least hashes each that nominate pairs for the first, cheap round; the second round is complete whatever these find.
LEAD_KEYS = 8
#: The order of shingles comes from about so many texts; at most COMMON of those in COMMON_IN of them are sent to the workers. Any order gives the same pairs.
SAMPLE, COMMON_IN, COMMON = 8_000, 3, 200_000
#: Longer posting lists are dealt as pairs of blocks of about so many members.
LONG = 1024
#: Parity bits of a set: a power of two of about four times its size, between these.
LEAST_BITS, MOST_BITS = 256, 8192
_SLACK = 1e-6


def _shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    hashes, counts = _shingle_hashes(texts, shingle)
    return [np.unique(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]


def _common(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts have, and how common each is, from some of the texts."""
    share = min(1.0, SAMPLE / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, text_col):
            for s in _shingle_sets(_base.texts_bytes(batch.column(0)), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(_base.as_signed(s))], ["t"])

    counted = docs.where(F.rand(SEED) < share).select(text_col).mapInArrow(run, "t bigint").groupBy("t").count().where(F.col("count") >= COMMON_IN)
    found = counted.orderBy(F.desc("count"), "t").limit(COMMON).toArrow()
    hashes = found.column("t").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.log2(found.column("count").to_numpy()[order] + 1e-9).astype(np.int64) + 1


def _prefix(shingles: np.ndarray, common: np.ndarray, level: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the one order of all, rare ones first: two sets of that similarity share one of them."""
    if not len(shingles):
        return shingles
    rank = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, level[at], 0)
    most = len(shingles) - int(np.ceil(similarity * len(shingles) - _SLACK)) + 1
    return shingles[np.lexsort((shingles, rank))[:most]]


def _parities(shingles: np.ndarray) -> bytes:
    """Bits that each tell the parity of how many shingles fall on it: two sets differ in at least as many shingles as these bits do."""
    bits = min(max(1 << (4 * len(shingles)).bit_length(), LEAST_BITS), MOST_BITS)
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _lead_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """LEAD_KEYS keys of each set, none of an empty one."""
    odd = [np.uint64(x) for x in np.random.RandomState(4).randint(1, 2**62, 2 * LEAD_KEYS) * 2 + 1]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
    some = [i for i, x in enumerate(sets) if len(x)]
    if some:
        all_, begins = np.concatenate([sets[i] for i in some]), np.cumsum([0, *(len(sets[i]) for i in some)])[:-1]
        least = [np.minimum.reduceat(all_ * m, begins) for m in odd]
        keys = np.column_stack([_base.mix64(_base.mix64(least[2 * k]) + least[2 * k + 1] + np.uint64(k)) for k in range(LEAD_KEYS)])
        for i, row in zip(some, _base.as_signed(np.ascontiguousarray(keys)), strict=True):
            out[i] = row
    return out


def sketches(docs: DataFrame, text_col: str, shingle: int, set_shingle: int, similarity: float) -> DataFrame:
    """docs without the text, with fp, and of the set of set_shingle-word hashes its size n, parities, prefix p and lead keys."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, text_col, set_shingle))
    kept = [c for c in docs.columns if c != text_col]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, level = sent.value
        longs = pa.list_(pa.int64())
        for batch in _base.chunks(batches, text_col):
            texts = _base.texts_bytes(batch.column(batch.schema.get_field_index(text_col)))
            sets = _shingle_sets(texts, set_shingle)
            columns = [pa.array(_base.as_signed(fingerprints_of(texts, shingle))), pa.array([len(x) for x in sets], pa.int32()), pa.array([_parities(x) for x in sets], pa.binary()),
                       pa.array([_prefix(x, common, level, similarity).view(np.int64) for x in sets], longs), pa.array(_lead_keys(sets), longs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *columns], [*kept, "fp", "n", "parities", "p", "keys"])

    return docs.select(*kept, text_col).mapInArrow(run, f"{types}, fp bigint, n int, parities binary, p array<bigint>, keys array<bigint>")


def _nominated(printed: DataFrame) -> DataFrame:
    """(u, v): hashes of texts that share a key of two least hashes, each with the first and the last text of the key: linear in the texts."""
    keyed = _base.settle(printed.select(F.explode("keys").alias("key"), F.col("k.h").alias("h"), "fp").distinct(), "simhash-nominated")
    one = F.struct("h", "fp")
    ends = _base.settle(keyed.groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a.h < b.h"), "simhash-ends")
    pairs = keyed.join(ends, "key").select("h", "fp", F.explode(F.array("a", "b")).alias("e")).where("h != e.h and fp != e.fp")
    return pairs.select(F.greatest("h", "e.h").alias("u"), F.least("h", "e.h").alias("v")).distinct()


class _Members:
    """Members of posting lists as arrays; parities folded to fewer bits on demand (bit i of the half is the sum of bits i of both halves)."""

    def __init__(self, members: pa.StructArray):
        self.h, self.label, self.n = (members.field(k).to_numpy().astype(np.int64) for k in ("h", "label", "n"))
        self.bytes = members.field("parities").to_pylist()
        self.bits = np.array([8 * len(x) for x in self.bytes], np.int64)
        self._folded: dict[int, np.ndarray] = {}

    def folded(self, bits: int) -> np.ndarray:
        """One row of 64-bit words for each member; zeros for those of fewer bits."""
        if bits not in self._folded:
            out = np.zeros((len(self.bits), bits // 64), np.uint64)
            for size in np.unique(self.bits[self.bits >= bits]).tolist():
                at = np.flatnonzero(self.bits == size)
                rows = np.frombuffer(b"".join([self.bytes[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1, bits // 64)
                out[at] = np.bitwise_xor.reduce(rows, axis=1)
            self._folded[bits] = out
        return self._folded[bits]


def _possible(m: _Members, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], similarity: float) -> list[np.ndarray]:
    """Pairs (h, h) of two blocks of a list, each (members, places of the shingle), that can reach the similarity if this is the first
    shingle they share, and are not grouped yet. Pairs whose parities differ in more bits than such sets may differ in shingles are left out as well.

    What is left of each set from its place of the shingle on is as much as they can have in common, and
    similarity / (1 + similarity) of both sizes is what they need. A pair that has the similarity passes in the list of its first common shingle."""
    share, out = similarity / (1 + similarity), []
    (xm, xp), (ym, yp) = x, y
    for at in range(0, len(xm), 256):
        part = xm[at : at + 256]
        need = share * (m.n[part, None] + m.n[ym]) - _SLACK
        good = (m.label[part, None] != m.label[ym]) & ((m.n[part] - xp[at : at + 256])[:, None] >= need) & (m.n[ym] - yp >= need)
        if x is y:
            good &= m.h[part, None] < m.h[ym]
        i, j = np.nonzero(good)
        i, j = part[i], ym[j]
        bits = np.minimum(m.bits[i], m.bits[j])
        can = np.zeros(len(i), bool)
        for size in np.unique(bits).tolist():
            here = np.flatnonzero(bits == size)
            for some in np.array_split(here, 1 + len(here) * size // (1 << 25)):
                differ = np.bitwise_count(m.folded(size)[i[some]] ^ m.folded(size)[j[some]]).sum(axis=1, dtype=np.int64)
                can[some] = differ <= (1 - share * 2) * (m.n[i[some]] + m.n[j[some]]) + _SLACK
        if can.any():
            out.append(np.sort(np.column_stack([m.h[i[can]], m.h[j[can]]]), axis=1))
    return out


def _linked(members: pa.StructArray, a: int, b: int, similarity: float) -> np.ndarray:
    """Distinct pairs of one group of lists: of the one long list's blocks a and b, or of all its short lists."""
    m, at = _Members(members), members.field("at")
    owner = np.repeat(np.arange(len(m.h)), at.value_lengths().to_numpy())
    flat = at.flatten()
    t, place, block = (flat.field(k).to_numpy() for k in ("t", "place", "block"))
    order = np.lexsort((owner, t))
    owner, place, block = owner[order], place[order].astype(np.int64), block[order]
    found: list[np.ndarray] = []
    if a != b:
        found = _possible(m, *((owner[block == k], place[block == k]) for k in (a, b)), similarity)
    else:
        lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # lists of the same members are looked at once, with the least places
        for seg in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(t[order])) + 1):
            key = owner[seg].tobytes()
            lists[key] = (owner[seg], np.minimum(place[seg], lists[key][1]) if key in lists else place[seg])
        for x in lists.values():
            found += _possible(m, x, x, similarity)
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def candidates(printed: DataFrame, labels: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v), u > v: hashes of all texts of different labels whose sets can have the similarity. labels: (fp, label).

    Every text is posted under the prefix of its set; every pair of every list is looked at, in blocks where a list is long. Short
    lists of the same first member go together, so that what many lists of one family of texts share is sent once."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                pairs = _linked(members.values, a, b, similarity)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["u", "v"])

    about = printed.select(F.col("k.h").alias("h"), "fp", "n", "parities", "p").join(_base.bounded(labels), "fp")
    # lists of several labels only: what is grouped already needs no pair
    lists = about.select("label", F.explode("p").alias("t")).groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    lists = _base.settle(lists.where("lo < hi").select("t"), "simhash-lists")
    posted = printed.select(F.col("k.h").alias("h"), F.posexplode("p").alias("place", "t")).join(_base.bounded(lists), "t", "left_semi").distinct()
    posted = _base.settle(posted, "simhash-posted")
    met = _base.settle(posted.select("h").distinct(), "simhash-met")
    members = _base.settle(about.select("h", "n", "label", "parities").join(_base.bounded(met), "h", "left_semi").dropDuplicates(["h"]), "simhash-members")
    sizes = _base.settle(posted.groupBy("t").agg(F.count("*").alias("c"), F.min("h").alias("first")), "simhash-sizes")
    short = F.col("c") <= LONG
    loads = _base.settle(sizes.where(short).groupBy("first").agg((1 + F.floor(F.sum("c") / (64 * LONG))).cast("int").alias("parts")), "simhash-loads")
    few = posted.join(sizes.where(short).join(loads, "first").select("t", "first", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int").alias("part")), "t")
    few = few.select("first", "part", F.lit(0).alias("a"), F.lit(0).alias("b"), "h", "t", "place", F.lit(0).alias("block"))
    many = posted.join(sizes.where(~short).select("t", F.ceil(F.col("c") / LONG).cast("int").alias("blocks")), "t").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select(F.col("t").alias("first"), F.lit(-1).alias("part"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "h", "t", "place", "block")
    group = ["first", "part", "a", "b"]
    dealt = few.unionByName(many).groupBy(*group, "h").agg(F.collect_list(F.struct("t", "place", "block")).alias("at"))
    groups = dealt.join(members, "h").groupBy(*group).agg(F.collect_list(F.struct("h", "label", "n", "parities", "at")).alias("m"))
    return groups.where(F.size("m") > 1).select("a", "b", "m").mapInArrow(link, "u bigint, v bigint").distinct()


def similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY, set_shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """Edges (u, v) of fingerprints, u > v, from the pairs of text hashes whose sets have at least that Jaccard similarity.

    docs: (k, text), texts: (h, k, fp), one document for each text hash. The texts in pairs only are read again."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct().join(texts, "h")
    asked = _base.settle(asked.select(F.struct("k.n", "k.i", "k.h").alias("k"), "fp"), "simhash-asked")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.chunks(batches, "text"):
            sets = _shingle_sets(_base.texts_bytes(batch.column(2)), set_shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sets], pa.binary())], ["h", "fp", "s"])

    wanted = docs.join(_base.bounded(asked), docs.k.eqNullSafe(asked.k)).select(asked.k.h.alias("h"), "fp", "text")
    sets = _base.settle(wanted.mapInArrow(cut, "h bigint, fp bigint, s binary").dropDuplicates(["h"]), "simhash-sets")
    a = sets.select(F.col("h").alias("u"), F.col("fp").alias("fu"), F.col("s").alias("a"))
    b = sets.select(F.col("h").alias("v"), F.col("fp").alias("fv"), F.col("s").alias("b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(good))

    joined = pairs.join(a, "u").join(b, "v").select("fu", "fv", "a", "b")
    return joined.mapInArrow(verify, "x bigint, y bigint").where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _roots(reps: DataFrame, edges: DataFrame) -> DataFrame:
    """reps with the root of each fingerprint's component."""
    roots = components.components(edges, "simhash-cc").select(F.col("node").alias("fp"), "root")
    return reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group: that of the smallest id, and of rows with that id one of the smallest text hash and text.

    Texts group if their fingerprints are within max_bits, or if the Jaccard similarity of their sets of five-word shingles is at
    least `similarity`; all such pairs count. A first round groups what a few least hashes nominate; the second looks at every pair
    of texts, still in different groups, that shares a shingle of both prefixes. Ids and hashes decide what goes before the kept texts move."""
    text, id_ = _base.text_or_empty(text_col), F.col(f"`{id_col}`")
    key = F.struct(id_.isNull().alias("n"), id_.alias("i"), F.xxhash64(text).alias("h"))
    keyed = docs.select(text.alias("text"), key.alias("k"))
    printed = _base.settle(sketches(keyed, "text", shingle, SIMILAR_SHINGLE, similarity), "simhash-prints")
    reps = _base.settle(printed.groupBy("fp").agg(F.min("k").alias("k")), "simhash-reps")
    texts = _base.settle(printed.groupBy(F.col("k.h").alias("h")).agg(F.min("k").alias("k"), F.first("fp").alias("fp")), "simhash-texts")
    near = links(reps.select("fp"), "fp", max_bits)
    first_found = _base.settle(_nominated(printed), "simhash-first")
    edges = _base.settle(near.unionByName(similar(keyed, texts, first_found, similarity)), "simhash-edges")
    labels = _base.settle(_roots(reps, edges).select("fp", F.col("root").alias("label")), "simhash-labels")
    found = _base.settle(candidates(printed, labels, similarity), "simhash-candidates")
    rooted = _base.settle(_roots(reps, edges.unionByName(similar(keyed, texts, found, similarity))), "simhash-rooted")
    first = rooted.groupBy("root").agg(F.min("k").alias("first"))
    kept_keys = _base.settle(rooted.join(first, "root").select("fp", "first"), "simhash-kept")
    counted = _base.settle(printed.groupBy("k", "fp").agg(F.count("*").alias("c")), "simhash-counted")
    marked = counted.join(kept_keys, "fp")
    gone = _base.settle(marked.where("k != first").select(F.col("k").alias("key")).distinct(), "simhash-gone")
    several = _base.settle(marked.where("k = first and c > 1").select(F.col("k").alias("key")), "simhash-repeated")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("k"))
    kept = whole.join(_base.bounded(gone), F.col("k").eqNullSafe(F.col("key")), "left_anti")
    if several.isEmpty():
        return kept.select("row.*")
    alone = kept.join(_base.bounded(several), F.col("k").eqNullSafe(F.col("key")), "left_anti").select("row.*")
    once = kept.join(_base.bounded(several), F.col("k").eqNullSafe(F.col("key")), "left_semi").groupBy("k").agg(F.min("row").alias("row"))
    return alone.unionByName(once.select("row.*"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(_base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""The corpus operators against brute force over small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import sqlcheck
import xxhash
from pyspark.sql import functions as F

from docmill.llm import _base, ann, bpe, components, lattice, licenses, llm_oracle_sql, llm_queries, maxscore, mixing, quality, simhash, substrings, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "The", "the", "x", "é", "漢字", "!!", "don't"]


def some_text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


SHARED = some_text(60)
ROWS = [
    (1, "a b c d", "en", "s1", 7), (2, "", None, "s1", 0), (3, None, "en", None, None), (None, "no id here", "en", "s2", 10), (4, "a b c d", "en", "s2", 7), (4, "a b c d", "en", "s2", 7),
    (5, some_text(30) + " " + SHARED, "de", "s3", 9), (6, SHARED + "\n" + some_text(20), "de", "s3", 9), (7, some_text(4000), "fr", "s1", 1), (8, "De " * 300, "fr", "S", 1), (9, " \t\n ", "fr", "S", 1), (10, "w" * 5000, "en", "s1", 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(_base.LOWER) if lower else raw).split()


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = llm_queries()[name](spark, sqlcheck.SF).toPandas()
    want = sqlcheck.connect().sql(llm_oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and sqlcheck.rows(got) == sqlcheck.rows(want)


def test_mixing(spark, docs):
    mixed = mixing.mix(docs.withColumn("size", F.lit("clash")))
    got = mixed.collect()
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += len(words_of(r[1]))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    assert len(got) == len(ROWS)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["size"] == len(words_of(r["text"]))
        assert r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"])) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
    assert mixing.expand(mixed).count() == sum(r["copies"] for r in got) and sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(empty(spark)).count() == 0


def vectors(n=300, d=16):
    r = np.random.RandomState(1)
    centres = r.randn(10, d)
    x = centres[r.randint(0, 10, n)] + 0.3 * r.randn(n, d)
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    rows[3:6] = [(i, rows[2][1]) for i in range(3, 6)]  # equal vectors: ties
    return rows + [(1000, None), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [0.0] * d), (None, [1.0] * d), (7, rows[7][1])]


def best_of(rows, every, k, score):
    good = {i: v for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    return {q: sorted(((-score(good[q], v), i) for i, v in good.items() if i != q))[:k] for q in good if q % every == 0}


def test_ann_recall_and_cases(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(df, F.col("id") % 20 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = best_of([r for r in rows if r[0] != 1003], 20, 20, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)))
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert found == sorted(found) and q not in [i for _, i in found] and len(found) == 20
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>")
    assert ann.nearest(few, F.col("id") % 20 == 0).count() == 2


def test_maxscore_is_exact(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in maxscore.top_k(df, F.col("id") % 50 == 0).collect())
    whole = lambda v: [math.floor(256 * c) for c in v]
    want = best_of(rows, 50, 5, lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b), strict=True)))
    assert got == sorted((q, n + 1, i, -s) for q, best in want.items() for n, (s, i) in enumerate(best))
    assert maxscore.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_licenses(spark):
    t = dict(licenses.TEMPLATES)
    rows = [("a/LICENSE", t["MIT"]), ("a/b/c/x.py", "code"), ("a/b/LICENSE.txt", t["Apache-2.0"]), ("a/y.py", "print\n" + t["GPL-3.0"] + "\nmore"), ("z/q.py", None), (None, ""), ("a/d/w.py", "the of and a b"), ("a/d/w.py", "the of and a b")]
    df = spark.createDataFrame([(i, p, x, "clash") for i, (p, x) in enumerate(rows)], "doc_id int, p string, text string, license string")
    got = {r["doc_id"]: (r["license"], r["how"], r["line"]) for r in licenses.scan(df, "p").collect()}
    assert got == {0: ("MIT", "file", -1), 1: ("Apache-2.0", "inherited", None), 2: ("Apache-2.0", "file", -1), 3: ("GPL-3.0", "header", 1), 4: (None, "none", None), 5: (None, "none", None), 6: ("MIT", "inherited", None), 7: ("MIT", "inherited", None)}
    assert licenses.scan(df.limit(0), "p").count() == 0
    assert {r["n_lines"] for r in licenses.scan(df, "p").where("how = 'header'").collect()} == {1}


def test_licences_over_several_lines(spark):
    texts = ["x\n# Licensed under the Apache\n#   License, Version 2.0.\nx = 1", "// This work is licensed under\n// the GNU General Public\n// License, version 3.\nend", "\n\nReleased under the MIT License.\n\n",
             "This work is licensed\nunder a Creative Commons\nAttribution 4.0\nInternational License.", None, "", "Released under the MIT License.\n" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("p", F.lit("a/b"))
    got = {r["doc_id"]: (r["license"], r["line"], r["n_lines"]) for r in licenses.scan(df, "p").collect()}
    assert got[0] == ("Apache-2.0", 1, 2) and got[1] == ("GPL-3.0", 0, 3) and got[2] == ("MIT", 2, 1) and got[6] == ("MIT", 0, 1)
    assert got[4] == got[5] == (None, None, None)
    one = {r["doc_id"]: r["license"] for r in licenses.scan(df, "p", header_lines=1).collect()}
    assert one[2] == "MIT" and one[1] is None
    four = {r["doc_id"]: (r["license"], r["line"], r["n_lines"]) for r in licenses.scan(df, "p", header_lines=4).collect()}
    assert four[3] == ("CC-BY-4.0", 0, 4)


def test_wrapped_licences_equal_their_sql(spark, tmp_path):
    import duckdb
    import pandas as pd

    texts = ["a\n# Licensed under the Apache\n# License, Version 2.0.\nb", "Released\nunder the\nMIT License.\n\nx", "Released under\nthe MIT License.", "plain", None, "\nReleased under the MIT License.\n"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": ["s", "s", "t", "t", "u", None], "lang": "en"})
    documents.to_parquet(tmp_path / "documents.parquet")
    got = licenses.op3_licenses(spark, str(tmp_path)).toPandas()
    assert sorted(got["n_lines"].dropna()) == [1, 2, 2, 3]
    con = duckdb.connect()
    con.register("documents", documents)
    assert sqlcheck.rows(got) == sqlcheck.rows(con.sql(licenses.OP3_SQL).df())


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    odd = ["<|endoftext|>a <|endoftext|>", "it's  \n\n x y　z\x1c", "\U0001f600​﻿", "ab" * 2000, "".join(chr(c) for c in range(0x20, 0x3000))]
    texts = [r[1] or "" for r in ROWS] + odd
    codec = bpe.Codec.load(bpe.default_vocabulary())
    ids, counts = codec.encode(texts)
    ends = np.cumsum(counts)
    for text, part in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == t.encode(text, add_special_tokens=False).ids
    assert [b.decode() for b in codec.decode_bytes(ids.astype(np.int64), counts)] == texts
    both = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")))).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both) and len(both) == len(ROWS)
    assert bpe.round_trip(docs).where("doc_id = 2").first()["n_tokens"] == 0 and bpe.round_trip(empty(spark)).count() == 0
    old = bpe.MEMO_WORDS
    try:  # a memo too small for one chunk
        bpe.MEMO_WORDS = 8
        small = bpe.Codec(bpe.default_vocabulary())
        again, n = small.encode(texts)
    finally:
        bpe.MEMO_WORDS = old
    assert again.tolist() == ids.tolist() and n.tolist() == counts.tolist()


def test_lattice_sums_over_all_segmentations():
    pieces = lattice.Pieces.load(lattice.default_vocabulary())
    log_p, go, stop = weights = pieces.log_weights()
    place = {n: i for i, n in enumerate(pieces.names)}

    def total(rest, first):
        if not rest:
            return math.exp(stop)
        out = 0.0
        for k in range(1, len(rest) + 1):
            i = place.get(rest[:k])
            if i is not None and pieces.begins[i] == first:
                out += math.exp(log_p[i] + (0 if first else go)) * total(rest[k:], False)
        return out

    words = [b"the", b"inform", "é".encode(), b"zq9", b"a"]
    got = lattice.word_scores(pieces, words, weights)[0]
    for w, g in zip(words, got, strict=True):
        assert g == pytest.approx(math.log(total(lattice.MARK + w, True)), rel=1e-9)
    used = lattice.expected_counts(pieces, words, np.ones(len(words)), weights)
    assert used[pieces.begins].sum() == pytest.approx(len(words))


def test_lattice_base_score_and_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD_WORDS", 6)  # so that most words are joined
    got = lattice.score(docs).collect()
    assert len(got) == len(ROWS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter()
    for r in ROWS:
        if not held(r[0]):
            c.update([*words_of(r[1], True), b""])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in ROWS:
        w = [*words_of(r[1], True), b""]
        want[r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lattice.score(empty(spark)).count() == 0


def by_segmentation(pieces, word, log_p, go, stop):
    """Natural log of a word's probability, place by place in plain Python."""
    place = {n: i for i, n in enumerate(pieces.names)}
    word = lattice.MARK + word
    at = [0.0] + [None] * len(word)
    for end in range(1, len(word) + 1):
        terms = []
        for begin in range(max(0, end - pieces.most), end):
            i = place.get(word[begin:end])
            if at[begin] is not None and i is not None and pieces.begins[i] == (begin == 0):
                terms.append(at[begin] + log_p[i] + (go if begin else 0.0))
        if terms:
            at[end] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
    return at[-1] + stop


def test_lattice_scores_of_whole_documents(spark, docs):
    pieces = lattice.Pieces.load(lattice.default_vocabulary())
    weights = pieces.log_weights()
    learned = [r for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    n = sum(len(words_of(r[1])) + 1 for r in learned)
    log_end, log_word = math.log((len(learned) + 0.5) / (n + 1)), math.log((n - len(learned) + 0.5) / (n + 1))
    one = {w: by_segmentation(pieces, w, *weights) for r in ROWS for w in words_of(r[1], True)}
    want = collections.Counter((r[0], round((log_end + sum(one[w] + log_word for w in words_of(r[1], True))) / math.log(10), 4)) for r in ROWS)
    got = lattice.score(docs).collect()
    assert collections.Counter((r["doc_id"], round(r["vocabulary_score"], 4)) for r in got) == want
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["vocabulary_score"] for r in got if not r["held_out"])


def test_lattice_takes_long_words_in_segments(spark, monkeypatch):
    pieces = lattice.Pieces.load(lattice.default_vocabulary())
    weights = pieces.log_weights()
    words = [b"information" * 40, b"x" * 333, "é漢".encode() * 50]
    whole, used = lattice.word_scores(pieces, words, weights)[0], lattice.expected_counts(pieces, words, np.array([1.0, 2.0, 3.0]), weights)
    long_ = spark.createDataFrame([(1, "q" * 100_000 + " end", "en", "s", 1)], DOCS)
    assert math.isfinite(lattice.score(long_).first()["score"])
    monkeypatch.setattr(lattice, "SEGMENT", 50)
    assert lattice.word_scores(pieces, words, weights)[0] == pytest.approx(whole)
    assert lattice.expected_counts(pieces, words, np.array([1.0, 2.0, 3.0]), weights) == pytest.approx(used)


def brute_removal(texts, window):
    where = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        covered = {i + k for i in range(len(t) - window + 1) if where[tuple(t[i : i + window])] > 1 for k in range(window)}
        out.append([w for i, w in enumerate(t) if i not in covered])
    return out


@pytest.mark.parametrize(("window", "gram"), [(35, 12), (6, 3), (4, 4)])
def test_substrings(spark, docs, window, gram):
    got = substrings.deduplicate(docs.withColumn("kept_text", F.lit("clash")), window=window, gram=gram).collect()
    texts = [words_of(r[1]) for r in ROWS]
    want = collections.Counter((r[0], len(t), b" ".join(k).decode()) for r, t, k in zip(ROWS, texts, brute_removal(texts, window), strict=True))
    assert collections.Counter((r["doc_id"], r["n_words"], r["kept_text"]) for r in got) == want
    assert all(r["n_removed"] == r["n_words"] - len(r["kept_text"].split(" ") if r["kept_text"] else []) for r in got)
    assert substrings.deduplicate(empty(spark), window=window, gram=gram).count() == 0


def test_substring_index_goes_on_with_later_batches(spark, docs):
    index = substrings.FingerprintIndex.fresh(spark)
    index.max_runs = 2
    old = docs.where("doc_id <= 5")
    substrings.deduplicate(old, index=index, batches=2).count()
    new = docs.where("doc_id = 6")
    got = substrings.deduplicate(new, index=index, history=old, batches=1).collect()
    assert len(index.runs) == 1 and len(got) == 1
    want = brute_removal([words_of(r[1]) for r in ROWS if r[0] is not None and r[0] <= 6], 35)[-1]
    assert got[0]["kept_text"] == b" ".join(want).decode() and got[0]["n_removed"] >= 60


def groups(links, nodes):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    base = some_text(400).split()
    near = []
    for i in range(40):
        w = list(base)
        w[random.randrange(400)] = f"v{i}"
        near.append((100 + i, " ".join(w), "en", "n", 1))
    rows = ROWS + near
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    prints = {}
    for r in rows:
        w = words_of(r[1], True)
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[r[0], r[1]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    distinct = set(prints.values())
    root = groups([(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = collections.Counter((r[0], prints[r[0], r[1]], least.get(root[prints[r[0], r[1]]])) for r in rows)
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r["source"] == "n" for r in kept) == 1 and sum(r["text"] == "a b c d" for r in kept) == 1 and len(kept[0]) == 5
    assert simhash.keep_one(empty(spark)).count() == 0


def five_word_sets(texts):
    out = []
    for t in texts:
        w = words_of(t, True)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set())
    return out


def smallest_of_groups(rows, similarity=0.8):
    """The ids keep_one has to keep, by looking at every pair of rows with distinct ids."""
    sets, prints = five_word_sets([r[1] for r in rows]), [int(p) for p in simhash.fingerprints_of([r[1].encode() for r in rows])]
    edges = []
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if (prints[i] ^ prints[j]).bit_count() <= 2 or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            edges.append((j, i))
    root = groups(edges, range(len(rows)))
    least = {}
    for n, r in enumerate(rows):
        least[root[n]] = min(r[0], least.get(root[n], r[0]))
    return sorted(least.values())


def with_edits(words, r, blocks, name):
    """words with `blocks` stretches of five replaced, each of which costs up to nine shingles."""
    out = list(words)
    for b in r.choice(len(words) // 12, blocks, replace=False):
        at = int(b) * 12
        out[at : at + 5] = [f"{name}{b}x{k}" for k in range(5)]
    return out


def template_family(members, r):
    """Texts of one template, similar to each other below 0.8, each with a partner at 0.8 or a little more."""
    base = [f"t{i}" for i in range(600)]
    rows = []
    for i in range(members):
        own = with_edits(base, r, 5, f"m{i}v")
        partner = with_edits(own, r, 7, f"p{i}v")
        rows += [(1 + i, " ".join(own), "en", "f", 1), (10_000 + i, " ".join(partner), "en", "f", 1)]
    return rows


def test_keep_one_finds_partners_inside_a_template_family(spark):
    rows = template_family(150, np.random.RandomState(8))
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == smallest_of_groups(rows)


def scattered_pairs(pairs, r):
    """Pairs of unrelated texts of 150 words, 0.80 to 0.85 similar through single words changed here and there."""
    rows = []
    while len(rows) < 2 * pairs:
        one = [f"w{x}" for x in r.randint(0, 5000, 150)]
        other = list(one)
        for at in r.choice(150, r.randint(3, 6), replace=False):
            other[at] = f"e{r.randint(10**6)}"
        a, b = five_word_sets([" ".join(one), " ".join(other)])
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            i = len(rows) // 2
            rows += [(1 + i, " ".join(one), "en", "p", 1), (10_000 + i, " ".join(other), "en", "p", 1)]
    return rows


def test_keep_one_finds_every_pair_just_above_the_threshold(spark):
    rows = scattered_pairs(200, np.random.RandomState(9))
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == smallest_of_groups(rows) == list(range(1, 201))


def test_long_posting_lists_link_like_short_ones(monkeypatch):
    r = np.random.RandomState(2)
    prints = np.unique((r.randint(0, 1 << 16, 700).astype(np.uint64) << np.uint64(8)) | np.uint64(5))
    want = groups([(int(a), int(b)) for a, b in itertools.combinations(prints, 2) if int(a ^ b).bit_count() <= 2], [int(p) for p in prints])
    for longest in (100, 10_000):
        monkeypatch.setattr(simhash, "LONG_LIST", longest)
        u, v = simhash._star(prints, 2, (0, 3, 4, 5, 6))
        assert {int(a): int(b) for a, b in zip(u, v, strict=True)} == {a: b for a, b in want.items() if a != b}


def test_near_copies_meet_in_long_lists(spark, monkeypatch):
    rows = template_family(40, np.random.RandomState(3))
    monkeypatch.setattr(simhash, "LONG", 16)  # lists are dealt in blocks
    got = sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect())
    assert got == smallest_of_groups(rows)


CLASHES = ("_id", "_th", "_text", "rest", "row", "k", "key", "_h", "fp", "_mix_source", "_copy", "_row", "_p", "_i", "_x", "d", "t")


def test_columns_named_like_inner_ones_stay(spark, docs):
    some = docs.where("doc_id is null or doc_id != 7")
    clashing = some.withColumns({c: F.lit(c) for c in CLASHES})
    for run in (substrings.deduplicate, simhash.keep_one, lambda d: mixing.expand(mixing.mix(d)), lambda d: licenses.scan(d, "source"), lambda d: bpe.round_trip(d)):
        got, want = run(clashing), run(some)
        plain = [c for c in want.columns if c not in CLASHES]
        assert collections.Counter(map(str, got.select(plain).collect())) == collections.Counter(map(str, want.select(plain).collect()))
        assert all(r[c] == c for r in got.select([c for c in CLASHES if c in got.columns]).collect() for c in r.asDict())


def test_components(spark):
    r = random.Random(3)
    edges = [(max(a, b), min(a, b)) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(180)) if a != b] + [(i + 1, i) for i in range(1000, 1040)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = groups(edges, {n for e in edges for n in e})
    assert got == {n: w for n, w in want.items() if n != w}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_quality(spark, docs):
    emit, move = np.random.RandomState(0).randn(4, 2), np.array([[0.7, -0.2], [0.1, 0.4]])
    marginal, pair, z = quality.forward_backward(np.concatenate([emit, emit[:1]]), move, np.array([4, 1]))
    paths = {p: math.exp(sum(emit[i, p[i]] for i in range(4)) + sum(move[p[i], p[i + 1]] for i in range(3))) for p in itertools.product((0, 1), repeat=4)}
    total = sum(paths.values())
    assert marginal[:4, 1] == pytest.approx([sum(v for p, v in paths.items() if p[i]) / total for i in range(4)])
    assert pair.sum() == pytest.approx(3) and z == pytest.approx(math.log(total) + np.logaddexp(*emit[0]))
    whole = _base.table(spark, "/root/testdata/sf0.01", "documents")
    labels = _base.table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(whole, labels)
    got = quality.score(whole, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    odd = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odd)
    nothing = quality.train(whole, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5} and quality.score(empty(spark), model).count() == 0


def test_toxicity(spark, docs):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        grade = r.choice([0, 0, 1, 2])
        bad = {0: [], 1: ["meh"] * 2, 2: ["awful", "vile"]}[grade]
        w = [r.choice(WORDS) for _ in range(30)] + bad
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, grade))
    labels += [(5, None), (None, 1), (10**6, 2)]
    df, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, marks)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = toxicity.score(df, model).join(marks, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("severity", "toxic").collect()
    assert sum(round(x["severity"]) == x["toxic"] for x in got if x["toxic"] is not None) >= 0.95 * len(got)
    odd = toxicity.score(docs.withColumn("severity", F.lit("clash")), model).collect()
    assert len(odd) == len(ROWS) and all(0 <= x["severity"] <= 2 for x in odd)
    nothing = toxicity.train(df, marks.limit(0))
    assert {x["severity"] for x in toxicity.score(docs, nothing).collect()} == {0.0} and toxicity.score(empty(spark), model).count() == 0

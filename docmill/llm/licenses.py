"""License scans (operator 3) in DataFrame functions only.

Headers (one to HEADER_LINES adjacent lines of any text, so that wrapped notices count) and licence files (whole texts whose file name says so) are compared with licence templates by
the cosine of sparse TF-IDF vectors; inverse document frequencies of the templates' terms are counted over all documents, other terms
count as unseen. Windows without any of a template's heaviest terms cannot reach the threshold, which is what the first filter uses.
A document without a match takes the licence of its nearest ancestor directory that has a licence file; directories
are resolved once each, by joins of path prefixes, and documents then join their own directory.

Cases: null and empty texts have no licence of their own; a null path is the root directory's; ties go to the earlier
template, then the fewer lines, then the earlier line; a wrapped notice that fills more than HEADER_LINES lines is not a header; repeated rows get equal results; licence files of one directory that disagree: the one of the smallest path decides;
empty tables give empty results; columns that clash with outputs (path, license, how, similarity, line, n_lines) are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import _base

#: Short licence notices, earlier ones win ties.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
THRESHOLD = 0.7
HEADER_LINES = 3
BROADCAST_DIRECTORIES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "[^a-z0-9]+"


def _terms_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in "".join(c if c in _LOWER or c in "0123456789" else " " for c in text.translate(str.maketrans(_UPPER, _LOWER))).split():
        out[t] = out.get(t, 0) + 1
    return out


def _folded(text: Column) -> Column:
    return F.lower(text)


def _terms(folded: Column) -> Column:
    return F.split(folded, _BREAK)


def frequencies(docs: DataFrame, text_col: str, templates) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each template term occurs. One row per template term reaches the driver."""
    vocabulary = sorted({t for _, x in templates for t in _terms_of(x)})
    seen = F.array_intersect(_terms(_folded(_base.text_or_empty(text_col))), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), seen)).alias("t")).groupBy("t").count().collect()
    counts = {r["t"]: r["count"] for r in rows}
    return counts.pop("", 0), {t: counts.get(t, 0) for t in vocabulary}


def _vectors(n: int, df: dict[str, int], templates):
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    unseen = math.log(1 + n) + 1
    vectors = []
    for _, text in templates:
        v = {t: c * idf[t] for t, c in _terms_of(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()})
    return idf, unseen, vectors


def _anchors(vectors, threshold: float) -> list[str]:
    """Terms so that a text with none of them has a cosine below the threshold to every template; heavy ones, which are rare in texts, and long ones, which are rare as parts of words."""
    out: set[str] = set()
    for v in vectors:
        left = 1.0
        for t, x in sorted(v.items(), key=lambda p: (p[0] not in out, -(p[1] ** 2) * min(len(p[0]), 6), p[0])):
            if left < threshold**2 * (1 - 1e-9):
                break
            out.add(t)
            left -= x * x
    return sorted(out)


def matches(docs: DataFrame, id_col: str, path_col: str, text_col: str, templates=TEMPLATES, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE, header_lines: int = HEADER_LINES) -> DataFrame:
    """(_id, _path, _th, best): each text that matches a template, best = (similarity, -template, -n_lines, -line); line -1 of no lines is the whole text of a licence file."""
    n, df = frequencies(docs, text_col, templates)
    idf, unseen, vectors = _vectors(n, df, templates)
    text = _base.text_or_empty(text_col)
    anchors = _anchors(vectors, threshold)
    has_anchor = lambda c: reduce(lambda a, b: a | b, [c.contains(t) for t in anchors])  # noqa: E731  as part of words too: cheap, and only a first filter
    key = [F.col(id_col).alias("_id"), F.col(path_col).alias("_path"), F.xxhash64(text).alias("_th")]
    found = docs.select(*key, _folded(F.col(text_col)).alias("low")).where(has_anchor(F.col("low")))
    # a generator keeps the split lines as a column of their own: inside a lambda they would be split again for each line
    cut = found.select("_id", "_path", "_th", "low", F.monotonically_increasing_id().alias("_row"), F.explode(F.array(F.split("low", "\n"))).alias("ls"))
    hits = F.filter(F.transform("ls", lambda x, i: F.when(has_anchor(x), i)), lambda i: i.isNotNull())
    # a window is start * header_lines + further lines, as a number so that duplicates are found by hashing
    around = F.flatten(F.transform(hits, lambda i: F.array(*[(i - back) * header_lines + more for more in range(header_lines) for back in range(more + 1)])))
    start, more = lambda c: F.floor(c / header_lines).cast("int"), lambda c: F.pmod(c, F.lit(header_lines))
    inside = F.filter(F.array_distinct(around), lambda c: (c >= 0) & (start(c) + more(c) < F.size("ls")))
    unit = lambda c: F.concat_ws(" ", *[F.when(more(c) >= k, F.get("ls", start(c) + k)) for k in range(header_lines)])
    windows = F.transform(inside, lambda c: F.struct(start(c).alias("line"), (more(c) + 1).alias("n"), unit(c).alias("unit")))
    whole = F.when(F.coalesce(F.col("_path"), F.lit("")).rlike(licence_file), F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("n"), F.col("low").alias("unit")))).otherwise(F.array().cast("array<struct<line:int,n:int,unit:string>>"))
    units = cut.select("_id", "_path", "_th", "_row", F.explode(F.concat(whole, windows)).alias("u"))
    split = units.select("_id", "_path", "_th", "_row", "u.line", "u.n", _terms(F.col("u.unit")).alias("ts")).where(F.arrays_overlap("ts", F.array(*map(F.lit, anchors))))
    terms = split.select("_id", "_path", "_th", "_row", "line", "n", F.explode("ts").alias("t")).where("t != ''")
    counted = terms.groupBy("_id", "_path", "_th", "_row", "line", "n", "t").agg(F.count("*").alias("tf"))
    of = lambda values: F.create_map(*[F.lit(x) for p in sorted(values.items()) for x in p])
    weight = F.col("tf") * F.coalesce(of(idf)[F.col("t")], F.lit(unseen))
    dots = [F.sum(weight * F.coalesce(of(v)[F.col("t")], F.lit(0.0))).alias(f"d{i}") for i, v in enumerate(vectors)]
    lines = counted.groupBy("_id", "_path", "_th", "_row", "line", "n").agg(F.sqrt(F.sum(weight * weight)).alias("norm"), *dots)
    best = F.greatest(*[F.struct(F.round(F.col(f"d{i}") / F.col("norm"), 9).alias("similarity"), F.lit(-i).alias("template"), (-F.col("n")).alias("n"), (-F.col("line")).alias("line")) for i in range(len(vectors))])
    return lines.select("_id", "_path", "_th", best.alias("best")).where(F.col("best.similarity") >= threshold).groupBy("_id", "_path", "_th").agg(F.max("best").alias("best"))


def directory(path: Column) -> Column:
    """The directory of a path, without the last slash; the root is empty."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def scan(docs: DataFrame, path_col: str, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE, first_is_file: bool = False, header_lines: int = HEADER_LINES) -> DataFrame:
    """docs with license, how (file, header, inherited or none), similarity, line and n_lines of the match (line -1, n_lines 0: the whole file), and path.

    first_is_file: in tables without file names, a directory's licence file is its matching document of the smallest id."""
    outputs = ("license", "how", "similarity", "line", "n_lines", "path")
    kept = [c for c in docs.columns if c not in outputs]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(path_col).alias("_p"), F.col(id_col).alias("_i"), F.col(text_col).alias("_x"))
    own = _base.settle(matches(docs, "_i", "_p", "_x", templates, threshold, licence_file, header_lines), "licences")
    names = F.array(*[F.lit(t[0]) for t in templates])
    own = own.select("_id", "_path", "_th", F.element_at(names, F.lit(1) - F.col("best.template")).alias("_license"), F.col("best.similarity").alias("_similarity"), (-F.col("best.line")).cast("int").alias("_line"), (-F.col("best.n")).cast("int").alias("_n"))
    is_file = F.coalesce(F.col("_path"), F.lit("")).rlike(licence_file)
    by_dir = own.withColumn("dir", directory(F.col("_path")))
    rank = F.struct((~is_file).alias("other"), F.col("_id"), F.col("_path"), F.col("_th"))
    declared = (by_dir if first_is_file else by_dir.where(is_file)).groupBy("dir").agg(F.min_by("_license", rank).alias("dir_license"))
    dirs = docs.select(directory(F.col("_p")).alias("d")).distinct()
    parts = F.split("d", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    ancestors = dirs.select("d", F.explode(F.array_distinct(up)).alias("a")).select("d", "a.depth", "a.up")
    resolved = _base.settle(ancestors.join(declared, F.col("up") == F.col("dir")).groupBy("d").agg(F.max_by("dir_license", "depth").alias("_inherited")), "directories")
    side = F.broadcast(resolved) if resolved.count() <= BROADCAST_DIRECTORIES else resolved
    whole = docs.withColumn("_t", F.xxhash64(_base.text_or_empty("_x"))).withColumn("_d", directory(F.col("_p")))
    joined = whole.join(own, F.col("_i").eqNullSafe(F.col("_id")) & F.col("_p").eqNullSafe(F.col("_path")) & (F.col("_t") == F.col("_th")), "left").join(side, F.col("_d") == F.col("d"), "left")
    how = F.when(F.col("_license").isNotNull(), F.when(F.col("_line") < 0, "file").otherwise("header")).when(F.col("_inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select("_row.*", F.col("_p").alias("path"), F.coalesce("_license", "_inherited").alias("license"), how.alias("how"), F.col("_similarity").alias("similarity"), F.col("_line").alias("line"), F.col("_n").alias("n_lines"))


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """The licence of every document; its path is source/lang/doc_id, and a directory's first licensed document stands for its licence file."""
    docs = _base.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string")).alias("at"))
    return scan(docs, "at", first_is_file=True).select("doc_id", "path", "license", "how", F.round("similarity", 6).alias("similarity"), "line", "n_lines")


def op3_sql(templates=TEMPLATES, threshold: float = THRESHOLD, header_lines: int = HEADER_LINES) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fold = lambda c: f"lower({c})"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)}, {c})" for i, (n, x) in enumerate(templates) for t, c in _terms_of(x).items())
    ahead = "".join(f", lead(unit, {k}) over w as u{k}" for k in range(1, header_lines))
    windows = " union all ".join(f"select doc_id, line, {k + 1} as n, concat_ws(' ', unit{''.join(f', u{j}' for j in range(1, k + 1))}) as unit from led" + (f" where u{k} is not null" if k else "") for k in range(header_lines))
    return f"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || doc_id::varchar as path from documents),
tt as (select * from (values {rows}) v(i, name, t, c)),
n as (select count(*)::double as n from d),
seen as (select t, count(*) as df from (select distinct doc_id, unnest(regexp_split_to_array({fold("text")}, '{_BREAK}')) as t from d) where t in (select t from tt) group by t),
idf as (select x.t, ln((1 + n) / (1 + coalesce(df, 0))) + 1 as idf from (select distinct t from tt) x left join seen using (t), n),
tv as (select i, name, t, c * idf as w, sqrt(sum((c * idf) ** 2) over (partition by i)) as norm from tt join idf using (t)),
single as (select doc_id, unnest(string_split(text, chr(10))) as unit, unnest(range(0, len(string_split(text, chr(10))))) as line from d),
led as (select doc_id, line, unit{ahead} from single window w as (partition by doc_id order by line)),
lines as ({windows}),
terms as (select doc_id, line, n, t, count(*) as tf from (select doc_id, line, n, unnest(regexp_split_to_array({fold("unit")}, '{_BREAK}')) as t from lines) where t <> '' group by all),
wt as (select doc_id, line, terms.n, t, tf * coalesce(idf, (select ln(1 + n) + 1 from n)) as w from terms left join idf using (t)),
norms as (select doc_id, line, n, sqrt(sum(w * w)) as norm from wt group by all),
dots as (select doc_id, line, n, i, name, sum(wt.w * tv.w / tv.norm) as dot from wt join tv using (t) group by all),
cos as (select doc_id, line, n, i, name, round(dot / norm, 9) as s from dots join norms using (doc_id, line, n)),
own as (select * from cos where s >= {threshold} qualify row_number() over (partition by doc_id order by s desc, i, n, line) = 1),
x as (select d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') as dir, name as license, s, line, own.n from d left join own using (doc_id)),
declared as (select dir, arg_min(license, doc_id) as license from x where license is not null group by dir)
select doc_id, path, coalesce(x.license, a.license, b.license, c.license) as license,
       case when x.license is not null then 'header' when coalesce(a.license, b.license, c.license) is not null then 'inherited' else 'none' end as how,
       round(s, 6) as similarity, line::int as line, x.n::int as n_lines
from x left join declared a on x.dir = a.dir left join declared b on regexp_replace(x.dir, '/?[^/]*$', '') = b.dir left join declared c on c.dir = ''
"""


OP3_SQL = op3_sql()

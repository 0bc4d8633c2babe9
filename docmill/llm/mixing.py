"""Mixing sources to target weights (operator 1).

Words are counted per source (partial sums before the only shuffle), target shares are filled up
like water under the cap of ``max_repeat`` times each source, and every document is then taken
floor(rate) times plus one more time with probability frac(rate), decided by a seeded hash of its id.

Cases: null text has size 0; a null source is a source of its own, last in order; sources of no
words get target 0 and rate 0; documents with equal ids draw equal numbers, so reruns and repeated
rows agree; an empty table gives an empty result. Columns of the input are kept, but those named
like an output column (size, source_size, target, rate, copies, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm import _base

#: One word, by the ASCII white space of the word-based operators.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix-1"
#: Up to so many sources the plan is broadcast (some 60 bytes each); beyond it Spark chooses the join.
BROADCAST_SOURCES = 20_000
OUTPUT = ("size", "source_size", "target", "rate", "copies", "taken")


def n_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """From (source, size) rows, one row per source: source, source_size, target, rate.

    The windows run over one row per source, after aggregation. A source is capped if its cap is not
    above its share of what the sources capped before it leave, in the order of cap by weight.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.withColumn("w", F.element_at(cycle, ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    by_source = by_source.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    capped = by_source.withColumn("total", total).withColumn("capped", F.col("cap") * weight_left <= F.col("w") * left)
    open_weight = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * open_words / open_weight)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    return capped.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(id_col, seed: str = SEED):
    """A number from 0 to 1 (not included) from the seed and the id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken; one row per document."""
    docs = docs.select(*[c for c in docs.columns if c not in OUTPUT], n_words(F.col(text_col)).alias("size"))
    return _apply(docs, docs.select(F.col(source_col).alias("source"), "size"), id_col, source_col, weights, max_repeat, seed)


def _apply(docs, sizes, id_col, source_col, weights, max_repeat, seed) -> DataFrame:
    key = _base.free("_mix_source", docs.columns)
    shares = _base.settle(plan(sizes, weights, max_repeat).withColumnRenamed("source", key), "mix-plan")
    side = F.broadcast(shares) if shares.count() <= BROADCAST_SOURCES else shares
    joined = docs.join(side, F.col(source_col).eqNullSafe(F.col(key)), "left").drop(key)
    whole = F.floor("rate")
    copies = (whole + F.when(draw(F.col(id_col), seed) < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """Each row of mix() as often as its copies say, without the mix's own columns."""
    kept = [c for c in mixed.columns if c not in OUTPUT]
    copy = _base.free("_copy", kept)
    return mixed.where("copies > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy)).drop(copy)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents. Sizes are counted once and kept as (doc_id, source, size)."""
    docs = _base.table(spark, sf_dir, "documents")
    sized = _base.settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    mixed = _apply(sized, sized.select("source", "size"), "doc_id", "source", WEIGHTS, MAX_REPEAT, SEED)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


OP1_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size,
         [5.0, 2.0, 1.0][((row_number() over (order by source collate "C" nulls last) - 1) % 3 + 1)::int]::double as w
  from sized group by source
), c as (
  select *, source_size * 3.0::double as cap, (sum(source_size) over ())::double as total, sum(w) over () as all_w from s
), o as (
  select *, cap * (all_w - coalesce(sum(w) over b, 0)) <= w * (total - coalesce(sum(cap) over b, 0)) as capped
  from c window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), p as (
  select source, source_size,
         case when capped then cap else w * (total - coalesce(sum(case when capped then cap end) over (), 0))
              / sum(case when not capped then w end) over () end as target
  from o
), r as (
  select *, case when source_size > 0 then least(target / source_size, 3.0) else 0.0 end::double as rate from p
), d as (
  select doc_id, x.source, size, source_size, target,
         (floor(rate) + case when ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / 4503599627370496.0::double
                               < rate - floor(rate) then 1 else 0 end)::int as copies
  from sized x join r on x.source is not distinct from r.source
)
select *, (size * copies)::bigint as taken from d
"""

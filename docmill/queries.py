"""The registered queries: every operator of the document API over the given tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import builtins as B
from docmill.plans.compiler import compile_query, filtered
from docmill.plans.model import Join, OrderBy, Q, Query, Select, Where

KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(name: str, build):
    """A query over one table; joins read other tables of the same folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = build() if callable(build) else build
        q = q.query() if isinstance(q, Q) else q
        return compile_query(q, table(spark, sf_dir, name), lambda n: table(spark, sf_dir, n), KEYS.get(name))

    return run


def _orders(*wheres: Where) -> Q:
    return Q().select("o_orderkey", "o_orderstatus", "o_totalprice").where(*wheres)


def _lines(*wheres: Where) -> Q:
    return Q().select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").where(*wheres)


def _parts(*wheres: Where) -> Q:
    return Q().select("p_partkey", "p_name", "p_type", "p_size").where(*wheres)


def _customers(*wheres: Where) -> Q:
    return Q().select("c_custkey", "c_name", "c_acctbal").where(*wheres)


_O = "select o_orderkey, o_orderstatus, o_totalprice from orders where "
_L = "select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where "
_P = "select p_partkey, p_name, p_type, p_size from part where "
_C = "select c_custkey, c_name, c_acctbal from customer where "

_to_customer = Join("customer", (Where("c_custkey", "eq", "$o_custkey"),), "c")


def _agg(fn: str, field: str) -> Q:
    return Q().select("l_returnflag", Select(field, fn)).group_by("l_returnflag")


def _builtin(name: str, columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(*columns())

    return run


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_add("scan_all", over("region", Q().select("*")), "select * from region")
_add("point_get", over("customer", Q().select("*").where(Where("c_custkey", "eq", 7)).limit(1)), "select * from customer where c_custkey = 7")
_add("batch_get", over("customer", Q().select("*").where(Where("c_custkey", "in", [1, 5, 9, 42]))), "select * from customer where c_custkey in (1, 5, 9, 42)")
_add("project_alias", over("nation", Q().select(Select("n_name", as_="nation"), "n_regionkey")), "select n_name as nation, n_regionkey from nation")
_add("where_eq", over("orders", _orders(Where("o_orderstatus", "eq", "F"))), _O + "o_orderstatus = 'F'")
_add("where_neq", over("orders", _orders(Where("o_orderstatus", "neq", "F"))), _O + "o_orderstatus is distinct from 'F'")
_add("where_eq_typed", over("orders", _orders(Where("o_orderstatus", "eq", 1))), _O + "false")
_add("where_self_eq", over("lineitem", _lines(Where("l_suppkey", "eq", "$l_linenumber"))), _L + "l_suppkey = l_linenumber")
_add("where_self_neq", over("lineitem", _lines(Where("l_suppkey", "neq", "$l_linenumber"), Where("l_linenumber", "eq", 3))), _L + "l_suppkey <> l_linenumber and l_linenumber = 3")
_add("where_self_lt", over("lineitem", _lines(Where("l_partkey", "lt", "$l_suppkey"))), _L + "l_partkey < l_suppkey")
_add("where_lt", over("part", _parts(Where("p_size", "lt", 10))), _P + "coalesce(p_size, 0) < 10")
_add("where_lte", over("part", _parts(Where("p_size", "lte", 10))), _P + "coalesce(p_size, 0) <= 10")
_add("where_gt", over("customer", _customers(Where("c_acctbal", "gt", 5000))), _C + "coalesce(c_acctbal, 0) > 5000")
_add("where_gte", over("customer", _customers(Where("c_acctbal", "gte", -100))), _C + "coalesce(c_acctbal, 0) >= -100")
_add("where_numeric_string", over("events", Q().select("event_id", "user_id").where(Where("props.k", "gt", 50))), "select event_id, user_id from events where coalesce(try_cast(props->>'$.k' as double), 0) > 50")
_add("where_time", over("events", Q().select("event_id", "ts").where(Where("ts", "gte", "2024-01-15 00:00:00"))), "select event_id, ts from events where ts >= timestamp '2024-01-15 00:00:00'")
_add("where_in", over("orders", _orders(Where("o_orderstatus", "in", ["F", "P"]))), _O + "o_orderstatus in ('F', 'P')")
_add("where_contains", over("part", _parts(Where("p_name", "contains", "ring"))), _P + "contains(p_name, 'ring')")
_add("where_contains_all", over("part", _parts(Where("p_name", "containsAll", ["small", "ring"]))), _P + "list_has_all(string_split(p_name, ' '), ['small', 'ring'])")
_add("where_contains_any", over("part", _parts(Where("p_name", "containsAny", ["small", "ring"]))), _P + "list_has_any(string_split(p_name, ' '), ['small', 'ring'])")
_add("where_has_prefix", over("part", _parts(Where("p_name", "hasPrefix", "s"))), _P + "starts_with(p_name, 's')")
_add("where_has_suffix", over("part", _parts(Where("p_name", "hasSuffix", "g"))), _P + "ends_with(p_name, 'g')")
_add("where_regex", over("part", _parts(Where("p_name", "regex", "^[a-m].*r"))), _P + "regexp_matches(p_name, '^[a-m].*r')")
_add("where_conjunction", over("lineitem", _lines(Where("l_quantity", "gt", 30), Where("l_returnflag", "eq", "R"), Where("l_discount", "lte", 0.05))), _L + "l_quantity > 30 and l_returnflag = 'R' and l_discount <= 0.05")


def foreach_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan behind ForEach: filtered documents, whole, before anything is handed out one by one."""
    where = (Where("text", "regex", "(?i)licen[sc]e"), Where("lang", "eq", "en"))
    return filtered(table(spark, sf_dir, "documents"), (), where, lambda n: table(spark, sf_dir, n), False).select("doc_id", "source")


_add("foreach_scan", foreach_scan, "select doc_id, source from documents where regexp_matches(text, '(?i)licen[sc]e') and lang = 'en'")

_add("join_left_eq", over("orders", Q().select("o_orderkey", Select("c.c_name", as_="customer")).join(_to_customer)), "select o_orderkey, c_name as customer from orders left join customer on c_custkey = o_custkey")
_add("join_theta_neq", over("nation", Q().select("n_name", Select("r.r_name", as_="other")).join(Join("region", (Where("r_regionkey", "neq", "$n_regionkey"),), "r"))), "select n_name, r_name as other from nation left join region on r_regionkey <> n_regionkey")
_add("join_range", over("nation", Q().select("n_nationkey", Select("b.n_nationkey", as_="below")).join(Join("nation", (Where("n_nationkey", "lt", "$n_nationkey"), Where("n_regionkey", "eq", "$n_regionkey")), "b"))), "select a.n_nationkey, b.n_nationkey as below from nation a left join nation b on b.n_nationkey < a.n_nationkey and a.n_regionkey = b.n_regionkey")
_add("join_const_clause", over("orders", Q().select("o_orderkey", Select("c.c_name", as_="builder")).join(Join("customer", (Where("c_custkey", "eq", "$o_custkey"), Where("c_mktsegment", "eq", "BUILDING")), "c"))), "select o_orderkey, c_name as builder from orders left join customer on c_custkey = o_custkey and c_mktsegment = 'BUILDING'")
_add("join_one_to_many", over("customer", Q().select("c_custkey", Select("o.o_orderkey", as_="o_orderkey")).join(Join("orders", (Where("o_custkey", "eq", "$c_custkey"),), "o"))), "select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey")
_add("join_chain3", over("lineitem", Q().select("l_orderkey", "l_linenumber", "l_partkey", Select("c.c_name", as_="customer")).join(Join("orders", (Where("o_orderkey", "eq", "$l_orderkey"),), "o"), Join("customer", (Where("c_custkey", "eq", "$o.o_custkey"),), "c"))), "select l_orderkey, l_linenumber, l_partkey, c_name as customer from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey")
_add("join_then_filter_inner", over("orders", Q().select("o_orderkey", Select("c.c_name", as_="customer")).join(_to_customer).where(Where("c.c_mktsegment", "eq", "BUILDING"))), "select o_orderkey, c_name as customer from orders join customer on c_custkey = o_custkey where c_mktsegment = 'BUILDING'")
_add("join_default_alias", over("nation", Q().select("n_name", Select("region.r_name", as_="region")).join(Join("region", (Where("r_regionkey", "eq", "$n_regionkey"),)))), "select n_name, r_name as region from nation left join region on r_regionkey = n_regionkey")

_add("agg_count", over("lineitem", _agg("count", "l_orderkey")), "select l_returnflag, count(*)::double as count_l_orderkey from lineitem group by 1")
_add("agg_sum", over("lineitem", _agg("sum", "l_quantity")), "select l_returnflag, sum(l_quantity) as sum_l_quantity from lineitem group by 1")
_add("agg_min", over("lineitem", _agg("min", "l_extendedprice")), "select l_returnflag, min(l_extendedprice) as min_l_extendedprice from lineitem group by 1")
_add("agg_max", over("lineitem", _agg("max", "l_extendedprice")), "select l_returnflag, max(l_extendedprice) as max_l_extendedprice from lineitem group by 1")
_add("agg_multi_key", over("lineitem", Q().select("l_returnflag", "l_linestatus", Select("l_quantity", "sum", "qty"), Select("l_quantity", "count", "n"), Select("l_discount", "max", "most")).group_by("l_returnflag", "l_linestatus")), "select l_returnflag, l_linestatus, sum(l_quantity) as qty, count(*)::double as n, max(l_discount) as most from lineitem group by 1, 2")
_add("agg_global", over("orders", Q().select(Select("o_orderkey", "count", "n"), Select("o_totalprice", "max", "most"))), "select count(*)::double as n, max(o_totalprice) as most from orders")
_add("agg_global_empty", over("orders", Q().select(Select("o_orderkey", "count", "n")).where(Where("o_orderstatus", "eq", "none"))), "select count(*)::double as n from orders where o_orderstatus = 'none' having count(*) > 0")
_add("agg_expr_key", over("events", Q().select(Select("ts|@dateTrunc:day", as_="day"), Select("event_id", "count", "n")).group_by("ts|@dateTrunc:day")), "select strftime(date_trunc('day', ts), '%Y-%m-%d 00:00:00 +0000 UTC') as day, count(*)::double as n from events group by 1")
_add("agg_having", over("orders", Q().select("o_custkey", Select("o_orderkey", "count", "n")).group_by("o_custkey").having(Where("n", "gte", 12))), "select o_custkey, count(*)::double as n from orders group by 1 having count(*) >= 12")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined, filtered, grouped and sorted: the value of large orders by market segment, in whole cents."""
    q = Q().join(_to_customer).where(Where("o_totalprice", "gt", 200000)).select(Select("c.c_mktsegment", as_="segment"), Select("o_totalprice", "sum", "total"), Select("o_orderkey", "count", "n")).group_by("c.c_mktsegment").order_by(OrderBy("segment")).query()
    out = compile_query(q, table(spark, sf_dir, "orders"), lambda n: table(spark, sf_dir, n), "o_orderkey")
    return out.withColumn("total", F.round("total", 2))


_add("agg_join", flagship, "select c_mktsegment as segment, round(sum(o_totalprice), 2) as total, count(*)::double as n from orders left join customer on c_custkey = o_custkey where o_totalprice > 200000 group by 1 order by 1")
_add("order_multi", over("customer", Q().select("c_custkey", "c_mktsegment", "c_acctbal").order_by(OrderBy("c_mktsegment"), OrderBy("c_acctbal", "desc"))), "select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey")
_add("limit_topk", over("customer", Q().select("c_custkey", "c_acctbal").order_by(OrderBy("c_acctbal", "desc")).limit(10)), "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 10")
_add("page_2", over("customer", Q().select("c_custkey", "c_acctbal").order_by(OrderBy("c_acctbal", "asc")).limit(25).page(2)), "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 25 offset 50")
_add("agg_order_page", over("orders", Q().select("o_custkey", Select("o_orderkey", "count", "n")).group_by("o_custkey").order_by(OrderBy("n", "desc"), OrderBy("o_custkey")).limit(5).page(1)), "select o_custkey, count(*)::double as n from orders group by 1 order by n desc, o_custkey limit 5 offset 5")

_add("json_get", over("events", Q().select("event_id", Select("props.k", as_="k"))), "select event_id, props->>'$.k' as k from events")
_add("json_not_null", over("events", Q().select("event_id").where(Where("props.k", "neq", "null"))), "select event_id from events where props->>'$.k' is not null")
_add("json_eq", over("events", Q().select("event_id").where(Where("props.k", "eq", 42))), "select event_id from events where (props->>'$.k') = '42'")
_add("array_path", over("embeddings", Q().select("vec_id", Select("embedding.0", as_="first"), Select("embedding.#", as_="n"))), "select vec_id, embedding[1] as first, len(embedding)::bigint as n from embeddings")
_add("mod_case", over("part", Q().select("p_partkey", Select("p_name|@upper", as_="up"), Select("p_brand|@lower", as_="low"), Select("p_name|@snakeCase", as_="snake"), Select("p_name|@kebabCase", as_="kebab"), Select("p_name|@camelCase", as_="camel"))), "select p_partkey, upper(p_name) as up, lower(p_brand) as low, replace(lower(p_name), ' ', '_') as snake, replace(lower(p_name), ' ', '-') as kebab, lower(string_split(p_name, ' ')[1]) || upper(string_split(p_name, ' ')[2][1]) || lower(string_split(p_name, ' ')[2][2:]) as camel from part")
_add("mod_replace_trim", over("part", Q().select("p_partkey", Select('p_name|@replaceAll:{"old":"ring","new":"band"}', as_="replaced"), Select("p_name|@trim", as_="trimmed"))), "select p_partkey, replace(p_name, 'ring', 'band') as replaced, replace(p_name, ' ', '') as trimmed from part")
_add("mod_date_trunc", over("events", Q().select("event_id", Select("ts|@dateTrunc:month", as_="month"), Select("ts|@dateTrunc:year", as_="year"))), "select event_id, strftime(date_trunc('month', ts), '%Y-%m-%d 00:00:00 +0000 UTC') as month, strftime(date_trunc('year', ts), '%Y-%m-%d 00:00:00 +0000 UTC') as year from events")
_add("mod_unix", over("events", Q().select("event_id", Select("ts|@unix", as_="s"), Select("ts|@unixMilli", as_="ms"), Select("ts|@unixNano", as_="ns"))), "select event_id, (epoch_us(ts) // 1000000)::varchar as s, (epoch_us(ts) // 1000)::varchar as ms, (epoch_us(ts) * 1000)::varchar as ns from events")

_add("fn_hash", _builtin("customer", lambda: ["c_custkey", B.BUILTINS["md5"](F.col("c_name")).alias("m"), B.BUILTINS["sha1"](F.col("c_name")).alias("s1"), B.BUILTINS["sha256"](F.col("c_name")).alias("s2")]), "select c_custkey, md5(c_name) as m, sha1(c_name) as s1, sha256(c_name) as s2 from customer")
_add("fn_base64", _builtin("customer", lambda: ["c_custkey", B.BUILTINS["base64Encode"](F.col("c_name")).alias("b"), B.BUILTINS["base64Decode"](B.BUILTINS["base64Encode"](F.col("c_name"))).alias("back")]), "select c_custkey, to_base64(c_name::blob) as b, c_name as back from customer")
_add("fn_strings", _builtin("part", lambda: ["p_partkey", B.trim_prefix(F.col("p_brand"), "Brand#").alias("number"), B.trim_suffix(F.col("p_name"), "ring").alias("stem"), B.BUILTINS["startsWith"](F.col("p_name"), "s").alias("s"), B.to_int(B.trim_prefix(F.col("p_brand"), "Brand#")).alias("n"), B.quote(F.col("p_name")).alias("quoted")]), "select p_partkey, replace(p_brand, 'Brand#', '') as number, regexp_replace(p_name, 'ring$', '') as stem, starts_with(p_name, 's') as s, replace(p_brand, 'Brand#', '')::bigint as n, '\"' || p_name || '\"' as quoted from part")
_add("fn_arrays", _builtin("part", lambda: ["p_partkey", F.size(B.split(F.col("p_name"), " ")).alias("n"), B.last(B.split(F.col("p_name"), " ")).alias("last"), F.array_join(F.reverse(B.split(F.col("p_name"), " ")), "-").alias("turned"), B.index_of(B.split(F.col("p_name"), " "), "ring").alias("at")]), "select p_partkey, len(string_split(p_name, ' '))::int as n, string_split(p_name, ' ')[-1] as last, array_to_string(list_reverse(string_split(p_name, ' ')), '-') as turned, coalesce(list_position(string_split(p_name, ' '), 'ring'), 0)::bigint - 1 as at from part")
_add("fn_convert", _builtin("events", lambda: ["event_id", B.to_float(F.get_json_object("props", "$.k")).alias("f"), B.to_bool(F.get_json_object("props", "$.k")).alias("b"), B.to_int(F.col("event_type")).alias("i"), B.to_str(F.col("user_id")).alias("s")]), "select event_id, coalesce(try_cast(props->>'$.k' as double), 0) as f, coalesce((props->>'$.k') in ('1','t','T','TRUE','true','True'), false) as b, 0::bigint as i, user_id::varchar as s from events")

__all__ = ["QUERIES", "SQL", "Query", "flagship"]

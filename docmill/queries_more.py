"""Further registered queries: the document API, transactions, configuration and script functions, each through the operator that it is named for."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import queries_dml as dml
from docmill.authz import Context
from docmill.database import Database
from docmill.errors import DocError
from docmill.functions.builtins import BUILTINS as B
from docmill.operators.documents import Document, Documents, from_json_value
from docmill.plans.compiler import compile_query
from docmill.plans.model import Join, OrderBy, Q, Query, Select, Where
from docmill.queries import table
from docmill.sources import convert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _fails(work) -> str:
    """The kind of error that work raises, or none."""
    try:
        work()
    except DocError as e:
        return type(e).__name__
    return "none"


# clauses and paths


@_query("select event_id from events where event_id % 2 = 1")
def where_self_long(spark, sf_dir):
    """Longs beyond 2**53 that differ in the last digit."""
    events = table(spark, sf_dir, "events").select("event_id", (F.lit(1_705_363_200_000_000_000) + F.col("event_id")).alias("a"))
    return compile_query(Q().select("event_id").where(Where("a", "lt", "$b")).query(), events.withColumn("b", F.col("a") + F.col("event_id") % 2), None)


@_query(r"select p_partkey from part where regexp_matches(p_name, '(?P<first>[a-m]\p{L}+) ring')")
def where_regex_classes(spark, sf_dir):
    return compile_query(Q().select("p_partkey").where(Where("p_name", "regex", r"(?P<first>[a-m]\p{L}+) ring")).query(), table(spark, sf_dir, "part"), None)


@_query("select p_partkey from part where list_contains(string_split(p_name, ' '), 'ring')")
def where_contains_list(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return compile_query(Q().select("p_partkey").where(Where("words", "contains", "ring")).query(), parts, None)


@_query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3")
def where_nested_path(spark, sf_dir):
    packed = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("at")).alias("info"))
    return compile_query(Q().select("c_custkey", "c_name").where(Where("info.segment", "eq", "BUILDING"), Where("info.at.nation", "eq", 3)).query(), packed, None)


@_query("select event_id, strftime(ts, '%Y-%m-%d') || ' 00:00:00 +0000 UTC' as day, strftime(ts, '%Y-%m') || '-01 00:00:00 +0000 UTC' as month from events")
def mod_date_zone(spark, sf_dir):
    """Late evenings west of Greenwich stay on their own day."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T23:00:00-05:00")).alias("at"))
    return compile_query(Q().select("event_id", Select("at|@dateTrunc:day", as_="day"), Select("at|@dateTrunc:month", as_="month")).query(), events, None)


@_query("select p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), '-') as turned, string_split(p_name, ' ')[2] as second from part")
def mod_reverse(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    out = compile_query(Q().select("p_partkey", Select("words|@reverse", as_="turned"), Select("words.1", as_="second")).query(), parts, None)
    return out.withColumn("turned", F.array_join("turned", "-"))


@_query("select p_brand, count(*)::double as n, min(p_size)::double as least, max(p_size)::double as most from part where p_size > 5 group by 1")
def query_from_json(spark, sf_dir):
    """The same query model, read from its JSON form."""
    text = {"select": [{"field": "p_brand"}, {"field": "p_partkey", "aggregate": "count", "as": "n"}, {"field": "p_size", "aggregate": "min", "as": "least"}, {"field": "p_size", "aggregate": "max", "as": "most"}], "where": [{"field": "p_size", "op": "gt", "value": 5}], "groupBy": ["p_brand"]}
    return compile_query(Query.from_dict(json.loads(json.dumps(text))), table(spark, sf_dir, "part"), None)


@_query("select * from (values ('unknown operator', 'Validation'), ('unknown aggregate', 'Validation'), ('bad direction', 'Validation'), ('negative limit', 'Validation'), ('fine', 'none')) v(kind, error)")
def query_validation(spark, sf_dir):
    bad = {
        "unknown operator": Q().select("a").where(Where("a", "like", 1)), "unknown aggregate": Q().select(Select("a", "median", "m")), "bad direction": Q().select("a").order_by(OrderBy("a", "up")),
        "negative limit": Q().select("a").limit(-1), "fine": Q().select("a").where(Where("a", "eq", 1)),
    }
    return spark.createDataFrame([(k, _fails(lambda q=q: q.query().check())) for k, q in bad.items()], "kind string, error string")


# reads of a database


@_query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation where n_nationkey = 3")
def document_get(spark, sf_dir):
    d = dml._world(spark, sf_dir).get("nation", 3)
    return spark.createDataFrame([(d.get("n_nationkey"), d.get("n_name"), d.get("n_regionkey"))], "n_nationkey bigint, n_name string, n_regionkey bigint")


@_query("select * from (select n_nationkey::bigint as id, n_name as name from nation where n_nationkey in (7, 2, 11)) union all select -1, 'NotFound'")
def document_batch_get(spark, sf_dir):
    db = dml._world(spark, sf_dir)
    found = [(d.get("n_nationkey"), d.get("n_name")) for d in db.batch_get("nation", [7, 2, 11])]
    return spark.createDataFrame([*found, (-1, _fails(lambda: db.batch_get("nation", [7, 999])))], "id bigint, name string")


@_query("select n_name as nation, r_name as region from nation join region on r_regionkey = n_regionkey where r_regionkey < 3")
def foreach_joined(spark, sf_dir):
    """Documents handed to a function one by one, joined and filtered."""
    rows: list = []
    dml._world(spark, sf_dir).for_each("nation", lambda d: rows.append((d.get("n_name"), d.get("r.r_name"))), [Where("n_regionkey", "lt", 3)], [Join("region", (Where("r_regionkey", "eq", "$n_regionkey"),), "r")])
    return spark.createDataFrame(rows, "nation string, region string")


@_query("select 3::bigint as seen")
def foreach_stopped(spark, sf_dir):
    seen: list = []
    dml._world(spark, sf_dir).for_each("nation", lambda d: seen.append(d) or len(seen) < 3)
    return spark.createDataFrame([(len(seen),)], "seen bigint")


@_query("select 2::bigint as next_page, n_name, n_nationkey::bigint as n_nationkey from nation order by n_nationkey limit 10 offset 10")
def query_page(spark, sf_dir):
    page = dml._world(spark, sf_dir).query("nation", Q().order_by(OrderBy("n_nationkey")).limit(10).page(1).query())
    return page.documents.select(F.lit(page.next_page).cast("bigint").alias("next_page"), "n_name", "n_nationkey")


# writes


def _customers(spark, sf_dir, **extra: dict) -> tuple[Database, DataFrame]:
    rows = table(spark, sf_dir, "customer")
    db = Database(spark, dml._root(spark))
    schema = dml._schema_of(rows, "customer", "c_custkey")
    schema["properties"].update({k: {**schema["properties"].get(k, {}), **v} for k, v in extra.items()})
    db.configure([schema])
    return db, rows


@_query("select c_custkey, upper(c_name) as shout, 'new' as state from customer")
def fields_computed_and_default(spark, sf_dir):
    """A field computed on read, and a default."""
    db, rows = _customers(spark, sf_dir, shout={"type": "string", "x-compute": {"expr": "upper(c_name)", "read": True}}, state={"type": "string", "default": "new"})
    db.tx(lambda t: t.create_all("customer", rows))
    return db.query("customer", Q().select("c_custkey", "shout", "state").query()).documents


@_query("select c_custkey::varchar as id, true as equal, true as recent from customer")
def change_log_computed(spark, sf_dir):
    """Clock values that a bulk creation computes are the same in the data and in the log."""
    db, rows = _customers(spark, sf_dir, made={"type": "integer", "x-compute": {"expr": "now().UnixMilli()", "write": True}})
    db.tx(lambda t: t.create_all("customer", rows))
    log = db.store(Context()).cdc().where("collection = 'customer'").select("documentID", F.explode("diff").alias("o")).where("o.path = 'made'").select(F.col("documentID").alias("id"), from_json_value(F.col("o.value"), T.LongType()).alias("logged"))
    data = db.raw("customer").select(F.col("c_custkey").cast("string").alias("id"), "made")
    return data.join(log, "id").select("id", (F.col("made") == F.col("logged")).alias("equal"), (F.col("made") > 1_700_000_000_000).alias("recent"))


@_query("select 'Validation' as create_error, 'Validation' as set_error, count(*)::bigint as rows from customer")
def tx_create_duplicates(spark, sf_dir):
    """Ids that are there twice are refused, and nothing of such a transaction is kept."""
    db, rows = _customers(spark, sf_dir)
    twice = rows.unionByName(rows.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.lit(0.0)))
    first = _fails(lambda: db.tx(lambda t: t.create_all("customer", twice)))
    db.tx(lambda t: t.create_all("customer", rows))
    return db.raw("customer").agg(F.count("*").alias("rows")).select(F.lit(first).alias("create_error"), F.lit(_fails(lambda: db.tx(lambda t: t.set_all("customer", twice)))).alias("set_error"), "rows")


@_query("select c_custkey, case when c_custkey % 3 = 0 then 1.5 else c_acctbal end as c_acctbal from customer union all select c_custkey + 10000000, c_acctbal from customer where c_custkey % 5 = 0")
def tx_upsert_customers(spark, sf_dir):
    """A bulk upsert of a whole table: every third customer changes, every fifth has a new double."""
    db, rows = _customers(spark, sf_dir)
    db.tx(lambda t: t.create_all("customer", rows))
    changed = rows.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(1.5))
    more = rows.where("c_custkey % 5 = 0").withColumn("c_custkey", (F.col("c_custkey") + 10_000_000).cast(rows.schema["c_custkey"].dataType))
    db.tx(lambda t: t.set_all("customer", changed.unionByName(more)))
    return db.raw("customer").select("c_custkey", "c_acctbal")


def _ordering(spark, sf_dir) -> Database:
    """Customers and the orders that refer to them."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    db = Database(spark, dml._root(spark))
    db.configure([dml._schema_of(customer, "customer", "c_custkey"), dml._schema_of(orders, "orders", "o_orderkey", o_custkey={"x-foreign": {"collection": "customer", "cascade": True}})])
    db.tx(lambda t: (t.create_all("customer", customer), t.create_all("orders", orders)))
    return db


@_query("select o_orderkey from orders where o_custkey % 7 <> 0")
def tx_delete_cascade_orders(spark, sf_dir):
    """Customers deleted in bulk take their orders along."""
    db = _ordering(spark, sf_dir)
    db.tx(lambda t: t.delete_all("customer", table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select("c_custkey")))
    return db.raw("orders").select("o_orderkey")


@_query("select c_custkey, c_name from customer where c_custkey % 2 = 1")
def tx_revert_customers(spark, sf_dir):
    """Every second customer deleted after all were renamed; the rest set back to what a snapshot has."""
    import time

    db, rows = _customers(spark, sf_dir)
    db.tx(lambda t: t.create_all("customer", rows))
    then = time.time_ns()
    db.tx(lambda t: t.update_all("customer", rows.select("c_custkey", F.lit("x").alias("c_name"))))
    db.tx(lambda t: t.delete_all("customer", rows.where("c_custkey % 2 = 0").select("c_custkey")))
    db.tx(lambda t: t.set_all("customer", t.snapshot("customer", then).where("c_custkey % 2 = 1")))
    return db.raw("customer").select("c_custkey", "c_name")


@_query("select 'before' as name, n_nationkey::bigint as id from nation where n_nationkey = 4 union all select 'Forbidden', -1")
def tx_rollback(spark, sf_dir):
    """A transaction sees its own writes; after a rollback they are gone, and it takes no more."""
    db = dml._world(spark, sf_dir)
    db.tx(lambda t: t.update("nation", 4, {"n_name": "before"}))
    t = db.begin()
    t.update("nation", 4, {"n_name": "after"})
    assert t.get("nation", 4).get("n_name") == "after"
    t.rollback()
    d = db.get("nation", 4)
    return spark.createDataFrame([(d.get("n_name"), d.get("n_nationkey")), (_fails(lambda: t.set("nation", {"n_nationkey": 4, "n_name": "late"})), -1)], "name string, id bigint")


@_query("select * from (values ('create', 'Validation'), ('update', 'NotFound'), ('foreign key', 'Validation'), ('read only', 'Forbidden'), ('wrong type', 'Validation')) v(kind, error)")
def tx_refusals(spark, sf_dir):
    db = dml._world(spark, sf_dir)
    cases = {
        "create": lambda: db.tx(lambda t: t.create("nation", {"n_nationkey": 3, "n_name": "x", "n_regionkey": 1})), "update": lambda: db.tx(lambda t: t.update("nation", 999, {"n_name": "x"})),
        "foreign key": lambda: db.tx(lambda t: t.create("nation", {"n_nationkey": 999, "n_name": "x", "n_regionkey": 77})), "read only": lambda: db.begin(read_only=True).set("nation", {"n_nationkey": 3}),
        "wrong type": lambda: db.tx(lambda t: t.set("nation", {"n_nationkey": 3, "n_name": 5, "n_regionkey": 1})),
    }
    return spark.createDataFrame([(k, _fails(f)) for k, f in cases.items()], "kind string, error string")


# configuration


@_query("select c_custkey, c_nationkey::varchar as c_nationkey, null::varchar as note from customer")
def replace_collection(spark, sf_dir):
    """A stored number field becomes text, and a field is added."""
    db, rows = _customers(spark, sf_dir)
    db.tx(lambda t: t.create_all("customer", rows))
    schema = dml._schema_of(rows, "customer", "c_custkey")
    schema["properties"]["c_nationkey"] = {"type": "string"}
    schema["properties"]["note"] = {"type": "string"}
    db.configure([schema])
    return db.raw("customer").select("c_custkey", "c_nationkey", "note")


@_query("select r_regionkey::bigint as r_regionkey, 0::bigint as nations from region")
def drop_collection(spark, sf_dir):
    """A dropped collection is empty when it is declared again, in every namespace."""
    db = dml._world(spark, sf_dir)
    other = Context({"namespace": "other"})
    db.tx(lambda t: (t.create_all("region", table(spark, sf_dir, "region")), t.create_all("nation", table(spark, sf_dir, "nation"))), other)
    schemas = [s.raw for s in (db.schemas["region"], db.schemas["nation"])]
    db.configure(schemas[:1])
    db.configure(schemas)
    left = db.raw("nation").count() + db.raw("nation", other).count()
    return db.raw("region").select("r_regionkey", F.lit(left).cast("bigint").alias("nations"))


@_query("select * from (values (0, true, false), (1, false, true), (2, true, true), (3, true, false)) v(step, first, second)")
def lock_lease(spark, sf_dir):
    """(0) taken once, (1) only the holder renews: shown as first=false for the other, (2) an expired lease is taken over, (3) the old holder has lost it."""
    store = Database(spark, dml._root(spark)).store(Context())
    a, b = store.lock("job"), store.lock("job")
    rows = [(0, a.try_lock(), b.try_lock()), (1, b.renew(), a.renew())]
    short = store.lock("short", 0.0)
    late = store.lock("short", 60.0)
    rows += [(2, short.try_lock(), late.try_lock()), (3, late.is_locked(), short.renew())]
    return spark.createDataFrame(rows, "step int, first boolean, second boolean")


# documents


@_query("""select * from (values ('string', 'abc'), ('bool', 'true'), ('float', '2.5'), ('int', '7'), ('array', '[1, 2]'), ('missing string', ''), ('exists null', 'true'), ('exists none', 'false'), ('nested', 'deep'), ('length', '2')) v(what, value)""")
def document_getters(spark, sf_dir):
    d = Document({"s": "abc", "b": "true", "f": "2.5", "i": 7, "l": [1, 2], "n": None, "o": {"p": "deep"}})
    rows = [("string", d.get_string("s")), ("bool", json.dumps(d.get_bool("b"))), ("float", str(d.get_float("f"))), ("int", str(d.get_int("i"))), ("array", json.dumps(d.get_array("l"))), ("missing string", d.get_string("x")),
            ("exists null", json.dumps(d.exists("n"))), ("exists none", json.dumps(d.exists("x"))), ("nested", d.get("o.p")), ("length", str(d.get("l.#")))]
    return spark.createDataFrame(rows, "what string, value string")


@_query("""select * from (values ('set', '{"a":{"b":2,"c":3}}'), ('merge', '{"a":{"b":1,"d":4},"e":5}'), ('overwrite', '{"x":1}'), ('delete', '{"a":{}}'), ('join', '{"a":{"b":1},"o":{"z":9}}'), ('apply', '{"a":{"b":2},"n":1}'), ('revert', '{"a":{"b":1}}'), ('clone', '{"a":{"b":1}}')) v(what, value)""")
def document_changes(spark, sf_dir):
    start = Document({"a": {"b": 1}})
    after = start.clone().set("a.b", 2).set("n", 1)
    ops = after.diff(start)
    made = {"set": start.clone().set("a.b", 2).set("a.c", 3), "merge": start.clone().merge({"a": {"d": 4}, "e": 5}), "overwrite": start.clone().overwrite({"x": 1}), "delete": start.clone().delete("a.b"), "join": start.clone().merge_join({"z": 9}, "o"),
            "apply": start.clone().apply_ops(ops), "revert": after.clone().revert_ops(ops), "clone": start}
    return spark.createDataFrame([(k, json.dumps(v.value, separators=(",", ":"))) for k, v in made.items()], "what string, value string")


@_query("select * from (values ('slice', '2,3'), ('filter', '2,4'), ('map', '2,3,4,5'), ('each', '1,2,3,4')) v(what, value)")
def document_lists(spark, sf_dir):
    all_ = Documents([Document({"n": n}) for n in (1, 2, 3, 4)])
    seen: list = []
    all_.for_each(lambda d, _: seen.append(d.get("n")))
    text = lambda ds: ",".join(str(d.get("n")) for d in ds)
    rows = [("slice", text(all_.slice(1, 3))), ("filter", text(all_.filter(lambda d, _: d.get("n") % 2 == 0))), ("map", text(all_.map(lambda d, _: d.clone().set("n", d.get("n") + 1)))), ("each", ",".join(map(str, seen)))]
    return spark.createDataFrame(rows, "what string, value string")


@_query("select c_custkey, c_name, c_acctbal from customer")
def json_round_trip(spark, sf_dir):
    """Rows as JSON documents, written, read again and parsed."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = f"{dml._root(spark)}/json"
    convert.write_json(rows, path)
    return convert.read_json(spark, path, rows.schema)


@_query("""select * from (values ('a: 1\nb:\n- x\n- y\n', '{"a": 1, "b": ["x", "y"]}')) v(yaml, json)""")
def yaml_json(spark, sf_dir):
    text = '{"a": 1, "b": ["x", "y"]}'
    yaml = convert.json_to_yaml(text)
    return spark.createDataFrame([(yaml, json.dumps(json.loads(convert.yaml_to_json(yaml)), sort_keys=True))], "yaml string, json string")


# script functions as columns


def _words():
    return F.split("p_name", " ")


@_query("""select p_partkey, len(string_split(p_name, ' '))::int as n, 0::int as n_text, list_contains(string_split(p_name, ' '), 'ring') as has, contains(p_name, 'ring') as has_text, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') as uniq,
 array_to_string(string_split(p_name, ' ')[2:], ' ') as dropped, string_split(p_name, ' ')[2] as chunks, upper(replace(p_name, ' ', ',')) as mapped, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x = 'ring'), ',') as filtered,
 list_filter(string_split(p_name, ' '), lambda x: x <> 'ring')[1] as found, (p_size + 2)::double as total from part where len(string_split(p_name, ' ')) = 2""")
def fn_lists(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where(F.size(_words()) == 2)
    return parts.select(
        "p_partkey", B["len"](_words()).alias("n"), B["len"](F.col("p_name")).alias("n_text"), B["contains"](_words(), "ring").alias("has"), B["contains"](F.col("p_name"), "ring").alias("has_text"), B["join"](F.sort_array(B["uniq"](B["flatten"](F.array(_words(), _words())))), ",").alias("uniq"),
        B["join"](B["drop"](_words(), 1), " ").alias("dropped"), B["last"](B["last"](B["chunk"](_words(), 1))).alias("chunks"), B["join"](B["map"](_words(), F.upper), ",").alias("mapped"), B["join"](B["filter"](_words(), lambda x: x == "ring"), ",").alias("filtered"), B["find"](_words(), lambda x: x != "ring").alias("found"), B["sum"](F.array("p_size", F.lit(2))).alias("total"))


@_query("""select p_partkey, p_size = 0 as zero, false as zero_text, p_name = '' as empty_text, true as empty_list, p_size <> 0 as filled, p_brand = p_brand as same, p_size::varchar = '7' as seven, p_size::double as number, coalesce(p_name, 'x') as given, true as deep from part""")
def fn_zero(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", B["isZero"](F.col("p_size")).alias("zero"), B["isZero"](F.lit("abc")).alias("zero_text"), B["empty"](F.col("p_name")).alias("empty_text"), B["empty"](F.array().cast("array<int>")).alias("empty_list"), B["notEmpty"](F.col("p_size")).alias("filled"), B["equal"](F.col("p_brand"), F.col("p_brand")).alias("same"),
        B["equal"](B["toStr"](F.col("p_size")), F.lit("7")).alias("seven"), B["toFloat"](F.col("p_size").cast("string")).alias("number"), B["getOr"](F.col("p_name"), F.lit("x")).alias("given"), B["deepEqual"](F.array("p_size", "p_partkey"), F.array("p_size", "p_partkey")).alias("deep"))


@_query("""select p_partkey, replace(p_name, 'ring', 'band') as replaced, p_name as trimmed, ltrim(p_name, 's') as l, rtrim(p_name, 'g') as r, ends_with(p_name, 'ring') as e, p_name as unquoted, sha256(p_name) = sha256(p_name) as h, lower(p_brand) as low, upper(p_name) as up from part""")
def fn_text(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", B["replace"](name, "ring", "band").alias("replaced"), B["trim"](F.concat(F.lit(" \t"), name, F.lit(" \n"))).alias("trimmed"), B["trimLeft"](name, "s").alias("l"), B["trimRight"](name, "g").alias("r"), B["endsWith"](name, "ring").alias("e"), B["unquote"](B["quote"](name)).alias("unquoted"),
        (F.length(B["sha512"](name)) == 128).alias("h"), B["lower"](F.col("p_brand")).alias("low"), B["upper"](name).alias("up"))


@_query("""select event_id, epoch_us(ts) as micros, ts as parsed, ts as unixed, event_id * 1500000000::bigint as span, 5400000000000::bigint as fixed, true as past, true as ahead, true as clock from events""")
def fn_time(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events")
    wall = lambda c: c.cast("timestamp_ntz")
    return events.select(
        "event_id", F.unix_micros(B["unixMicro"](us)).alias("micros"), wall(B["toTime"](F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).alias("parsed"), wall(B["parseTime"](F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS"), "dd/MM/yyyy HH:mm:ss.SSSSSS")).alias("unixed"),
        B["toDuration"](F.concat((F.col("event_id") * 1.5).cast("decimal(20,1)").cast("string"), F.lit("s"))).alias("span"), B["toDuration"](F.lit("1h30m")).alias("fixed"), (B["now"]() > F.col("ts").cast("timestamp")).alias("past"),
        (B["until"](F.lit("2999-01-01").cast("timestamp")) > F.expr("interval '1' day")).alias("ahead"), (B["since"](F.lit("2001-01-01").cast("timestamp")) > F.expr("interval '1' day")).alias("clock"))


@_query("""select c_custkey, 'a,b' as keys, c_custkey || ',' || c_nationkey as vals, c_nationkey::bigint + 1 as changed, c_custkey as pruned, c_name as decoded, c_custkey::varchar as mapped, '{}' as fresh, c_nationkey::varchar as left_only from customer where c_nationkey <> c_custkey""")
def fn_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_nationkey != c_custkey").select("c_custkey", "c_name", F.col("c_custkey").cast("bigint").alias("k"), F.col("c_nationkey").cast("bigint").alias("n"))
    both = F.create_map(F.lit("a"), F.col("k"), F.lit("b"), F.col("n"))
    pair = F.struct("k", "n")
    return rows.select(
        "c_custkey", F.array_join(B["keys"](both), ",").alias("keys"), F.array_join(B["values"](both), ",").alias("vals"), B["set"](pair, "n", F.col("n") + 1).getField("n").alias("changed"), B["prune"](pair, "k").getField("k").cast(rows.schema["c_custkey"].dataType).alias("pruned"), F.try_variant_get(B["jsonDecode"](B["jsonEncode"](F.struct("c_name"))), "$.c_name", "string").alias("decoded"),
        B["toMap"](B["jsonEncode"](pair))["k"].alias("mapped"), F.to_json(B["newDocument"]()).alias("fresh"), B["difference"](F.array("k", "n"), F.array("k")).getField("left").getItem(0).cast("string").alias("left_only"))


@_query("select c_custkey, '[' || c_custkey || ',1]' as slice, 0::int as none, c_name as doc, 32::int as ids, true as uuids from customer")
def fn_convert_more(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select(
        "c_custkey", F.to_json(B["toSlice"](F.array("c_custkey", F.lit(1)))).alias("slice"), F.size(B["toSlice"](F.col("c_name"))).alias("none"), F.try_variant_get(B["asDoc"](F.struct("c_name")), "$.c_name", "string").alias("doc"), F.length(B["ksuid"]()).alias("ids"), (F.length(B["uuid"]()) == 36).alias("uuids"))

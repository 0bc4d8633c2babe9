"""Registered queries of writes, constraints, history and streams. Stores live in the session's shared folder, or in local mode in a temporary one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import authz, catalog, schema
from docmill.authz import Context
from docmill.database import Database
from docmill.functions import paths
from docmill.operators import documents as docs
from docmill.plans import explain
from docmill.plans.model import Where
from docmill.queries import table
from docmill.sources.store import CDC_TYPE
from docmill.streaming.changes import stream

_KINDS = {"string": "string", "int": "integer", "bigint": "integer", "double": "number"}


def _root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/docmill-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='docmill-')}"


def _schema_of(df: DataFrame, name: str, key: str, **extra: dict) -> dict:
    """A collection schema for a table; extra adds keywords to fields."""
    return {"type": "object", "x-collection": name, "required": [key], "properties": {c: {"type": _KINDS[t], **({"x-primary": True} if c == key else {}), **extra.get(c, {})} for c, t in df.dtypes if t in _KINDS}}


def _world(spark: SparkSession, sf_dir: str) -> Database:
    """Regions and nations, nations referring to regions."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    db = Database(spark, _root(spark))
    db.configure([_schema_of(region, "region", "r_regionkey"), _schema_of(nation, "nation", "n_nationkey", n_regionkey={"x-foreign": {"collection": "region", "cascade": True}})])
    db.tx(lambda t: (t.create_all("region", region), t.create_all("nation", nation)))
    return db


def _market(spark: SparkSession, sf_dir: str) -> Database:
    """Regions, nations and all customers; customers refer to nations, nations to regions."""
    customer = table(spark, sf_dir, "customer")
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    up = lambda name: {"x-foreign": {"collection": name, "cascade": True}}
    db = Database(spark, _root(spark))
    db.configure([_schema_of(region, "region", "r_regionkey"), _schema_of(nation, "nation", "n_nationkey", n_regionkey=up("region")), _schema_of(customer, "customer", "c_custkey", c_nationkey=up("nation"))])
    db.tx(lambda t: (t.create_all("region", region), t.create_all("nation", nation), t.create_all("customer", customer)))
    return db


def _rows(df: DataFrame) -> DataFrame:
    return df.drop(schema.EXTRA)


def tx_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment changed and as many new ones, in one frame."""
    db = _market(spark, sf_dir)
    customer = table(spark, sf_dir, "customer")
    changed = customer.where("c_mktsegment = 'BUILDING'").withColumn("c_name", F.lower("c_name"))
    more = customer.where("c_mktsegment = 'MACHINERY'").withColumn("c_custkey", -1 - F.col("c_custkey"))
    db.tx(lambda t: t.set_all("customer", changed.unionByName(more)))
    return _rows(db.raw("customer"))


def tx_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    db = Database(spark, _root(spark))
    db.configure([_schema_of(customer, "customer", "c_custkey", c_name={"x-immutable": True})])
    db.tx(lambda t: t.create_all("customer", customer))
    patch = customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit("other").alias("c_name"))
    db.tx(lambda t: t.update_all("customer", patch))
    return _rows(db.raw("customer"))


def tx_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region deleted, which takes its nations and their customers along."""
    db = _market(spark, sf_dir)
    db.tx(lambda t: t.delete("region", 1))
    return _rows(db.raw("customer"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bulk rename of customers leaves in the change log."""
    db = _market(spark, sf_dir)
    db.tx(lambda t: t.update_all("customer", table(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey", F.lower("c_name").alias("c_name"))))
    log = db.store(Context()).cdc().where("collection = 'customer' and action = 'update'")
    value = lambda c: docs.from_json_value(F.col(c), paths.T.StringType())
    return log.select("documentID", F.explode("diff").alias("o")).select("documentID", "o.op", "o.path", value("o.value").alias("value"), value("o.beforeValue").alias("before"))


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))), table(spark, sf_dir, "customer")
    db = Database(spark, _root(spark))
    db.configure([_schema_of(orders, "orders", "o_orderkey", o_custkey={"x-foreign": {"collection": "customer"}}), _schema_of(customer, "customer", "c_custkey")])
    t = db.begin()
    t.create_all("customer", customer)
    t.create_all("orders", orders)
    return t.violations("orders").select("id", "value")


def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    db = Database(spark, _root(spark))
    db.configure([_schema_of(part, "part", "p_partkey", p_name={"x-unique": True})])
    t = db.begin()
    t.create_all("part", part)
    return t.violations("part").select("rule", "value")


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    s = schema.parse(_schema_of(events, "events", "event_id", value={"maximum": 400}, event_type={"enum": ["click", "view", "purchase"]}, props={"pattern": "[0-4][0-9]}"}))
    found = events.select("event_id", s.errors(lambda p: paths.resolve(events.schema, p)).alias("e")).where(F.size("e") > 0)
    return found.select("event_id", F.size("e").alias("n"), F.exists("e", lambda x: x.startswith("value")).alias("too_large"))


def doc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf operations between customers and a changed version of them."""
    before = table(spark, sf_dir, "customer")
    after = before.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.lit(1.5)).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    pack = lambda df, name: df.select("c_custkey", F.struct(*[F.col(c) for c in df.columns]).alias(name))
    both = pack(before, "b").join(pack(after, "a"), "c_custkey")
    ops = both.select("c_custkey", F.explode(docs.diff_columns(before.schema, "b", "a")).alias("o"))
    return ops.select("c_custkey", "o.op", "o.path", docs.from_json_value(F.col("o.beforeValue"), paths.T.StringType()).alias("before"))


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as documents that each event updates: the current ones, and the change log."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    steps = events.withColumn("old_type", F.lag("event_type").over(order)).withColumn("old_value", F.lag("value").over(order)).withColumn("n", F.row_number().over(order))
    change = lambda p, new, old: F.when(~F.col(new).eqNullSafe(F.col(old)), F.struct(F.when(F.col(old).isNull(), "add").otherwise("replace").alias("op"), F.lit(p).alias("path"), docs.as_json(F.col(new)).alias("value"), docs.as_json(F.col(old)).alias("beforeValue")))
    log = steps.select(F.col("event_id").cast("string").alias("_id"), F.lit("user").alias("collection"), F.when(F.col("n") == 1, "create").otherwise("update").alias("action"), F.col("user_id").cast("string").alias("documentID"),
                       F.array_compact(F.array(change("event_type", "event_type", "old_type"), change("value", "value", "old_value"))).alias("diff"), (F.col("us") * 1000 + F.col("event_id") % 1000).alias("timestamp"), F.lit("{}").alias("metadata"))
    last = F.struct("us", "event_id")
    current = events.groupBy("user_id").agg(F.max_by("event_type", last).alias("event_type"), F.max_by("value", last).alias("value"))
    return current, log


#: 2024-01-16 00:00:00 UTC in nanoseconds.
_THEN = 1_705_363_200_000_000_000


def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, log = _history(spark, sf_dir)
    return docs.state_at(current, log, "user_id", _THEN)


def revert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers renamed in bulk and set back to what they were."""
    import time

    db = _market(spark, sf_dir)
    then = time.time_ns()
    db.tx(lambda t: t.update_all("customer", table(spark, sf_dir, "customer").select("c_custkey", F.lit("x").alias("c_name"))))
    db.tx(lambda t: t.set_all("customer", t.snapshot("customer", then)))
    return _rows(db.raw("customer"))


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of events, followed as a stream with a filter into a Parquet sink."""
    root = _root(spark)
    _, log = _history(spark, sf_dir)
    log.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], CDC_TYPE).schema]).write.parquet(f"{root}/log")
    found = stream(spark, f"{root}/log", "user", [Where("action", "eq", "update")]).select("_id", "documentID")
    found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")


_USER = {"type": "object", "x-collection": "user", "required": ["_id"], "properties": {"_id": {"type": "string", "x-primary": True}, "language": {"type": "string", "x-index": {"language_idx": {}}}, "account_id": {"type": "string", "x-foreign": {"collection": "account"}, "x-index": {"account_language_idx": {"additional_fields": ["language"]}}}}}
_ACCOUNT = {"type": "object", "x-collection": "account", "required": ["_id"], "properties": {"_id": {"type": "string", "x-primary": True}}, "x-authorization": {"rules": [{"effect": "deny", "action": ["set"], "match": "contains(meta.Get('roles'), 'read_only')"}, {"effect": "allow", "action": ["*"], "match": "contains(meta.Get('roles'), 'super_user')"}]}}


def explain_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.parse(_USER)
    lists = {"none": (), "key": (Where("_id", "eq", "1"),), "two": (Where("account_id", "eq", "1"), Where("language", "eq", "x")), "range": (Where("language", "lt", "x"),)}
    rows = [(n, e.index, ",".join(f for f, _ in e.equal), e.bound.field if e.bound else "", e.backwards) for n, w in lists.items() for e in [explain.choose(s, w)]]
    return spark.createDataFrame(rows, "name string, index string, matched string, seek string, reverse boolean")


def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = catalog.plan([_ACCOUNT], {s.collection: s for s in map(schema.parse, (_USER, _ACCOUNT))})
    rows = [(kind, i.collection, o.op, o.path) for kind, items in (("delete", plan.to_delete), ("create", plan.to_create), ("replace", plan.to_replace)) for i in items for o in i.diff]
    return spark.createDataFrame(rows, "kind string, collection string, op string, path string")


def authz_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = schema.parse(_ACCOUNT)
    rows = [(a, role, authz.allowed(s, a, Context({"roles": [role]}), {})) for a in ("create", "set", "query") for role in ("super_user", "read_only", "other")]
    return spark.createDataFrame(rows, "action string, role string, allowed boolean")


def dag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    dag = catalog.Dag({s.collection: s for s in map(schema.parse, (_USER, _ACCOUNT))})
    return spark.createDataFrame(list(enumerate(dag.creation_order())), "n int, collection string")


def cmd_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    t = _world(spark, sf_dir).begin()
    commands = [{"get": {"collection": "nation", "id": 3}}, {"update": {"collection": "nation", "id": 3, "update": {"n_name": "x"}}}, {"query": {"collection": "nation", "query": {"select": [{"field": "n_name"}], "where": [{"field": "n_nationkey", "op": "eq", "value": 3}]}}}, {"rollback": {}}]
    return spark.createDataFrame([(n, json.dumps(t.cmd(c), sort_keys=True)) for n, c in enumerate(commands)], "n int, response string")


QUERIES = {f.__name__: f for f in (tx_upsert, tx_update, tx_delete_cascade, change_log, fk_violations, unique_violations, schema_violations, doc_diff, time_travel, revert, change_stream, explain_choice, plan_diff, authz_matrix, dag_order, cmd_dispatch)}

SQL = {
    "tx_upsert": "select c_custkey, case when c_mktsegment = 'BUILDING' then lower(c_name) else c_name end as c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer union all select -1 - c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_mktsegment = 'MACHINERY'",
    "tx_update": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, case when c_mktsegment = 'BUILDING' then 0.0 else c_acctbal end as c_acctbal, c_mktsegment from customer",
    "tx_delete_cascade": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)",
    "change_log": "select c_custkey::varchar as documentID, 'replace' as op, 'c_name' as path, lower(c_name) as value, c_name as before from customer where c_nationkey < 10",
    "fk_violations": "select o_orderkey::varchar as id, k::varchar as value from (select o_orderkey, case when o_orderkey % 11 = 0 then -o_custkey else o_custkey end as k from orders) where k not in (select c_custkey from customer)",
    "unique_violations": "select 'unique p_name' as rule, p_name as value from part group by p_name having count(*) > 1",
    "schema_violations": "select event_id, n, too_large from (select event_id, ((value > 400)::int + (event_type not in ('click', 'view', 'purchase'))::int + (not regexp_matches(props, '[0-4][0-9]}'))::int)::int as n, value > 400 as too_large from events) where n > 0",
    "doc_diff": "select c_custkey, 'replace' as op, 'c_acctbal' as path, c_acctbal::varchar as before from customer where c_custkey % 3 = 0 and c_acctbal <> 1.5 union all select c_custkey, 'remove', 'c_mktsegment', c_mktsegment from customer where c_custkey % 5 = 0",
    "time_travel": "select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value from events where ts < timestamp '2024-01-16 00:00:00' group by user_id",
    "revert": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer",
    "change_stream": "select event_id::varchar as _id, user_id::varchar as documentID from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as n from events) where n > 1",
    "explain_choice": "select * from (values ('none', '_id.primaryidx', '', '', false), ('key', '_id.primaryidx', '_id', '', false), ('two', 'account_language_idx', 'account_id,language', '', false), ('range', 'language_idx', '', 'language', true)) v(name, index, matched, seek, reverse)",
    "plan_diff": "select 'delete' as kind, 'user' as collection, 'remove' as op, path from (values ('properties._id.type'), ('properties._id.x-primary'), ('properties.account_id.type'), ('properties.account_id.x-foreign.collection'), ('properties.account_id.x-index.account_language_idx.additional_fields'), ('properties.language.type'), ('properties.language.x-index.language_idx'), ('required'), ('type'), ('x-collection')) v(path)",
    "authz_matrix": "select action, role, role = 'super_user' as allowed from (values ('create'), ('set'), ('query')) a(action), (values ('super_user'), ('read_only'), ('other')) r(role)",
    "dag_order": "select * from (values (0, 'account'), (1, 'user')) v(n, collection)",
    "cmd_dispatch": """select 0 as n, '{"get": {"n_name": "' || n_name || '", "n_nationkey": 3, "n_regionkey": ' || n_regionkey || '}}' as response from nation where n_nationkey = 3 union all select 1, '{"update": {"n_name": "x", "n_nationkey": 3, "n_regionkey": ' || n_regionkey || '}}' from nation where n_nationkey = 3 union all select 2, '{"page": {"count": 1, "documents": [{"n_name": "x"}], "nextPage": 1}}' union all select 3, '{"rollback": {}}'""",
}

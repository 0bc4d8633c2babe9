"""The document database: collections with schemas, transactions, queries, change log and time travel.

A transaction stages frames: every command is a plan over the snapshot and what was staged before, so reads see own writes; a
commit checks constraints with joins, writes new versions and appends the change log. Commands take whole frames as well as single documents.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import authz, catalog, scripts
from docmill.authz import Context
from docmill.errors import DocError, Forbidden, NotFound, Unauthorized, Validation
from docmill.functions import paths
from docmill.operators import documents as docs
from docmill.operators.documents import Document
from docmill.plans import explain
from docmill.plans.compiler import compile_query, filtered
from docmill.plans.model import Join, Page, Query, Where
from docmill.schema import CDC, EXTRA, CollectionSchema, parse
from docmill.sources.store import CDC_TYPE, Store


#: Commands on a collection whose plans may pile up in a transaction before the rows are written.
STAGED_PLANS = 4


def new_id() -> str:
    """An id that sorts by time."""
    return f"{int(time.time() * 1000):012x}{uuid.uuid4().hex[:20]}"


class Database:
    def __init__(self, spark: SparkSession, root: str, library: str = "", compat: bool = False, optimizer: Callable = explain.choose):
        """library: script functions that all scripts may call. compat: the strict operator list, min and max from 0, cascades
        whatever the flag says, and creation over existing ids."""
        self.spark, self.root, self.library, self.compat, self.optimizer = spark, root.rstrip("/"), library, compat, optimizer
        self._schema_files = Store(spark, root, "_schemas")
        self.functions: dict[str, Callable] = {}
        self.schemas: dict[str, CollectionSchema] = {}
        self.refresh()

    def refresh(self) -> None:
        """Read the schemas again, as another process may have configured them."""
        v = self._schema_files.version()
        raw = json.loads(self._schema_files.files.read(f"{self._schema_files.root}/_manifests/manifest-{v:010d}.json")) if v else {}
        self.schemas = {n: parse(s) for n, s in raw.items()}
        self._schema_version = v

    def store(self, context: Context) -> Store:
        return Store(self.spark, self.root, context.namespace)

    def collections(self) -> list[str]:
        return sorted([*self.schemas, CDC.collection])

    def has_collection(self, name: str) -> bool:
        return name in self.schemas or name == CDC.collection

    def schema(self, name: str) -> CollectionSchema:
        if name == CDC.collection:
            return CDC
        if name not in self.schemas:
            raise Validation(f"collection {name} does not exist")
        return self.schemas[name]

    # configuration

    def plan(self, wanted: list[str | dict], values: dict | None = None) -> catalog.Plan:
        return catalog.plan(wanted, self.schemas, values)[0]

    def configure(self, wanted: list[str | dict], values: dict | None = None, context: Context | None = None) -> catalog.Plan:
        """Drop, create and replace collections so that the schemas are these."""
        context = context or Context()
        plan, schemas = catalog.plan(wanted, self.schemas, values)
        for item in (*plan.to_delete, *plan.to_create, *plan.to_replace):
            s = self.schemas.get(item.collection) or schemas[item.collection]
            authz.require(s, "configure", context, {}, self.library)
        if plan.is_empty:
            return plan
        for namespace in self.namespaces():
            store, frames = Store(self.spark, self.root, namespace), {}
            stored = store.manifest()
            for item in plan.to_delete:
                if item.collection in stored:
                    frames[item.collection] = None
            for item in plan.to_replace:
                old, new = self.schemas[item.collection].struct(), schemas[item.collection].struct()
                if item.collection in stored and old != new:
                    frames[item.collection] = refitted(store.frame(item.collection, old), new)
            if frames:
                store.commit(store.version(), frames, {}, None)
        self._save_schemas(schemas)
        return plan

    def namespaces(self) -> list[str]:
        """Those that have data."""
        return [n[3:] for n in self._schema_files.files.names(self.root) if n.startswith("ns=") and n != "ns=_schemas"]

    def _save_schemas(self, schemas: dict[str, CollectionSchema]) -> None:
        name = f"{self._schema_files.root}/_manifests/manifest-{self._schema_version + 1:010d}.json"
        if not self._schema_files.files.create(name, json.dumps({n: s.raw for n, s in schemas.items()})):
            raise DocError("conflict: the schemas were configured by another process")
        self.refresh()

    # transactions

    def begin(self, context: Context | None = None, read_only: bool = False) -> Transaction:
        return Transaction(self, context or Context(), read_only)

    def tx(self, work: Callable[[Transaction], Any], context: Context | None = None, read_only: bool = False) -> Any:
        """Run work in a transaction: committed at its end, rolled back if it raises."""
        t = self.begin(context, read_only)
        try:
            out = work(t)
        except BaseException:
            t.rollback()
            raise
        t.commit()
        return out

    def get(self, collection: str, id_: Any, context: Context | None = None) -> Document:
        return self.begin(context, True).get(collection, id_)

    def batch_get(self, collection: str, ids: list, context: Context | None = None) -> list[Document]:
        return self.begin(context, True).batch_get(collection, ids)

    def query(self, collection: str, q: Query, context: Context | None = None) -> Page:
        return self.begin(context, True).query(collection, q)

    def for_each(self, collection: str, fn: Callable[[Document], bool | None], where: Iterable[Where] = (), join: Iterable[Join] = (), context: Context | None = None) -> int:
        return self.begin(context, True).for_each(collection, fn, where, join)

    def run_script(self, script, params: dict | None = None, context: Context | None = None) -> Any:
        return scripts.run(script, {"params": params or {}, "db": self, "ctx": context or Context(), "meta": (context or Context()).metadata}, self.library)

    def raw(self, collection: str, context: Context | None = None) -> DataFrame:
        """The stored frame, without rules, computed fields or staged changes."""
        return self.store(context or Context()).frame(collection, self.schema(collection).struct())


class Transaction:
    def __init__(self, db: Database, context: Context, read_only: bool):
        self.db, self.context, self.read_only, self.spark = db, context, read_only, db.spark
        self.store = db.store(context)
        self.base = self.store.version()
        self.staged: dict[str, DataFrame] = {}
        self.touched: dict[str, list[tuple[str, DataFrame]]] = {}  # collection: (action, ids), in order
        self.open = True
        self.pending: dict[str, dict[Any, tuple[tuple, Document]]] = {}  # single documents, not yet part of a frame
        self._order: dict[str, list[tuple[Any, str, int]]] = {}
        self._depth: dict[str, int] = {}
        self._folders: list[str] = []

    # reads

    def frame(self, collection: str) -> DataFrame:
        """Documents with own writes, computed fields filled in."""
        s = self.db.schema(collection)
        df = self.store.cdc() if collection == CDC.collection else self._rows(collection)
        for p in s.all_properties():
            if p.compute and p.compute.read and "." not in p.path:
                df = df.withColumn(p.path, self._computed(p.compute.expr).cast(df.schema[p.path].dataType))
        if EXTRA in df.columns:
            df = df.withColumn(EXTRA, F.try_parse_json(EXTRA))
        return df

    def _rows(self, collection: str) -> DataFrame:
        self._flush(collection)
        return self._frame(collection)

    def _frame(self, collection: str) -> DataFrame:
        if collection in self.staged:
            return self.staged[collection]
        return self.store.frame(collection, self.db.schema(collection).struct(), self.base)

    def _is_new(self, collection: str) -> bool:
        return collection not in self.staged and collection not in self.store.manifest(self.base)

    def _flush(self, collection: str) -> None:
        """Single documents become one frame, joined once."""
        held = self.pending.pop(collection, None)
        if not held:
            return
        s = self.db.schema(collection)
        key, schema = s.primary_key, s.struct()
        rows = self.spark.createDataFrame([row for row, _ in held.values()], schema)
        if not self._is_new(collection):
            current = self._frame(collection)
            rows = current.join(rows.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").unionByName(rows)
        self._stage(collection, rows)
        kind = schema[key].dataType.simpleString()
        self.touched.setdefault(collection, []).append(("", self.spark.createDataFrame(self._order.pop(collection), f"id {kind}, action string, seq int")))

    def _current(self, collection: str, id_: Any) -> Document | None:
        """The stored or staged document, without computed fields: from memory where it is there."""
        if id_ in self.pending.get(collection, {}):
            return self.pending[collection][id_][1].clone()
        if self._is_new(collection):
            return None
        key = self.db.schema(collection).primary_key
        rows = _documents(self._frame(collection).where(F.col(key) == F.lit(id_)).limit(1))
        return rows[0] if rows else None

    def _computed(self, expr: str):
        """A computed field: a registered Python function of no arguments that gives a Column, the clock, or a Spark SQL expression."""
        if expr in self.db.functions:
            return self.db.functions[expr]()
        known = {"now().UnixMilli()": F.unix_millis(F.current_timestamp()), "now().Unix()": F.unix_seconds(F.current_timestamp())}
        return known[expr.strip()] if expr.strip() in known else F.expr(expr)

    def _authorized(self, action: str, collection: str, names: dict) -> None:
        authz.require(self.db.schema(collection), action, self.context, {"tx": self, "db": self.db, **names}, self.db.library)

    def query(self, collection: str, q: Query) -> Page:
        began = time.time()
        s = self.db.schema(collection)
        q = q if q.select else Query(**{**q.__dict__, "select": Query.from_dict({"select": [{"field": "*"}]}).select})
        q.check(self.db.compat)
        self._authorized("query", collection, {"query": q.to_dict()})
        for j in q.join:
            self._authorized("query", j.collection, {"query": {"where": [{"field": w.field, "op": w.op, "value": w.value} for w in j.on]}})
        chosen = self.db.optimizer(s, q.where)
        df = compile_query(q, self.frame(collection), self.frame, s.primary_key, self.db.compat)
        return Page(df, q.page + 1, chosen, time.time() - began)

    def _find(self, collection: str, ids: list) -> DataFrame:
        key = self.db.schema(collection).primary_key
        return self.frame(collection).where(paths.resolve(self.frame(collection).schema, key).col.isin(ids))

    def get(self, collection: str, id_: Any) -> Document:
        s = self.db.schema(collection)
        self._authorized("query", collection, {"query": {"where": [{"field": s.primary_key, "op": "eq", "value": id_}]}})
        rows = _documents(self._find(collection, [id_]).limit(1))
        if not rows:
            raise NotFound(f"{collection} {id_} not found")
        return rows[0]

    def batch_get(self, collection: str, ids: list) -> list[Document]:
        """In the order of the ids; every one must exist."""
        key = self.db.schema(collection).primary_key
        self._authorized("query", collection, {"query": {"where": [{"field": key, "op": "in", "value": ids}]}})
        found = {d.get(key): d for d in _documents(self._find(collection, list(ids)))}
        for i in ids:
            if i not in found:
                raise NotFound(f"{collection} {i} not found")
        return [found[i] for i in ids]

    def for_each(self, collection: str, fn: Callable[[Document], bool | None], where: Iterable[Where] = (), join: Iterable[Join] = ()) -> int:
        """Documents one by one, partition by partition; fn stops the scan by returning False."""
        for w in where:
            w.check()
        self._authorized("query", collection, {"query": {"where": [{"field": w.field, "op": w.op, "value": w.value} for w in where]}})
        n = 0
        for row in filtered(self.frame(collection), tuple(join), tuple(where), self.frame, self.db.compat).toLocalIterator():
            n += 1
            if fn(_document(row)) is False:
                break
        return n

    # writes

    def create(self, collection: str, doc: Document | dict) -> Any:
        return self._one("create", collection, doc)

    def set(self, collection: str, doc: Document | dict) -> Any:
        return self._one("set", collection, doc)

    def update(self, collection: str, id_: Any, values: dict[str, Any]) -> Document:
        key = self.db.schema(collection).primary_key
        self._one("update", collection, Document({}).set_all({**values, key: id_}))
        return self._current(collection, id_)

    def delete(self, collection: str, id_: Any) -> None:
        self._one("delete", collection, {self.db.schema(collection).primary_key: id_})

    def _one(self, action: str, collection: str, doc: Document | dict) -> Any:
        s = self.db.schema(collection)
        doc = Document(doc)
        if action == "create" and doc.get(s.primary_key) in (None, ""):
            doc.set(s.primary_key, new_id())
        id_ = doc.get(s.primary_key)
        if id_ is None:
            raise Validation(f"{collection}: {s.primary_key} is required")
        before = self._current(collection, id_)
        event = f"on{action.capitalize()}"
        names = {"doc": doc, "before": before, "tx": self, "db": self.db, "meta": self.context.metadata, "ctx": self.context, "schema": s, "query": None}
        for t in s.triggers:
            if event in t.events:
                scripts.run(self.db.functions.get(t.script.strip(), t.script), names, self.db.library)
        self._may(action, collection, {"doc": doc})
        if action == "delete":
            self._rows(collection)
            self._delete(collection, self.spark.createDataFrame([(id_,)], f"{s.primary_key} {s.struct()[s.primary_key].dataType.simpleString()}"), set())
            return id_
        if action == "create" and before is not None and not self.db.compat:
            raise Validation(f"{collection}: a document with this id exists")
        if action == "update":
            if before is None:
                raise NotFound(f"{collection} {id_} not found")
            doc = before.clone().merge(doc)
        for p in s.all_properties():
            if p.compute and p.compute.write:
                doc.set(p.path, self.spark.range(1).select(self._computed(p.compute.expr)).first()[0])
            if p.has_default and action != "update" and not doc.exists(p.path):
                doc.set(p.path, p.default)
            if p.immutable and before is not None and before.exists(p.path):
                doc.set(p.path, before.get(p.path))
        row = _row(s.struct(), doc.value, "")
        if bad := s.document_errors(doc):
            raise Validation(f"{collection} {id_}: " + "; ".join(bad))
        self.pending.setdefault(collection, {})[id_] = (row, doc)
        order = self._order.setdefault(collection, [])
        order.append((id_, action, len(order)))
        return id_

    def _may(self, action: str, collection: str, names: dict) -> None:
        s = self.db.schema(collection)
        if not self.open:
            raise Forbidden("the transaction has ended")
        if self.read_only:
            raise Forbidden("the transaction is read-only")
        if s.read_only and not self.context.internal:
            raise Forbidden(f"collection {collection} is read-only")
        if s.immutable and action in ("update", "delete", "set") and not self.context.internal:
            raise Forbidden(f"collection {collection} is immutable")
        if s.prevent_deletes and action == "delete":
            raise Forbidden(f"documents of {collection} can't be deleted")
        self._authorized(action, collection, names)

    def create_all(self, collection: str, rows: DataFrame) -> None:
        """Whole frames: columns are the collection's, missing ones are null. An id that is there twice is an error, as in the other commands but delete_all."""
        self._write("create", collection, self._fit(collection, rows), {})

    def set_all(self, collection: str, rows: DataFrame) -> None:
        self._write("set", collection, self._fit(collection, rows), {})

    def update_all(self, collection: str, patches: DataFrame) -> None:
        """Patches by primary key: a null leaves a field as it is."""
        self._write("update", collection, self._fit(collection, patches), {})

    def delete_all(self, collection: str, ids: DataFrame) -> None:
        self._write("delete", collection, self._fit(collection, ids), {})

    def _fit(self, collection: str, rows: DataFrame) -> DataFrame:
        schema = self.db.schema(collection).struct()
        have = set(rows.columns)
        return rows.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])

    def _write(self, action: str, collection: str, rows: DataFrame, names: dict) -> None:
        s = self.db.schema(collection)
        self._may(action, collection, names)
        key, schema, current = s.primary_key, s.struct(), self._rows(collection)
        if action == "delete":
            self._delete(collection, rows.select(key).distinct(), set())
            return
        for p in s.properties:
            if p.compute and p.compute.write:
                rows = rows.withColumn(p.name, self._computed(p.compute.expr).cast(schema[p.name].dataType))
        joined = rows.select(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]).alias("new")).join(
            current.select(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]).alias("old")), F.col(f"new.{key}") == F.col(f"old.{key}"), "left")
        if action == "update":
            columns = docs.merged(schema, "old", "new")
            columns = [*columns[:-1], self._merge_extra().alias(EXTRA)]
        else:
            columns = [F.col(f"new.`{f.name}`").alias(f.name) for f in schema.fields]
        after = joined.select(*columns, F.col("old").alias("_old"))
        for p in s.properties:
            if p.has_default and action != "update":
                after = after.withColumn(p.name, F.coalesce(F.col(p.name), F.lit(p.default).cast(schema[p.name].dataType)))
        for p in s.properties:
            if p.immutable and action in ("update", "set"):
                after = after.withColumn(p.name, F.when(F.col("_old").isNull(), F.col(p.name)).otherwise(F.coalesce(F.col(f"_old.`{p.name}`"), F.col(p.name))))
        # written once: the checks, the data and the change log all read the same rows, clocks and ids included
        written = self._written(after.select(*[F.col(f"`{f.name}`") for f in schema.fields], F.col("_old").isNotNull().alias("_known")))
        after = written.drop("_known")
        if action == "create" and not self.db.compat and not written.where("_known").isEmpty():
            raise Validation(f"{collection}: a document with this id exists")
        if action == "update":
            missing = written.where("not _known").select(key).limit(1).collect()
            if missing:
                raise NotFound(f"{collection} {missing[0][0]} not found")
        twice = written.groupBy(key).count().where("count > 1").select(key).limit(1).collect()
        if twice:
            raise Validation(f"{collection} {twice[0][0]}: the id is there twice")
        bad = after.select(key, s.errors(lambda p: paths.resolve(schema, p)).alias("errors")).where(F.size("errors") > 0).limit(3).collect()
        if bad:
            raise Validation(f"{collection} {bad[0][0]}: " + "; ".join(bad[0]["errors"]))
        self._stage(collection, current.join(after.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti").unionByName(after))
        self.touched.setdefault(collection, []).append((action, after.select(F.col(key).alias("id"))))

    def _written(self, rows: DataFrame) -> DataFrame:
        """rows in a folder of this transaction, which goes at its end."""
        folder = f"{self.store.root}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._folders.append(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _stage(self, collection: str, rows: DataFrame) -> None:
        """Every so many commands the staged rows are written, so that plans stay short however long a transaction is."""
        self._depth[collection] = self._depth.get(collection, 0) + 1
        if self._depth[collection] % STAGED_PLANS == 0:
            rows = self._written(rows)
        self.staged[collection] = rows

    def _clean(self) -> None:
        for folder in self._folders:
            self.store.files.delete(folder)
        self._folders.clear()

    @staticmethod
    def _merge_extra():
        both = F.map_concat(F.map_filter(_as_map("old"), lambda k, _: ~F.coalesce(F.map_contains_key(_as_map("new"), k), F.lit(False))), _as_map("new"))
        return F.when(F.col(f"new.{EXTRA}").isNull(), F.col(f"old.{EXTRA}")).when(F.col(f"old.{EXTRA}").isNull(), F.col(f"new.{EXTRA}")).otherwise(
            F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(both), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.to_json(e["value"]))), ","), F.lit("}")))

    def _delete(self, collection: str, ids: DataFrame, seen: set[str]) -> None:
        """Documents and, along the foreign keys, those that refer to them: a semi join per edge, to the last level."""
        key = self.db.schema(collection).primary_key
        current = self._rows(collection)
        gone = current.join(ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi").select(F.col(key).alias("id"))
        if not gone.limit(1).count():
            return
        for child, cs in self.db.schemas.items():
            for path, fk in cs.foreign_keys():
                if fk.collection != collection or not (fk.cascade or self.db.compat):
                    continue
                rows = self._rows(child)
                if rows.schema.names and cs.primary_key:
                    at = paths.resolve(rows.schema, path).col
                    hit = rows.join(gone.select(F.col("id").alias("_k")), at == F.col("_k"), "left_semi").select(cs.primary_key)
                    if child == collection:
                        hit = hit.join(gone.select(F.col("id").alias("_g")), F.col(cs.primary_key) == F.col("_g"), "left_anti")
                    self._delete(child, hit, seen)
        self._stage(collection, self._rows(collection).join(gone.select(F.col("id").alias("_k")), F.col(key) == F.col("_k"), "left_anti"))
        self.touched.setdefault(collection, []).append(("delete", gone))

    # end

    def violations(self, collection: str) -> DataFrame:
        """(rule, id, value) of foreign keys without target and of unique values that are there twice, after the staged changes."""
        s, rows = self.db.schema(collection), self._rows(collection)
        out = self.spark.createDataFrame([], "rule string, id string, value string")
        for path, fk in s.foreign_keys():
            at = paths.resolve(rows.schema, path).col
            target = self.db.schema(fk.collection)
            ids = self._rows(fk.collection).select(F.col(target.primary_key).alias("_k"))
            lost = rows.where(at.isNotNull()).join(ids, at == F.col("_k"), "left_anti")
            out = out.unionByName(lost.select(F.lit(f"foreign key {path}").alias("rule"), F.col(s.primary_key).cast("string").alias("id"), at.cast("string").alias("value")))
        for path in s.unique_fields():
            at = paths.resolve(rows.schema, path).col
            twice = rows.where(at.isNotNull()).groupBy(at.alias("v")).agg(F.count("*").alias("n"), F.min(F.col(s.primary_key).cast("string")).alias("id")).where("n > 1")
            out = out.unionByName(twice.select(F.lit(f"unique {path}").alias("rule"), "id", F.col("v").cast("string").alias("value")))
        return out

    def commit(self) -> None:
        if not self.open:
            return
        for collection in list(self.pending):
            self._flush(collection)
        self.open = False
        if not self.touched:
            return
        checked = set(self.touched)
        for name, s in self.db.schemas.items():
            if any(fk.collection in self.touched for _, fk in s.foreign_keys()) and any(a == "delete" for c in self.touched for a, _ in self.touched[c]):
                checked.add(name)
        for name in sorted(checked):
            bad = self.violations(name).limit(1).collect()
            if bad:
                raise Validation(f"{name} {bad[0]['id']}: {bad[0]['rule']} is violated by {bad[0]['value']}")
        keys = {n: [f for i in self.db.schema(n).indexes.values() if not i.primary for f in i.fields[:1] if "." not in f][:2] + [self.db.schema(n).primary_key] for n in self.staged}
        self.store.commit(self.base, self.staged, keys, self._changes())
        self._clean()

    def _changes(self) -> DataFrame:
        """The change records of this transaction: one for each document, after against before."""
        now = time.time_ns()
        out = self.spark.createDataFrame([], CDC_TYPE)
        for n, (collection, steps) in enumerate(sorted(self.touched.items())):
            s = self.db.schema(collection)
            schema, key = s.struct(), s.primary_key
            ids = None
            for order, (action, frame) in enumerate(steps):
                one = frame.select("id", F.lit(action).alias("action"), F.lit(float(order)).alias("o")) if action else frame.select("id", "action", (F.lit(order) + F.col("seq") / 1e9).alias("o"))
                ids = one if ids is None else ids.unionByName(one)
            ids = ids.groupBy("id").agg(F.max_by("action", "o").alias("last"), F.min_by("action", "o").alias("first"))
            wrap = lambda df, name: df.select(F.col(key).alias(f"{name}_k"), F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]).alias(name))  # noqa: E731, B023
            before, after = wrap(self.store.frame(collection, schema, self.base), "before"), wrap(self._rows(collection), "after")
            joined = ids.join(before, F.col("id") == F.col("before_k"), "left").join(after, F.col("id") == F.col("after_k"), "left")
            action = F.when(F.col("after_k").isNull(), F.lit("delete")).when(F.col("first") == "create", F.lit("create")).otherwise(F.col("last"))
            records = joined.where("before_k is not null or after_k is not null").select(
                F.concat(F.lit(f"{now:020x}-{n:04d}-"), F.col("id").cast("string")).alias("_id"), F.lit(collection).alias("collection"), action.alias("action"), F.col("id").cast("string").alias("documentID"),
                docs.diff_columns(schema, "before", "after").alias("diff"), F.lit(now + n).cast("bigint").alias("timestamp"), F.lit(self.context.metadata.to_json()).alias("metadata"))
            out = out.unionByName(records)
        return out

    def rollback(self) -> None:
        self.open = False
        self.staged.clear()
        self.touched.clear()
        self.pending.clear()
        self._clean()

    # history

    def snapshot(self, collection: str, timestamp: int) -> DataFrame:
        """All documents of a collection as they were just before a time in nanoseconds."""
        s = self.db.schema(collection)
        return docs.state_at(self._rows(collection), self.store.cdc().where(F.col("collection") == collection), s.primary_key, timestamp)

    def time_travel(self, collection: str, id_: Any, timestamp: int) -> Document:
        self._authorized("query", collection, {"query": {"where": [{"field": self.db.schema(collection).primary_key, "op": "eq", "value": id_}]}})
        s = self.db.schema(collection)
        current = self._rows(collection).where(F.col(s.primary_key) == F.lit(id_))
        log = self.store.cdc().where((F.col("collection") == collection) & (F.col("documentID") == str(id_)))
        rows = _documents(docs.state_at(current, log, s.primary_key, timestamp).limit(1))
        if not rows:
            raise NotFound(f"{collection} {id_} not found at {timestamp}")
        return rows[0]

    def revert(self, collection: str, id_: Any, timestamp: int) -> None:
        self.set(collection, self.time_travel(collection, id_, timestamp))

    def cmd(self, command: dict) -> dict:
        """A command as JSON: {"create": {"collection": ..., "document": ...}} and so on; errors come back as {"error": ...}."""
        try:
            return self._cmd(command)
        except DocError as e:
            return {"error": e.to_dict()}

    def _cmd(self, command: dict) -> dict:
        for kind in ("create", "set", "update", "delete", "get", "query", "revert", "timeTravel", "commit", "rollback"):
            if kind not in command:
                continue
            c = command[kind] or {}
            if kind in ("commit", "rollback"):
                getattr(self, kind)()
                return {kind: {}}
            name = c.get("collection")
            if not name:
                raise Validation(f"{kind}: collection is required")
            if kind in ("create", "set"):
                return {kind: self._current(name, getattr(self, kind)(name, c["document"])).value}
            if kind == "update":
                return {kind: self.update(name, c["id"], c.get("update") or {}).value}
            if kind == "delete":
                self.delete(name, c["id"])
                return {kind: {}}
            if kind == "get":
                return {kind: self.get(name, c["id"]).value}
            if kind == "query":
                page = self.query(name, Query.from_dict(c.get("query") or {}))
                rows = page.rows()
                return {"page": {"documents": rows, "nextPage": page.next_page, "count": len(rows)}}
            if kind == "revert":
                self.revert(name, c["id"], int(c["timestamp"]))
                return {kind: {}}
            return {kind: self.time_travel(name, c["id"], int(c["timestamp"])).value}
        raise Validation("unsupported command")


def refitted(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored rows under another schema: fields keep what can be cast, new ones are null."""
    have = {f.name: f.dataType for f in rows.schema.fields}

    def one(f: T.StructField):
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        at = F.col(f"`{f.name}`")
        if have[f.name] == f.dataType:
            return at
        nested = (T.StructType, T.ArrayType, T.MapType)
        if isinstance(have[f.name], nested) or isinstance(f.dataType, nested):
            text = F.to_json(at) if isinstance(have[f.name], nested) else at.cast("string")
            return (F.from_json(text, f.dataType) if isinstance(f.dataType, nested) else text.try_cast(f.dataType)).alias(f.name)
        return at.try_cast(f.dataType).alias(f.name)

    return rows.select(*[one(f) for f in schema.fields])


def _as_map(side: str):
    return F.from_json(F.col(f"{side}.{EXTRA}"), "map<string,variant>")


def _row(schema: T.StructType, value: dict, at: str) -> tuple:
    out = []
    known = {f.name for f in schema.fields}
    for f in schema.fields:
        if f.name == EXTRA and not at:
            rest = {k: v for k, v in value.items() if k not in known}
            out.append(json.dumps(rest, separators=(",", ":")) if rest else None)
            continue
        v = value.get(f.name)
        where = f"{at}{f.name}"
        if v is None:
            out.append(None)
        elif isinstance(f.dataType, T.StructType):
            if not isinstance(v, dict):
                raise Validation(f"{where}: an object is required")
            out.append(_row(f.dataType, v, where + "."))
        elif isinstance(f.dataType, T.StringType):
            out.append(v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else _wrong(where, "string"))
        elif isinstance(f.dataType, T.LongType):
            out.append(int(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else _wrong(where, "integer"))
        elif isinstance(f.dataType, T.DoubleType):
            out.append(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else _wrong(where, "number"))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(v if isinstance(v, bool) else _wrong(where, "boolean"))
        else:
            out.append(v if isinstance(v, list) else _wrong(where, "array"))
    return tuple(out)


def _wrong(where: str, kind: str):
    raise Validation(f"{where}: type must be {kind}")


def _plain(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items() if x is not None}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if type(v).__name__ == "VariantVal":
        return v.toPython()
    return v


def _document(row) -> Document:
    value = _plain(row.asDict(recursive=True))
    extra = value.pop(EXTRA, None)
    if isinstance(extra, str):
        extra = json.loads(extra)
    return Document({**value, **(extra or {})})


def _documents(df: DataFrame) -> list[Document]:
    return [_document(r) for r in df.collect()]


__all__ = ["Context", "Database", "Transaction", "Unauthorized", "new_id"]

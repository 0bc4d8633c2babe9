"""Predicates, paths, aggregates, sorting and documents over literal rows, against a row-wise evaluator."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docmill import catalog, schema, scripts
from docmill.errors import Forbidden, Validation, wrap
from docmill.functions import builtins as B
from docmill.functions import paths
from docmill.operators import predicates
from docmill.operators.documents import Document
from docmill.plans import explain
from docmill.plans.compiler import compile_query, nested
from docmill.plans.model import Field, Join, OrderBy, Q, Query, Select, Where

TYPE = "_id string, age bigint, txt string, flag boolean, tags array<string>, other bigint, contact struct<email:string>"
ROWS = [
    ("1", 5, "7", True, ["a", "b"], 5, ("x@y",)), ("2", None, "abc", False, [], 0, (None,)), ("3", 60, None, None, None, None, None),
    ("4", -3, "a b", True, ["a b"], 9, ("a@x.com",)), ("5", 0, "", False, ["10"], -3, ("a@x.co",)), ("6", 7, "$x", None, ["b"], 7, None),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, TYPE).cache()


def as_documents():
    names = ("_id", "age", "txt", "flag", "tags", "other")
    for r in ROWS:
        yield Document({**{n: v for n, v in zip(names, r, strict=False) if v is not None}, **({"contact": {"email": r[6][0]}} if r[6] and r[6][0] else {})})


def kept(df, *wheres):
    return sorted(r["_id"] for r in df.where(predicates.conjunction(wheres, lambda p: paths.resolve(df.schema, p))).select("_id").collect())


def test_clauses_equal_the_row_evaluator(people):
    values = {"age": [5, 0, -1, 60.0, "5", True, "null", "$other"], "txt": ["7", 7, "abc", "a", "", "null", "$_id"], "flag": [True, False, "true", 1], "contact.email": ["x@y", "null"], "missing": [0, "x", "null"]}
    clauses = [Where(f, op, v) for f, vs in values.items() for v in vs for op in ("eq", "neq", "lt", "lte", "gt", "gte") if not (op not in ("eq", "neq") and v in ("null", True, False))]
    clauses += [Where("tags", op, v) for op in ("containsAll", "containsAny") for v in (["a"], ["a", "b"], ["10"], [])]
    clauses += [Where("txt", "containsAny", ["b"]), Where("txt", "containsAll", ["a", "b"]), Where("tags", "contains", "b"), Where("txt", "contains", "b"), Where("age", "in", [5, 60]), Where("txt", "in", ["7", 7]), Where("txt", "in", [7])]
    clauses += [Where("txt", "hasPrefix", "a"), Where("txt", "hasSuffix", "c"), Where("txt", "regex", "^a.c$"), Where("txt", "regex", "("), Where("age", "eq", Field("other"))]
    random.Random(1).shuffle(clauses)
    got = people.select("_id", *[predicates.clause(w, lambda p: paths.resolve(people.schema, p)).alias(f"c{i}") for i, w in enumerate(clauses)]).collect()
    docs = {d.get("_id"): d for d in as_documents()}
    for r, (i, w) in itertools.product(got, enumerate(clauses)):
        assert bool(r[f"c{i}"]) == docs[r["_id"]].where([w]), (r["_id"], w)


def test_numeric_zero_rule_null_and_typed(people):
    assert kept(people, Where("age", "lt", 1)) == ["2", "4", "5"]
    assert kept(people, Where("txt", "gt", 5)) == ["1"]
    assert kept(people, Where("age", "neq", 5)) == ["2", "3", "4", "5", "6"]
    assert kept(people, Where("age", "eq", "null")) == ["2"]
    with pytest.raises(Validation):
        predicates.clause(Where("age", "like", 1), lambda p: None)


def test_joins_nulls_alias_and_fanout(spark, people):
    right = spark.createDataFrame([("a", 5, 1), ("b", 5, None), ("c", None, 3)], "k string, n bigint, opt bigint")
    q = Q().select("_id", Select("r.k", as_="k"), Select("r.opt", as_="opt")).join(Join("right", (Where("n", "eq", "$age"),), "r")).query()
    rows = sorted((r["_id"], r["k"], r["opt"]) for r in compile_query(q, people, lambda n: right).collect())
    assert rows[:3] == [("1", "a", 1), ("1", "b", None), ("2", None, None)] and len(rows) == 7
    q2 = Q().select("_id", Select("right.k", as_="k"), Select("s.k", as_="k2")).join(Join("right", (Where("n", "eq", "$age"),)), Join("more", (Where("opt", "eq", "$right.opt"),), "s")).query()
    assert {(r["k"], r["k2"]) for r in compile_query(q2, people, lambda n: right).collect()} == {("a", "a"), ("b", None), (None, None)}
    with pytest.raises(Validation):
        compile_query(Q().select("*").join(Join("right", (Where("n", "eq", "$age"),), "age")).query(), people, lambda n: right)


def test_aggregates_and_empty(people):
    q = Q().select("flag", Select("age", "sum"), Select("age", "min", "lo"), Select("txt", "max", "hi"), Select("age", "count", "n")).group_by("flag").having(Where("n", "gte", 2)).order_by(OrderBy("n", "desc"), OrderBy("flag")).query()
    rows = [tuple(r) for r in compile_query(q, people).collect()]
    assert rows == [(None, 67.0, 7.0, 0.0, 2.0), (False, 0.0, 0.0, 0.0, 2.0), (True, 2.0, -3.0, 7.0, 2.0)]
    none = Q().select(Select("age", "sum")).where(Where("_id", "eq", "none")).query()
    assert compile_query(none, people).collect() == []
    pos = Q().select(Select("other", "min", "m")).where(Where("other", "gt", 4)).query()
    assert compile_query(pos, people).first()["m"] == 5.0 and compile_query(pos, people, compat=True).first()["m"] == 0.0


def test_sort_page_projection(people):
    q = Q().select("_id", Select("age", as_="years")).order_by(OrderBy("age", "asc")).limit(2)
    assert [r["_id"] for r in compile_query(q.query(), people, primary_key="_id").collect()] == ["2", "4"]
    assert [r["_id"] for r in compile_query(q.page(1).query(), people, primary_key="_id").collect()] == ["5", "1"]
    assert [r["_id"] for r in compile_query(Q().select("_id").order_by(OrderBy("nope")).query(), people, primary_key="_id").collect()] == list("123456")
    out = nested(compile_query(Q().select("_id", "contact.email", Select("nope", as_="a.b")).query(), people))
    assert out.where("_id = '1'").first().asDict(True) == {"_id": "1", "contact": {"email": "x@y"}, "a": {"b": None}}
    assert compile_query(Q().select("*", "age").query(), people).columns == people.columns


def test_validation_and_json():
    for bad in (Query(), Q().select("a").limit(-1).query(), Q().select("a").page(-1).query(), Q().select(Select("a", "avg")).query(), Q().select("a", Select("b", "sum")).query(), Q().select(Select("b", "sum")).group_by("a").query(),
                Q().select("*").where(Where("", "eq", 1)).query(), Q().select("*").where(Where("a", "like", 1)).query(), Q().select("*").where(Where("a", "eq")).query(), Q().select("*").order_by(OrderBy("a", "up")).query(), Q().select("*").join(Join("x", ())).query()):
        with pytest.raises(Validation):
            bad.check()
    with pytest.raises(Validation):
        Q().select("*").where(Where("a", "regex", "x")).query().check(strict=True)
    q = Q().select("*").where(Where("description", "contains", "testing")).query()
    assert q.to_json() == '{"select":[{"field":"*"}],"where":[{"field":"description","op":"contains","value":"testing"}],"page":0}'
    assert Query.from_dict(q.to_dict()) == q
    assert Select("maker", "count").alias == "count_maker"


def test_modifiers_and_paths(spark):
    df = spark.createDataFrame([("helloWorld", "hello_world", "hello world", "1993-08-17T00:00:00Z", ["a", "b"], '{"k": [1, {"x": "y"}], "n": null}', [("v1",), ("v2",)])], "a string, b string, c string, t string, l array<string>, j string, s array<struct<x:string>>")
    get = lambda p: df.select((lambda r: paths.raw_text(r) if paths.family(r.kind) == "variant" else r.col)(paths.resolve(df.schema, p))).first()[0]
    assert get("a|@snakeCase") == "hello_world" and get("b|@camelCase") == "helloWorld" and get("b|@kebabCase") == "hello-world" and get("c|@trim") == "helloworld"
    assert get('c|@replaceAll:{"old":" world","new":""}') == "hello" and get("a|@upper") == "HELLOWORLD"
    assert [get(f"t|@dateTrunc:{u}") for u in ("month", "year", "day")] == ["1993-08-01 00:00:00 +0000 UTC", "1993-01-01 00:00:00 +0000 UTC", "1993-08-17 00:00:00 +0000 UTC"]
    assert get("t|@unix") == "745545600" and get("t|@unixMilli") == "745545600000" and get("t|@unixNano") == "745545600000000000"
    assert get("l|@reverse") == ["b", "a"] and get("l.0") == "a" and get("l.#") == 2 and get("l.7") is None and get("s.#.x") == ["v1", "v2"]
    assert get("j.k.0") == "1" and get("j.k.1.x") == "y" and get("j.n") is None and get("j|@keys") == ["k", "n"] and get("a|@tostr") == '"helloWorld"'
    assert paths.resolve(df.schema, "nope") is None and paths.leaf_paths(df.schema)[:2] == ["a", "b"]
    with pytest.raises(Validation):
        paths.resolve(df.schema, "a|@nope")


def test_builtins(spark):
    one = spark.range(1)
    lit, a = F.lit, F.array(*[F.lit(x) for x in (3, 1, 3)])
    cases = [(B.to_int(lit("x")), 0), (B.to_float(lit("2.5")), 2.5), (B.to_bool(lit("yes")), False), (B.to_bool(lit("t")), True), (B.chunk(a, 2), [[3, 1], [3]]), (B.drop(a, 1), [1, 3]), (B.last(a), 3), (B.array_sum(a), 7.0), (B.index_of(a, 1), 1),
             (B.split(lit("a.b"), "."), ["a", "b"]), (B.trim(lit(" x ")), "x"), (B.trim_left(lit("xxa"), "x"), "a"), (B.trim_prefix(lit("abc"), "ab"), "c"), (B.trim_suffix(lit("abc"), "bc"), "a"), (B.quote(lit('a"b')), '"a\\"b"'), (B.unquote(lit('"a"')), "a"),
             (B.find(a, lambda x: x < 3), 1), (B.contains(a, 1), True), (B.empty(F.array()), True), (B.BUILTINS["uniq"](a), [3, 1]), (B.BUILTINS["len"](a), 3), (B.BUILTINS["base64Decode"](lit("YQ==")), "a")]
    got = one.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i
    assert len(one.select(B.BUILTINS["ksuid"]()).first()[0]) == 32


def test_document_operations():
    d = Document({"name": "a", "contact": {"email": "x", "phone": "1"}, "age": 10, "on": "true"})
    b = d.clone().set("contact.email", "y").delete("age").set("city", "B")
    ops = b.diff(d)
    assert [(o.op, o.path, o.value, o.before_value) for o in ops] == [("remove", "age", None, 10), ("replace", "contact.email", "y", "x"), ("add", "city", "B", None)]
    assert d.clone().apply_ops(ops).value == b.value and b.clone().revert_ops(ops).value == d.value
    assert d.clone().merge({"contact": {"phone": "2"}}).get("contact") == {"email": "x", "phone": "2"} and d.clone().merge_join({"k": 1}, "acc").get("acc.k") == 1
    assert d.get_bool("on") and d.get_int("contact.phone") == 1 and d.get_array("none") == [] and d.exists("name") and not d.exists("x.y") and d.field_paths() == ["name", "contact.email", "contact.phone", "age", "on"]
    for bad in ("[1]", "{", 3):
        with pytest.raises(Validation):
            Document(bad)


FILM = {
    "type": "object", "x-collection": "film", "required": ["reel"],
    "properties": {
        "reel": {"type": "string", "x-primary": True}, "maker": {"type": "string", "x-foreign": {"collection": "studio"}, "x-index": {"maker_year": {"additional_fields": ["year"]}}},
        "year": {"type": "integer", "x-index": {"by_year": {}}}, "can": {"type": "object", "properties": {"seal": {"type": "string", "x-unique": True}}}, "minutes": {"$ref": "#/common/length"},
    },
    "common": {"length": {"type": "integer", "minimum": 0}},
}
STUDIO = {"type": "object", "x-collection": "studio", "x-require-index": True, "required": ["name"], "properties": {"name": {"type": "string", "x-primary": True}}}


def test_schema_explain_and_dag(spark):
    s = schema.parse(FILM)
    assert set(s.indexes) == {"reel.primaryidx", "maker.foreignidx", "can.seal.uniqueidx", "maker_year", "by_year"}
    pick = lambda *ws: (lambda e: (e.index, [f for f, _ in e.equal], e.bound and e.bound.field, e.backwards))(explain.choose(s, ws))
    assert pick() == ("reel.primaryidx", [], None, False) and pick(Where("reel", "eq", "1")) == ("reel.primaryidx", ["reel"], None, False)
    assert pick(Where("year", "gt", 1950), Where("maker", "eq", "x")) == ("maker_year", ["maker"], "year", False)
    assert pick(Where("year", "lte", 1950)) == ("by_year", [], "year", True) and pick(Where("minutes", "eq", 1))[1] == []
    assert pick(Where("maker", "eq", "x"), Where("year", "eq", 3)) == ("maker_year", ["maker", "year"], None, False)
    with pytest.raises(Forbidden):
        explain.choose(schema.parse(STUDIO), (Where("x", "eq", 1),))
    dag = catalog.Dag({x.collection: x for x in map(schema.parse, (FILM, STUDIO))})
    assert dag.creation_order() == ["studio", "film"] and dag.deletion_order() == ["film", "studio"] and dag.children("studio") == ["film"]
    with pytest.raises(Validation):
        catalog.Dag({"film": s})
    for bad in ({**FILM, "required": []}, {**FILM, "x-collection": ""}, {**FILM, "properties": {}}, {**FILM, "properties": {**FILM["properties"], "x": {}}}, {**FILM, "properties": {**FILM["properties"], "id2": {"type": "string", "x-primary": True}}}):
        with pytest.raises(Validation):
            schema.parse(bad)
    df = spark.createDataFrame([("1", -1), (None, 3)], "reel string, minutes bigint")
    got = [r[0] for r in df.select(s.errors(lambda p: paths.resolve(df.schema, p))).collect()]
    assert got == [["minutes: minimum 0"], ["reel is required"]]
    p, _ = catalog.plan([FILM, STUDIO], {})
    assert [i.collection for i in p.to_create] == ["studio", "film"] and not p.is_empty


def test_scripts_and_errors():
    assert scripts.run("1 + 2 * 3 == 7 && [1, 2][1] == 2", {}) is True
    assert scripts.run("a?.b?.c", {"a": {}}) is None and scripts.run("x.name", {"x": {"name": "n"}}) == "n" and scripts.run(lambda n: n + 1, {"n": 1, "m": 2}) == 2
    with pytest.raises(Validation):
        scripts.run("nope", {})
    e = wrap(Validation("inner"), 404, "outer")
    assert e.code == 404 and e.messages == ["inner", "outer"] and wrap(Validation("a"), None, "b").code == 400

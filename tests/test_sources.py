import pytest

from docmill.errors import Internal, Validation
from docmill.operators.documents import Document, Documents
from docmill.sources import convert, store


def test_yaml_and_json(spark, tmp_path):
    assert convert.yaml_to_json("a: {b: [1, x]}") == '{"a": {"b": [1, "x"]}}' and convert.json_to_yaml('{"a": 1}') == "a: 1\n"
    for bad, f in (("a: [", convert.yaml_to_json), ("{", convert.json_to_yaml)):
        with pytest.raises(Validation):
            f(bad)
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    convert.write_json(df, f"{tmp_path}/j")
    assert sorted(convert.read_json(spark, f"{tmp_path}/j", df.schema).collect()) == sorted(df.collect())
    assert [r[0] for r in convert.as_json(df).collect()] == ['{"id":1}', '{"id":2,"t":"x"}']
    assert [r["document"] is None for r in convert.parsed(spark.createDataFrame([("{",), ('{"a":1}',)], "x string"), "x").collect()] == [True, False]


def test_document_lists():
    d = Documents(Document({"n": i}) for i in range(5))
    assert [x.get("n") for x in d.slice(1, 3)] == [1, 2] and len(d.filter(lambda x, i: x.get("n") > 2)) == 2
    assert [x.get("m") for x in d.map(lambda x, i: x.clone().set("m", i * 2))] == [0, 2, 4, 6, 8]
    seen = []
    d.for_each(lambda x, i: seen.append(i))
    assert seen == [0, 1, 2, 3, 4]


def test_stores_versions_and_conflicts(spark, tmp_path):
    root = store.open_root("local", spark, storage_path=str(tmp_path))
    assert store.open_root("hadoop", spark, uri="file:///x") == "file:///x"
    with pytest.raises(Internal):
        store.open_root("none", spark)
    s = store.Store(spark, root, "a")
    one, two = spark.range(3), spark.range(5)
    assert s.version() == 0 and s.manifest() == {} and s.frame("c", one.schema).count() == 0 and s.cdc().count() == 0
    assert s.commit(0, {"c": one}, {"c": ["id"]}, None) == 1 and s.commit(1, {"c": two}, {}, None) == 2
    assert s.frame("c", one.schema).count() == 5 and s.frame("c", one.schema, 1).count() == 3
    with pytest.raises(Internal, match="conflict"):
        s.commit(1, {"c": one}, {}, None)
    assert s.commit(2, {"c": None}, {}, None) == 3 and s.manifest() == {} and store.Store(spark, root, "b").version() == 0
    lock = s.lock("c", lease_seconds=-1)
    assert lock.try_lock() and s.lock("c").try_lock()

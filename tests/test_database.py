"""A lending library as a database: shelves hold books, readers borrow them."""

import time

import pytest

from docmill.authz import Context
from docmill.database import Database
from docmill.errors import DocError, Forbidden, NotFound, Validation
from docmill.plans.model import Join, OrderBy, Q, Query, Select, Where
from docmill.streaming.changes import subscribe

SHELF = {
    "type": "object", "x-collection": "shelf", "required": ["code"],
    "properties": {
        "code": {"type": "string", "x-primary": True}, "floor": {"type": "integer", "minimum": 0, "maximum": 9, "x-immutable": True}, "mood": {"type": "string", "default": "quiet"},
        "opened": {"type": "integer", "x-compute": {"expr": "now().Unix()", "write": True}},
    },
    "x-authorization": {"rules": [
        {"effect": "deny", "action": ["delete"], "match": "meta.Get('desk') == 'visitor'"},
        {"effect": "allow", "action": ["query"], "match": "true"},
        {"effect": "allow", "action": ["*"], "match": "staff(meta)"},
        {"effect": "allow", "action": ["set", "delete"], "match": "doc.Get('floor') == meta.Get('floor')"},
    ]},
}
BOOK = {
    "type": "object", "x-collection": "book", "required": ["isbn", "title", "shelf"],
    "properties": {
        "isbn": {"type": "string", "x-primary": True}, "title": {"type": "string"}, "pages": {"type": "integer", "minimum": 1}, "shelf": {"type": "string", "x-foreign": {"collection": "shelf", "cascade": True}, "x-index": {"by_place": {"additional_fields": ["pages"]}}},
        "print": {"type": "object", "properties": {"barcode": {"type": "string", "x-unique": True}}}, "binding": {"type": "string", "enum": ["paper", "cloth"]}, "subjects": {"type": "array", "items": {"type": "string"}}, "spine": {"type": "string"},
    },
    "x-triggers": {"label": {"order": 1, "events": ["onCreate"], "script": "doc.Set('spine', upper(doc.Get('title')) + '/' + doc.Get('shelf'))"}},
}
LOAN = {"type": "object", "x-collection": "loan", "required": ["no", "book"], "properties": {"no": {"type": "integer", "x-primary": True}, "book": {"type": "string", "x-foreign": {"collection": "book", "cascade": True}}, "days": {"type": "number"}}}
HELPERS = "function staff(meta) { return meta.Get('desk') == 'main' }"
MAIN = Context({"desk": "main"})


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, f"file://{tmp_path}", HELPERS)
    d.configure([LOAN, BOOK, SHELF], context=MAIN)
    return d


def fill(db):
    def work(t):
        t.create("shelf", {"code": "A", "floor": 1})
        t.create("shelf", {"code": "B", "floor": 2, "mood": "lively"})
        for n, (title, shelf) in enumerate([("Tides", "A"), ("Moss", "B"), ("Rust", "A")]):
            t.create("book", {"isbn": f"i{n}", "title": title, "pages": 100 * (n + 1), "shelf": shelf, "print": {"barcode": f"|{n}|"}, "subjects": ["nature", title.lower()], "donor": "Ines"})
            t.create("loan", {"no": n, "book": f"i{n}", "days": 2.5})

    db.tx(work, MAIN)


def titles(db, *wheres):
    return sorted(r["title"] for r in db.query("book", Q().select("title").where(*wheres).query(), MAIN).rows())


def test_single_documents(db):
    fill(db)
    assert db.get("shelf", "A", MAIN).get("mood") == "quiet" and db.get("shelf", "B", MAIN).get("mood") == "lively"
    assert abs(db.get("shelf", "A", MAIN).get("opened") - time.time()) < 600
    book = db.get("book", "i1", MAIN)
    assert book.get("spine") == "MOSS/B" and book.get("donor") == "Ines" and book.get("print.barcode") == "|1|"
    assert [d.get("title") for d in db.batch_get("book", ["i2", "i0"], MAIN)] == ["Rust", "Tides"]
    for read in (lambda: db.get("book", "i9", MAIN), lambda: db.batch_get("book", ["i0", "i9"], MAIN)):
        with pytest.raises(NotFound):
            read()


def test_queries(db):
    fill(db)
    assert titles(db, Where("pages", "gt", 150)) == ["Moss", "Rust"] and titles(db, Where("subjects", "contains", "moss")) == ["Moss"] and len(titles(db, Where("donor", "eq", "Ines"))) == 3
    placed = Q().select("title", Select("at.floor", as_="floor")).join(Join("shelf", (Where("code", "eq", "$shelf"),), "at")).order_by(OrderBy("pages", "desc")).limit(2).query()
    page = db.query("book", placed, MAIN)
    assert [(r["title"], r["floor"]) for r in page.rows()] == [("Rust", 1), ("Moss", 2)] and page.next_page == 1
    by_shelf = db.query("book", Q().select("shelf", Select("pages", "sum")).group_by("shelf").order_by(OrderBy("shelf")).query(), MAIN).rows()
    assert by_shelf == [{"shelf": "A", "sum_pages": 400.0}, {"shelf": "B", "sum_pages": 200.0}]
    chosen = db.query("book", Q().where(Where("pages", "lt", 150), Where("shelf", "eq", "A")).query(), MAIN).explain
    assert chosen.index == "by_place" and chosen.equal == (("shelf", "A"),) and chosen.bound.field == "pages" and chosen.backwards
    met = []
    assert db.for_each("book", lambda d: met.append(d.get("title")), [Where("title", "hasSuffix", "st")], context=MAIN) == 1 and met == ["Rust"]


def test_what_is_refused(db, spark):
    fill(db)
    new = {"isbn": "n", "title": "New", "pages": 5, "shelf": "A"}
    for change, message in (({"shelf": "Z"}, "foreign key"), ({"print": {"barcode": "|1|"}}, "unique"), ({"pages": 0}, "pages"), ({"pages": "many"}, "pages"), ({"binding": "wood"}, "binding"), ({"title": None}, "title"), ({"isbn": "i1"}, "exists")):
        with pytest.raises(Validation, match=message):
            db.tx(lambda t, change=change: t.create("book", {**new, **change}), MAIN)
    with pytest.raises(NotFound):
        db.tx(lambda t: t.update("book", "i9", {"pages": 4}), MAIN)
    twice = spark.createDataFrame([("n", "One", 1, "A"), ("n", "Two", 2, "A")], "isbn string, title string, pages bigint, shelf string")
    for write in ("create_all", "set_all"):
        with pytest.raises(Validation, match="twice"):
            db.tx(lambda t, write=write: getattr(t, write)("book", twice), MAIN)
    assert len(titles(db)) == 3


def test_transactions_see_their_writes_and_roll_back(db):
    fill(db)

    def work(t):
        assert t.update("shelf", "A", {"floor": 7, "mood": "loud"}).get("floor") == 1
        changed = t.update("book", "i0", {"print.barcode": "new", "signed": True})
        assert changed.get("print.barcode") == "new" and changed.get("donor") == "Ines" and changed.get("signed") is True

    db.tx(work, MAIN)
    assert db.get("shelf", "A", MAIN).get("mood") == "loud"

    def fail(t):
        t.delete("book", "i0")
        raise KeyError("stop")

    with pytest.raises(KeyError):
        db.tx(fail, MAIN)
    assert db.get("book", "i0", MAIN).get("signed") is True
    first, second = db.begin(MAIN), db.begin(MAIN)
    first.set("loan", {"no": 50, "book": "i0"})
    second.set("loan", {"no": 51, "book": "i0"})
    first.commit()
    with pytest.raises(DocError, match="conflict"):
        second.commit()


def test_cascades_and_frames(db, spark):
    fill(db)
    db.tx(lambda t: t.delete("shelf", "A"), MAIN)
    assert titles(db) == ["Moss"] and [r["no"] for r in db.query("loan", Query(), MAIN).rows()] == [1]
    many = spark.range(300).selectExpr("concat('m', id) as isbn", "'Many' as title", "id + 1 as pages", "'B' as shelf")
    db.tx(lambda t: t.create_all("book", many), MAIN)
    db.tx(lambda t: t.update_all("book", many.where("pages <= 100").selectExpr("isbn", "'First' as title")), MAIN)
    assert len(titles(db, Where("title", "eq", "First"))) == 100 and len(titles(db, Where("title", "eq", "Many"))) == 200


def test_history(db, tmp_path):
    fill(db)
    moments = [time.time_ns()]
    for change in ({"pages": 111}, {"pages": 112, "binding": "cloth"}):
        db.tx(lambda t, change=change: t.update("book", "i0", change), MAIN)
        moments.append(time.time_ns())
    db.tx(lambda t: t.delete("book", "i0"), MAIN)
    past = db.begin(MAIN, True)
    assert [past.time_travel("book", "i0", m).get("pages") for m in moments] == [100, 111, 112]
    assert not past.time_travel("book", "i0", moments[1]).exists("binding") and past.time_travel("book", "i0", moments[2]).get("binding") == "cloth"
    assert past.snapshot("book", moments[0]).count() == 3 and past.snapshot("book", 1).count() == 0
    with pytest.raises(NotFound):
        past.time_travel("book", "i0", time.time_ns())
    with pytest.raises(Forbidden):
        past.revert("book", "i0", moments[1])
    db.tx(lambda t: t.revert("book", "i0", moments[1]), MAIN)
    assert db.get("book", "i0", MAIN).get("pages") == 111
    of_book = Q().where(Where("documentID", "eq", "i0"), Where("collection", "eq", "book")).order_by(OrderBy("timestamp")).query()
    assert [c["action"] for c in db.query("system_cdc", of_book, MAIN).rows()] == ["create", "update", "update", "delete", "set"]


def test_streams(db, tmp_path):
    fill(db)
    db.tx(lambda t: t.update("book", "i1", {"pages": 7}), MAIN)
    got = []
    follow = lambda handler, name: subscribe(db, "book", handler, f"{tmp_path}/{name}", [Where("action", "eq", "update")], MAIN)
    follow(lambda c: got.append(c["documentID"]), "a")
    db.tx(lambda t: t.update("book", "i2", {"pages": 8}), MAIN)
    follow(lambda c: got.append(c["documentID"]), "a")
    assert got == ["i1", "i2"]
    some = []
    query = follow(lambda c: some.append(c["documentID"]) or False, "b")
    assert some == ["i1"] and not query.isActive
    follow(lambda c: some.append(c["documentID"]), "b")
    assert some[1:] == ["i1", "i2"]  # the batch in which it stopped comes again
    everything = []
    subscribe(db, "*", lambda c: everything.append(c), f"{tmp_path}/c", (), Context(internal=True))
    assert len(everything) == 10
    with pytest.raises(Forbidden):
        subscribe(db, "*", print, f"{tmp_path}/d", (), MAIN)


def test_rules(db):
    fill(db)
    upstairs, visitor = Context({"desk": "stairs", "floor": 2}), Context({"desk": "visitor", "floor": 1})
    db.tx(lambda t: t.set("shelf", {"code": "B", "floor": 2, "mood": "calm"}), upstairs)
    assert db.get("shelf", "B", visitor).get("mood") == "calm"
    for context, write in ((upstairs, lambda t: t.set("shelf", {"code": "A", "floor": 1})), (visitor, lambda t: t.delete("shelf", "A")), (upstairs, lambda t: t.create("shelf", {"code": "C", "floor": 2})), (MAIN, lambda t: t.create("system_cdc", {"_id": "1"}))):
        with pytest.raises(Forbidden):
            db.tx(write, context)


def test_commands_scripts_namespaces_and_locks(db):
    fill(db)
    branch = Context({"namespace": "branch", "desk": "main"})
    assert db.query("shelf", Query(), branch).count() == 0
    t = db.begin(MAIN)
    assert t.cmd({"create": {"collection": "shelf", "document": {"code": "D", "floor": 3}}})["create"]["mood"] == "quiet"
    assert t.cmd({"update": {"collection": "shelf", "id": "D", "update": {"mood": "odd"}}})["update"]["mood"] == "odd"
    assert t.cmd({"get": {"collection": "shelf", "id": "Q"}})["error"]["code"] == 404 and t.cmd({"lend": {}})["error"]["code"] == 400
    assert t.cmd({"query": {"collection": "shelf", "query": {"select": [{"field": "code"}], "where": [{"field": "floor", "op": "gte", "value": 2}]}}})["page"]["count"] == 2
    assert t.cmd({"delete": {"collection": "shelf", "id": "D"}}) == {"delete": {}} and t.cmd({"rollback": {}}) == {"rollback": {}}
    assert db.run_script("function twice(x) { return x * 2 } twice(params.n) == 8 ? [params.n, 'ok'] : null", {"n": 4}) == [4, "ok"]
    lock = db.store(MAIN).lock("stocktaking")
    assert lock.try_lock() and lock.is_locked() and lock.renew() and not db.store(MAIN).lock("stocktaking").try_lock()
    lock.unlock()
    assert not lock.is_locked() and not lock.renew()


def test_configuration(db):
    fill(db)
    assert db.plan([LOAN, BOOK, SHELF]).is_empty
    longer = {**BOOK, "properties": {**BOOK["properties"], "pages": {"type": "string"}}}
    plan = db.configure([longer, SHELF], context=MAIN)
    assert [i.collection for i in plan.to_delete] == ["loan"] and [i.collection for i in plan.to_replace] == ["book"] and not plan.to_create
    assert titles(db, Where("pages", "eq", "200")) == ["Moss"] and db.collections() == ["book", "shelf", "system_cdc"]
    with pytest.raises(Validation):
        db.configure([longer], context=MAIN)
    db.configure([LOAN, longer, SHELF], context=MAIN)
    assert db.query("loan", Query(), MAIN).count() == 0

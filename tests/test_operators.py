"""Coalescing, transactions, shapes, replay, links, writing and redaction, many of them against plain models."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from retrace.errors import FrameOverflow, InvalidDeclaration
from retrace.functions import sqlshape
from retrace.functions import values as V
from retrace.errors import InvalidRecord
from retrace.operators import coalesce, drafts, failures, links, replay, txlog, write
from retrace.operators.redact import Rules, leaks, redact

CHANGE = "struct<pair:boolean,old:string,new:string,raw:string>"
STEPS = f"frame string, objectType string, objectId string, event string, actor string, id string, loggedAt timestamp, seq long, changes map<string,{CHANGE}>, attributes map<string,string>"


def frame(seed: int, name: str = "f") -> list[tuple]:
    rng = random.Random(seed)
    out, state = [], {}
    for seq in range(rng.randrange(5, 40)):
        obj = str(rng.randrange(3))
        event = rng.choice(["create", "update", "update", "update", "remove", "approved"])
        changes = {}
        for f in rng.sample(["a", "b", "c"], rng.randrange(0, 3)):
            old, new = state.get((obj, f), "null"), str(rng.randrange(3))
            kind = rng.random()
            if kind < 0.1:
                changes[f] = (False, None, None, json.dumps([new]))
            elif kind < 0.3:
                changes[f] = (True, old, old, None)
            else:
                changes[f] = (True, old, new, None)
                state[obj, f] = new
        out.append((name, "order", obj, event, rng.choice(["x", "y", None, "x"]), f"{name}-{seq}", datetime(2024, 1, 1, 0, 0, seq % 60), seq, changes, {"n": str(seq)} if rng.random() < 0.3 else {}))
    return out


def plain(rows):
    return [{"objectType": r[1], "objectId": r[2], "event": r[3], "actor": r[4], "id": r[5], "seq": r[7], "changes": {k: dict(zip(("pair", "old", "new", "raw"), c)) for k, c in r[8].items()}, "attributes": r[9]} for r in rows]


def test_coalescing_is_the_fold(spark):
    frames = {f"f{seed}": frame(seed, f"f{seed}") for seed in range(40)}
    df = spark.createDataFrame([r for rows in frames.values() for r in rows], STEPS)
    got: dict = {}
    for r in coalesce.coalesce_records(df).orderBy("frame", "place").collect():
        got.setdefault(r["frame"], []).append((r["id"], r["event"], r["actor"], {k: c.asDict() for k, c in r["changes"].items()}, r["attributes"]))
    for name, rows in frames.items():
        want = [(r["id"], r["event"], r["actor"], r["changes"], r["attributes"]) for r in coalesce.model(plain(rows))]
        assert got.get(name, []) == want, name


def test_valve_and_atomic():
    rows = plain([("f", "o", str(i % 4), "create", "x", str(i), None, i, {"a": (True, "null", str(i), None)}, {}) for i in range(8)])
    assert [r["id"] for r in coalesce.fold(rows, 10)] == ["0", "1", "2", "3"]
    assert [r["id"] for r in coalesce.fold(rows, 2)] == ["0", "1", "2", "3", "4", "5", "6", "7"]
    with pytest.raises(FrameOverflow):
        coalesce.fold(rows, 2, atomic=True)
    assert coalesce.fold(rows, 4, comparator=lambda *_: True)[0]["changes"] == {}


def test_fold_frames(spark):
    df = spark.createDataFrame([r for s in range(4) for r in frame(s, f"f{s}")], STEPS)
    out = coalesce.fold_frames(df, 2).orderBy("frame", "place").collect()
    want = [r["id"] for s in range(4) for r in coalesce.fold(plain(frame(s, f"f{s}")), 2)]
    assert [r["id"] for r in out] == want
    assert {r["frame"] for r in coalesce.crowded_frames(df, 2).collect()} == {f"f{s}" for s in range(4) if len({r[2] for r in frame(s)}) > 2}


@pytest.mark.parametrize("held", [1, 2, 3, 9])
def test_coalesce_valved(spark, held):
    """Crowded frames and others side by side: every frame gives what its own fold gives."""
    frames = {f"f{seed}": frame(seed, f"f{seed}") for seed in range(12)}
    df = spark.createDataFrame([r for rows in frames.values() for r in rows], STEPS)
    got: dict = {}
    for r in coalesce.coalesce_valved(df, held).orderBy("frame", "place").collect():
        got.setdefault(r["frame"], []).append((r["id"], r["event"], r["place"]))
    for name, rows in frames.items():
        assert got.get(name, []) == [(r["id"], r["event"], i) for i, r in enumerate(coalesce.fold(plain(rows), held))], name


def test_numbers(spark):
    cases = {"1": "1", "1.0": "1", '"-0.50"': "-0.5", "1e2": "100", "12.5e-1": "1.25", "null": "0", '"-"': "0", '""': "0", '"abc"': None, "-0": "0", "00012": "12", ".5": "0.5", "5.": "5", "1e5000": None, "12345678901234567890.10": "12345678901234567890.1"}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", V.canonical_number(F.col("v")).alias("n")).collect()
    assert {r["v"]: r["n"] for r in rows} == cases


def test_keys(spark):
    r = spark.createDataFrame([("a|b\\c", "x.y")], "a string, b string").select(V.composite_id([F.col("a"), F.col("b")]).alias("i"), V.element_key("lines", F.col("b"), "qty").alias("k"), V.resolved_actor(F.lit(""), F.lit(None).cast("string")).alias("s"), V.affected_count(F.lit("99999999999999999999")).alias("n")).first()
    assert (r["i"], r["k"], r["s"], r["n"]) == ("a\\|b\\\\c|x.y", "lines.x\\.y.qty", "system", None)


@pytest.mark.parametrize("sql,want", [
    ("INSERT INTO shop.order (id, total, at) VALUES (?, ?, NOW())", ("INSERT", ("shop", "order"), {"id": 0, "total": 1, "at": None}, {}, True)),
    ("update `t` set a = ?, v = v + 1 where id = ? and v = ?", ("UPDATE", ("t",), {"a": 0, "v": None}, {"id": 1, "v": 2}, True)),
    ("DELETE FROM \"T\" WHERE a = ? -- all of it\n AND b = ?", ("DELETE", ("T",), {}, {"a": 0, "b": 1}, True)),
    ("UPDATE t SET a = ? WHERE id > ?", ("UPDATE", ("t",), {"a": 0}, {}, False)),
    ("UPDATE t SET a = COALESCE(?, b), c = ? WHERE id = ?", ("UPDATE", ("t",), {"a": None, "c": 1}, {"id": 2}, True)),
    ("DELETE FROM t", ("DELETE", ("t",), {}, {}, False)),
    ("INSERT INTO t (a) SELECT 1", None), ("INSERT INTO t (a, b) VALUES (?)", None), ("SELECT 1", None), ("UPDATE /*+ hint */ t SET a = ?", None), ("MERGE INTO t", None),
])
def test_shapes(sql, want):
    s = sqlshape.read_shape(sql)
    assert (None if s is None else (s.kind, s.table, s.assigned, s.where, s.exact)) == want


def test_comments():
    assert sqlshape.without_comments("a /* x /* y */ z */ b", "postgresql") == "a   b"
    assert sqlshape.without_comments("a '--' -- c\nb") == "a '--' \nb"
    assert sqlshape.without_comments("a # c", "mysql") == "a " and sqlshape.without_comments("a # c") == "a # c"
    assert sqlshape.without_comments(r"a 'x\'y'") is None and sqlshape.without_comments("a /*! x */") is None
    assert sqlshape.tables_written("WITH x AS (SELECT 1) DELETE FROM a.b USING x") == ["a.b"] and sqlshape.tables_written("UPDATE a, b SET x = 1") is None


def entries(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for seq in range(40):
        sql = rng.choice(["UPDATE t SET a = ?", "UPDATE t SET a = ?", "BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT s1", "SAVEPOINT s2", "RELEASE SAVEPOINT s1", "ROLLBACK TO SAVEPOINT s1", "ROLLBACK TO s2"])
        out.append((f"c{seed}", seq, sql, rng.random() < 0.1, None, "statement"))
    return out


def model_fates(rows):
    """A stack of lists that hands its statements on."""
    stack, fate, seqs = [], {}, [r[1] for r in rows if r[2].startswith("UPDATE")]
    for _, seq, sql, failed, _, _ in rows:
        if sql.startswith("UPDATE"):
            if stack:
                stack[-1][1].append(seq)
                if failed:
                    fate[seq] = "VOID"
            else:
                fate[seq] = "VOID" if failed else "COMMITTED"
        elif sql == "BEGIN":
            stack = stack or [(None, [])]
        elif sql in ("COMMIT", "ROLLBACK"):
            for _, own in stack:
                for s in own:
                    fate.setdefault(s, "COMMITTED" if sql == "COMMIT" else "VOID")
            stack = []
        elif stack:
            name = sql.split()[-1]
            if sql.startswith("SAVEPOINT"):
                stack.append((name, []))
            elif name in [n for n, _ in stack]:
                i = max(k for k, (n, _) in enumerate(stack) if n == name)
                inner = [s for _, own in stack[i:] for s in own]
                stack = stack[:i]
                stack[-1][1].extend(inner)
                if sql.startswith("ROLLBACK"):
                    fate.update(dict.fromkeys(inner, "VOID"))
                    stack.append((name, []))
    return {s: fate.get(s, "PENDING") for s in seqs}


def test_fates(spark):
    logs = {f"c{s}": entries(s) for s in range(30)}
    df = spark.createDataFrame([r for rows in logs.values() for r in rows], "connection string, seq long, sql string, failed boolean, flush long, kind string")
    got: dict = {}
    for r in txlog.fates(df, include_pending=True).collect():
        got.setdefault(r["connection"], {})[r["seq"]] = r["fate"]
    assert got == {k: v for k, rows in logs.items() if (v := model_fates(rows))}


def test_owners(spark):
    rows = [(1, "flush_start", None, 7), (2, "statement", "UPDATE t SET a = 1", None), (3, "flush_start", None, 8), (4, "statement", "UPDATE t SET a = 1", None), (5, "flush_end", None, 8), (6, "statement", "UPDATE t SET a = 1", None), (7, "flush_end", None, 7), (8, "statement", "UPDATE t SET a = 1", None), (9, "statement", "BEGIN", None), (10, "statement", "UPDATE t SET a = 1", None), (11, "flush_claim", None, 9), (12, "statement", "COMMIT", None)]
    df = spark.createDataFrame([("c", s, q, False, f, k) for s, k, q, f in rows], "connection string, seq long, sql string, failed boolean, flush long, kind string")
    assert {r["seq"]: r["owner"] for r in txlog.fates(df).collect()} == {2: 7, 4: 8, 6: 7, 8: None, 10: 9}


def bound_rows(spark, statements):
    """(seq, flush, sql, params, affected, generated key) bound to an order and its lines."""
    df = spark.createDataFrame([("c", *s) for s in statements], "connection string, seq long, flush long, sql string, params array<string>, affected long, generated_key string")
    mapping = replay.mapping_table(spark, [replay.Mapped("orders", "order", ("id",), (("status", "status"), ("author_id", "author")), references=("author_id",)), replay.Mapped("line", "line", ("order_id", "pos"), (("qty", "quantity"),), owner_key="order_id", collection="lines", owner_type="order")])
    return replay.bound(sqlshape.with_shapes(df), mapping)


def test_replay(spark):
    rows = bound_rows(spark, [
        (1, 1, "INSERT INTO orders (status, author_id) VALUES (?, ?)", ['"draft"', "null"], 1, "5"),
        (2, 1, "UPDATE orders SET author_id = ? WHERE id = ?", ["9", "5"], 1, None),
        (3, 2, "UPDATE orders SET status = ? WHERE id = ?", ['"draft"', "5"], 1, None),
        (4, 2, "UPDATE orders SET status = ? WHERE id = ?", ['"paid"', "5"], 0, None),
        (5, 2, "UPDATE orders SET status = ? WHERE id = ?", ['"sent"', "5"], 1, None),
        (6, 3, "UPDATE orders SET status = ? WHERE id = ?", ['"x"', "77"], 1, None),
        (7, 3, "DELETE FROM orders WHERE id = ?", ["5"], 1, None),
        (8, 3, "UPDATE orders SET status = ? WHERE id = ?", ['"y"', "5"], 1, None),
        (9, 3, "UPDATE orders SET status = ? WHERE status = ?", ['"y"', "5"], 1, None),
        (10, 3, "UPDATE orders /*! */ SET status = 1", [], 1, None),
    ])
    states = replay.row_states(rows.where("binding = 'ROW'"))
    changes = replay.field_changes(states)
    got = sorted((r["seq"], r["statement"], r["column"], r["old"], r["new"]) for r in changes.collect())
    assert got == [(1, "INSERT", "author_id", None, "null"), (1, "INSERT", "status", None, '"draft"'), (2, "UPDATE", "author_id", "null", "9"), (5, "UPDATE", "status", '"draft"', '"sent"'), (7, "DELETE", "author_id", "9", None), (7, "DELETE", "status", '"sent"', None)]
    assert sorted((r["seq"], r["text"]) for r in replay.doubts(rows, states).collect()) == [(6, "the row was not known"), (9, "condition is not the key"), (10, "unreadable")]
    records = {r["seq"]: r for r in replay.records(replay.completed_creates(changes)).collect()}
    assert {s: r["event"] for s, r in records.items()} == {1: "create", 5: "update", 7: "remove"}
    assert records[1]["changes"]["author"]["new"] == "9" and records[7]["changes"] == {}
    assert [(r["valid_from"], r["row"]["status"]) for r in replay.versions(states).where("key = '5'").orderBy("valid_from").collect()][-1] == (5, '"sent"')


def test_unreadable_statements(spark):
    """What can't be read is a doubt about the tables it names, about any if it names none, and nothing if it doesn't write."""
    texts = ["INSERT INTO orders SELECT * FROM other", "INSERT INTO elsewhere SELECT * FROM orders", "CREATE TABLE orders (id int)", "UPDATE orders, line SET qty = 1", "TRUNCATE TABLE shop.Line"]
    rows = bound_rows(spark, [(i, 1, sql, [], None, None) for i, sql in enumerate(texts)])
    assert sorted((r["seq"], r["root"] or "") for r in replay.doubts(rows, replay.row_states(rows.where("binding = 'ROW'"))).collect()) == [(0, "orders"), (3, ""), (4, "line")]


def test_elements(spark):
    insert = "INSERT INTO line (order_id, pos, qty) VALUES (?, ?, ?)"
    rows = bound_rows(spark, [(1, 1, insert, ["5", "1", "10"], 1, None), (2, 1, insert, ["5", "2", "20"], 1, None), (3, 2, "UPDATE line SET qty = ? WHERE order_id = ? AND pos = ?", ["11", "5", "1"], 1, None), (4, 3, "DELETE FROM line WHERE order_id = ?", ["5"], 2, None), (5, 3, "DELETE FROM line WHERE order_id = ?", ["6"], 4, None)])
    states = replay.row_states(rows.where("binding = 'ROW'"))
    got = sorted((r["seq"], r["objectId"], r["name"], r["old"], r["new"]) for r in replay.element_changes(replay.field_changes(states)).collect())
    assert got == [(1, "5", "lines.5|1", None, "5|1"), (2, "5", "lines.5|2", None, "5|2"), (3, "5", "lines.5|1.quantity", "10", "11")]
    facts, doubts = replay.emptied(rows, states)
    assert [(r["seq"], r["objectId"], r["old"]) for r in facts.collect()] == [(4, "5", ["5|1", "5|2"])] and [r["seq"] for r in doubts.collect()] == [5]


def test_element_runs(spark):
    """A run ends when a key comes up again in it, not in an earlier one."""
    steps = [("o", "1", 7, i, n, "1", "2") for i, n in enumerate(["a", "a", "b", "b", "a", "c", "b"])] + [("o", "1", 8, 9, "a", "1", "2"), ("o", "2", 7, 3, "a", "1", "2")]
    df = spark.createDataFrame(steps, "objectType string, objectId string, flush long, seq long, name string, old string, new string")
    got = sorted((r["objectId"], r["flush"], r["run"], r["since"], sorted(r["changes"])) for r in drafts.element_runs(df).collect())
    assert got == [("1", 7, 1, 0, ["a"]), ("1", 7, 2, 1, ["a", "b"]), ("1", 7, 3, 3, ["a", "b", "c"]), ("1", 7, 4, 6, ["b"]), ("1", 8, 1, 9, ["a"]), ("2", 7, 1, 3, ["a"])]


def test_completed_creates(spark):
    """An update is the rest of a creation only if it fills references the insert left null, in its flush and with none begun between."""
    mapped = [replay.Mapped("relay", "relay", ("id",), (("next_id", "next"), ("title", "title")), references=("next_id",))]
    insert, fill = "INSERT INTO relay (id, next_id, title) VALUES (?, ?, ?)", "UPDATE relay SET next_id = ? WHERE id = ?"
    log = [
        (1, 1, insert, ["1", "null", "null"]), (2, 1, fill, ["9", "1"]),
        (3, 1, insert, ["2", "null", "null"]), (4, 1, "UPDATE relay SET title = ? WHERE id = ?", ['"x"', "2"]),
        (5, 1, insert, ["3", "8", "null"]), (6, 1, fill, ["9", "3"]),
        (7, 1, insert, ["4", "null", "null"]), (8, 2, fill, ["9", "4"]),
        (10, 3, insert, ["5", "null", "null"]), (12, 3, fill, ["9", "5"]),
    ]
    df = spark.createDataFrame([("c", *r, 1, None) for r in log], "connection string, seq long, flush long, sql string, params array<string>, affected long, generated_key string")
    rows = replay.bound(sqlshape.with_shapes(df), replay.mapping_table(spark, mapped))
    changes = replay.field_changes(replay.row_states(rows))
    events = lambda begins: sorted((r["objectId"], r["event"]) for r in replay.records(replay.completed_creates(changes, begins)).collect())
    apart = [("2", "create"), ("2", "update"), ("3", "create"), ("3", "update"), ("4", "create"), ("4", "update")]
    assert events(None) == sorted([("1", "create"), *apart, ("5", "create")])
    assert events(spark.createDataFrame([("c", 11)], "connection string, seq long")) == sorted([("1", "create"), *apart, ("5", "create"), ("5", "update")])


def test_counts_changed_rows(spark):
    rows = bound_rows(spark, [(1, 1, "INSERT INTO orders (status) VALUES (?)", ['"a"'], 1, "5"), (2, 1, "UPDATE orders SET status = ? WHERE id = ?", ['"a"', "5"], 0, None), (3, 1, "UPDATE orders SET author_id = ? WHERE id = ?", ["7", "5"], 0, None), (4, 1, "UPDATE orders SET author_id = ? WHERE id = ?", ["8", "5"], 1, None)])
    states = replay.row_states(rows.where("binding = 'ROW'"))
    said = lambda changed: sorted((r["seq"], r["column"], r["old"], r["new"]) for r in replay.field_changes(states, changed).where("statement = 'UPDATE'").collect())
    assert said(True) == [(4, "author_id", "7", "8")] and said(False) == [(4, "author_id", None, "8")]


def test_executions(spark):
    rows = [(1, 1, "oven", "1", "INSERT", "base"), (2, 1, "oven", "1", "INSERT", "kiln"), (3, 1, "oven", "1", "UPDATE", "base"), (4, 1, "oven", "1", "UPDATE", "kiln"), (5, 2, "oven", "1", "UPDATE", "base")]
    df = spark.createDataFrame([("c", *r) for r in rows], "connection string, seq long, flush long, objectType string, key string, statement string, root string")
    assert [r["execution"] for r in replay.executions(df).orderBy("seq").collect()] == [1, 1, 2, 2, 3]


def test_links():
    steps = [(1, 1, "add", "a", None), (2, 1, "add", "b", None), (3, 1, "remove", "a", None), (4, 2, "remove", "b", None), (5, 2, "add", "c", None), (6, 3, "emptied", None, None), (7, 4, "add", "x", None), (8, 4, "add", "x", None), (9, 5, "gone", "x", None), (10, 5, "gone", "y", True)]
    assert [r[:6] for r in links.link_runs(steps, [])] == [(1, 1, 0, [], ["a", "b"], None), (1, 3, 1, ["a", "b"], ["b"], None), (2, 4, 2, ["b"], ["c"], None), (3, 6, 3, ["c"], [], None), (4, 7, 4, [], ["x"], None), (4, 8, 5, None, None, "a link arrived that was there"), (5, 9, 6, None, None, "nobody looked who held the target"), (5, 10, 7, ["y"], [], None)]


def test_link_rules():
    """Numbers in order, what an account shows already, the owner's own removal, and what a deletion takes with it."""
    step = lambda seq, kind, target=None, flush=1, observed=None: (seq, flush, kind, target, observed)
    assert links.link_runs([step(1, "add", "10"), step(2, "add", "9"), step(3, "add", "x")], [])[0][4] == ["9", "10", "x"]
    taken = [step(1, "add", "a"), step(2, "remove", "b"), step(3, "add", "c")]
    assert links.undone(taken, ["a", "d"], [1, 2]) == {"b", "d"} and links.undone(taken, ["a"], [7]) is None and links.undone([step(1, "emptied")], ["a"], [1]) is None
    assert [r[3:5] for r in links.link_runs(taken, links.undone(taken, ["a", "d"], [1, 2]))] == [(["b", "d"], ["a", "c", "d"])]
    # emptied right before the owner went: part of its removal; with a statement in between, a change of the list
    assert links.link_runs([step(1, "add", "a"), step(2, "begin", flush=2), step(3, "emptied", flush=2), step(4, "row gone", flush=2)], ["z"]) == [(1, 1, 0, ["z"], ["a", "z"], None, [])]
    assert [r[:5] for r in links.link_runs([step(1, "remove", "z"), step(2, "emptied"), step(3, "row gone")], ["y", "z"])] == [(1, 1, 0, ["y", "z"], ["y"])]
    assert [r[3:5] for r in links.link_runs([step(1, "emptied"), step(2, "add", "q"), step(3, "row gone")], ["z"])] == [(["z"], ["q"])]
    assert links.link_runs([step(1, "row"), step(2, "add", "a")], None)[0][3:5] == ([], ["a"])
    assert links.link_runs([step(4, "gone", "a"), step(5, "gone", "b", observed=False)], ["a"])[0] == (1, 4, 0, ["a"], [], None, [4])


def test_links_reconciled(spark):
    steps = spark.createDataFrame([("t", str(o), 5, 1, "gone", "a", None, 2) for o in (1, 2, 3)] + [("t", "1", 6, 1, "gone", "b", None, 2)], "association string, owner string, seq long, flush long, kind string, target string, observed boolean, affected long")
    accounts = spark.createDataFrame([("t", "1", ["a", "b"], []), ("t", "2", ["a", "c"], []), ("t", "3", [], [])], "association string, owner string, targets array<string>, includes array<long>")
    found = links.reconciled(links.runs_of(steps, accounts), steps).collect()
    assert [(r["seq"], r["text"]) for r in found] == [(6, "a target was taken out of 2 lists, and 1 were known to hold it")]


def test_link_runs_by_owner(spark):
    df = spark.createDataFrame([("t", "1", 1, 1, "add", "a", None), ("t", "2", 2, 1, "remove", "b", None)], "association string, owner string, seq long, flush long, kind string, target string, observed boolean")
    accounts = spark.createDataFrame([("t", "2", ["b", "c"])], "association string, owner string, targets array<string>")
    assert sorted((r["owner"], r["old"], r["new"]) for r in links.runs_of(df, accounts).collect()) == [("1", [], ["a"]), ("2", ["b", "c"], ["c"])]


def record(spark, **values):
    base = {"objectType": "order", "objectId": "1", "event": "update", "loggedAt": datetime(2024, 1, 1), "source": None, "id": None, "seq": 1, "changes": {"total": (True, "1", "2", None)}, "attributes": {}}
    schema = f"objectType string, objectId string, event string, loggedAt timestamp, source string, id string, seq long, changes map<string,{CHANGE}>, attributes map<string,string>"
    return spark.createDataFrame([tuple({**base, **values}.values())], schema)


def test_writer(spark):
    writer = write.Writer("nobody", [write.Enricher({"who": F.lit('"ordinary"'), "k": F.lit("1")}), write.Enricher({"who": F.lit('"moment"')}, moment=True), write.Enricher({"other": F.lit("1")}, types=("cart",))], Rules(("secret",)), {"order": "orders"})
    out, bad = writer.write(record(spark, attributes={"k": "9", "secret": '"s"'}), "run")
    r = out.first()
    assert (r["source"], r["route"], r["attributes"]) == ("nobody", "orders", {"who": '"moment"', "k": "9"}) and r["id"][14] == "7" and bad.count() == 0
    assert writer.write(record(spark, event=""), "run")[1].first()["reason"] == "no event"
    assert writer.write(record(spark, changes={}), "run")[0].count() == 0
    with pytest.raises(InvalidDeclaration):
        write.Enricher({"event": F.lit("1")})


def test_redaction(spark):
    changes = {"card": (True, '"4111"', "null", None), "pay.card": (True, '""', '"x"', None), "data": (False, None, None, '{"card":"SECRET","n":[{"card":"SECRET"}]}'), "plain": (True, "1", "2", None)}
    out = redact(record(spark, changes=changes, attributes={"card": '"SECRET"', "extra": '{"deep":{"card":"SECRET"}}', "ok": "1"}), Rules(("order.card",)))
    r = out.first()
    assert r["changes"]["card"].asDict() == {"pair": True, "old": '"***"', "new": "null", "raw": None}
    assert r["changes"]["pay.card"]["old"] == '""' and r["changes"]["pay.card"]["new"] == '"***"' and r["changes"]["plain"]["new"] == "2"
    assert json.loads(r["changes"]["data"]["raw"]) == {"card": "***", "n": [{"card": "***"}]} and set(r["attributes"]) == {"extra", "ok"}
    assert leaks(out, ["SECRET", "4111"]).count() == 0
    assert redact(record(spark, objectType="cart", changes=changes), Rules(("order.card",))).first()["changes"]["card"]["old"] == '"4111"'
    with pytest.raises(InvalidDeclaration):
        Rules(("a.b.c",))


def test_drafts(spark):
    pair = lambda o, n: (True, o, n, None)
    records = spark.createDataFrame([("order", "1", 7, "update", 3, {"status": pair("a", "b")}), ("order", "2", 7, "remove", 9, {})], f"objectType string, objectId string, flush long, event string, seq long, changes map<string,{CHANGE}>")
    elements = spark.createDataFrame([("order", "1", 7, 2, "lines.1.qty", "1", "2"), ("order", "1", 7, 4, "lines.1.qty", "2", "3"), ("order", "2", 7, 5, "lines.2.qty", "1", "2"), ("order", "3", 8, 6, "lines.3.qty", "1", "2"), ("order", "3", None, 8, "x", "1", "2")], "objectType string, objectId string, flush long, seq long, name string, old string, new string")
    runs = spark.createDataFrame([("tags", "1", 7, 5, 0, ["a"], ["a", "b"], None)], "association string, owner string, flush long, since long, run int, old array<string>, new array<string>, doubt string")
    out = drafts.drafts(records, drafts.element_runs(elements), drafts.link_changes(runs, "order", "tags")).orderBy("since")
    assert [(r["objectId"], r["event"], r["since"], sorted(r["changes"])) for r in out.collect()] == [("1", "update", 2, ["lines.1.qty", "status", "tags"]), ("1", "update", 4, ["lines.1.qty"]), ("3", "update", 6, ["lines.3.qty"]), ("2", "remove", 9, [])]


def test_context_as_of(spark):
    records = spark.createDataFrame([("oven", "1", 5, {"site": (True, "1", "2", None)}), ("oven", "1", 9, {})], f"objectType string, objectId string, seq long, changes map<string,{CHANGE}>")
    images = spark.createDataFrame([("oven", "oven", "1", 1, 5, {"label": "old"}), ("oven", "oven", "1", 5, None, {"label": "now"}), ("carts", "cart", "1", 5, None, {"label": "another's"}), ("oven", "oven", "2", 1, 3, {"label": "gone"})], "root string, objectType string, key string, valid_from long, valid_to long, row map<string,string>")
    out = drafts.with_context(records, images, {"oven": ["label"]}).orderBy("seq").collect()
    assert len(out) == 2 and out[0]["changes"]["label"].asDict() == {"pair": True, "old": "now", "new": "now", "raw": None} and out[1]["changes"] == {}
    late = spark.createDataFrame([("oven", "2", 5, {"site": (True, "1", "2", None)})], records.schema)
    assert set(drafts.with_context(late, images, {"oven": ["label"]}).first()["changes"]) == {"site"}


def test_holders(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "owner string, target string")
    held = links.holders(rows, spark.createDataFrame([("a",)], "target string"), "tags")
    assert sorted(r["owner"] for r in held.collect()) == ["1", "3"]
    still = spark.createDataFrame([("tags", "3", "a")], "association string, owner string, target string")
    assert [r["owner"] for r in links.departed(held, still).collect()] == ["1"]


def test_failures(spark):
    bad = spark.createDataFrame([("no event",), ("no event",)], "reason string")
    assert failures.report(bad) == {"no event": 2}
    with pytest.raises(InvalidRecord):
        failures.report(bad, "throw")
    error = ValueError("can't reach https://me:pw@host with 'secret'")
    assert "pw" not in failures.safe_message(error, "full") and "secret" not in failures.safe_message(error) and failures.safe_message(error, "none") == "ValueError"


def test_frame(spark):
    from retrace.operators.frame import CoalescingFrame

    steps = spark.createDataFrame([r[1:] for r in [("f", "order", "1", "create", "x", "a", datetime(2024, 1, 1), 1, {"v": (True, "null", "1", None)}, {}), ("f", "order", "1", "update", "x", "b", datetime(2024, 1, 1), 2, {"v": (True, "1", "2", None)}, {})]], STEPS.replace("frame string, ", ""))
    written: list = []
    frame_ = CoalescingFrame(lambda df: written.append([(r["id"], r["event"]) for r in df.collect()]), max_held=0)
    with frame_():
        with frame_():
            frame_.record(steps.where("seq = 1"))
        frame_.record(steps.where("seq = 2"))
        assert written == []
    frame_.record(steps)
    assert written == [[("a", "create")], [("a", "create"), ("b", "update")]]
    with pytest.raises(FrameOverflow), frame_(atomic=True):
        frame_.record(steps)
    with pytest.raises(InvalidDeclaration), frame_():
        frame_.begin(atomic=True)
    assert len(written) == 2 and frame_.depth == 0


def test_frame_valve(spark):
    """Over batches as in one fold: what the valve lets out, in the order in which it does."""
    from retrace.operators.frame import CoalescingFrame

    for seed in range(6):
        rows = frame(seed)
        written: list = []
        for most in (1, 2, 50):
            held = CoalescingFrame(lambda df: written.append([(r["id"], r["event"], r["actor"], {k: c.asDict() for k, c in r["changes"].items()}) for r in df.collect()]), max_held=most)  # noqa: B023
            with held():
                for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
                    held.record(spark.createDataFrame([r[1:] for r in part], STEPS.replace("frame string, ", "")))
            assert written.pop() == [(r["id"], r["event"], r["actor"], r["changes"]) for r in coalesce.fold(plain(rows), most)], (seed, most)
            try:
                coalesce.fold(plain(rows), most, atomic=True)
                fits = True
            except FrameOverflow:
                fits = False
            try:
                with held(atomic=True):
                    held.record(spark.createDataFrame([r[1:] for r in rows], STEPS.replace("frame string, ", "")))
                assert fits and len(written.pop()) > 0
            except FrameOverflow:
                assert not fits and not written

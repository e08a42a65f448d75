"""Tables, commits, units of work, schemas and streams."""

from datetime import datetime

import pytest

from retrace.config import EngineConfig
from retrace.errors import InvalidDeclaration, InvalidRecord, TableNotFound, TransactionSpoilt
from retrace.sources.schema import TableDefinition, compare
from retrace.sources.store import Collector, Store, UnitOfWork, bulk_outcome
from retrace.streaming import streams


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    for name in ("audit_log", "orders", "outbox"):
        s.create(TableDefinition(name, {"warehouseId": "long"}))
    return s


def rows(spark, items, route="audit_log"):
    return spark.createDataFrame([(i, "order", "1", e, datetime(2024, 1, 1), 5, route, n) for n, (i, e) in enumerate(items)], "id string, objectType string, objectId string, event string, loggedAt timestamp, warehouseId int, route string, seq long")


def test_upserts(spark, store):
    store.upsert(rows(spark, [("a", "create"), ("b", "create"), ("a", "update")]), ["audit_log"], "1")
    store.upsert(rows(spark, [("b", "remove")]), ["audit_log"], "2")
    pinned = store.commits("audit_log")[:1]
    assert {r["id"]: r["event"] for r in store.read("audit_log").collect()} == {"a": "update", "b": "remove"}
    assert {r["id"]: r["event"] for r in store.read("audit_log", pinned).collect()} == {"a": "update", "b": "create"}
    store.upsert(rows(spark, [("b", "remove")]), ["audit_log"], "2")
    assert store.read("audit_log").count() == 2 and store.read("orders").count() == 0
    with pytest.raises(InvalidRecord):
        store.upsert(rows(spark, [(None, "create")]), ["audit_log"], "3")
    with pytest.raises(TableNotFound):
        store.upsert(rows(spark, [("x", "create")]), ["nowhere"], "3")


def test_unit_of_work(spark, store):
    with UnitOfWork(store) as unit:
        unit.write(rows(spark, [("a", "create")]), "audit_log", outbox="outbox")
        assert store.read("audit_log").count() == 0
    assert store.read("audit_log").count() == store.read("outbox").count() == 1
    with pytest.raises(TransactionSpoilt), UnitOfWork(store) as unit:
        unit.write(rows(spark, [("b", "create")]), "audit_log")
        unit.spoil("no")
    with pytest.raises(ValueError), UnitOfWork(store) as unit:
        unit.write(rows(spark, [("b", "create")]), "audit_log")
        raise ValueError
    assert store.read("audit_log").count() == 1


def test_one_mark(spark, store):
    """A commit over two tables counts in both or in none, and later units of work win."""
    store.stage(rows(spark, [("a", "create")]), "audit_log", "0")
    store.stage(rows(spark, [("a", "create")]), "orders", "0")
    assert store.read("audit_log").count() == store.read("orders").count() == 0
    store.publish("0")
    assert store.read("audit_log").count() == store.read("orders").count() == 1
    for event in ("update", "remove"):
        with UnitOfWork(store) as unit:
            unit.write(rows(spark, [("a", event)]), "orders")
            with pytest.raises(TransactionSpoilt):
                unit.write(rows(spark, [("z", event)]), "orders")
    assert [r["event"] for r in store.read("orders").collect()] == ["remove"]


def test_filters_reach_the_files(spark, store):
    store.upsert(rows(spark, [("a", "create")]), ["audit_log"], "1")
    store.upsert(rows(spark, [("a", "update"), ("b", "create")]), ["audit_log"], "2")
    found = store.read("audit_log").where("event = 'create'")
    assert [r["id"] for r in found.collect()] == ["b"]
    assert "EqualTo(event,create)" in found._jdf.queryExecution().executedPlan().toString()


def test_config_sends(spark, tmp_path):
    record = spark.createDataFrame([("order", "1", "create", datetime(2024, 1, 1), "x", None, 1, {"v": (True, "null", "1", None)}, {}), ("", "2", "create", None, None, None, 2, {}, {})], "objectType string, objectId string, event string, loggedAt timestamp, source string, id string, seq long, changes map<string,struct<pair:boolean,old:string,new:string,raw:string>>, attributes map<string,string>")
    for transport in ("sync", "queue", "outbox", "collector"):
        config = EngineConfig(f"file://{tmp_path}/{transport}", routing={"order": "orders"}, transport=transport)
        s = config.store(spark)
        for name in ("audit_log", "orders", "outbox"):
            s.create(TableDefinition(name))
        collector, n = Collector(), {t: 0 for t in ("orders", "outbox")}
        if transport == "outbox":
            with pytest.raises(InvalidDeclaration):
                config.send(spark, record, "1")
            with UnitOfWork(s) as unit:
                counts = config.send(spark, record, "1", unit=unit)
        else:
            counts = config.send(spark, record, "1", collector=collector)
        assert counts == {"no object type": 1}
        n = {t: s.read(t).count() for t in n} | {"collector": len(collector.rows)}
        assert n == {"orders": 0, "outbox": 0, "collector": 0} | {{"sync": "orders", "collector": "collector"}.get(transport, "outbox"): 1}
    with pytest.raises(InvalidRecord):
        EngineConfig(f"file://{tmp_path}/sync", on_failure="throw").send(spark, record, "2")


def test_schema(spark, store):
    more = TableDefinition("audit_log", {"warehouseId": "long", "place": "struct<lat:double,lon:double>"})
    assert set(store.sync(more).missing) == {"place.lat", "place.lon"} and store.check([more]).count() == 0
    with pytest.raises(InvalidDeclaration):
        store.sync(TableDefinition("audit_log", {"warehouseId": "string"}))
    assert [r["problem"] for r in store.check([TableDefinition("missing_one")]).collect()] == ["the table is missing"]
    with pytest.raises(InvalidDeclaration):
        TableDefinition("audit_log", {"event": "string"})
    with pytest.raises(InvalidDeclaration):
        TableDefinition("Bad Name")
    assert compare(more.schema(), more.schema()).clean


def test_outcomes(spark):
    items = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "position int, id string")
    answers = spark.createDataFrame([(0, "a", 201, None), (1, "b", 429, "busy"), (2, "x", 200, None), (3, "d", 400, "bad")], "position int, id string, status int, reason string")
    good, bad = bulk_outcome(items, answers)
    assert [r["id"] for r in good.collect()] == ["a"] and {r["id"]: r["transient"] for r in bad.collect()} == {"b": True, "c": False, "d": False}


def test_collector(spark):
    sink = Collector()
    sink.write(rows(spark, [("a", "create")]))
    sink.assert_written(1, id="a")
    sink.assert_nothing(id="b")


def test_config():
    EngineConfig("/x", coalescing=True, numeric_fields=("a",))
    for bad in ({"transport": "pigeon"}, {"numeric_fields": ("a",)}, {"default_table": "A B"}, {"transport": "outbox", "outbox_table": "audit_log"}, {"batch_size": 0}):
        with pytest.raises(InvalidDeclaration):
            EngineConfig("/x", **bad)


def test_queue_stream(spark, store, tmp_path):
    rows(spark, [("a", "create"), ("b", "create"), ("a", "update")]).write.parquet(f"{tmp_path}/queue")
    stream = spark.readStream.schema(rows(spark, [("a", "x")]).schema).parquet(f"{tmp_path}/queue")
    streams.upsert_stream(stream, store, ["audit_log"], f"{tmp_path}/checkpoint").awaitTermination()
    assert {r["id"]: r["event"] for r in store.read("audit_log").collect()} == {"a": "update", "b": "create"}


def test_settled_stream(spark, tmp_path):
    """Two batches; the second ends the transaction the first left open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "connection string, seq long, sql string, params string, failed boolean, kind string, flush long"
    first = [("c", 1, "UPDATE t SET a = 1", None, False, "statement", None), ("c", 2, "BEGIN", None, False, "statement", None), ("c", 3, "UPDATE t SET a = 2", None, False, "statement", 4)]
    second = [("c", 4, "SAVEPOINT s", None, False, "statement", None), ("c", 5, "UPDATE t SET a = 3", None, False, "statement", None), ("c", 6, "ROLLBACK TO s", None, False, "statement", None), ("c", 7, "COMMIT", None, False, "statement", None)]
    for batch in (first, second):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        out = streams.settled_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log"))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("seq", "fate", "owner").collect()
    assert sorted((r["seq"], r["fate"], r["owner"]) for r in got) == [(1, "COMMITTED", None), (3, "COMMITTED", 4), (5, "VOID", None)]



"""Queries: narrowing, cursors, limits, compiled predicates. The seeded chains hold narrowing against plain Python."""

import random
from datetime import datetime

import pytest

from pyspark.sql import functions as F

from retrace.errors import InvalidQuery
from retrace.operators import aggs
from retrace.plans.query import Cursor, Filter
from retrace.plans.query import HistoryQuery as Q
from retrace.plans.reader import Limits, Reader, hydrate

ROWS = [(f"{i:03d}" if i % 9 else None, ["order", "cart"][i % 2], str(i % 5), ["create", "update", "remove"][i % 3], datetime(2024, 1, 1 + i % 4), ["a", "b", None][i % 3], i % 4, None if i % 4 else f"n{i % 3}", i) for i in range(60)]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "id string, objectType string, objectId string, event string, loggedAt timestamp, source string, warehouseId int, note string, seq int")


@pytest.fixture(scope="module")
def reader(records):
    return Reader({"audit_log": records})


def found(reader, query):
    return {r["seq"] for r in reader.matching(reader.extended(query)).select("seq").collect()}


def test_predicates(reader):
    assert found(reader, Q.for_("order").with_object_ids(2, "4")) == {r[8] for r in ROWS if r[1] == "order" and r[2] in ("2", "4")}
    assert found(reader, Q.any().where_not_exists("note")) == {r[8] for r in ROWS if r[7] is None}
    assert found(reader, Q.any().where_between("warehouseId", 1, 2)) == {r[8] for r in ROWS if 1 <= r[6] <= 2}
    assert found(reader, Q.any().between(datetime(2024, 1, 2), datetime(2024, 1, 3))) == {r[8] for r in ROWS if 2 <= r[4].day <= 3}
    assert found(reader, Q.any().match_nothing()) == set()


def test_nothing_is_an_empty_plan(reader):
    plan = reader.matching(Q.any().match_nothing())._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


@pytest.mark.parametrize("seed", range(25))
def test_narrowing_only_ever_narrows(reader, seed):
    rng = random.Random(seed)
    query, rows = Q.any(), list(ROWS)
    for _ in range(rng.randrange(1, 5)):
        before = {r[8] for r in rows}
        step = rng.randrange(3)
        values = rng.sample(["a", "b", "c"], rng.randrange(1, 3)) if step == 1 else rng.sample(range(5), rng.randrange(0 if step == 2 else 1, 4))
        if step == 0:
            query, rows = query.narrow_object_ids(*map(str, values)), [r for r in rows if r[2] in map(str, values)]
        elif step == 1:
            query, rows = query.narrow_actors(*values), [r for r in rows if r[5] in values]
        else:
            query, rows = query.narrow_in("warehouseId", *values), [r for r in rows if r[6] in values]
        assert {r[8] for r in rows} <= before
    assert found(reader, query) == {r[8] for r in rows}


def test_narrow_in_rules():
    q = Q.any()
    assert q.where("f", True).narrow_in("f", 1).nothing
    assert not q.where("f", 1).narrow_in("f", "1").nothing
    assert q.where_not_exists("f").narrow_in("f", 1).nothing
    assert q.where_exists("f").narrow_in("f", 1).filters == (Filter("f", "in", (1,)),)
    assert q.narrow_in("f").nothing and q.match_nothing().narrow_actors("x").nothing
    with pytest.raises(InvalidQuery):
        q.where_between("f", 1, 2).narrow_in("f", 1)
    assert q.where("f", 1).where_in("f", 2, 3).filters == (Filter("f", "in", (2, 3)),)


@pytest.mark.parametrize("bad", [lambda: Q.for_(""), lambda: Q.any().with_events(), lambda: Q.any().with_ids(*map(str, range(65_537))), lambda: Q.any().between(datetime(2024, 2, 1), datetime(2024, 1, 1)), lambda: Q.any().where("event", "x"), lambda: Q.any().where("", 1), lambda: Q.any().where_between("f", None, None), lambda: Q.any().where_between("f", 2, 1), lambda: Q.any().page(0, 5), lambda: Q.any().take(0), lambda: Q.any().where("f", [1]), lambda: Cursor.of("?"), lambda: Cursor.of("x" * 5000), lambda: Cursor((None,), "q").token()])
def test_refusals(bad):
    with pytest.raises(InvalidQuery):
        bad()


def test_cursor_belongs_to_its_search(reader):
    token = Cursor(("2024-01-01 00:00:00", "001", "audit_log"), Q.for_("order").fingerprint()).token()
    assert Q.for_("order").take(7).after(token).limit == 7
    for other in (Q.for_("cart"), Q.for_("order").with_events("create"), Q.for_("order").oldest_first(), Q.for_("order").with_option("v", 1)):
        with pytest.raises(InvalidQuery):
            reader.find(other.after(token))
    assert Q.for_("order").after(token).with_events("create").cursor is None
    assert Q.for_("order").page(3, 5).fingerprint() == Q.for_("order").fingerprint()


@pytest.mark.parametrize("newest", [True, False])
def test_pages_by_token_are_the_pages_by_number(records, newest):
    r = Reader({"audit_log": records.where("id IS NOT NULL")})
    query = Q.any().take(7) if newest else Q.any().oldest_first().take(7)
    whole = [x["seq"] for x in r.iterate(query)]
    seen, page = [], r.find(query)
    while True:
        seen += [x["seq"] for x in page.hits]
        if page.next_token is None:
            break
        page = r.find(query.after(page.next_token))
    assert seen == whole and len(set(seen)) == len(whole)
    assert [x["seq"] for x in r.find(query.page(2, 7)).hits] == whole[7:14]


def test_rows_without_id_come_last_and_give_no_token(reader):
    rows = [x["id"] for x in reader.iterate(Q.any().between(datetime(2024, 1, 1), datetime(2024, 1, 1)).oldest_first())]
    assert rows[-1] is None and None not in rows[:1]


def test_limits(records):
    r = Reader({"audit_log": records}, limits=Limits(10, 30))
    for q in (Q.any().take(11), Q.any().page(4, 10)):
        with pytest.raises(InvalidQuery):
            r.find(q)
    page = r.find(Q.any().page(2, 10))
    assert page.total == 60 and page.total_pages == 6 and page.max_reachable_page == 3 and page.has_more
    with pytest.raises(InvalidQuery):
        list(r.iterate(Q.any().page(1, 5)))


def test_extension_applies_everywhere(records):
    r = Reader({"audit_log": records}, extensions=[lambda q: q.narrow_in("warehouseId", 1)])
    assert {x["warehouseId"] for x in r.iterate(Q.any())} == {1}
    out = r.raw(Q.any(), {"aggs": {"w": {"terms": {"field": "warehouseId"}}}})
    assert [x["w"] for x in out["aggregations"]["w"].collect()] == [1]
    old = Reader({"audit_log": records}).find(Q.any().take(3)).next_token
    with pytest.raises(InvalidQuery):
        r.find(Q.any().take(3).after(old))
    first = r.find(Q.any().take(3))
    assert len(first.hits) == 3 and not {x["seq"] for x in r.find(Q.any().take(3).after(first.next_token)).hits} & {x["seq"] for x in first.hits}


@pytest.mark.parametrize("body", [{"runtime_mappings": {}}, {"aggs": []}, {"aggs": {"x": {"global": {}}}}, {"aggs": {"x": {"terms": {"field": "event"}, "aggs": {"y": {"children": {}}}}}}, {"from": 1, "search_after": ["a"]}, {"size": 5000}, {"from": 9999, "size": 10}, {"highlight": {}}, {"aggs": {"x": {"inference": {}}}}])
def test_raw_refuses(reader, body):
    with pytest.raises(InvalidQuery):
        reader.raw(Q.any(), body)


def test_nothing_has_no_aggregations(reader):
    assert "aggregations" not in reader.raw(Q.any().match_nothing(), {"aggs": {"x": {"terms": {"field": "event"}}}})


def test_hydrate_documents_of_any_age(spark):
    rows = spark.createDataFrame([(None, "x1", "order", "1", "create", "2020-01-01 10:00:00", "a", 7), ("y2", "y2", "order", None, None, "yesterday", None, 8)], "id string, _id string, objectType string, objectId string, event string, loggedAt string, source string, warehouseId int")
    a, b = sorted(hydrate(rows, ["warehouseId"]).collect(), key=lambda r: r["id"])
    assert (a["id"], a["loggedAt"], a["warnings"]) == ("x1", datetime(2020, 1, 1, 10), [])
    assert b["loggedAt"] == datetime(1970, 1, 1) and set(b["warnings"]) == {"loggedAt", "objectId", "event"} and b["event"] == ""


def test_search_after_follows_the_sort(spark):
    """Pages by the body's own sort, missing values last, meet every row once."""
    data = [(str(i), "order", "1", "update", datetime(2024, 1, 1), "x", i % 3 if i % 4 else None, i % 2) for i in range(20)]
    df = spark.createDataFrame(data, "id string, objectType string, objectId string, event string, loggedAt timestamp, source string, a int, b int")
    for sort in ([("a", "asc"), ("b", "desc"), ("id", "asc")], [("a", "desc"), ("id", "desc")]):
        r = Reader({"audit_log": df})
        whole = [tuple(x) for x in r.raw(Q.any(), {"sort": sort, "size": 20})["hits"].select(*[n for n, _ in sort]).collect()]
        met, last = [], None
        while True:
            body = {"sort": sort, "size": 3} | ({"search_after": list(last)} if last else {})
            page = [tuple(x) for x in r.raw(Q.any(), body)["hits"].select(*[n for n, _ in sort]).collect()]
            if not page:
                break
            met, last = met + page, page[-1]
        assert met == whole and len(met) == 20
    with pytest.raises(InvalidQuery):
        r.raw(Q.any(), {"sort": [("a", "asc")], "search_after": [1, 2]})


def test_ip_range(spark):
    import ipaddress

    texts = ["10.0.0.1", "10.0.1.0", "192.168.0.256", "::1", "2001:db8::", "2001:db8::ff:1", "fe80:0:0:0:0:0:0:1", "no address", "1::2::3", "::", None, "255.255.255.255", "2001:db8:0:0:0:0:0:0:1", "12345::"]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")

    def number(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)

    assert [None if r[0] is None else int(r[0], 16) for r in df.select(aggs.ip_key(F.col("ip"))).collect()] == [None if t is None else number(t) for t in texts]
    got = aggs.aggregate(df, {"net": {"ip_range": {"field": "ip", "ranges": [{"from": "10.0.0.0", "to": "10.0.1.0"}, {"from": "2001:db8::", "key": "six"}, {"to": "::2"}]}}})["net"].collect()
    assert {r["net"]: r["doc_count"] for r in got} == {"10.0.0.0-10.0.1.0": 1, "six": 3, "*-::2": 2}


def test_nested_geo_and_moving(spark):
    rows = [("1", 1, [("a", 1.0, 10.0), ("b", 3.0, 30.0)]), ("2", 2, [("a", 5.0, -20.0)]), ("3", 3, []), ("4", 4, [("b", 2.0, 5.0), ("b", 4.0, 7.0)])]
    df = spark.createDataFrame(rows, "id string, day int, lines array<struct<kind:string,lat:double,lon:double>>")
    out = aggs.aggregate(df, {"lines": {"nested": {"path": "lines"}, "aggs": {"kind": {"terms": {"field": "kind"}, "aggs": {"records": {"reverse_nested": {}}}}, "mean": {"avg": {"field": "lat"}}}}})
    assert (out["lines"].first()["doc_count"], out["lines"].first()["mean"]) == (5, 3.0)
    assert {r["kind"]: r["doc_count"] for r in out["lines>kind"].collect()} == {"a": 2, "b": 3}
    assert {r["kind"]: r["doc_count"] for r in out["lines>kind>records"].collect()} == {"a": 2, "b": 2}
    flat = df.selectExpr("id", "inline(lines)")
    box = aggs.aggregate(flat, {"box": {"geo_bounds": {"lat": "lat", "lon": "lon"}}, "middle": {"geo_centroid": {"lat": "lat", "lon": "lon"}}})
    found = {k: v for t in {id(x): x for x in box.values()}.values() for k, v in t.first().asDict().items()}
    assert (found["box_top"], found["box_bottom"], found["box_left"], found["box_right"], found["middle_lat"], found["middle_lon"]) == (5.0, 1.0, -20.0, 30.0, 3.0, 6.4)
    moving = aggs.aggregate(df, {"day": {"histogram": {"field": "day", "interval": 1}, "aggs": {"most": {"max": {"field": "day"}}, "p": {"moving_percentiles": {"buckets_path": "most", "window": 2, "percents": [50, 100]}}}}})["day"]
    assert [r["p"] for r in moving.orderBy("day").collect()] == [None, [1, 1], [1, 2], [2, 3]]
    wide = spark.createDataFrame([(float(x),) for x in [1, 2, 1, 100, 101, 102, 1]], "x double")
    bars = aggs.aggregate(wide, {"bar": {"variable_width_histogram": {"field": "x", "buckets": 2}}})["bar"].collect()
    assert sorted(r["doc_count"] for r in bars) == [3, 4]

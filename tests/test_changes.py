"""Scripts of inserts, updates and deletes, and what versions, history and audit make of them."""

from datetime import datetime

from pyspark.sql import functions as F

from tagloom.operators import changes as C

KEY, ORDER = ["id"], ["ts", "seq"]


def feed(spark, *rows):
    """(id, name, price, op), a second apart."""
    return spark.createDataFrame([(i, n, p, op, datetime(2024, 1, 1, 0, 0, k), k) for k, (i, n, p, op) in enumerate(rows)], "id int, name string, price double, op string, ts timestamp_ntz, seq int")


def test_versions_of_an_update_and_a_delete(spark):
    rows = [(1, "Widget", 9.99, "INSERT"), (1, "Widget", 14.99, "UPDATE")]
    v = C.scd2(feed(spark, *rows), KEY, ORDER, "op")
    assert v.count() == 2
    assert [r.price for r in C.current(v).collect()] == [14.99]
    v = C.scd2(feed(spark, *rows, (1, "Widget", 14.99, "DELETE")), KEY, ORDER, "op")
    assert C.current(v).count() == 0
    assert v.filter("valid_to is null").count() == 0 and v.count() == 2


def test_update_without_a_change_makes_a_version(spark):
    assert C.scd2(feed(spark, (1, "a", 1.0, "INSERT"), (1, "a", 1.0, "UPDATE")), KEY, ORDER, "op").count() == 2


def test_history_keeps_each_old_row_at_the_time_of_capture(spark):
    rows = [(1, "Widget", 9.99, "INSERT"), (1, "Widget", 14.99, "UPDATE"), (1, "Widget", 19.99, "UPDATE"), (1, "Widget", 24.99, "UPDATE"), (2, "Gadget", 5.0, "INSERT"), (2, "Gadget", 5.0, "DELETE")]
    h = C.history(feed(spark, *rows), KEY, ORDER, ["name", "price"], "op").orderBy("id", "valid_from").collect()
    assert [(r.price, r.history_operation) for r in h] == [(9.99, "UPDATE"), (14.99, "UPDATE"), (19.99, "UPDATE"), (5.0, "DELETE")]
    assert all(r.valid_from == r.valid_to for r in h)
    assert C.history(feed(spark, *rows), KEY, ORDER, ["name"], "op", ["DELETE"]).count() == 1


def test_audit_log_and_its_replay(spark):
    f = feed(spark, (1, "Order", 9.0, "INSERT"), (1, "Order", 10.0, "UPDATE"), (1, "Order", 10.0, "DELETE"), (2, "Kept", None, "INSERT"))
    json = C.as_json("name", "price")
    log = C.audit(f, "orders", KEY, ORDER, "op", F.lag(json).over(C.by_key(KEY, ORDER)), json)
    got = [(r.operation, r.old_data, r.new_data) for r in log.filter("id = 1").orderBy("changed_at").collect()]
    assert got == [("INSERT", None, '{"name":"Order","price":9.0}'), ("UPDATE", '{"name":"Order","price":9.0}', '{"name":"Order","price":10.0}'), ("DELETE", '{"name":"Order","price":10.0}', None)]
    assert [(r.id, r.data) for r in C.replay(log, KEY).collect()] == [(2, '{"name":"Kept","price":null}')]


def test_as_of_and_version_ids(spark):
    v = C.scd2(feed(spark, (1, "a", 1.0, "INSERT"), (1, "b", 2.0, "UPDATE")), KEY, ORDER)
    assert [r.name for r in C.as_of(v, datetime(2024, 1, 1, 0, 0, 0)).collect()] == ["a"]
    assert sorted(r.version_id for r in C.with_version_ids(v, KEY).collect()) == [1, 2]


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "id int, v string")
    assert sorted((r.id, r.op) for r in C.snapshot_changes(a, b, KEY).collect()) == [(2, "UPDATE"), (3, "DELETE"), (4, "INSERT")]
    assert C.snapshot_changes(a, a, KEY).count() == 0


def test_stamped_rows(spark):
    before = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (None, "n", 10), (3, None, 10)], "k int, v string, at int")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (None, "n"), (3, None), (4, "d")], "k int, v string")
    made = {r.k: r["at"] for r in C.stamped(before, after, ["k"], "at", F.lit(99)).collect()}
    assert made == {1: 10, 2: 99, None: 10, 3: 10, 4: 99}

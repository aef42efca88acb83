"""The registered queries: each applies an operator to whole tables. oracle.SQL has the same for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.text import capitalized, joined_sorted, substr_from_zero, total
from tagloom.operators import changes, guard, relational
from tagloom.plans import schema
from tagloom.registry import Context, compile_tags
from tagloom.sources.tables import read
from tagloom.tags import TableTags, parse_comment

KEY, ORDER = ("user_id",), ("ts", "event_id")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.strip("_")] = f
    return f


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as row changes of users: the first inserts, a last purchase deletes, the others update."""
    (events,) = read(spark, d, "events")
    return changes.with_operation(events.select("user_id", "event_id", "ts", "event_type"), KEY, ORDER, F.col("event_type") == "purchase")


# Row changes


@query
def scd2_versions(spark, d):
    (events,) = read(spark, d, "events")
    return changes.scd2(events.select("user_id", "event_id", "event_type", "ts"), KEY, ORDER).drop("ts")


@query
def scd2_current(spark, d):
    return changes.current(scd2_versions(spark, d)).select("user_id", "event_id")


@query
def scd2_with_delete(spark, d):
    return changes.scd2(feed(spark, d), KEY, ORDER, "op").select("user_id", "event_type", "valid_from", "valid_to")


@query
def history_update(spark, d):
    (events,) = read(spark, d, "events")
    return changes.history(events, KEY, ORDER, ["event_type"]).withColumnRenamed("event_type", "old_type")


@query
def history_delete(spark, d):
    return changes.history(feed(spark, d), KEY, ORDER, ["event_type"], "op")


@query
def audit_log(spark, d):
    return user_log(spark, d)


def user_log(spark: SparkSession, d: str, seq: bool = False) -> DataFrame:
    old = F.lag("event_type").over(changes.by_key(KEY, ORDER))
    return changes.audit(feed(spark, d), "users", KEY, ORDER, "op", old, F.col("event_type"), seq=seq)


@query
def audit_json(spark, d):
    (orders,) = read(spark, d, "orders")
    return orders.select("o_orderkey", changes.as_json("o_orderkey", "o_orderstatus").alias("new_data"))


@query
def audit_redact(spark, d):
    (customer,) = read(spark, d, "customer")
    return changes.redacted(customer.select("c_custkey", "c_name"), "c_name", "hash")


@query
def audit_shared_log(spark, d):
    logs = [t.select(F.lit(n).alias("table_name"), F.col(c).alias("new_data")) for n, c, t in zip(("nation", "region"), ("n_name", "r_name"), read(spark, d, "nation", "region"), strict=True)]
    return logs[0].unionByName(logs[1])


# Soft deletion, policies, masking


def deletable_orders(spark, d):
    (orders,) = read(spark, d, "orders")
    return orders.withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))


@query
def softdelete_active(spark, d):
    return guard.active(deletable_orders(spark, d)).select("o_orderkey", "o_custkey")


@query
def softdelete_cascade(spark, d):
    (lineitem,) = read(spark, d, "lineitem")
    return guard.cascade(lineitem.select("l_orderkey", "l_linenumber"), deletable_orders(spark, d), "l_orderkey", "o_orderkey")


@query
def softdelete_cascade_chain(spark, d):
    customer, orders, lineitem = read(spark, d, "customer", "orders", "lineitem")
    gone = customer.withColumn("deleted_at", F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    mid = guard.cascade(orders.select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")
    return guard.cascade(lineitem.select("l_orderkey", "l_linenumber"), mid, "l_orderkey", "o_orderkey")


@query
def rls_select_policy(spark, d):
    (customer,) = read(spark, d, "customer")
    tags = TableTags("customer", parse_comment("@rls @rls.policy(SELECT, PUBLIC, 'c_nationkey = 1') @rls.policy(SELECT, PUBLIC, \"c_mktsegment = 'BUILDING'\")"))
    return compile_tags(customer, Context("customer", tags))["customer_secured"].select("c_custkey", "c_mktsegment")


@query
def rls_default_deny(spark, d):
    (customer,) = read(spark, d, "customer")
    return guard.secured(customer, []).select("c_custkey")


@query
def anon_partial(spark, d):
    (customer,) = read(spark, d, "customer")
    return guard.masked(customer.select("c_custkey", "c_name"), "c_name", "partial", 2, "***", 2)


# Validation and integrity


@query
def validate_range(spark, d):
    return guard.violations(read(spark, d, "lineitem")[0], guard.in_range("l_quantity", 1, 40)).select("l_orderkey", "l_linenumber")


@query
def validate_length(spark, d):
    return guard.violations(read(spark, d, "part")[0], guard.has_length("p_name", 5, 10)).select("p_partkey")


@query
def validate_not_empty(spark, d):
    name = F.when(F.col("p_size") < 5, "  ").otherwise(F.col("p_name"))
    return guard.violations(read(spark, d, "part")[0], guard.not_empty(name)).select("p_partkey")


@query
def validate_pattern(spark, d):
    return guard.violations(read(spark, d, "part")[0], guard.matches("p_brand", "^Brand#[1-3][0-9]?$")).select("p_partkey")


@query
def validate_report(spark, d):
    rules = {"l_quantity_range": guard.in_range("l_quantity", 1, 40), "l_returnflag_not_empty": guard.not_empty("l_returnflag"), "l_discount_length": guard.has_length("l_linestatus", 2)}
    return guard.report(read(spark, d, "lineitem")[0], rules)


@query
def pk_duplicates(spark, d):
    return guard.duplicates(read(spark, d, "lineitem")[0], ["l_orderkey", "l_linenumber"], primary=True)


@query
def partial_unique_violations(spark, d):
    return guard.duplicates(read(spark, d, "orders")[0], ["o_custkey"], "o_orderstatus = 'P'")


@query
def fk_orphans(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return guard.orphans(orders, customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@query
def not_null_violations(spark, d):
    return guard.nulls(read(spark, d, "customer")[0], F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))


# Projections and filters


@query
def proj_alias(spark, d):
    return read(spark, d, "customer")[0].select(F.col("c_custkey").alias("x"), F.col("c_name").alias("name"), F.lit(2).alias("constant"))


@query
def case_notes(spark, d):
    return read(spark, d, "customer")[0].select(F.col("c_custkey").alias("id"), relational.notes().alias("notes"))


@query
def ilike_search(spark, d):
    return read(spark, d, "part")[0].filter(F.col("p_name").ilike("%RED%")).select("p_partkey")


@query
def modulo_filter(spark, d):
    return read(spark, d, "orders")[0].filter("o_orderkey % 2 = 1").select("o_orderkey")


@query
def exclude_glob(spark, d):
    return schema.excluded(read(spark, d, "part")[0], "p_brand", ["Brand#1*"]).select("p_partkey")


@query
def nicer_name(spark, d):
    return read(spark, d, "customer")[0].select("c_custkey", capitalized("c_mktsegment").alias("nm"))


@query
def substr_zero(spark, d):
    return read(spark, d, "nation")[0].select(substr_from_zero("n_name", 10).alias("z")).distinct()


@query
def struct_access(spark, d):
    row = F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"))
    return read(spark, d, "orders")[0].select("o_orderkey", (row["a"] + 1).alias("a1"))


@query
def schema_evolve_copy(spark, d):
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return schema.evolved(read(spark, d, "customer")[0], {"c_custkey": F.col("c_custkey"), "c_mktsegment": segment}, {"c_mktsegment": "UNKNOWN"})


# Joins


@query
def sales_by_category(spark, d):
    return relational.sales_by_category(*read(spark, d, "lineitem", "orders", "customer", "nation", "region"))


@query
def sales_by_store(spark, d):
    return relational.sales_by_store(*read(spark, d, "lineitem", "supplier", "nation", "region"))


@query
def customer_list(spark, d):
    return relational.customer_list(*read(spark, d, "customer", "nation", "region"))


@query
def film_list(spark, d):
    return relational.film_list(*read(spark, d, "region", "nation", "supplier"))


@query
def actor_info(spark, d):
    return relational.actor_info(*read(spark, d, "region", "nation", "supplier"))


@query
def customer_balance(spark, d):
    return relational.balance(*read(spark, d, "customer", "orders"), F.lit("2024-06-30 00:00:00").cast("timestamp_ntz"))


@query
def rewards_report(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    times = [F.lit(t).cast("timestamp_ntz") for t in ("1995-01-01 00:00:00", "1996-12-31 00:00:00")]
    return relational.rewards(customer, orders, *times, 500_000, 2)


@query
def left_join_on_filter(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return customer.join(orders.filter("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query
def anti_left_null(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return customer.join(orders.filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query
def in_stock_anti(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return customer.join(orders.filter("o_orderstatus = 'O'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query
def not_exists(spark, d):
    nation, customer = read(spark, d, "nation", "customer")
    return nation.join(customer.filter("c_acctbal < -990"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select("n_nationkey")


@query
def exists_semi(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return customer.join(orders.filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query
def arith_join(spark, d):
    nation, region = read(spark, d, "nation", "region")
    return nation.join(region, F.col("n_nationkey") == F.col("r_regionkey") + 10).select("n_nationkey", "r_name")


@query
def friends_in_list(spark, d):
    return relational.friends(read(spark, d, "nation")[0], "n_nationkey", "n_name", (1, 2))


@query
def join_derived_agg(spark, d):
    customer, orders = read(spark, d, "customer", "orders")
    return customer.join(has_many(spark, d).toDF("k", "n"), F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "n")


@query
def top1_lateral(spark, d):
    """The least order of each customer: a pre-aggregated minimum instead of a sort of each group."""
    customer, orders = read(spark, d, "customer", "orders")
    first = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return customer.join(first, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "o_orderkey")


@query
def udtf_user_posts(spark, d):
    """A SQL table function called for each row; Catalyst makes a join of it."""
    customer, orders = read(spark, d, "customer", "orders")
    # Names of their own: another call of this session may read another folder.
    own = uuid.uuid4().hex
    customer.createOrReplaceTempView(f"customer_{own}")
    orders.createOrReplaceTempView(f"orders_{own}")
    spark.sql(f"CREATE TEMPORARY FUNCTION user_posts_{own}(k BIGINT) RETURNS TABLE(o_orderkey BIGINT, o_orderstatus STRING) RETURN SELECT o_orderkey, o_orderstatus FROM orders_{own} WHERE o_custkey = k")
    return spark.sql(f"SELECT c.c_custkey, p.o_orderkey, p.o_orderstatus FROM customer_{own} c, LATERAL user_posts_{own}(c.c_custkey) p")


# Aggregates and sets


@query
def has_many(spark, d):
    return read(spark, d, "orders")[0].groupBy("o_custkey").agg(F.count("*").alias("n_children"))


@query
def having_summary(spark, d):
    return relational.summary(*read(spark, d, "customer", "orders"), 2)


@query
def group_concat(spark, d):
    return read(spark, d, "nation")[0].groupBy("n_regionkey").agg(joined_sorted("n_name").alias("names"))


@query
def array_agg_rows(spark, d):
    """The rows of each region, as rows, written as JSON."""
    rows = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))
    return read(spark, d, "nation")[0].groupBy("n_regionkey").agg(F.to_json(rows).alias("nations"))


@query
def groupby_dedupe(spark, d):
    return read(spark, d, "lineitem")[0].select("l_returnflag", "l_linestatus").dropDuplicates()


@query
def _distinct(spark, d):
    return read(spark, d, "customer")[0].select("c_mktsegment").distinct()


@query
def name_clash(spark, d):
    return guard.duplicates(read(spark, d, "part")[0].select(F.lower("p_brand").alias("nm")), ["nm"])


@query
def partition_month_sum(spark, d):
    return read(spark, d, "orders")[0].groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(total("o_totalprice").alias("total"))


@query
def union_distinct(spark, d):
    customer, supplier = read(spark, d, "customer", "supplier")
    return customer.select(F.col("c_nationkey").alias("k")).union(supplier.select("s_nationkey")).distinct()


@query
def inherit_union(spark, d):
    supplier, customer = read(spark, d, "supplier", "customer")
    base = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return base.unionByName(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("extra")), allowMissingColumns=True)


@query
def values_srf(spark, d):
    return spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int")


@query
def generate_series(spark, d):
    return spark.range(1).select(F.explode(F.sequence(F.lit(30894622507013190), F.lit(30894622507013200))).alias("v"))


@query
def explode_array(spark, d):
    return read(spark, d, "part")[0].select("p_partkey", F.explode(F.split("p_name", " ")).alias("w"))


@query
def unnest_zip(spark, d):
    """Two arrays of different lengths side by side, with places from 1; the shorter one ends in nulls."""
    pairs = F.arrays_zip(F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    return read(spark, d, "part")[0].select("p_partkey", F.posexplode(pairs).alias("pos", "p")).select("p_partkey", (F.col("pos") + 1).cast("long").alias("ord"), "p.a", "p.b")


# Schemas


@query
def schema_diff(spark, d):
    a = spark.createDataFrame([("id", "int"), ("nm", "text"), ("x", "int")], "c string, t string")
    b = spark.createDataFrame([("id", "bigint"), ("name", "text"), ("x", "int")], "c string, t string")
    return schema.diff(a, b)


@query
def column_diff(spark, d):
    a = spark.createDataFrame([("o_orderkey", "bigint"), ("o_custkey", "int"), ("o_note", "text")], "c string, t string")
    b = spark.createDataFrame([("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_comment", "text")], "c string, t string")
    return schema.diff(a, b)


@query
def topo_levels(spark, d):
    depth = schema.levels({"lineitem": ["orders"], "orders": ["customer"], "customer": ["nation"], "nation": ["region"]})
    return spark.createDataFrame(sorted(depth.items()), "obj string, depth int")


# Extensions: not in the reference's own behaviour


@query
def as_of_versions(spark, d):
    return changes.as_of(scd2_versions(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("user_id", "event_id")


@query
def audit_replay(spark, d):
    """Each user's state as the audit log leaves it; equals the current versions."""
    return changes.replay(user_log(spark, d, seq=True), KEY).withColumnRenamed("data", "event_type")


@query
def snapshot_changes(spark, d):
    """Two snapshots of customers compared: those of one segment gone, balances of another changed."""
    (customer,) = read(spark, d, "customer")
    rows = customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    after = rows.filter("c_mktsegment <> 'BUILDING'").withColumn("c_nationkey", F.when(F.col("c_mktsegment") == "MACHINERY", -1).otherwise(F.col("c_nationkey")))
    return changes.snapshot_changes(rows, after, ["c_custkey"]).select("c_custkey", "op")


EXTENSION_SQL = {
    "as_of_versions": "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND (t IS NULL OR t > TIMESTAMP '2024-01-15 00:00:00')",
    "audit_replay": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1 AND NOT (event_type = 'purchase' AND n > 1)",
    "snapshot_changes": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'DELETE' ELSE 'UPDATE' END AS op FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events tagged @temporal, their current versions counted by type: tags to registry to window to view."""
    (events,) = read(spark, d, "events")
    tags = TableTags("users", parse_comment("@temporal"))
    made = compile_tags(events.select("user_id", "event_id", "event_type", "ts"), Context("users", tags, KEY, ORDER))
    return made["users_current"].groupBy("event_type").agg(F.count("*").alias("n"))



"""Reports over star-shaped tables: joins that aggregate first, ordered string aggregation, and set-returning lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import joined_sorted, money, total


def notes() -> Column:
    return F.when(F.col("c_acctbal") >= 0, "active").otherwise("")


def sales_by_category(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Sales by region. Lines are summed by order before any join, so the fact table is shuffled once, as partial sums."""
    by_order = lineitem.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("sales"))
    by_customer = by_order.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("sales").alias("sales"))
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = by_customer.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("r_name").alias("category")).agg(F.sum("sales").cast("double").alias("total_sales")).orderBy(F.desc("total_sales"))


def sales_by_store(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    by_supplier = lineitem.groupBy("l_suppkey").agg(F.sum(money("l_extendedprice")).alias("sales"))
    joined = by_supplier.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name", "s_name").agg(F.sum("sales").cast("double").alias("total_sales")).select(F.concat("n_name", F.lit(","), "r_name").alias("store"), F.col("s_name").alias("manager"), "total_sales")


def customer_list(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), notes().alias("notes"))


def film_list(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    joined = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy(F.col("r_regionkey").alias("fid"), F.col("r_name").alias("title")).agg(joined_sorted(F.concat("n_name", F.lit(" "), "s_name")).alias("actors"))


def actor_info(region: DataFrame, nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """A region's nations with their suppliers: the inner list is aggregated first, then joined, instead of looked up per row."""
    names = supplier.groupBy("s_nationkey").agg(joined_sorted("s_name").alias("names"))
    per_nation = nation.join(names, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_regionkey", F.concat("n_name", F.lit(": "), "names").alias("x"))
    lists = per_nation.groupBy("n_regionkey").agg(F.when(F.count("x") > 0, joined_sorted("x", distinct=True)).alias("info"))
    return region.join(lists, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.max("info").alias("info"))


def balance(customer: DataFrame, orders: DataFrame, until: Column) -> DataFrame:
    """Fees up to a time less what is paid, from one pass over the orders."""
    fees, paid = F.when(F.col("o_orderdate") <= until, F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    sums = orders.groupBy("o_custkey").agg(total(fees).alias("fees"), total(paid).alias("paid"))
    joined = customer.select("c_custkey").join(sums, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", (F.coalesce("fees", F.lit(0.0)) - F.coalesce("paid", F.lit(0.0))).alias("balance"))


def rewards(customer: DataFrame, orders: DataFrame, start: Column, end: Column, spent: float, bought: int) -> DataFrame:
    good = orders.filter(F.col("o_orderdate").between(start, end)).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("o_orderkey").alias("n")).filter((F.col("s") > spent) & (F.col("n") > bought))
    return customer.join(good, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


def summary(customer: DataFrame, orders: DataFrame, least: int) -> DataFrame:
    """Customers with at least `least` orders, by aggregating before the join."""
    counts = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("post_count"), F.max("o_orderdate").alias("latest"))
    joined = customer.select("c_custkey").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("post_count", F.coalesce("post_count", F.lit(0).cast("long")))
    return joined.filter(F.col("post_count") >= least).select("c_custkey", "post_count", "latest")


def friends(df: DataFrame, key: str, name: str, offsets: Sequence[int]) -> DataFrame:
    """Rows whose key is another's plus an offset: the offsets are exploded into an equi-join."""
    wanted = df.select(key, F.explode(F.array(*[F.col(key) + o for o in offsets])).alias("_k"))
    return wanted.join(df.select(F.col(key).alias("_f"), name), F.col("_k") == F.col("_f")).select(key, name)


def not_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose value is in none of keys, as SQL's NOT IN: of any null among keys none, and a null only if there are no keys.

    An anti-join, beside which at most one row each tells whether there is a null and whether there is a key at all.
    """
    key = keys.columns[0]
    some, null = keys.limit(1).select(F.lit(True).alias("_some")), keys.filter(F.col(key).isNull()).limit(1).select(F.lit(True).alias("_null"))
    kept = df.join(F.broadcast(null), F.lit(True), "left_anti").join(keys.withColumnRenamed(key, "_key"), F.col(column) == F.col("_key"), "left_anti")
    return kept.filter(F.col(column).isNotNull()).unionByName(kept.filter(F.col(column).isNull()).join(F.broadcast(some), F.lit(True), "left_anti"))


def if_given(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with a value, all rows if none is given: the plan has no predicate then."""
    return df if value is None else df.filter(F.col(column) == value)


def version_key(column: str) -> Column:
    """What versions sort by: their numbers, one after the other."""
    return F.transform(F.split(column, r"\."), lambda x: x.cast("long"))


def by_setting(df: DataFrame, column: str, setting: str) -> DataFrame:
    """Rows whose column equals a setting of the session, none if it isn't set."""
    value = df.sparkSession.conf.get(setting, None)
    return df.filter(F.lit(False)) if value is None else df.filter(F.col(column) == value)

"""Registered queries of predicates, joins, orders, sets and functions, each with its SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators import relational
from tagloom.queries import query
from tagloom.sources.tables import columns_df, read

SQL: dict[str, str] = {}
TABLES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


def sql(text: str):
    """Registers a query together with its SQL."""

    def register(f):
        SQL[f.__name__.strip("_")] = text
        return query(f)

    return register


# Predicates


@sql("SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 5) NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def not_in_subquery(spark, d):
    customer, supplier = read(spark, d, "customer", "supplier")
    rows = customer.select("c_custkey", F.nullif("c_nationkey", F.lit(5)).alias("k"))
    return relational.not_in(rows, "k", supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))).select("c_custkey")


@sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) = ('R', 'F')")
def row_value_equality(spark, d):
    return read(spark, d, "lineitem")[0].filter(F.struct("l_returnflag", "l_linestatus") == F.struct(F.lit("R"), F.lit("F"))).select("l_orderkey", "l_linenumber")


@sql("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'BRASS') OR 'red' = ANY(string_split(p_name, ' '))")
def any_of_array(spark, d):
    return read(spark, d, "part")[0].filter(F.array_contains(F.split("p_type", " "), "BRASS") | F.array_contains(F.split("p_name", " "), "red")).select("p_partkey")


@sql("SELECT p_partkey, CASE WHEN (p_size & 1) <> 0 THEN 'BEFORE' ELSE 'AFTER' END AS timing, (p_size & 4) <> 0 AS is_insert FROM part WHERE (p_size & 6) <> 0")
def bit_tests(spark, d):
    bit = lambda k: F.col("p_size").bitwiseAND(k) != 0
    return read(spark, d, "part")[0].filter(bit(6)).select("p_partkey", F.when(bit(1), "BEFORE").otherwise("AFTER").alias("timing"), bit(4).alias("is_insert"))


@sql("SELECT 'all' AS asked, c_custkey FROM customer WHERE (NULL IS NULL OR c_mktsegment = NULL) UNION ALL SELECT 'one' AS asked, c_custkey FROM customer WHERE ('BUILDING' IS NULL OR c_mktsegment = 'BUILDING')")
def optional_parameter(spark, d):
    (customer,) = read(spark, d, "customer")
    parts = [relational.if_given(customer, "c_mktsegment", value).select(F.lit(asked).alias("asked"), "c_custkey") for asked, value in (("all", None), ("one", "BUILDING"))]
    return parts[0].unionByName(parts[1])


_TYPE = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END"
_NAMES = ", ".join(f"'{t}'" for t in TABLES)


@sql(f'SELECT table_name AS "table", ordinal_position AS ord, column_name AS "column", {_TYPE} AS type FROM information_schema.columns WHERE table_name IN ({_NAMES})')
def catalog_columns(spark, d):
    return columns_df(spark, dict(zip(TABLES, read(spark, d, *TABLES), strict=True))).select("table", "ord", "column", "type")


@sql(f'SELECT table_name AS "table", count(*) AS n_columns FROM information_schema.columns WHERE table_name IN ({_NAMES}) AND table_name NOT LIKE \'n%\' AND table_name NOT IN (\'part\') GROUP BY table_name')
def catalog_tables(spark, d):
    """Tables that no system filter takes out: by a pattern and by a list."""
    named = catalog_columns(spark, d).filter(~F.col("table").like("n%") & ~F.col("table").isin("part"))
    return named.groupBy("table").agg(F.count("*").alias("n_columns"))


# Joins


@sql("SELECT c_custkey, x.doubled, x.label FROM customer, LATERAL (SELECT c_acctbal * 2 AS doubled, lower(c_mktsegment) AS label) x")
def lateral_scalar(spark, d):
    return read(spark, d, "customer")[0].select("c_custkey", (F.col("c_acctbal") * 2).alias("doubled"), F.lower("c_mktsegment").alias("label"))


_LINES = range(1, 8)


@sql("WITH edges AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT o.o_orderkey, " + ", ".join(f"e{k}.l_partkey AS part{k}" for k in _LINES) + " FROM orders o " + " ".join(f"LEFT JOIN edges e{k} ON e{k}.l_orderkey = o.o_orderkey AND e{k}.l_linenumber = {k}" for k in _LINES))
def edge_fan_in(spark, d):
    """Left joins to one edge table, a kind of edge each: one aggregation of the edges by kind instead of a join for each."""
    orders, lineitem = read(spark, d, "orders", "lineitem")
    edges = lineitem.groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == k, F.col("l_partkey"))).alias(f"part{k}") for k in _LINES])
    return orders.join(edges, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", *[f"part{k}" for k in _LINES])


@sql("SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1)) AS k FROM nation")
def table_function_join(spark, d):
    return read(spark, d, "nation")[0].select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_regionkey").cast("long") + 1)).alias("k"))


# Aggregates


@sql("""SELECT n_regionkey, '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS nations FROM nation GROUP BY n_regionkey""")
def json_object_agg(spark, d):
    pairs = F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")))
    return read(spark, d, "nation")[0].groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(pairs)).alias("nations"))


@sql("SELECT 'orders' AS \"table\", max(o_orderkey) + 1 AS next_id FROM orders UNION ALL SELECT 'customer' AS \"table\", coalesce(max(c_custkey), 0) + 1 AS next_id FROM customer WHERE c_custkey < 0")
def next_ids(spark, d):
    """Where sequences go on: after the largest id, at 1 for an empty table."""
    orders, customer = read(spark, d, "orders", "customer")
    tables = {"orders": orders.select(F.col("o_orderkey").alias("id")), "customer": customer.filter("c_custkey < 0").select(F.col("c_custkey").alias("id"))}
    parts = [t.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id")).select(F.lit(n).alias("table"), "next_id") for n, t in tables.items()]
    return parts[0].unionByName(parts[1])


@sql("SELECT coalesce(sum(CAST(CASE WHEN o_orderstatus = 'X' THEN o_totalprice END AS DECIMAL(18,2))), 0)::DOUBLE AS none, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0)::DOUBLE AS every FROM orders")
def global_sums(spark, d):
    amount = lambda c: F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")
    return read(spark, d, "orders")[0].agg(amount(F.when(F.col("o_orderstatus") == "X", F.col("o_totalprice"))).alias("none"), amount(F.col("o_totalprice")).alias("every"))


@sql("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY o_custkey")
def appended_cells(spark, d):
    return read(spark, d, "orders")[0].groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ", ").alias("statuses"))


# Orders: a rank makes the order part of the result


@sql("SELECT n_nationkey, row_number() OVER (ORDER BY nullif(n_regionkey, 2) ASC NULLS LAST, n_name DESC) AS place FROM nation")
def order_by_keys(spark, d):
    by = Window.orderBy(F.nullif("n_regionkey", F.lit(2)).asc_nulls_last(), F.desc("n_name"))
    return read(spark, d, "nation")[0].select("n_nationkey", F.row_number().over(by).cast("long").alias("place"))


@sql("SELECT o_orderstatus, list_position(['P', 'O', 'F'], o_orderstatus) AS place, count(*) AS n FROM orders GROUP BY o_orderstatus")
def order_by_position(spark, d):
    counts = read(spark, d, "orders")[0].groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.select("o_orderstatus", F.array_position(F.array(*map(F.lit, "POF")), F.col("o_orderstatus")).cast("int").alias("place"), "n").orderBy("place")


@sql("SELECT w, row_number() OVER (ORDER BY CAST(w AS BLOB)) AS place FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS w FROM part)")
def order_by_binary(spark, d):
    words = read(spark, d, "part")[0].select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand")).alias("w")).distinct()
    return words.select("w", F.row_number().over(Window.orderBy(F.col("w").cast("binary"))).cast("long").alias("place"))


@sql("SELECT v, row_number() OVER (ORDER BY CAST(split_part(v, '.', 1) AS INT), CAST(split_part(v, '.', 2) AS INT), CAST(split_part(v, '.', 3) AS INT)) AS place FROM (SELECT DISTINCT concat(p_size % 12, '.', p_partkey % 15, '.', p_size % 3) AS v FROM part)")
def order_by_version(spark, d):
    """Versions by their numbers: 1.10 after 1.9."""
    versions = read(spark, d, "part")[0].select(F.concat_ws(".", F.col("p_size") % 12, F.col("p_partkey") % 15, F.col("p_size") % 3).alias("v")).distinct()
    return versions.select("v", F.row_number().over(Window.orderBy(relational.version_key("v"))).cast("long").alias("place"))


# Sets


@sql("SELECT 1 AS part, c_custkey FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT 2 AS part, NULL AS c_custkey UNION ALL SELECT 3 AS part, c_custkey FROM customer WHERE c_acctbal < -900")
def return_query(spark, d):
    """Rows returned in parts, one of them a null row."""
    (customer,) = read(spark, d, "customer")
    one = lambda k, cond: customer.filter(cond).select(F.lit(k).alias("part"), "c_custkey")
    return one(1, "c_acctbal > 9900").unionByName(spark.range(1).select(F.lit(2).alias("part"), F.lit(None).cast("long").alias("c_custkey"))).unionByName(one(3, "c_acctbal < -900"))


@sql("SELECT k, 'dropped' AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500) WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT k, 'added' AS side FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) WHERE k NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def set_differences(spark, d):
    customer, supplier = read(spark, d, "customer", "supplier")
    a = customer.filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).distinct()
    b = supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("dropped")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("added")))


# Functions


@sql("SELECT n_nationkey, n_name || nullif(n_name, 'FRANCE') AS strict_join, concat(n_name, nullif(n_name, 'FRANCE')) AS lenient_join, split_part(n_name, '_', 2) AS second, position('_' IN n_name) AS place, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS padded, replace(lower(n_name), 'n', '-') AS replaced FROM nation")
def string_functions(spark, d):
    other = F.nullif("n_name", F.lit("FRANCE"))
    named = [F.concat("n_name", other).alias("strict_join"), F.concat_ws("", "n_name", other).alias("lenient_join"), F.split_part("n_name", F.lit("_"), F.lit(2)).alias("second")]
    return read(spark, d, "nation")[0].select("n_nationkey", *named, F.locate("_", F.col("n_name")).cast("long").alias("place"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("padded"), F.replace(F.lower("n_name"), F.lit("n"), F.lit("-")).alias("replaced"))


@sql("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, CAST(CAST(o_orderdate - INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_before, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter FROM orders")
def date_functions(spark, d):
    day = F.col("o_orderdate")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    seconds = F.unix_timestamp(day.cast("timestamp")) if spark.conf.get("spark.sql.session.timeZone") == "UTC" else F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    return read(spark, d, "orders")[0].select("o_orderkey", F.year(day).cast("long").alias("y"), F.month(day).cast("long").alias("m"), text(F.last_day(day)).alias("month_end"), text(day - F.expr("INTERVAL 1 MONTH")).alias("month_before"), seconds.alias("seconds"), text(F.date_trunc("quarter", day)).alias("quarter"))


@sql("SELECT p_partkey, string_split(p_type, ' ')[1] AS first, CAST(len(string_split(p_type, ' ')) AS INT) AS n, coalesce(list_position(string_split(p_type, ' '), 'BRASS'), 0) AS place, array_to_string(list_sort(string_split(p_type, ' ')), '+') AS sorted FROM part")
def array_functions(spark, d):
    words = F.split("p_type", " ")
    return read(spark, d, "part")[0].select("p_partkey", words[0].alias("first"), F.size(words).alias("n"), F.array_position(words, "BRASS").cast("int").alias("place"), F.array_join(F.sort_array(words), "+").alias("sorted"))


@sql("SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INT) AS brand, TRY_CAST(p_name AS INT) AS bad, CAST(p_size AS VARCHAR) AS size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part")
def casts(spark, d):
    return read(spark, d, "part")[0].select("p_partkey", F.substring("p_brand", 7, 9).try_cast("int").alias("brand"), F.col("p_name").try_cast("int").alias("bad"), F.col("p_size").cast("string").alias("size"), F.col("p_retailprice").cast("decimal(18,2)").cast("double").alias("price"))


@sql("SELECT n_nationkey, n_nationkey + 2 AS with_default, n_nationkey + n_regionkey * 10 AS given, n_nationkey + nullif(n_regionkey, 1) AS strict, coalesce(nullif(n_regionkey, 1), -1) AS lenient FROM nation")
def scalar_functions(spark, d):
    """SQL scalar functions: a default, null in and null out, and called on null."""
    (nation,) = read(spark, d, "nation")
    own = uuid.uuid4().hex
    nation.createOrReplaceTempView(f"nation_{own}")
    spark.sql(f"CREATE TEMPORARY FUNCTION plus_{own}(a INT, b INT DEFAULT 2) RETURNS INT RETURN a + b")
    spark.sql(f"CREATE TEMPORARY FUNCTION known_{own}(a INT) RETURNS INT RETURN coalesce(a, -1)")
    return spark.sql(f"SELECT n_nationkey, plus_{own}(n_nationkey) AS with_default, plus_{own}(n_nationkey, n_regionkey * 10) AS given, plus_{own}(n_nationkey, nullif(n_regionkey, 1)) AS strict, known_{own}(nullif(n_regionkey, 1)) AS lenient FROM nation_{own}")


@sql("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def session_setting(spark, d):
    """A policy that compares with a setting of the session; without the setting nobody sees a row."""
    name = "spark.tagloom.segment"
    spark.conf.set(name, "BUILDING")
    seen: DataFrame = relational.by_setting(read(spark, d, "customer")[0], "c_mktsegment", name)
    spark.conf.unset(name)
    return seen.select("c_custkey")

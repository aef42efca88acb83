"""Registered queries of tags and of what is made from them, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.text import pascal, singular
from tagloom.operators import changes, guard
from tagloom.oracle import SQL as ORACLE
from tagloom.plans import parts
from tagloom.queries import KEY, ORDER, feed
from tagloom.relational_queries import _NAMES, _TYPE, TABLES, sql
from tagloom.schema_queries import _CHANGES, changes_of, schemas
from tagloom.sources.tables import columns_df, read

# Row changes


@sql("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version_id FROM events")
def version_ids(spark, d):
    (events,) = read(spark, d, "events")
    versions = changes.scd2(events.select("user_id", "event_id", "event_type", "ts"), KEY, ORDER)
    return changes.with_version_ids(versions, KEY, ["event_id"]).select("user_id", "event_id", F.col("version_id").cast("long").alias("version_id"))


@sql(ORACLE["history_delete"].replace("op IN ('UPDATE','DELETE')", "op = 'DELETE'"))
def history_on(spark, d):
    """History of deletes only."""
    return changes.history(feed(spark, d), KEY, ORDER, ["event_type"], "op", [changes.DELETE])


_STAMPS = """b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 5 <> 0),
a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"""


@sql(f"""WITH {_STAMPS} SELECT a.o_orderkey, a.o_orderstatus, a.o_totalprice, CASE WHEN b.o_orderkey IS NOT NULL AND b.o_orderstatus IS NOT DISTINCT FROM a.o_orderstatus AND b.o_totalprice IS NOT DISTINCT FROM a.o_totalprice
THEN b.updated_at ELSE TIMESTAMP '2030-01-01 00:00:00' END AS updated_at FROM a LEFT JOIN b USING (o_orderkey)""")
def last_updated(spark, d):
    """What a trigger that stamps written rows leaves: new and altered orders have the time of the write."""
    (orders,) = read(spark, d, "orders")
    before = orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("updated_at"))
    after = orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return changes.stamped(before, after, ["o_orderkey"], "updated_at", F.expr("timestamp_ntz'2030-01-01 00:00:00'"))


# Guards


@sql("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') = 'O' OR o_totalprice < 200000)")
def validate_check(spark, d):
    """Rows for which a check is false; those for which it is null pass."""
    return guard.violations(read(spark, d, "orders")[0], "nullif(o_orderstatus, 'P') = 'O' OR o_totalprice < 200000").select("o_orderkey")


@sql("SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'MACHINERY') = 'BUILDING' OR c_acctbal > 0, false)")
def rls_rejected_writes(spark, d):
    """Rows that no policy's check allows to be written; null allows nothing."""
    return guard.rejected(read(spark, d, "customer")[0], ["nullif(c_mktsegment, 'MACHINERY') = 'BUILDING'", "c_acctbal > 0"]).select("c_custkey")


@sql("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name FROM customer")
def audit_redact_mask(spark, d):
    return changes.redacted(read(spark, d, "customer")[0].select("c_custkey", "c_name"), "c_name", "mask")


@sql("SELECT c_custkey, sha256(c_name) AS c_name, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer")
def anon_hash_and_null(spark, d):
    customer = read(spark, d, "customer")[0].select("c_custkey", "c_name", "c_mktsegment")
    return guard.masked(guard.masked(customer, "c_name", "hash"), "c_mktsegment", "null")


# Schemas


_EXTERNAL = "SELECT DISTINCT p_brand AS name FROM part WHERE p_brand LIKE 'Brand#1%'"


@sql(f'WITH {_CHANGES}, x AS ({_EXTERNAL}) SELECT kind, name, change, "to" FROM changes WHERE owner IN (SELECT name FROM x)')
def external_violations(spark, d):
    """Changes of tables that belong to others: there should be none."""
    external = read(spark, d, "part")[0].filter("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("name"))
    return parts.external_changes(*schemas(spark, d), external).select("kind", "name", "change", "to")


@sql(f"WITH {_CHANGES}, x AS ({_EXTERNAL}) SELECT kind, owner, name, change FROM changes WHERE owner NOT IN (SELECT name FROM x) AND name NOT IN (SELECT name FROM x)")
def own_changes(spark, d):
    external = read(spark, d, "part")[0].filter("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("name"))
    return parts.without_external(changes_of(spark, d), external).select("kind", "owner", "name", "change")


_TAGS = """SELECT CASE WHEN p_size % 2 = 0 THEN 'docs' ELSE 'deprecated' END AS namespace,
CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'description' ELSE 'previously' END WHEN p_size % 3 = 0 THEN 'replace' WHEN p_size % 3 = 1 THEN 'remove' ELSE '' END AS tag,
CASE WHEN p_partkey % 5 = 0 THEN 'table' WHEN p_partkey % 5 = 1 THEN 'view' ELSE 'column' END AS kind, CASE WHEN p_partkey % 5 < 2 THEN '' ELSE p_brand END AS owner, concat('c', p_partkey) AS name,
CASE WHEN p_partkey % 11 <> 0 THEN concat('old', p_partkey) END AS arg FROM part"""


def _tags(spark, d):
    return spark.sql(_TAGS.replace("FROM part", "FROM {part}"), part=read(spark, d, "part")[0])


@sql(f"SELECT kind, owner, arg AS name, name AS \"to\" FROM ({_TAGS}) t WHERE namespace = 'docs' AND tag = 'previously' AND kind <> 'view' AND arg IS NOT NULL")
def previous_names(spark, d):
    return parts.previous_names(_tags(spark, d))


@sql(f"""SELECT kind, owner, name, CASE tag WHEN '' THEN 'DEPRECATED' WHEN 'replace' THEN 'DEPRECATED: use ' || arg || ' instead' ELSE 'DEPRECATED: scheduled for removal after ' || arg END AS message,
CASE tag WHEN '' THEN 'Deprecated' WHEN 'replace' THEN 'Deprecated → ' || arg ELSE 'Remove after ' || arg END AS status FROM ({_TAGS}) t WHERE namespace = 'deprecated' AND (tag = '' OR arg IS NOT NULL)""")
def deprecations(spark, d):
    return parts.deprecations(_tags(spark, d))


_LINKS = "SELECT 'x' || n_nationkey AS owner, 'x' || ((n_nationkey * n_nationkey + 3) % 25) AS target FROM nation"


@sql(f"WITH RECURSIVE e AS ({_LINKS}), r AS (SELECT owner, target FROM e WHERE owner <> target UNION SELECT r.owner, e.target FROM r JOIN e ON e.owner = r.target WHERE e.owner <> e.target) SELECT e.owner, e.target FROM e JOIN r ON r.owner = e.owner AND r.target = e.owner")
def fk_cycles(spark, d):
    """Foreign keys of tables on a cycle; from each table one leads on."""
    links = read(spark, d, "nation")[0].select(F.concat(F.lit("x"), "n_nationkey").alias("owner"), F.expr("concat('x', (n_nationkey * n_nationkey + 3) % 25)").alias("target"))
    return parts.cyclic(links)


@sql("SELECT c_mktsegment AS name, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS deps FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY c_mktsegment")
def object_dependencies(spark, d):
    customer, nation = read(spark, d, "customer", "nation")
    edges = customer.filter("c_acctbal > 9000").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_mktsegment").alias("name"), F.col("n_name").alias("needs"))
    return parts.dependencies(edges).select("name", F.array_join("deps", ",").alias("deps"))


# Keys of the given tables
PRIMARY = [("customer", "c_custkey"), ("nation", "n_nationkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")]
FOREIGN = [("customer", "c_nationkey", "nation"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"), ("nation", "n_regionkey", "region"), ("orders", "o_custkey", "customer"), ("supplier", "s_nationkey", "nation")]
_PASCAL = "array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_COLUMN = _PASCAL.format(c="column_name")
_VALUES = lambda rows: ", ".join(str(r) for r in rows)


@sql(f"""SELECT table_name AS "table", column_name AS "column", {_TYPE} AS type, {_COLUMN} AS pascal, lower({_COLUMN}[1]) || {_COLUMN}[2:] AS camel,
CASE WHEN table_name = 'orders' THEN 'Order' ELSE {_PASCAL.format(c="table_name")} END AS type_name, p.c IS NOT NULL AS is_primary, f.c IS NOT NULL AS is_foreign, f.target AS "references"
FROM information_schema.columns LEFT JOIN (VALUES {_VALUES(PRIMARY)}) p(t, c) ON p.t = table_name AND p.c = column_name
LEFT JOIN (VALUES {_VALUES(FOREIGN)}) f(t, c, target) ON f.t = table_name AND f.c = column_name WHERE table_name IN ({_NAMES})""")
def enriched_columns(spark, d):
    columns = columns_df(spark, dict(zip(TABLES, read(spark, d, *TABLES), strict=True))).select("table", "column", "type")
    primary, foreign = spark.createDataFrame(PRIMARY, "table string, column string"), spark.createDataFrame(FOREIGN, "table string, column string, target string")
    return parts.enriched(columns, primary, foreign)


@sql("""WITH w AS (SELECT DISTINCT s.w || e.w AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) s, (SELECT unnest(['s', 'es', 'ies', 'ss', 'xes', 'ches', '']) AS w) e)
SELECT w, CASE WHEN length(w) <= 2 OR regexp_matches(w, '(ss|us|is)$') THEN w WHEN suffix(w, 'ies') AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, -2) WHEN suffix(w, 's') THEN left(w, -1) ELSE w END AS one FROM w""")
def singular_names(spark, d):
    words = read(spark, d, "part")[0].select(F.explode(F.split("p_name", " ")).alias("stem")).distinct()
    ends = F.array(*map(F.lit, ["s", "es", "ies", "ss", "xes", "ches", ""]))
    w = words.select("stem", F.explode(ends).alias("end")).select(F.concat("stem", "end").alias("w")).distinct()
    return w.select("w", singular(F.col("w")).alias("one"))


@sql("SELECT s_suppkey, " + _PASCAL.format(c="lower(s_name || '_ab_' || s_suppkey)") + " AS pascal FROM supplier")
def pascal_names(spark, d):
    return read(spark, d, "supplier")[0].select("s_suppkey", pascal(F.lower(F.concat("s_name", F.lit("_ab_"), "s_suppkey"))).alias("pascal"))

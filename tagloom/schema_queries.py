"""Registered queries on schemas as rows, each with its SQL for DuckDB.

The schemas are made of the part table: a brand is a table, a part one of its columns, indexes, keys, checks or other
objects, and a part's type its definition. Before, every fifth part isn't there yet; after, every seventh is gone,
every eleventh is defined otherwise, and every thirteenth index, key or check has another name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.plans import parts, schema
from tagloom.relational_queries import sql
from tagloom.sources.tables import read

_KINDS = ["table", "column", "primary_key", "index", "foreign_key", "check", "view", "func", "policy", "trigger", "sequence", "proc"]
_SHAPED = ["primary_key", "index", "foreign_key", "check"]
_TOP = ["table", "view", "func", "sequence", "proc"]


def _list(kinds: list[str]) -> str:
    return ", ".join(f"'{k}'" for k in kinds)


def _both() -> tuple[str, str]:
    """SQL of the two schemas, for Spark and DuckDB alike."""
    kind = f"CASE p_partkey % {len(_KINDS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
    made = f"SELECT {kind} AS kind, p_partkey AS ord, p_brand, p_type FROM part"
    row = f"""SELECT kind, CASE WHEN kind IN ({_list(_TOP)}) THEN '' ELSE p_brand END AS owner, {{name}} AS name, {{body}} AS body,
        CASE WHEN kind IN ({_list(_SHAPED)}) THEN p_type END AS shape, ord % 2 = 0 AS system, ord FROM ({made}) m WHERE {{where}}"""
    name = "CASE WHEN kind = 'table' THEN concat('t', ord) ELSE concat('x', ord) END"
    other = f"CASE WHEN kind IN ({_list(_SHAPED)}) AND ord % 13 = 0 THEN concat('y', ord) ELSE {name} END"
    before = row.format(name=name, body="p_type", where="ord % 5 <> 0")
    return before, row.format(name=other, body="CASE WHEN ord % 11 = 0 THEN concat(p_type, ' NOT NULL') ELSE p_type END", where="ord % 7 <> 0")


_BEFORE, _AFTER = _both()
_CHANGES = f"""a AS ({_BEFORE}), b AS ({_AFTER}),
g AS (SELECT a.*, row_number() OVER (PARTITION BY a.kind, a.owner, a.shape ORDER BY a.name) AS r FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.kind = a.kind AND b.owner = a.owner AND b.name = a.name)),
n AS (SELECT b.*, row_number() OVER (PARTITION BY b.kind, b.owner, b.shape ORDER BY b.name) AS r FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.kind = a.kind AND b.owner = a.owner AND b.name = a.name)),
c AS (SELECT a.kind, a.owner, a.name, 'modify' AS verb, NULL AS "to", b.body FROM a JOIN b USING (kind, owner, name) WHERE a.body <> b.body
  UNION ALL SELECT coalesce(g.kind, n.kind) AS kind, coalesce(g.owner, n.owner) AS owner, coalesce(g.name, n.name) AS name,
    CASE WHEN n.name IS NULL THEN 'drop' WHEN g.name IS NULL THEN 'add' WHEN g.body <> n.body THEN 'modify' WHEN NOT (g.system AND n.system) THEN 'rename' END AS verb,
    CASE WHEN g.name IS NOT NULL THEN n.name END AS "to", coalesce(n.body, g.body) AS body
    FROM g FULL OUTER JOIN n ON g.kind = n.kind AND g.owner = n.owner AND g.shape = n.shape AND g.r = n.r),
changes AS (SELECT kind, owner, name, verb || '_' || kind AS change, "to", body FROM c WHERE verb IS NOT NULL)"""


def schemas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    (part,) = read(spark, d, "part")
    return tuple(spark.sql(text.replace("FROM part", "FROM {part}"), part=part) for text in (_BEFORE, _AFTER))


def changes_of(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    before, after = schemas(spark, d)
    return parts.part_changes(*(df.filter(F.col("kind").isin(list(kinds))) if kinds else df for df in (before, after)))


def _of(*kinds: str) -> str:
    return f'WITH {_CHANGES} SELECT owner, name, change, "to" FROM changes WHERE kind IN ({_list(list(kinds))})'


@sql(_of("column"))
def column_parts_diff(spark, d):
    return changes_of(spark, d, "column").select("owner", "name", "change", "to")


@sql(_of("primary_key"))
def pk_diff(spark, d):
    return changes_of(spark, d, "primary_key").select("owner", "name", "change", "to")


@sql(_of("index"))
def index_diff(spark, d):
    return changes_of(spark, d, "index").select("owner", "name", "change", "to")


@sql(_of("foreign_key"))
def fk_diff(spark, d):
    return changes_of(spark, d, "foreign_key").select("owner", "name", "change", "to")


@sql(_of("check"))
def check_diff(spark, d):
    return changes_of(spark, d, "check").select("owner", "name", "change", "to")


@sql(_of("table", "view", "func", "proc", "policy", "trigger", "sequence"))
def object_diff(spark, d):
    return changes_of(spark, d, "table", "view", "func", "proc", "policy", "trigger", "sequence").select("owner", "name", "change", "to")


@sql(f"WITH {_CHANGES} SELECT owner, name, change FROM changes WHERE change IN ('drop_table', 'drop_column')")
def destructive_changes(spark, d):
    return parts.destructive(changes_of(spark, d)).select("owner", "name", "change")


@sql(f"""WITH a AS ({_BEFORE}), b AS ({_AFTER}), a2 AS (SELECT *, row_number() OVER (PARTITION BY owner, body ORDER BY ord, name) AS r FROM a WHERE kind = 'column' AND name NOT IN (SELECT name FROM b WHERE kind = 'column')),
b2 AS (SELECT *, row_number() OVER (PARTITION BY owner, body ORDER BY ord, name) AS r FROM b WHERE kind = 'column' AND name NOT IN (SELECT name FROM a WHERE kind = 'column'))
SELECT a2.owner, a2.name, b2.name AS "to" FROM a2 JOIN b2 ON a2.owner = b2.owner AND a2.body = b2.body AND a2.r = b2.r""")
def rename_candidates(spark, d):
    before, after = schemas(spark, d)
    return parts.rename_candidates(*(df.filter("kind = 'column'") for df in (before, after)))


@sql(f"""WITH known AS (SELECT owner, name, 'z' || ord AS "to" FROM ({_BEFORE}) k WHERE kind = 'column' AND ord % 5 = 1)
SELECT owner, name, 'rename_column' AS change, "to" FROM known""")
def known_renames(spark, d):
    before, _ = schemas(spark, d)
    known = before.filter("kind = 'column' and ord % 5 = 1").select(*parts.KEY, F.concat(F.lit("z"), "ord").alias("to"))
    return parts.renamed(before, known)[1].select("owner", "name", "change", "to")


_PHASE = "CASE WHEN change LIKE 'rename_%' THEN 0 WHEN change LIKE 'drop_%' THEN {n} - list_position({k}, kind) ELSE {m} + list_position({k}, kind) END".format(n=1 + len(parts.KINDS), m=len(parts.KINDS), k="[" + _list(list(parts.KINDS)) + "]")


@sql(f"WITH {_CHANGES} SELECT change, CAST({_PHASE} AS INT) AS phase, count(*) AS n FROM changes GROUP BY ALL")
def change_order(spark, d):
    return changes_of(spark, d).withColumn("phase", parts.phase()).groupBy("change", "phase").agg(F.count("*").alias("n"))


@sql(f"""WITH {_CHANGES} SELECT change, CASE change WHEN 'add_column' THEN 'ALTER TABLE "' || owner || '" ADD COLUMN "' || name || '" ' || body
WHEN 'drop_column' THEN 'ALTER TABLE "' || owner || '" DROP COLUMN IF EXISTS "' || name || '" CASCADE' WHEN 'modify_column' THEN 'ALTER TABLE "' || owner || '" ALTER COLUMN "' || name || '" TYPE ' || body
WHEN 'rename_index' THEN 'ALTER INDEX "' || name || '" RENAME TO "' || "to" || '"' WHEN 'add_policy' THEN 'CREATE POLICY "' || name || '" ON "' || owner || '" ' || body
WHEN 'drop_view' THEN 'DROP VIEW IF EXISTS "' || name || '" CASCADE' WHEN 'modify_func' THEN 'CREATE OR REPLACE FUNCTION "' || name || '" ' || body
ELSE 'ALTER TABLE "' || owner || '" DROP CONSTRAINT "' || name || '"; ALTER TABLE "' || owner || '" ADD CONSTRAINT "' || coalesce("to", name) || '" ' || body END AS sql
FROM changes WHERE change IN ('add_column', 'drop_column', 'modify_column', 'rename_index', 'add_policy', 'drop_view', 'modify_func', 'modify_check', 'modify_foreign_key')""")
def change_statements(spark, d):
    wanted = ["add_column", "drop_column", "modify_column", "rename_index", "add_policy", "drop_view", "modify_func", "modify_check", "modify_foreign_key"]
    return parts.statements(changes_of(spark, d).filter(F.col("change").isin(wanted)), if_exists=True, cascade=True).select("change", "sql")


@sql(f"WITH {_CHANGES} SELECT owner, string_agg(change || ' ' || name, chr(10) ORDER BY {_PHASE}, change || ' ' || name) AS changes FROM changes GROUP BY owner")
def changes_by_table(spark, d):
    return parts.grouped(changes_of(spark, d))


@sql("SELECT n_name AS owner, 'fk' || n_nationkey AS name, 'REGION' || (n_regionkey * 2) AS target, n_regionkey * 2 < (SELECT count(*) FROM region) AS found FROM nation")
def fk_links(spark, d):
    nation, region = read(spark, d, "nation", "region")
    tables = region.select(F.lit("table").alias("kind"), F.concat(F.lit("REGION"), "r_regionkey").alias("name"))
    keys = nation.select(F.col("n_name").alias("owner"), F.concat(F.lit("fk"), "n_nationkey").alias("name"), F.concat(F.lit("REGION"), F.col("n_regionkey") * 2).alias("target"))
    return parts.linked(tables, keys)


@sql("""SELECT t.tag, o.r_name AS "schema", o.n_name AS name FROM (SELECT s.s_name AS tag, CASE WHEN s_suppkey % 3 = 0 THEN n.n_name WHEN s_suppkey % 3 = 1 THEN r.r_name || '.' || n.n_name ELSE 'x.' || n.n_name END AS target
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey) t
JOIN (SELECT r.r_name, n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey) o ON t.target = o.n_name OR t.target = o.r_name || '.' || o.n_name""")
def tag_match(spark, d):
    supplier, nation, region = read(spark, d, "supplier", "nation", "region")
    objects = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("schema"), F.col("n_name").alias("name"))
    target = F.expr("CASE s_suppkey % 3 WHEN 0 THEN name WHEN 1 THEN schema || '.' || name ELSE 'x.' || name END")
    tags = supplier.join(objects, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("tag"), target.alias("target"))
    return parts.matched(tags, objects)


@sql("""SELECT 'rls.require' AS rule, c_name AS "table", 'warn' AS severity, c_mktsegment = 'BUILDING' AS skipped FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def lint_report(spark, d):
    """Tables without a tag; those of one segment are excused with a reason, those of another with a blank one."""
    customer, orders = read(spark, d, "customer", "orders")
    tagged = orders.filter("o_orderstatus = 'O'").select("o_custkey").distinct().join(customer, F.col("o_custkey") == F.col("c_custkey"))
    tags = tagged.select(F.col("c_name").alias("table"), F.lit("rls").alias("namespace"))
    reasons = customer.select(F.lit("rls.require").alias("rule"), F.col("c_name").alias("table"), F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'public' WHEN 'MACHINERY' THEN ' ' END").alias("reason")).filter("reason is not null")
    return schema.lint(customer.select(F.col("c_name").alias("table")), tags, {"rls": "warn"}, reasons)


@sql("SELECT n.n_name AS name, concat_ws(chr(10), CASE WHEN n.n_nationkey % 2 = 0 THEN 'nation ' || n.n_nationkey END, (SELECT string_agg('@tag ' || s.s_name, chr(10) ORDER BY s.s_name) FROM supplier s WHERE s.s_nationkey = n.n_nationkey)) AS comment FROM nation n WHERE n.n_nationkey % 2 = 0 OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey)")
def merged_comments(spark, d):
    nation, supplier = read(spark, d, "nation", "supplier")
    written = nation.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("nation "), "n_nationkey")).alias("comment"))
    made = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.concat(F.lit("@tag "), "s_name").alias("comment"))
    return parts.merged_comments(written, made)

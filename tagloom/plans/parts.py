"""Schemas as rows, a part each, and what leads from one to another: changes, renames, their order and their SQL.

A part is (kind, owner, name, body, shape, system): owner is the table of a table's part and '' else, body is its
definition, shape what it is made of where its name may have been made up by a database, which `system` says.
Catalogs are DataFrames, so thousands of schemas are compared in the same few joins as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import camel, pascal, singular_last

#: Kinds of parts in the order in which they are made; they are dropped in the other one (fixed values).
KINDS = ("schema", "object", "sequence", "table", "column", "primary_key", "index", "foreign_key", "check", "attr", "view", "func", "proc", "policy", "trigger")
PART = "kind string, owner string, name string, body string, shape string, system boolean"
KEY = ["kind", "owner", "name"]
DESTRUCTIVE = ("drop_schema", "drop_table", "drop_column")


def part_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, owner, name, change, to, body) by two full outer joins: by name, then of what is left by shape.

    change is add_, drop_, modify_ or rename_ and the kind, to the new name where it differs. Of parts of one shape the
    first by name goes with the first. A name changed from one made-up name to another is no change. Parts of tables
    that are added or dropped as a whole aren't listed.
    """
    a, b = (df.select(*KEY, F.struct("body", "shape", "system").alias(k)) for df, k in ((before, "a"), (after, "b")))
    joined = a.join(b, KEY, "full_outer")
    modified = joined.filter("a is not null and b is not null and not (a.body <=> b.body)").select(*KEY, F.lit("modify").alias("verb"), F.lit(None).cast("string").alias("to"), "b.body")
    by_shape = Window.partitionBy("kind", "owner", "shape").orderBy("name")
    gone, new = (joined.filter(f"{other} is null").select("kind", "owner", "name", f"{own}.*").withColumn("r", F.row_number().over(by_shape)) for own, other in (("a", "b"), ("b", "a")))
    same = ["kind", "owner", "shape", "r"]
    left = gone.select(*same, F.struct("name", "body", "system").alias("a")).join(new.select(*same, F.struct("name", "body", "system").alias("b")), same, "full_outer")
    verb = F.expr("CASE WHEN b is null THEN 'drop' WHEN a is null THEN 'add' WHEN not (a.body <=> b.body) THEN 'modify' WHEN not (a.system and b.system) THEN 'rename' END")
    others = left.select("kind", "owner", F.coalesce("a.name", "b.name").alias("name"), verb.alias("verb"), F.expr("if(a is not null, b.name, null)").alias("to"), F.coalesce("b.body", "a.body").alias("body")).filter("verb is not null")
    changes = modified.unionByName(others).withColumn("change", F.concat_ws("_", "verb", "kind"))
    whole = changes.filter("change in ('add_table', 'drop_table')").select(F.col("name").alias("owner"))
    return changes.join(whole, "owner", "left_anti").select(*KEY, "change", "to", "body")


def renamed(before: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """before under the names of `known` (kind, owner, name, to), and these renames as changes: they come first."""
    joined = before.join(known.select(*KEY, "to"), KEY, "left")
    changes = joined.filter("to is not null").select(*KEY, F.concat(F.lit("rename_"), "kind").alias("change"), "to", "body")
    return joined.select("kind", "owner", F.coalesce("to", "name").alias("name"), *[c for c in before.columns if c not in KEY]), changes


def rename_candidates(before: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, name, to): each dropped column with the first unused added one of its table and body, in the order of ord.

    Within a table and a body the n-th dropped goes with the n-th added, so one join by that number does it. A table is
    one only if exactly one went and one came. before and after have ord besides what parts have.
    """
    gone, new = before.join(after.select(*KEY), KEY, "left_anti"), after.join(before.select(*KEY), KEY, "left_anti")
    nth = Window.partitionBy("owner", "body").orderBy("ord", "name")
    a, b = (df.filter("kind = 'column'").select("owner", "name", "body", F.row_number().over(nth).alias("r")) for df in (gone, new))
    columns = a.join(b.withColumnRenamed("name", "to"), ["owner", "body", "r"]).select("owner", "name", "to")
    a, b = (df.filter("kind = 'table'").groupBy("owner").agg(F.min("name").alias("name"), F.count("*").alias("n")).filter("n = 1").drop("n") for df in (gone, new))
    return columns.unionByName(a.join(b.withColumnRenamed("name", "to"), "owner").select("owner", "name", "to"))


def destructive(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin(list(DESTRUCTIVE)))


def without_external(changes: DataFrame, external: DataFrame) -> DataFrame:
    """Changes of what isn't in external (name): such tables and their parts belong to others."""
    names = external.select("name").distinct()
    return changes.join(names, "name", "left_anti").join(names.toDF("owner"), "owner", "left_anti")


def external_changes(before: DataFrame, after: DataFrame, external: DataFrame) -> DataFrame:
    """What would change of external tables: must be empty."""
    names = external.select(F.col("name").alias("owner")).distinct()
    return part_changes(before.join(names, "owner", "left_semi"), after.join(names, "owner", "left_semi"))


def phase() -> Column:
    """A change's place in the order: renames, then what is dropped from the last kind to the first, then what is added or altered."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return F.when(F.col("change").startswith("rename_"), 0).when(F.col("change").startswith("drop_"), 1 + len(KINDS) - place).otherwise(len(KINDS) + place)


def _made() -> dict[str, str]:
    """A statement for each change, with {t} the owner, {n} the name, {to} the new one, {b} the body."""
    out = {}
    for kind, word in {"schema": "SCHEMA", "object": "TYPE", "sequence": "SEQUENCE", "table": "TABLE", "view": "VIEW", "func": "FUNCTION", "proc": "PROCEDURE"}.items():
        out |= {f"add_{kind}": f"CREATE {word} {{not}}{{n}} {{b}}", f"drop_{kind}": f"DROP {word} {{if}}{{n}}{{cascade}}", f"rename_{kind}": f"ALTER {word} {{n}} RENAME TO {{to}}"}
        out[f"modify_{kind}"] = f"CREATE OR REPLACE {word} {{n}} {{b}}" if kind in ("view", "func", "proc") else f"ALTER {word} {{n}} {{b}}"
    for kind in ("primary_key", "foreign_key", "check"):
        out |= {f"add_{kind}": "ALTER TABLE {t} ADD CONSTRAINT {n} {b}", f"drop_{kind}": "ALTER TABLE {t} DROP CONSTRAINT {if}{n}{cascade}", f"rename_{kind}": "ALTER TABLE {t} RENAME CONSTRAINT {n} TO {to}"}
        out[f"modify_{kind}"] = "ALTER TABLE {t} DROP CONSTRAINT {n}; ALTER TABLE {t} ADD CONSTRAINT {new} {b}"
    for kind, word in {"policy": "POLICY", "trigger": "TRIGGER"}.items():
        out |= {f"add_{kind}": f"CREATE {word} {{n}} ON {{t}} {{b}}", f"drop_{kind}": f"DROP {word} {{if}}{{n}} ON {{t}}{{cascade}}", f"rename_{kind}": f"ALTER {word} {{n}} ON {{t}} RENAME TO {{to}}", f"modify_{kind}": f"DROP {word} {{n}} ON {{t}}; CREATE {word} {{new}} ON {{t}} {{b}}"}
    out |= {"add_index": "CREATE INDEX {not}{n} ON {t} {b}", "drop_index": "DROP INDEX {if}{n}{cascade}", "modify_index": "DROP INDEX {n}; CREATE INDEX {new} ON {t} {b}", "rename_index": "ALTER INDEX {n} RENAME TO {to}"}
    out |= {"add_column": "ALTER TABLE {t} ADD COLUMN {not}{n} {b}", "drop_column": "ALTER TABLE {t} DROP COLUMN {if}{n}{cascade}", "modify_column": "ALTER TABLE {t} ALTER COLUMN {n} TYPE {b}", "rename_column": "ALTER TABLE {t} RENAME COLUMN {n} TO {to}"}
    return out | {"add_attr": "ALTER TABLE {t} SET ({n} = {b})", "drop_attr": "ALTER TABLE {t} RESET ({n})", "modify_attr": "ALTER TABLE {t} SET ({n} = {b})"}


def statements(changes: DataFrame, if_exists: bool = False, if_not_exists: bool = False, cascade: bool = False) -> DataFrame:
    """changes with phase and sql: several statements are parted by semicolons; a change without one raises."""
    made = F.try_element_at(F.create_map(*[F.lit(x) for pair in _made().items() for x in pair]), F.col("change"))
    made = F.when(made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit("no statement for "), F.coalesce("change", F.lit("null")))))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    fills = {"{if}": F.lit("IF EXISTS " if if_exists else ""), "{not}": F.lit("IF NOT EXISTS " if if_not_exists else ""), "{cascade}": F.lit(" CASCADE" if cascade else "")}
    fills |= {"{t}": quoted(F.col("owner")), "{n}": quoted(F.col("name")), "{to}": quoted(F.col("to")), "{new}": quoted(F.coalesce("to", "name")), "{b}": F.coalesce("body", F.lit(""))}
    for mark, value in fills.items():
        made = F.replace(made, F.lit(mark), value)
    return changes.withColumn("phase", phase()).withColumn("sql", F.rtrim(made))


def grouped(changes: DataFrame) -> DataFrame:
    """(owner, changes): each table's changes in their order, as lines of one text."""
    line = F.struct(phase().alias("phase"), F.concat_ws(" ", "change", "name").alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda s: s["line"])
    return changes.groupBy("owner").agg(F.array_join(lines, "\n").alias("changes"))


def linked(parts: DataFrame, keys: DataFrame) -> DataFrame:
    """Foreign keys (owner, name, target) with found, whether their table is among parts."""
    tables = parts.filter("kind = 'table'").select(F.col("name").alias("target"), F.lit(True).alias("found")).distinct()
    return keys.join(tables, "target", "left").select("owner", "name", "target", F.coalesce("found", F.lit(False)).alias("found"))


def matched(tags: DataFrame, objects: DataFrame) -> DataFrame:
    """tags (tag, target) with the object (schema, name) that each means: targets are names, or schema and name with a dot."""
    keys = objects.select("schema", "name", F.explode(F.array(F.col("name"), F.concat_ws(".", "schema", "name"))).alias("target"))
    return tags.join(keys, "target").select("tag", "schema", "name")


def merged_comments(written: DataFrame, made: DataFrame) -> DataFrame:
    """(name, comment): what is written of each object, then what tags make of it in order, a line each."""
    lines = written.select("name", F.lit(0).alias("k"), "comment").unionByName(made.select("name", F.lit(1).alias("k"), "comment")).filter("comment is not null")
    return lines.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "comment"))), lambda s: s["comment"]), "\n").alias("comment"))


def previous_names(tags: DataFrame) -> DataFrame:
    """Known renames (kind, owner, name, to) from tags (namespace, tag, kind, owner, name, arg) that tell a table's or a column's name before."""
    told = tags.filter("namespace = 'docs' and tag = 'previously' and kind in ('table', 'column') and arg is not null")
    return told.select("kind", "owner", F.col("arg").alias("name"), F.col("name").alias("to"))


def deprecations(tags: DataFrame) -> DataFrame:
    """(kind, owner, name, message, status) of what tags of the namespace deprecated say; a tag of another name says nothing."""
    message = "CASE tag WHEN '' THEN 'DEPRECATED' WHEN 'replace' THEN concat('DEPRECATED: use ', arg, ' instead') WHEN 'remove' THEN concat('DEPRECATED: scheduled for removal after ', arg) END"
    status = "CASE tag WHEN '' THEN 'Deprecated' WHEN 'replace' THEN concat('Deprecated \u2192 ', arg) WHEN 'remove' THEN concat('Remove after ', arg) END"
    return tags.filter("namespace = 'deprecated'").select(*KEY, F.expr(message).alias("message"), F.expr(status).alias("status")).filter("message is not null")


def cyclic(keys: DataFrame) -> DataFrame:
    """Foreign keys (owner, target, ...) on a cycle of tables or on a way between two: they are added when all tables are there.

    Keys from tables that nothing points to, or to tables that point to nothing, are peeled off until none is left. A
    table's key to itself needs no other table, so it is none of these. Each round is a job on a catalog, not on data.
    """
    left = keys.filter("owner <> target")
    n = left.count()
    while n:
        sources, targets = left.select(F.col("owner").alias("target")).distinct(), left.select(F.col("target").alias("owner")).distinct()
        left = left.join(sources, "target", "left_semi").join(targets, "owner", "left_semi").select(*keys.columns)
        before, n = n, left.count()
        if n == before:
            break
    return left


def dependencies(edges: DataFrame) -> DataFrame:
    """(name, deps): what each object needs directly, each once, in order; itself left out."""
    return edges.filter("name <> needs").groupBy("name").agg(F.sort_array(F.collect_set("needs")).alias("deps"))


def enriched(columns: DataFrame, primary: DataFrame, foreign: DataFrame) -> DataFrame:
    """columns (table, column, ...) with the names that code is written with, whether they are keys, and the table a foreign key leads to.

    primary is (table, column), foreign (table, column, target); a column with several foreign keys has the first target by name.
    """
    pk = primary.select("table", "column", F.lit(True).alias("_pk")).distinct()
    fk = foreign.groupBy("table", "column").agg(F.min("target").alias("references"))
    joined = columns.join(pk, ["table", "column"], "left").join(fk, ["table", "column"], "left")
    named = joined.withColumn("pascal", pascal(F.col("column"))).withColumn("camel", camel(F.col("column"))).withColumn("type_name", pascal(singular_last(F.col("table"))))
    return named.withColumn("is_primary", F.coalesce("_pk", F.lit(False))).withColumn("is_foreign", F.col("references").isNotNull()).drop("_pk")

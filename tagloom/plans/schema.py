"""Schema differences as DataFrames, renames, order of changes, and rewriting a table to a new schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Changes that lose data.
DESTRUCTIVE = ("drop_schema", "drop_table", "drop_column")


def diff(before: DataFrame, after: DataFrame, key: str = "c", value: str = "t", kind: str = "column") -> DataFrame:
    """(key, change) by a full outer join: drop_, add_ or modify_ of the kind; equal rows give none."""
    a, b = before.select(F.col(key), F.col(value).alias("_a")), after.select(F.col(key), F.col(value).alias("_b"))
    joined = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_in_b").isNull(), f"drop_{kind}").when(F.col("_in_a").isNull(), f"add_{kind}").when(~F.col("_a").eqNullSafe(F.col("_b")), f"modify_{kind}")
    return joined.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def table_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of tables and of the columns of tables on both sides, from two columns_df()."""
    tables = diff(before.select("table").distinct().withColumn("t", F.lit(1)), after.select("table").distinct().withColumn("t", F.lit(1)), "table", "t", "table").withColumn("column", F.lit(None).cast("string"))
    both = before.select("table").intersect(after.select("table"))
    name = F.struct("table", "column").alias("c")
    columns = diff(before.join(both, "table", "left_semi").select(name, F.struct("type", "nullable").alias("t")), after.join(both, "table", "left_semi").select(name, F.struct("type", "nullable").alias("t")))
    return tables.unionByName(columns.select(F.col("c.table").alias("table"), "change", F.col("c.column").alias("column")))


def destructive(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin(list(DESTRUCTIVE)))


def renames(dropped: Iterable[tuple[str, str]], added: Iterable[tuple[str, str]], known: Mapping[str, str] | None = None) -> list[tuple[str, str]]:
    """Likely renames of (name, type): known ones, then each dropped column with the first unused added one of its type."""
    known = dict(known or {})
    left = {n: t for n, t in added if n not in known.values()}
    out = list(known.items())
    for name, kind in dropped:
        if name not in known and (match := next((n for n, t in left.items() if t == kind), None)):
            out.append((name, match))
            del left[match]
    return out


def levels(needs: Mapping[str, Iterable[str]]) -> dict[str, int]:
    """How far each object is from those that need nothing; objects of a cycle raise."""
    out: dict[str, int] = {}

    def level(name: str, on: tuple[str, ...]) -> int:
        if name in on:
            raise ValueError("a cycle: " + " -> ".join((*on[on.index(name) :], name)))
        if name not in out:
            out[name] = max((level(n, (*on, name)) + 1 for n in needs.get(name, ())), default=0)
        return out[name]

    for name in [*needs, *(n for ns in needs.values() for n in ns)]:
        level(name, ())
    return out


def ordered(changes: Iterable[tuple[str, str]], needs: Mapping[str, Iterable[str]]) -> list[tuple[str, str]]:
    """(change, object) so that what is needed is created first and dropped last."""
    depth = levels(needs)

    def rank(change: tuple[str, str]) -> tuple:
        drop = change[0].startswith("drop_")
        d = depth.get(change[1], 0)
        return (drop, -d if drop else d)

    return sorted(changes, key=rank)


def detached(needs: Mapping[str, Iterable[str]]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """The dependencies without those that close a cycle, and these: they are added when all objects are there."""
    kept: dict[str, list[str]] = {k: [] for k in needs}
    late = []

    def reaches(a: str, b: str, seen: set[str]) -> bool:
        return a == b or any(reaches(n, b, seen) for n in kept.get(a, ()) if not (n in seen or seen.add(n)))

    for child, parents in needs.items():
        for parent in parents:
            if reaches(parent, child, set()):
                late.append((child, parent))
            else:
                kept[child].append(parent)
    return kept, late


def evolved(df: DataFrame, columns: Mapping[str, Column], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """df rewritten to new columns, nulls of those with a default filled: what a table is replaced by where it can't be altered."""
    defaults = defaults or {}
    return df.select(*[(F.coalesce(c, F.lit(defaults[n])) if n in defaults else c).alias(n) for n, c in columns.items()])


def ddl(change: str, table: str, column: str | None = None, kind: str | None = None) -> str:
    """Spark SQL for a change that Spark can make in place; others raise, and evolved() rewrites the table."""
    t = "`" + table.replace("`", "``") + "`"
    made = {
        "add_column": f"ALTER TABLE {t} ADD COLUMNS (`{column}` {kind})", "drop_table": f"DROP TABLE {t}", "add_schema": f"CREATE DATABASE {t}", "drop_schema": f"DROP DATABASE {t}",
        "add_table": f"CREATE TABLE {t} (`{column}` {kind}) USING parquet", "rename_table": f"ALTER TABLE {t} RENAME TO `{column}`", "drop_view": f"DROP VIEW {t}", "drop_func": f"DROP FUNCTION {t}",
    }
    if change not in made:
        raise ValueError(f"{change} of {table} can't be made in place; rewrite the table")
    return made[change]


def excluded(df: DataFrame, column: str, patterns: Iterable[str]) -> DataFrame:
    """Rows whose name matches no glob (* any characters, ? one): all without a glob, and those without a name."""
    patterns = list(patterns)
    return df.filter(~F.coalesce(F.col(column).rlike("|".join(map(glob_regex, patterns))), F.lit(False))) if patterns else df


def glob_regex(glob: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in r".^$+()[]{}|\#" else c for c in glob) + "$"


def lint(objects: DataFrame, tags: DataFrame, required: Mapping[str, str], ignores: DataFrame | None = None) -> DataFrame:
    """(rule, table, severity, skipped): tables without a required namespace's tag; an ignore with a reason skips."""
    out = None
    for namespace, severity in required.items():
        missing = objects.select("table").distinct().join(tags.filter(F.col("namespace") == namespace).select("table"), "table", "left_anti")
        part = missing.select(F.lit(f"{namespace}.require").alias("rule"), "table", F.lit(severity).alias("severity"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = objects.select(F.lit("").alias("rule"), "table", F.lit("").alias("severity")).limit(0)
    if ignores is None:
        return out.withColumn("skipped", F.lit(False))
    reasons = ignores.filter(F.length(F.trim("reason")) > 0).select("rule", "table").distinct().withColumn("_i", F.lit(True))
    return out.join(reasons, ["rule", "table"], "left").withColumn("skipped", F.coalesce("_i", F.lit(False))).drop("_i")

"""Soft deletion, row-level security, masking, validation and integrity: filters, joins and column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.registry import Context, TagSpec, namespace


def active(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.filter(F.col(column).isNull())


def cascade(child: DataFrame, parent: DataFrame, foreign: str, primary: str, column: str = "deleted_at") -> DataFrame:
    """child with its parent's time of deletion where the parent is deleted, else its own; a restored parent restores nothing."""
    gone = parent.filter(F.col(column).isNotNull()).select(F.col(primary).alias("_pk"), F.col(column).alias("_gone"))
    joined = child.join(gone, F.col(foreign) == F.col("_pk"), "left")
    own = F.col(column) if column in child.columns else F.lit(None)
    return joined.withColumn(column, F.coalesce("_gone", own)).drop("_pk", "_gone")


def secured(df: DataFrame, policies: Sequence[tuple[str, Column | str]], role: str | None = None, bypass: Sequence[str] = ()) -> DataFrame:
    """The rows a role may see: those that any policy for it or for PUBLIC allows, and none without a policy."""
    if role in bypass:
        return df
    using = [F.expr(u) if isinstance(u, str) else u for who, u in policies if who in ("PUBLIC", role)]
    return df.filter(reduce(lambda a, b: a | b, using) if using else F.lit(False))


def rejected(df: DataFrame, checks: Sequence[Column | str]) -> DataFrame:
    """Rows that no policy's check allows to be written."""
    passed = [F.expr(c) if isinstance(c, str) else c for c in checks]
    return df.filter(~F.coalesce(reduce(lambda a, b: a | b, passed), F.lit(False))) if passed else df


def partial(column: str, left: int, pad: str, right: int) -> Column:
    """The first and last characters, and pad between them."""
    return F.concat(F.left(F.col(column), F.lit(left)), F.lit(pad), F.right(F.col(column), F.lit(right)))


def masked(df: DataFrame, column: str, how: str, *args) -> DataFrame:
    """A column under a masking function: partial(n, pad, m), hash, null, or fake (one of a fixed number of names, by a seeded hash)."""
    made = {
        "partial": lambda: partial(column, *args),
        "hash": lambda: F.sha2(F.col(column).cast("string"), 256),
        "null": lambda: F.lit(None).cast(df.schema[column].dataType),
        "fake": lambda: F.concat(F.lit(args[0] if args else "name"), F.lit("_"), F.pmod(F.xxhash64(F.lit(42), column), F.lit(1_000_000)).cast("string")),
    }
    if how not in made:
        raise ValueError(f"no such masking function: {how}")
    return df.withColumn(column, made[how]())


def violations(df: DataFrame, check: Column | str) -> DataFrame:
    """Rows for which a check is false; null passes, as in SQL."""
    return df.filter(~(F.expr(check) if isinstance(check, str) else check))


def not_empty(column: Column | str) -> Column:
    return F.length(F.trim(column)) > 0


def in_range(column: str, least=None, most=None) -> Column:
    return _bounded(F.col(column), least, most)


def has_length(column: str, least=None, most=None) -> Column:
    return _bounded(F.length(column), least, most)


def matches(column: str, pattern: str) -> Column:
    """Unanchored, in Java's dialect."""
    return F.col(column).rlike(pattern)


def _bounded(value: Column, least, most) -> Column:
    bounds = [value >= least] * (least is not None) + [value <= most] * (most is not None)
    if not bounds:
        raise ValueError("a bound is needed")
    return reduce(lambda a, b: a & b, bounds)


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of all rules, from one pass over the rows."""
    counts = df.agg(*[F.count_if(~check).alias(name) for name, check in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])).alias("r")).select("r.rule", "r.violations")


def duplicates(df: DataFrame, key: Sequence[str], where: Column | str | None = None, primary: bool = False) -> DataFrame:
    """Keys that more than one row has, of the rows where a partial index holds; nulls are equal in a primary key only."""
    rows = df.filter(where) if where is not None else df
    rows = rows if primary else rows.dropna(subset=list(key))
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, primary: str) -> DataFrame:
    """Rows of child whose foreign key isn't null and has no parent."""
    return child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias("_pk")), F.col(foreign) == F.col("_pk"), "left_anti")


def nulls(df: DataFrame, column: str | Column) -> DataFrame:
    return df.agg(F.count_if((F.col(column) if isinstance(column, str) else column).isNull()).alias("violations"))


@namespace("softdelete", {"": TagSpec(("table",), 0, 2)})
def _softdelete(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    column = str(context.tags.of("softdelete")[0].options.get("column", "deleted_at"))
    kept = df if column in df.columns else df.withColumn(column, F.lit(None).cast("timestamp"))
    return {"active": active(kept, column)}


@namespace("rls", {"": TagSpec(("table",), 0, 0), "policy": TagSpec(("table",), 0, 4)})
def _rls(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    policies = []
    for t in context.tags.of("rls", "policy"):
        given = dict(zip(("for", "to", "using", "check"), t.args, strict=False)) | t.options
        if str(given.get("for", "ALL")).upper() in ("ALL", "SELECT"):
            policies.append((str(given.get("to", "PUBLIC")), str(given.get("using", "true")).lower() if given.get("using") in (True, False, None) else str(given["using"])))
    return {"secured": secured(df, policies, context.role, context.options.get("bypass", ()))}


@namespace("anon", {"mask": TagSpec(("column",), 1, 4), "fake": TagSpec(("column",), 0, 4)})
def _anon(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    for t in context.tags.of("anon"):
        df = masked(df, t.column, "fake" if t.name == "fake" else str(t.args[0]), *(t.args if t.name == "fake" else t.args[1:]))
    return {"masked": df}


@namespace("validate", {"check": TagSpec(("column", "table"), 1, 1), "notEmpty": TagSpec(("column",), 0, 0), "range": TagSpec(("column",), 1, 2), "length": TagSpec(("column",), 1, 2), "pattern": TagSpec(("column",), 1, 1)})
def _validate(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    rules: dict[str, Column] = {}
    for t in context.tags.of("validate"):
        least, most = (t.options.get(k, t.args[i] if len(t.args) > i else None) for i, k in enumerate(("min", "max")))
        made = {"check": lambda t=t: F.expr(str(t.args[0])), "notEmpty": lambda t=t: not_empty(t.column), "range": lambda t=t, a=least, b=most: in_range(t.column, a, b), "length": lambda t=t, a=least, b=most: has_length(t.column, a, b), "pattern": lambda t=t: matches(t.column, str(t.args[0]))}
        rules[f"{t.column or context.table}_{t.name}"] = made[t.name]()
    passed = reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in rules.values()], F.lit(True))
    return {"accepted": df.filter(passed), "rejects": df.filter(~passed), "report": report(df, rules)} if rules else {}

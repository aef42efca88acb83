"""Row changes: versions, history and audit from one keyed feed.

A feed has a row per change: key columns, payload, a time and a tie-break. All three operators order each key's
changes by (time, tie-break) over the same partitioning, so one shuffle by key serves them all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tagloom.registry import Context, TagSpec, namespace

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


def by_key(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def with_operation(feed: DataFrame, key: Sequence[str], order: Sequence[str], is_delete: Column | None = None) -> DataFrame:
    """feed with `op`: a key's first change inserts, its last deletes where is_delete holds, the rest update."""
    w = by_key(key, order)
    last = F.lead(F.lit(1)).over(w).isNull()
    delete = F.lit(False) if is_delete is None else last & is_delete
    return feed.withColumn("op", F.when(F.lag(F.lit(1)).over(w).isNull(), INSERT).when(delete, DELETE).otherwise(UPDATE))


def scd2(feed: DataFrame, key: Sequence[str], order: Sequence[str], op: str | None = None) -> DataFrame:
    """A version per change: valid from its time to the next change of its key, null while current.

    With `op`, a delete ends the version before it and starts none. Changes that change nothing start versions too.
    """
    out = feed.withColumn("valid_from", F.col(order[0])).withColumn("valid_to", F.lead(order[0]).over(by_key(key, order)))
    return out.filter(F.col(op) != DELETE) if op else out


def current(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("valid_to").isNull())


def as_of(versions: DataFrame, moment) -> DataFrame:
    """Versions valid at a moment. An extension: the columns allow it, no tag asks for it."""
    at = moment if isinstance(moment, Column) else F.lit(moment)
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def with_version_ids(versions: DataFrame, key: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """A surrogate key, numbered within the row's key: (key, version_id) is unique without a global sort; ties order versions of one time."""
    return versions.withColumn("version_id", F.row_number().over(Window.partitionBy(*key).orderBy("valid_from", *ties)))


def history(feed: DataFrame, key: Sequence[str], order: Sequence[str], payload: Sequence[str], op: str | None = None, on: Sequence[str] = (UPDATE, DELETE)) -> DataFrame:
    """The row as it was before each update and delete; valid_from and valid_to are both the time of capture."""
    w = by_key(key, order)
    before = F.lag(F.struct(*payload)).over(w)
    out = feed.withColumn("_old", before).withColumn("history_operation", F.col(op) if op else F.lit(UPDATE)).filter(F.col("_old").isNotNull() & F.col("history_operation").isin(list(on)))
    return out.select(*key, *[F.col("_old")[c].alias(c) for c in payload], F.col(order[0]).alias("valid_from"), F.col(order[0]).alias("valid_to"), "history_operation")


def as_json(*columns: str) -> Column:
    """A row as JSON, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def audit(feed: DataFrame, table: str, key: Sequence[str], order: Sequence[str], op: str, old: Column, new: Column, on: Sequence[str] = (INSERT, UPDATE, DELETE), seq: bool = False) -> DataFrame:
    """A log row per change: old data null for inserts, new data null for deletes; with seq, the place among changes at one time."""
    out = feed.withColumn("_old", old).filter(F.col(op).isin(list(on)))
    return out.select(
        F.lit(table).alias("table_name"), F.col(op).alias("operation"), *key,
        F.when(F.col(op) != INSERT, F.col("_old")).alias("old_data"), F.when(F.col(op) != DELETE, new).alias("new_data"), F.col(order[0]).alias("changed_at"), *([F.col(order[-1]).alias("seq")] if seq else []),
    )


def replay(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows that an audit log leaves: each key's last new data, without deleted keys.

    Of changes at one time, the order of `seq` tells the last one where the log has it, else a delete counts as the
    last, and then the greatest data: always the same.
    """
    by = ["changed_at", "seq"] if "seq" in log.columns else ["changed_at"]
    rank = F.struct(*by, (F.col("operation") == DELETE).alias("_d"), F.col("new_data").alias("_n"))
    last = log.groupBy(*key).agg(F.max_by(F.struct("operation", "new_data"), rank).alias("_last"))
    return last.filter(F.col("_last.operation") != DELETE).select(*key, F.col("_last.new_data").alias("data"))


def redacted(df: DataFrame, column: str, how: str = "hash") -> DataFrame:
    """A column hashed (sha-256), masked, or omitted before it is logged."""
    if how == "omit":
        return df.drop(column)
    return df.withColumn(column, F.sha2(column, 256) if how == "hash" else F.mask(column))


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key, op, old and new rows between two snapshots of a table."""
    payload = [c for c in after.columns if c not in key]
    a = before.select(*key, F.struct(*payload).alias("old"))
    b = after.select(*key, F.struct(*payload).alias("new"))
    joined = a.join(b, list(key), "full_outer")
    op = F.when(F.col("old").isNull(), INSERT).when(F.col("new").isNull(), DELETE).when(~F.col("old").eqNullSafe(F.col("new")), UPDATE)
    return joined.withColumn("op", op).filter(F.col("op").isNotNull())


def stamped(before: DataFrame, after: DataFrame, key: Sequence[str], column: str, moment: Column) -> DataFrame:
    """after with the time of its last change in column: moment where a row is new or differs from before, else what it was.

    Keys are unique; a null key is a key. The column itself isn't compared, and after needn't have it.
    """
    payload = [c for c in after.columns if c not in (*key, column)]
    old = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.struct(*payload).alias("_old"), F.col(column).alias("_at"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    joined = after.select(*key, *payload).join(old, same, "left")
    at = F.when(F.col("_old").eqNullSafe(F.struct(*payload)), F.col("_at")).otherwise(moment)
    return joined.select(*key, *payload, at.alias(column))


@namespace("temporal", {"": TagSpec(("table",), 0, 2)})
def _temporal(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    versions = scd2(df, context.key, context.order, context.options.get("op"))
    return {"versions": versions, "current": current(versions)}


@namespace("history", {"": TagSpec(("table",), 0, 2)})
def _history(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    payload = [c for c in df.columns if c not in (*context.key, *context.order, context.options.get("op"))]
    on = context.tags.of("history")[0].options.get("on", ["update", "delete"])
    return {"history": history(df, context.key, context.order, payload, context.options.get("op"), [str(x).upper() for x in on])}


@namespace("audit", {"": TagSpec(("table",), 0, 3), "redact": TagSpec(("column",), 1, 1)})
def _audit(df: DataFrame, context: Context) -> dict[str, DataFrame]:
    for t in context.tags.of("audit", "redact"):
        df = redacted(df, t.column, str(t.args[0]))
    op = context.options.get("op")
    if op is None:
        op, df = "op", with_operation(df, context.key, context.order)
    payload = [c for c in df.columns if c not in (*context.order, op)]
    w = by_key(context.key, context.order)
    return {"audit_log": audit(df, context.table, context.key, context.order, op, F.lag(as_json(*payload)).over(w), as_json(*payload))}

"""Change capture on streams, an extension: a stream of row changes, kept as history, audit and versions.

Batch is the source of truth: each micro-batch is appended to the feed, and what the batch operators make of the
changed keys is written by key bucket, so a replayed batch overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, time: str, by: str, size: str, late: str) -> DataFrame:
    """Changes per window and kind; rows later than `late` no longer count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"))


def audit_stream(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, operation, old_data, new_data, changed_at) per change: the last value of each key is state.

    A change whose time is before one already seen of its key is logged as an update of what is known now.
    """

    def log(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        old = list(rows[value][:-1])
        old.insert(0, state.get[0] if state.exists else None)
        first = not state.exists
        state.update((rows[value].iloc[-1],))
        ops = ["INSERT" if first and i == 0 else "UPDATE" for i in range(len(rows))]
        yield pd.DataFrame({key: [k[0]] * len(rows), "operation": ops, "old_data": old, "new_data": list(rows[value]), "changed_at": list(rows[time])})

    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, operation string, old_data string, new_data string, changed_at {stream.schema[time].dataType.simpleString()}"
    return stream.select(key, time, F.col(value).cast("string").alias(value)).groupBy(key).applyInPandasWithState(log, out, f"{value} string", "append", GroupStateTimeout.NoTimeout)


def append_feed(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], buckets: int = 64) -> StreamingQuery:
    """Appends a stream of changes to a feed partitioned by key bucket and batch; a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

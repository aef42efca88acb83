"""Sum-of-squares packing of token sequences.

Every document becomes its ids and an end id; those over `capacity` are cut into pieces of that length, of which
only the last may be shorter. A full piece is a sequence of its own. The others are dealt evenly over shards of
about `shard_rows` rows, and each shard is packed alone: a piece goes where the sum of the squared counts of open
sequences per residual gap becomes smallest, among open sequences with room and a new one. So no task holds more
than a shard, however many documents there are, and a shard leaves open a few sequences at most.

Null texts are empty (one id, the end). Repeated rows and ids are packed as separate documents, and so are rows
without an id. An empty table gives no rows. Very long texts are cut like others. Columns other than doc_id and text
aren't read. Ties go to the smallest gap, and within a gap to the sequence opened last.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import saved, table
from tagloom.llm.word_ids import word_ids

CAPACITY, SHARD_ROWS = 4096, 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of every document."""

    def cut(batches):
        encode = word_ids().encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = encode(text)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, k * capacity, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each size, in the order given.

    With n[g] open bins of gap g, moving one from g to g - s changes the sum of squares by 2 (n[g - s] - n[g] + 1),
    and opening a bin by 2 n[capacity - s] + 1; full bins (gap 0) don't count. The least change is chosen.
    """
    n = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(n[s:capacity]) + s
        best, gap = 2 * int(n[capacity - s]) + 1, capacity
        if s == capacity:
            best = 0
        if len(gaps):
            change = np.where(gaps == s, 1 - 2 * n[gaps], 2 * (n[gaps - s] - n[gaps] + 1))
            k = int(change.argmin())
            if change[k] <= best:
                best, gap = int(change[k]), int(gaps[k])
        if gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_at[gap].pop()
            n[gap] -= 1
        where[i], offset[i] = b, capacity - gap
        if left := gap - s:
            open_at[left].append(b)
            n[left] += 1
    return where, offset


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row per piece with its sequence_id and offset in it; the sequences hold `capacity` ids at most."""
    cut = saved(pieces(docs, capacity))
    whole = cut.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("shard").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + where)).append_column("offset", pa.array(offset))

    packed = rest.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).groupBy("shard").applyInArrow(pack, PIECES + ", sequence_id long, offset long")
    return whole.unionByName(packed)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))

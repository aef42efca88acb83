"""Token ids as static range asymmetric numeral system blocks, in ascending document order.

A file is Parquet with a row per segment. A segment holds whole documents of about SEGMENT_IDS ids; its blocks of
BLOCK_IDS ids share one frequency table and are coded independently, each in LANES interleaved streams. Every
CHECKPOINT steps a block stores its lanes' states and its place in the words, so a reader can start there: decoding
runs over all checkpoints of a segment at once. Each block carries the crc32 of its ids, and reading verifies it.

Columns: part and seg order the segments; doc_ids and lengths list their documents; symbols and freqs (sum 65536)
are the table; n_words, states and places locate blocks and checkpoints in words; sums are the blocks' crc32.

Null and empty texts are a lone end id. Documents with a null id come first; repeated ids stay separate rows,
ordered by a hash of their text. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import saved, table
from tagloom.llm.word_ids import slices, word_ids

SEGMENT_IDS, BLOCK_IDS, LANES, CHECKPOINT = 1 << 20, 1 << 15, 64, 128
STEPS = BLOCK_IDS // LANES
BITS = 16
#: Ids below this are counted in an array, others sorted.
DENSE_IDS = 1 << 22

_FIELDS = [
    ("part", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()),
    ("symbols", pa.binary()), ("freqs", pa.binary()), ("n_words", pa.binary()), ("states", pa.binary()), ("places", pa.binary()), ("sums", pa.binary()), ("words", pa.binary()),
]
_SPARK = "part int, seg int, doc_ids array<long>, lengths array<long>, n_ids long, symbols binary, freqs binary, n_words binary, states binary, places binary, sums binary, words binary"
COLUMNS = [name for name, _ in _FIELDS]


def frequencies(counts: np.ndarray) -> np.ndarray:
    """counts, all above 0, scaled to sum 65536 with none below 1."""
    total = 1 << BITS
    if len(counts) > total:
        raise ValueError(f"a segment has {len(counts)} different ids; a table holds {total}")
    freqs = np.maximum(1, counts * (total - len(counts)) // counts.sum() + 1)
    rest = total - int(freqs.sum())
    freqs[np.argmax(counts)] += rest  # at least 0: each is rounded down
    return freqs.astype(np.uint32)


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids in ascending order, the place of each id among them, and their counts."""
    if len(ids) and int(ids.max()) >= DENSE_IDS:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def encode(ids: np.ndarray) -> dict[str, bytes]:
    """The table, blocks, checkpoints and sums of a segment."""
    symbols, index, counts = _counted(ids)
    freqs = frequencies(counts)
    starts = (np.cumsum(freqs) - freqs).astype(np.uint32)
    blocks = -(-len(ids) // BLOCK_IDS)
    padded = np.full(blocks * BLOCK_IDS, int(counts.argmax()), np.int64)
    padded[: len(ids)] = index
    # A step's ids of all blocks stand side by side.
    grid = padded.reshape(blocks, STEPS, LANES).transpose(1, 0, 2).copy()
    state = np.full((blocks, LANES), 1 << BITS, np.uint32)
    words = np.zeros((STEPS, blocks, LANES), np.uint16)
    used = np.zeros((STEPS, blocks, LANES), bool)
    states = np.zeros((blocks, STEPS // CHECKPOINT, LANES), np.uint32)
    sixteen, total = np.uint32(BITS), np.uint32(1 << BITS)
    for t in range(STEPS - 1, -1, -1):
        f = freqs[grid[t]]
        high = state >> sixteen
        full = high >= f
        used[t] = full
        words[t] = state.astype(np.uint16)
        state = np.where(full, high, state)
        # (q << 16) + r + start, of q and r from state by f. Doubles divide 32-bit integers by 17-bit ones to the right whole part.
        state += (state / f).astype(np.uint32) * (total - f) + starts[grid[t]]
        if t % CHECKPOINT == 0:
            states[:, t // CHECKPOINT] = state
    words, used = words.transpose(1, 0, 2), used.transpose(1, 0, 2)
    before = np.cumsum(used.sum(axis=2), axis=1)
    places = np.concatenate([np.zeros((blocks, 1), np.int64), before[:, CHECKPOINT - 1 : STEPS - 1 : CHECKPOINT]], axis=1)
    sums = np.array([zlib.crc32(ids[k : k + BLOCK_IDS].tobytes()) for k in range(0, len(ids), BLOCK_IDS)], np.uint32)
    return {
        "symbols": symbols.astype("<u4").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "n_words": before[:, -1].astype("<u4").tobytes(),
        "states": states.astype("<u4").tobytes(), "places": places.astype("<u4").tobytes(), "sums": sums.astype("<u4").tobytes(), "words": words[used].astype("<u2").tobytes(),
    }


def decode(n_ids: int, symbols: bytes, freqs: bytes, n_words: bytes, states: bytes, places: bytes, sums: bytes, words: bytes, check: bool = True) -> np.ndarray:
    """The ids of a segment; every checkpoint of every block is a start of its own."""
    table_ids, f = np.frombuffer(symbols, "<u4"), np.frombuffer(freqs, "<u4").astype(np.uint64)
    slots = np.repeat(np.arange(len(f)), f.astype(np.int64))
    of_freq, bias = f[slots], np.arange(1 << BITS, dtype=np.uint64) - (np.cumsum(f) - f)[slots]
    of_id = table_ids[slots]
    counts = np.frombuffer(n_words, "<u4").astype(np.int64)
    state = np.frombuffer(states, "<u4").astype(np.uint64).reshape(-1, LANES)
    at = (np.frombuffer(places, "<u4").astype(np.int64).reshape(len(counts), -1) + (np.cumsum(counts) - counts)[:, None]).reshape(-1)
    stream = np.concatenate([np.frombuffer(words, "<u2"), np.zeros(1, "<u2")]).astype(np.uint64)
    out = np.empty((len(state), CHECKPOINT, LANES), np.uint32)
    sixteen, low = np.uint64(BITS), np.uint64((1 << BITS) - 1)
    for t in range(CHECKPOINT):
        slot = (state & low).astype(np.int64)
        out[:, t] = of_id[slot]
        state = of_freq[slot] * (state >> sixteen) + bias[slot]
        need = state <= low
        nth = np.cumsum(need, axis=1)
        state = np.where(need, (state << sixteen) | stream[np.minimum(at[:, None] + nth - 1, len(stream) - 1)], state)
        at = at + nth[:, -1]
    ids = out.reshape(-1)[:n_ids]
    if check:
        for k, want in enumerate(np.frombuffer(sums, "<u4").tolist()):
            if zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].tobytes()) != want:
                raise ValueError(f"block {k} is damaged: its checksum differs")
    return ids


def segments(docs: DataFrame) -> DataFrame:
    """The rows of the file: documents range-partitioned and sorted by id, encoded to ids and coded by segment."""

    def code(batches):
        encode_all, part, seg = word_ids().encode_all, TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        room = SEGMENT_IDS

        def row():
            doc_ids, lengths, ids = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            one = [0, len(doc_ids)]
            coded = {"part": part, "seg": seg, "n_ids": len(ids), **encode(ids)}
            lists = {"doc_ids": pa.ListArray.from_arrays(one, doc_ids), "lengths": pa.ListArray.from_arrays(one, pa.array(lengths))}
            return pa.RecordBatch.from_arrays([lists[name] if name in lists else pa.array([coded[name]], kind) for name, kind in _FIELDS], COLUMNS)

        for batch in batches:
            for a, b in slices(batch["text"]):
                doc_ids = batch["doc_id"][a:b]
                ids, lengths = encode_all(batch["text"][a:b])
                ends = np.cumsum(lengths)
                at = done = 0
                while at < len(doc_ids):
                    # A segment ends with the document that fills it.
                    last = int(np.searchsorted(ends, done + room)) + 1
                    upto = min(last, len(doc_ids))
                    end = int(ends[upto - 1])
                    held.append((doc_ids[at:upto], lengths[at:upto], ids[done:end]))
                    room -= end - done
                    at, done = upto, end
                    if room <= 0:
                        yield row()
                        seg, held, room = seg + 1, [], SEGMENT_IDS
        if held:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_h")).repartitionByRange(n, "doc_id", "_h")
    return ordered.sortWithinPartitions("doc_id", "_h").select("doc_id", "text").mapInArrow(code, _SPARK)


def documents(file: DataFrame) -> DataFrame:
    """A row per document of a file: part, seg, doc_id, start within the segment, n_tokens, and the crc32 of its ids."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(*(row[k] for k in ("n_ids", "symbols", "freqs", "n_words", "states", "places", "sums", "words"))).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seg"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())],
                    ["part", "seg", "doc_id", "start_in_segment", "n_tokens", "ids_crc32"],
                )

    return file.mapInArrow(read, "part int, seg int, doc_id long, start_in_segment long, n_tokens long, ids_crc32 long")


def starts(file: DataFrame) -> DataFrame:
    """part, seg and the number of ids before each segment: summed in each part, then over the parts, of which there are few."""
    own = file.select("part", "seg", "n_ids").withColumn("own", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)))
    parts = file.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(parts, "part").select("part", "seg", (F.coalesce("own", F.lit(0)) + F.coalesce("base", F.lit(0))).alias("before"))


def op5_token_ids(spark, sf_dir: str) -> DataFrame:
    file = saved(segments(table(spark, sf_dir, "documents")))
    joined = documents(file).join(starts(file), ["part", "seg"])
    return joined.select("doc_id", (F.col("before") + F.col("start_in_segment")).alias("start"), "n_tokens", "ids_crc32")

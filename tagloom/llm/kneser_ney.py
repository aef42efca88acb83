"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted are documents whose label says quality 1. Words stand between white space, without a mark at their end and
without a capital at their beginning only; those seen LEAST_COUNT times or more in trusted text are words of the
model, and any other is an unknown word, whose probability is shared out over UNKNOWN_TYPES possible ones. Words are
numbered by their 64-bit hashes, from the most frequent on; these numbers (12 bytes a word) are broadcast.

Bigram counts of all trusted text make the count table, in shards of about SHARD entries by a hash of the bigram. The
counts of single words stand in the same table under contexts of their own (WORD_COUNTS of them, from the number of
words on). Each part of the input asks each shard once for its distinct bigrams and words, packed; where many parts
ask, a shard is sent to several tasks. The answers meet the part's documents again, as word numbers: they are counts
alone, in the order of the asks, which the part finds again from its documents. Chunks between white space are made
words once per SLICE bytes of text, and distinct numbers are found by sorting.

One in CALIBRATION trusted documents is kept out of vocabulary and counts, and only these set the thresholds: a
model knows the words of what it was trained on too well. A document goes if its log perplexity is above the QUANTILE
of those of its language plus MARGIN. That quantile is drawn to the one of all languages, which counts as PRIOR_TRUSTED
documents, so no number of documents switches between the two; the null language uses that of all.

The order is two because longer asks don't fit: a part's distinct triples of words, packed, take three times what its
pairs take, and more than the input by themselves (README).

Null and empty texts have no words: perplexity null, not kept. Very long texts are scored whole. A perplexity that
equals its threshold is kept. Labels of null don't count, and an id labelled several
times is trusted if any label says so. Without trusted text every text with words is kept. Repeated rows each give a
row. An empty table gives no rows. Of extra columns only _row is read, and returned: the caller's number of each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import concluded, only, released, releasing, saved, table
from tagloom.llm.word_ids import Memo

LEAST_COUNT, UNKNOWN_TYPES, SHARD = 3, 1_000_000, 2_000_000
#: Bytes of text whose chunks are looked up together, words whose bigrams are sorted together, and asks to a row.
SLICE, SORTED, ASKS = 4_000_000, 1_000_000, 1_000_000
#: Tasks whose counts are merged at once.
MERGED = 256
QUANTILE, MARGIN, PRIOR_TRUSTED, PRIOR_WORDS, CALIBRATION = 0.998, 0.25, 100, 20, 5
START, UNKNOWN = 0, 1
#: Of a word: all after it, the different ones after it once, twice and more often, and the different ones before it.
TOTAL, ONCE, TWICE, OFTEN, BEFORE = range(5)
WORD_COUNTS = 5


def word_of(chunk: str) -> str:
    word = chunk[:-1] if chunk[-1:] in (".", ",", ";", ":") else chunk
    return word.lower() if word.istitle() else word


def hash_of(word: str) -> int:
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers, ascending."""
    ordered = np.sort(numbers)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def hashed_slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts of SLICE bytes together: chunks in each, and the place of each chunk's word among the hashes of those of distinct chunks."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        chunks = pc.utf8_split_whitespace(texts.slice(low, high - low))
        every = chunks.flatten()
        # White space at either end of a text leaves an empty chunk there.
        full = pc.not_equal(every, "").to_numpy(zero_copy_only=False)
        lengths = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        n = np.bincount(np.repeat(np.arange(len(lengths)), lengths), full, len(lengths)).astype(np.int64)
        coded = every.dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(word_of(c).encode("utf-8", "surrogatepass")) for c in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        yield n, coded.indices.to_numpy()[full], hashes.view(np.int64)
        low = high


class _Numbers(Memo):
    def __init__(self, hashes: np.ndarray, ranks: np.ndarray):
        super().__init__()
        self.hashes, self.ranks = hashes, ranks

    def number(self, word: str) -> int:
        h = hash_of(word)
        at = int(np.searchsorted(self.hashes, np.int64(h)))
        return int(self.ranks[at]) + 2 if at < len(self.hashes) and self.hashes[at] == h else UNKNOWN

    def of_hashes(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        if not len(self.hashes):
            return np.full(len(hashes), UNKNOWN, np.uint32)
        return np.where(self.hashes[at] == hashes, self.ranks[at] + 2, UNKNOWN).astype(np.uint32)

    def __missing__(self, chunk: str) -> int:
        found = self.old.get(chunk)
        if found is None:
            found = self.number(word_of(chunk))
        return self.keep(chunk, found) if len(chunk) <= 64 else found


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def calibrates(column: str = "doc_id") -> Column:
    """Whether a trusted document sets thresholds instead of counts."""
    return F.pmod(F.xxhash64(F.lit("calibration"), column), F.lit(CALIBRATION)) == 0


def vocabulary(trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words counted LEAST_COUNT times or more, ascending, and their ranks from the most frequent on."""

    @releasing
    def count(batches):
        none, held, waiting = hash_of(""), (np.empty(0, np.int64), np.empty(0, np.int64)), []

        def merged():
            return summed(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))

        def rows(hashes, n):
            return pa.RecordBatch.from_arrays([pa.array(hashes[hashes != none]), pa.array(n[hashes != none])], ["h", "n"])

        for batch in batches:
            for _, at, hashes in hashed_slices(batch["text"]):
                waiting.append((hashes, np.bincount(at, minlength=len(hashes)).astype(np.int64)))
                if sum(len(h) for h, _ in waiting) > SORTED:
                    held, waiting = merged(), []
                if len(held[0]) > SORTED:
                    yield rows(*held)
                    held = held[0][:0], held[1][:0]
        yield rows(*merged())

    # Saved, so that the shuffle of all words is removed.
    counted = saved(trusted.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)).toArrow()
    hashes, n = (counted[k].to_numpy() for k in ("h", "n"))
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    ranks = np.empty(len(n), np.uint32)
    ranks[np.lexsort((hashes, -n))] = np.arange(len(n))
    return hashes, ranks


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, first bytes first: those of high order are mostly zeros."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(packed: bytes, kind: str) -> np.ndarray:
    size, whole = np.dtype(kind).itemsize, int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], whole, "zstd", asbytes=True) if whole else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def numbered(docs: DataFrame, words: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Documents as word numbers (compressed), and rows with what each part p of the input asks: distinct bigrams, and the counts of their words."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    size = len(words[0]) + 2

    @releasing
    def number(batches):
        numbers, part = _Numbers(*sent.value), TaskContext.get().partitionId()
        seen, waiting = np.empty(0, np.int64), []
        names = ["doc_id", "lang", "_row", "p", "n", "k", "words", "bigrams"]
        for batch in batches:
            low = 0
            for n, at, hashes in hashed_slices(batch["text"]):
                w, k, own = numbers.of_hashes(hashes)[at], len(n), batch.slice(low, len(n))
                waiting.append(distinct(bigrams_of(w, n, size)))
                if sum(map(len, waiting)) > SORTED:
                    seen, waiting = distinct(np.concatenate([seen, *waiting])), []
                ends = np.cumsum(n)
                packed = [squeezed(w[e - m : e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["lang"], own["_row"], pa.array([part] * k, pa.int32()), pa.array(n), pa.nulls(k, pa.int32()), pa.array(packed, pa.binary()), pa.nulls(k, pa.binary())], names)
                low += k
        asks = asks_of(distinct(np.concatenate([seen, *waiting])), size)
        for k in range(0, len(asks), ASKS):
            own = asks[k : k + ASKS]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([len(own)]), pa.array([k // ASKS], pa.int32()), pa.nulls(1, pa.binary()), pa.array([pack(own)])], names)

    row = F.col("_row") if "_row" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), row.cast("long").alias("_row"), "text").mapInArrow(number, "doc_id long, lang string, _row long, p int, n long, k int, words binary, bigrams binary")


def bigrams(words: np.ndarray, size: int) -> np.ndarray:
    """Each word with the one before it (START before the first) as one number."""
    w = words.astype(np.int64)
    return np.concatenate([[START], w[:-1]]) * size + w if len(w) else w


def bigrams_of(words: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The bigrams of texts that have `lengths` of these words each."""
    before = np.concatenate([[START], words[:-1].astype(np.int64)]) if len(words) else words.astype(np.int64)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return before * size + words


def asks_of(seen: np.ndarray, size: int) -> np.ndarray:
    """All that a part asks for (ascending), of whose texts `seen` are the distinct bigrams."""
    left, right = distinct(seen // size), distinct(seen % size)
    return np.concatenate([seen, *[(size + k) * size + left for k in (TOTAL, ONCE, TWICE, OFTEN)], (size + BEFORE) * size + right])


def unpacked_words(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of texts, and how many each has, about SORTED words at once."""
    held, size = [], 0
    for x in packed:
        held.append(unsqueezed(x, "<u4"))
        size += len(held[-1])
        if size > SORTED:
            yield np.concatenate(held), np.array(list(map(len, held)))
            held, size = [], 0
    if held:
        yield np.concatenate(held), np.array(list(map(len, held)))


def pack(keys: np.ndarray) -> bytes:
    """Ascending numbers below 2**63 by their differences, compressed."""
    return squeezed(np.diff(keys, prepend=0).astype("<i8"))


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(packed, "<i8"))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard of the keys, and their places, ascending."""
    ordered = np.sort(shard_of(keys, shards) << 32 | np.arange(len(keys)))
    of, places = ordered >> 32, ordered & 0xFFFFFFFF
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(keys) else np.empty(0, np.int64)
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(of[low]), places[low:high]


def counted(rows: DataFrame, size: int, shards: int, groups: int = 1) -> DataFrame:
    """The count table: shard, keys and counts (packed) of all bigrams of rows; each task sends its own sums.

    These are merged by groups of tasks first, so that no merge takes the sums of all tasks, however many there are.
    """

    @releasing
    def count(batches):
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for words, n in unpacked_words(batch["words"].to_pylist()):
                own = np.unique(bigrams_of(words, n, size), return_counts=True)
                held = summed(*(np.concatenate(x) for x in zip(held, own, strict=True)))
        keys, c = held
        group = TaskContext.get().partitionId() % groups
        for k, at in by_shard(keys, shards):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(keys[at])]), pa.array([squeezed(c[at].astype("<i8"))]), pa.array([group], pa.int32())], ["shard", "keys", "counts", "g"])

    schema = "shard int, keys binary, counts binary"
    own = rows.select("words").mapInArrow(count, schema + ", g int")
    if groups > 1:
        own = own.groupBy("shard", "g").applyInArrow(merged_shard, schema)
    return own.groupBy("shard").applyInArrow(merged_shard, schema)


def merged_shard(t: pa.Table) -> pa.Table:
    keys, c = summed(np.concatenate([unpack(x) for x in t["keys"].to_pylist()]), np.concatenate([unsqueezed(x, "<i8") for x in t["counts"].to_pylist()]))
    return pa.table([t["shard"][:1], pa.array([pack(keys)]), pa.array([squeezed(c.astype("<i8"))])], ["shard", "keys", "counts"])


def word_counts(counts: DataFrame, size: int) -> DataFrame:
    """(bigram, c) of the WORD_COUNTS contexts: what the counts say of single words."""
    kinds = [F.sum("c").alias("c0"), F.count_if(F.col("c") == 1).alias("c1"), F.count_if(F.col("c") == 2).alias("c2"), F.count_if(F.col("c") > 2).alias("c3")]
    after = counts.groupBy(F.expr(f"bigram div {size}").alias("w")).agg(*kinds)
    after = after.select("w", F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("k", "c")).filter("c > 0")
    before = counts.groupBy(F.expr(f"bigram % {size}").alias("w")).agg(F.count("*").alias("c")).select("w", F.lit(BEFORE).alias("k"), "c")
    return after.unionByName(before).select(((F.lit(size) + F.col("k")).cast("long") * size + F.col("w")).alias("bigram"), "c")


def in_shards(counts: DataFrame, shards: int) -> DataFrame:
    """(bigram, c) as shards like those of the count table."""

    @releasing
    def split(batches):
        for batch in batches:
            keys, c = batch["bigram"].to_numpy(), batch["c"].to_numpy()
            order = np.argsort(keys)
            keys, c = keys[order], c[order]
            for k, at in by_shard(keys, shards):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(keys[at])]), pa.array([squeezed(c[at].astype("<i8"))])], ["shard", "keys", "counts"])

    schema = "shard int, keys binary, counts binary"
    return counts.mapInArrow(split, schema).groupBy("shard").applyInArrow(merged_shard, schema)


def unpacked(table_: DataFrame) -> DataFrame:
    """(bigram, c) of a count table."""

    @releasing
    def rows(batches):
        for batch in batches:
            for keys, counts in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                b, c = unpack(keys), unsqueezed(counts, "<i8")
                for k in range(0, len(b), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(b[k : k + 100_000]), pa.array(c[k : k + 100_000])], ["bigram", "c"])

    return table_.select("keys", "counts").mapInArrow(rows, "bigram long, c long")


def answered(asked: DataFrame, table_: DataFrame, shards: int, copies: int) -> DataFrame:
    """part, k and shard of asks, and the counts (packed) of those of their bigrams that the shard would have, in their order.

    asked: part, k (its rows of asks) and bigrams (packed). The parts are dealt over `copies` of each shard. What a
    shard has nothing of isn't answered.
    """

    @releasing
    def split(batches):
        for batch in batches:
            for part, k, packed in zip(batch["part"].to_pylist(), batch["k"].to_pylist(), batch["bigrams"].to_pylist(), strict=True):
                keys = unpack(packed)
                own = dict(by_shard(keys, shards))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array([k] * len(own), pa.int32()), pa.array(list(own), pa.int32()), pa.array([pack(keys[at]) for at in own.values()], pa.binary())], ["part", "k", "shard", "bigrams"])

    def look_up(key: tuple, asks: pa.Table, tables: pa.Table) -> pa.Table:
        parts, ks, counts = [], [], []
        if len(tables) and len(asks):
            b, c = summed(np.concatenate([unpack(x) for x in tables["keys"].to_pylist()]), np.concatenate([unsqueezed(x, "<i8") for x in tables["counts"].to_pylist()]))
            for part, k, packed in zip(asks["part"].to_pylist(), asks["k"].to_pylist(), asks["bigrams"].to_pylist(), strict=True):
                keys = unpack(packed)
                at = np.minimum(np.searchsorted(b, keys), len(b) - 1)
                parts.append(part)
                ks.append(k)
                counts.append(squeezed(np.where(b[at] == keys, c[at], 0).astype("<i8")))
        return pa.table([pa.array(parts, pa.int32()), pa.array(ks, pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array(counts, pa.binary())], ["part", "k", "shard", "counts"])

    asks = asked.mapInArrow(split, "part int, k int, shard int, bigrams binary").withColumn("copy", F.pmod(F.xxhash64("part"), F.lit(copies)).cast("int"))
    sent = table_.select(F.col("shard").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_c"), "keys", "counts")
    return asks.groupBy("shard", "copy").cogroup(sent.groupBy("_s", "_c")).applyInArrow(look_up, "part int, k int, shard int, counts binary")


def found_counts(asks: np.ndarray, answers: pa.Table, shards: int) -> np.ndarray:
    """The counts of all asks of a part."""
    c = np.zeros(len(asks), np.int64)
    places = [dict(by_shard(asks[low : low + ASKS], shards)) for low in range(0, len(asks), ASKS)]
    for k, shard, packed in zip(answers["k"].to_pylist(), answers["shard"].to_pylist(), answers["counts"].to_pylist(), strict=True):
        c[k * ASKS + places[k][shard]] = unsqueezed(packed, "<i8")
    return c


def discounts(of_counts: dict[int, int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more, from the numbers of entries with counts 1 to 4."""
    n1, n2, n3, n4 = (max(of_counts.get(k, 0), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True)]])


class Model:
    """Discounts and the lower order's shares; of single words only what answers(), or else all of a small table."""

    def __init__(self, counts: DataFrame, size: int, of_words: DataFrame | None = None):
        of = {r["c"]: r["n"] for r in counts.filter("c < 5").groupBy("c").agg(F.count("*").alias("n")).collect()}
        self.size, self.d = size, discounts(of)
        small = of_words is None
        of_words = word_counts(counts, size) if small else of_words
        before = of_words.filter(F.col("bigram") >= (size + BEFORE) * size)
        least = before.groupBy(F.least("c", F.lit(5)).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("all")).collect()
        n = {r["c"]: r["n"] for r in least}
        self.lower_d = discounts({k: n.get(k, 0) for k in range(1, 5)})
        self.whole = max(sum(r["all"] for r in least), 1)
        self.rest = sum(self.lower_d[min(k, 3)] * m for k, m in n.items()) / self.whole / size
        unknown = before.filter(F.col("bigram") == (size + BEFORE) * size + UNKNOWN).agg(F.sum("c")).first()[0] or 0
        own = self._lower(np.array([unknown]))[0]
        self.unknown = max(own, 1 / size)
        self.norm = (1.0 if n else 0.0) + self.unknown - own
        if small:
            rows = of_words.orderBy("bigram").collect()
            self.answers(np.array([r["bigram"] for r in rows], np.int64), np.array([r["c"] for r in rows], np.int64))

    def _lower(self, before: np.ndarray) -> np.ndarray:
        return np.maximum(before - self.lower_d[np.minimum(before, 3)], 0) / self.whole + self.rest

    def answers(self, keys: np.ndarray, c: np.ndarray) -> None:
        """From now on words have these counts (keys ascending); other words have none."""

        def of(kind: int, words: np.ndarray) -> np.ndarray:
            asked = (self.size + kind) * self.size + words
            at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
            return np.where(keys[at] == asked, c[at], 0) if len(keys) else np.zeros(len(words), np.int64)

        kinds, words = keys // self.size - self.size, keys % self.size
        # After the last word stands one that no text has, for words without counts.
        self.left, self.right = (np.append(words[kinds == k], np.iinfo(np.int64).max) for k in (TOTAL, BEFORE))
        total = of(TOTAL, self.left[:-1])
        left_over = self.d[1] * of(ONCE, self.left[:-1]) + self.d[2] * of(TWICE, self.left[:-1]) + self.d[3] * of(OFTEN, self.left[:-1])
        self.total, self.gamma = np.append(total, 1), np.append(left_over / np.maximum(total, 1), 1.0)
        self.lower = np.append(self._lower(of(BEFORE, self.right[:-1])), self.rest) / self.norm

    def log_probabilities(self, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
        w, v = keys // self.size, keys % self.size
        at, to = np.searchsorted(self.left, w), np.searchsorted(self.right, v)
        at, to = np.where(self.left[at] == w, at, -1), np.where(self.right[to] == v, to, -1)
        lower = np.where(v == UNKNOWN, self.unknown / self.norm, self.lower[to])
        p = np.maximum(c - self.d[np.minimum(c, 3)], 0) / self.total[at] + self.gamma[at] * lower
        return np.log(np.where(v == UNKNOWN, p / UNKNOWN_TYPES, p))


@concluded
def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words and log_perplexity (null without words, or without trusted text)."""
    ids = saved(trusted_ids(labels).filter(~calibrates()))
    words = vocabulary(only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids))
    size = len(words[0]) + 2
    rows = saved(numbered(docs, words))
    texts = rows.filter("words is not null")
    asked = rows.filter("bigrams is not null").select(F.col("p").alias("part"), "n", "k", "bigrams")
    shards = min(-(-(texts.agg(F.sum("n")).first()[0] or 1) // SHARD), -(-size * size // SHARD))
    copies = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 1) // (shards * SHARD)))
    counts = saved(counted(only(texts.select("doc_id", "words"), ids), size, shards, -(-asked.select("part").distinct().count() // MERGED) or 1))
    of_words = saved(in_shards(word_counts(unpacked(counts), size), shards))
    sent = docs.sparkSession.sparkContext.broadcast(Model(unpacked(counts), size, unpacked(of_words)))
    # Saved, so that the shuffle of asks is removed before texts are shuffled.
    answers = saved(answered(asked.select("part", "k", "bigrams"), counts.unionByName(of_words), shards, copies))

    def score(key: tuple, own: pa.Table, known: pa.Table) -> pa.Table:
        model, seen, packed = sent.value, np.empty(0, np.int64), own["words"].to_pylist()
        for w, n in unpacked_words(packed):
            seen = distinct(np.concatenate([seen, distinct(bigrams_of(w, n, model.size))]))
        asks = asks_of(seen, model.size)
        c = found_counts(asks, known, shards)
        of_words = np.arange(len(seen), len(asks))[c[len(seen) :] > 0]
        model.answers(asks[of_words], c[of_words])
        logs, found = model.log_probabilities(seen, c[: len(seen)]), []
        for w, n in unpacked_words(packed):
            keys = bigrams_of(w, n, model.size)
            # Looked up in their order, which is several times as fast.
            order = np.argsort(keys)
            sums = np.bincount(np.repeat(np.arange(len(n)), n)[order], logs[np.searchsorted(seen, keys[order])], len(n))
            found += [-float(x / m) if m else None for x, m in zip(sums, n, strict=True)]
        released()
        return pa.table([own["doc_id"], own["lang"], own["_row"], own["n"], pa.array(found, pa.float64())], ["doc_id", "lang", "_row", "n_words", "log_perplexity"])

    scored = texts.select("p", "doc_id", "lang", "_row", "n", "words").groupBy("p").cogroup(answers.groupBy("part")).applyInArrow(score, "doc_id long, lang string, _row long, n_words long, log_perplexity double")
    return scored if "_row" in docs.columns else scored.drop("_row")


def quality_classifier(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_words, log_perplexity, threshold and kept."""
    scored = perplexities(docs, labels)
    # A short text's mean is drawn to its language's: PRIOR_WORDS words count as the median.
    middle = scored.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 1000).alias("_middle"))
    drawn = scored.join(middle, scored.lang.eqNullSafe(middle.lang), "left").drop(middle.lang)
    drawn = drawn.withColumn("_drawn", F.expr(f"(log_perplexity * n_words + _middle * {PRIOR_WORDS}) / (n_words + {PRIOR_WORDS})"))
    known = only(drawn.filter("_drawn is not null"), trusted_ids(labels).filter(calibrates()))
    by_lang = known.groupBy("lang").agg(F.percentile_approx("_drawn", quantile, 10_000).alias("_own"), F.count("*").alias("_n")).filter("lang is not null")
    overall = known.agg(F.percentile_approx("_drawn", quantile, 10_000)).first()[0]
    shrunk = F.expr(f"_own * _n / (_n + {PRIOR_TRUSTED})") + F.lit(overall).cast("double") * F.expr(f"{PRIOR_TRUSTED} / (_n + {PRIOR_TRUSTED})")
    judged = drawn.join(F.broadcast(by_lang), "lang", "left").withColumn("threshold", F.coalesce(shrunk, F.lit(overall).cast("double")) + margin)
    row = [c for c in judged.columns if c == "_row"]
    return judged.select(*row, "doc_id", "lang", "n_words", "log_perplexity", "threshold", F.expr("n_words > 0 and coalesce(_drawn <= threshold, true)").alias("kept"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Shared helpers: reading tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.word_ids import forgotten

#: Space, and the characters from tab to carriage return: the only separators of words here (fixed values).
SPACE = "\\x20\\x09-\\x0D"

#: Ids that are broadcast to pick rows (8 bytes each); with more, the join shuffles.
BROADCAST_ROWS = 2_000_000

#: Spark's setting by which a write that ends also removes the shuffle files it made; else these stay until the driver
#: happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only for a local session that names none, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.gettempdir() + "/tagloom-shared"


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here remove their shuffle files when they end."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing_paths() -> Iterator[list[str]]:
    """The folders that saved() makes in here and nothing has removed, in order."""
    outer, own = _passing.get(), []
    _passing.set(own)
    try:
        yield own
    finally:
        _passing.set(outer)


def concluded(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """`make` with its result saved, and what else it saved removed once that is done (or has failed)."""

    @wraps(make)
    def call(df: DataFrame, *more, **named) -> DataFrame:
        spark, outer, own = df.sparkSession, _passing.get(), []
        _passing.set(own)
        try:
            result = make(df, *more, **named)
            _passing.set(outer)
            return saved(result)
        finally:
            _passing.set(outer)
            removed(spark, own)

    return call


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Folders that saved() made go."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released() -> None:
    """Memory that this worker keeps for later goes back, encoders of ids too: Spark keeps workers, and other stages need it."""
    forgotten()
    pa.default_memory_pool().release_unused()
    # Of glibc only.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`make`, a function of a task's batches, with memory released when the task ends."""

    @wraps(make)
    def call(batches: Iterator) -> Iterator:
        try:
            yield from make(batches)
        finally:
            released()

    return call


def words_of(text: str) -> str:
    """SQL for the array of words of a text column: runs of anything but SPACE."""
    return f"filter(split(coalesce({text}, ''), '[{SPACE}]+'), w -> w <> '')".replace("\\", "\\\\")


def only(df: DataFrame, ids: DataFrame, how: str = "left_semi", on: str = "doc_id") -> DataFrame:
    """df's rows whose id is in ids (or isn't, left_anti); ids are broadcast if few enough."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, on, how)

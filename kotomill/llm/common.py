"""Shared helpers: table access, cut points in the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: The separators of the word rule used by several contracts, as a Java character class.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can read: spark.checkpoint.dir. Only a local master may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="kotomill-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


#: A written table may be broadcast if it is estimated to take at most this many bytes in memory; above it the same join shuffles.
BROADCAST_BYTES = 32 << 20
#: What a row takes in a hash table besides its values, and how far Parquet may shrink strings and arrays.
ROW_BYTES, SHRUNK = 32, 32
VARYING = (StringType, BinaryType, ArrayType, MapType, StructType)


#: The setting of the session's cache of file listings.
LISTED = "spark.sql.hive.filesourcePartitionFileCacheSize"

_scopes: list[list[Cut]] = []


@contextmanager
def passing() -> Iterator[Callable[[Cut], Cut]]:
    """Every table that is written within is deleted at the end, but for those given to the function: what a result still reads."""
    mine: list[Cut] = []
    kept: list[Cut] = []

    def keep(cut: Cut) -> Cut:
        kept.append(cut)
        return cut

    _scopes.append(mine)
    try:
        yield keep
    finally:
        _scopes.pop()
        for cut in mine:
            if not any(cut is k for k in kept):
                cut.drop()
        if _scopes:
            _scopes[-1].extend(kept)


class Cut:
    """A table written to the shared folder: cuts lineage, survives lost executors, and can be pruned when read."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/kotomill/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if _scopes:
            _scopes[-1].append(self)
        self.schema = df.schema
        self._rows: int | None = None
        where = self._path()
        where.getFileSystem(self._conf()).deleteOnExit(where)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    @property
    def df(self) -> DataFrame:
        # each reading would leave its listing of the files in the session's cache, which holds up to 250 MB of the driver's heap and is never asked for it again
        now = self.spark.conf.get(LISTED)
        self.spark.conf.set(LISTED, "0")
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        finally:
            self.spark.conf.set(LISTED, now)

    def bytes(self) -> int:
        where = self._path()
        return where.getFileSystem(self._conf()).getContentSummary(where).getLength()

    def rows(self) -> int:
        self._rows = self.df.count() if self._rows is None else self._rows
        return self._rows

    def small(self, limit: int = 0) -> bool:
        """Whether the rows, counted and sized as decoded, stay within the limit (BROADCAST_BYTES if 0)."""
        limit = limit or BROADCAST_BYTES
        stored = self.bytes()
        if stored > limit:
            return False
        fixed = sum(8 for f in self.schema if not isinstance(f.dataType, VARYING))
        varying = SHRUNK * stored if fixed < 8 * len(self.schema) else 0
        return self.rows() * (fixed + ROW_BYTES) + varying <= limit

    def drop(self) -> None:
        where = self._path()
        where.getFileSystem(self._conf()).delete(where, True)


#: Texts travel to Python in batches of at most this size.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2048


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: a worker holds a batch several times over, as Arrow, as strings and as results."""
    for key, most, unit in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "b"), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "")):
        now = re.match(r"\d+", spark.conf.get(key, None) or "")
        if not (now and 0 < int(now[0]) <= most):
            spark.conf.set(key, f"{most}{unit}")


def released() -> None:
    """Gives what a finished piece of work held back to the system; workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of batches, followed by released()."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return wrapped


def small_side(cut: Cut, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The written table, marked for broadcast only if its rows, counted and sized as decoded, stay within the limit."""
    return F.broadcast(cut.df) if cut.small(limit) else cut.df


def settled(spark: SparkSession) -> None:
    """Lets Spark free the shuffle files, broadcasts and plans of finished steps: it does so once the driver has collected them, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_words(text: str) -> Column:
    """Number of words of the contracts in the named column; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")

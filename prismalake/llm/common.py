"""What the operators of this subpackage share: the shared work folder, written intermediate tables, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where none is named and Spark runs on one machine (as in local tests) a folder is made and set as the checkpoint
    folder; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="prismalake-")
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "prismalake", f"{name}-{uuid.uuid4().hex}")


_scopes: list[list[str]] = []
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # with the query that made them


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back.

    Inside ``scratch`` the table is deleted at the end of the block, unless it is to be kept (until an outer block ends)."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are written inside: nothing that leaves the block may read them any more. Inside, a query's
    shuffle files go when it ends, as its rows are then in a table; a lost executor's part is made again. What else
    finished jobs have left on the executors' disks is given up at the end."""
    own: list[str] = []
    _scopes.append(own)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)
        _scopes.remove(own)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        gc.collect()
        spark._jvm.System.gc()  # Spark deletes shuffle files when their jobs' objects are collected


def crc_share(col: str, modulo: int):
    """crc32 of the id written as text, modulo ``modulo``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulo


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers (xor-shift and multiply rounds)."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


def spread(seed: int, n: int = 256) -> np.ndarray:
    """n pseudo-random odd 64-bit integers."""
    return mix64(np.arange(n, dtype=U64) + U64(seed * 1_000_003 + 17)) | U64(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand and kept by the worker."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                out = np.ones(n, U64)
                out[1:] = U64(base)
                np.multiply.accumulate(out, out=out)
                setattr(self, name, out)
        return self.up, self.down


def utf8(column: pa.Array) -> pa.Array:
    """The column's texts as binary; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return pc.fill_null(column, b"")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its rows (from 0)."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows so that ``column`` holds about ``limit`` bytes each; one longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    given_back()


def given_back() -> None:
    """Memory that a task has freed goes back to the system: workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return data + (((data >= 65) & (data <= 90)).view(np.uint8) << 5)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of the rows, and each row's first word (and the end)."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it until no column of ``taken`` has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name

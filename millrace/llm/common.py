"""Helpers shared by the corpus operators: shared folders, size-checked joins, word tables over Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.stable import delete

#: Rows up to which one side of a join is broadcast: at under 64 bytes a row, some 16 MB. Larger sides are shuffled.
BROADCAST_ROWS = 250_000
#: Bytes of an Arrow batch, where the session sets no bound of its own: the default of 64 MB is held several times over
#: by each task, in the JVM and in its worker.
BATCH_BYTES = 4 << 20
#: Bytes of text that the vectorised functions take at once, so that their scratch arrays stay in cache and bounded.
SLICE_BYTES = 1 << 20


# -- shared folders --------------------------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where that is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_millrace_shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext._millrace_shared = root
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared root; its content goes when the driver ends."""
    uri = f"{shared_root(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    atexit.register(discard, uri)
    return uri


def discard(uri: str) -> None:
    """Delete a folder made by shared_folder(), on any store that Spark can write to."""
    if urlparse(uri).scheme in ("", "file"):
        shutil.rmtree(urlparse(uri).path, ignore_errors=True)
    elif (spark := SparkSession.getActiveSession()) is not None:
        delete(spark, uri)


def local_path(uri: str) -> str | None:
    """The path under which a shared URI is mounted here, or None if it isn't a mounted file system."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put_file(uri: str, chunks: list[bytes | np.ndarray]) -> None:
    """Write a file of the shared folder in one step: a retried or speculative task replaces it by the same bytes."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        temporary = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as out:
            for chunk in chunks:
                out.write(memoryview(chunk).cast("B") if len(chunk) else b"")
        system.move(temporary, path)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        for chunk in chunks:
            out.write(memoryview(chunk).cast("B") if len(chunk) else b"")
    os.replace(temporary, path)


def map_file(uri: str) -> np.ndarray:
    """The bytes of a shared file: memory-mapped if mounted, else read whole; empty if there is no such file."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return np.zeros(0, np.uint8)
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read(), np.uint8)
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.zeros(0, np.uint8)
    return np.asarray(np.memmap(path, np.uint8, "r"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    uri = shared_folder(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each SparkContext: they may not have it installed. Bounds Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if not getattr(context, "_millrace_shipped", False):
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="millrace-package-")) / "millrace.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        context.addPyFile(str(target))
        atexit.register(shutil.rmtree, target.parent, True)
        context._millrace_shipped = True


def give_back() -> None:
    """Give this worker's free memory back to the system: it is used again by later tasks and stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def _tidy(function: Callable) -> Callable:
    """The function, giving free memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def map_arrow(df: DataFrame, function: Callable, schema: object) -> DataFrame:
    """df.mapInArrow with this package at the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(function), schema)


# -- joins -----------------------------------------------------------------------------------------------------


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised side of narrow rows, with a broadcast hint only if its counted rows are within the bound."""
    return F.broadcast(small) if small.count() <= rows else small


def rank_rows(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Add 0-based positions in a total order without one task for all rows: ranges, then one offset a range."""
    ranged = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    sizes = sorted((r["p"], r["n"]) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = {}, 0
    for p, n in sizes:  # one entry for each range partition
        offsets[p], total = total, total + n
    table = F.create_map(*[F.lit(x).cast("long") for p in offsets for x in (p, offsets[p])]) if offsets else None
    at = table[part] if offsets else F.lit(0).cast("long")
    return ranged.withColumn(name, at + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id")


# -- Arrow text ------------------------------------------------------------------------------------------------


def texts(column: pa.Array) -> pa.Array:
    """A batch's text column as a string array without nulls (null counts as empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("")


def encoded(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null counts as empty."""
    return texts(column).cast(pa.large_binary()).to_pylist()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row offsets in them) over runs of whole texts of about `limit` bytes."""
    column = texts(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20_240_229).integers(0, 2**64, (64, 256), dtype=np.uint64).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of texts, and where each text's words start (one more entry).

    Tabulation hashing over (place in the word, byte), finished by a mixer; A-Z count as a-z if `lower`.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    chars = _LOWER[data] if lower else data
    ink = ~_WS[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = ink[edges]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = np.cumsum(start, dtype=np.int32) - 1
    place = np.arange(len(data), dtype=np.int32) - starts.astype(np.int32)[np.maximum(word, 0)]
    value = _TABLE[((place & 63) << 8) | chars]
    far = np.flatnonzero(ink & (place > 63))
    if len(far):
        value[far] = mix(value[far] + place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[~ink] = 0
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, offsets)


def crc_of_ids(ids: list) -> np.ndarray:
    """crc32 of each id written as decimal text (null: as the empty text)."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.int64)

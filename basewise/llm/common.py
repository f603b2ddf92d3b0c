"""What the text operators share: bounded Arrow batches, shared intermediate tables, byte views and word hashes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch may hold, so that a batch of long texts stays small; one longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that the array code handles at a time; one longer text makes a piece of its own.
PIECE_BYTES = 1 << 18

_settled = False


def settle() -> None:
    """Once in a worker: large arrays come from the system in blocks of their own and go back at once; smaller ones are used again."""
    global _settled
    if not _settled:
        _settled = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: fixed, else it grows with the blocks that are freed
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
            libc.mallopt(-8, 2)  # M_ARENA_MAX
        except AttributeError:  # another C library
            pass


def release() -> None:
    """Gives memory that a finished task has freed back to the system: workers live on, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS and BATCH_BYTES where it is higher.

    It stays so: plans read it when they run, after the operator that made them has returned. A batch ends with the row
    that takes it beyond BATCH_BYTES, so no executor gathers many long texts before it sends them to its worker."""
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    now = int(spark.conf.get(rows))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


# -- intermediate tables and broadcasts ----------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. In local mode only, a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="basewise-"))
    return sc.getCheckpointDir()


_folders: dict[str, str] = {}
#: For each open scope, the folders and broadcasts that end with it.
_scopes: list[list[str | Broadcast]] = []
#: The folder of each table that cut() gave.
_cuts: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: With this a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _folder(spark: SparkSession) -> str:
    """One folder for all intermediate tables of the application; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = path = f"{shared_dir(spark)}/basewise-{app}"

        def clean() -> None:
            try:
                remove(spark, path)
            except Exception:  # noqa: BLE001 (the JVM may have ended first)
                pass

        atexit.register(clean)
    return _folders[app]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: its lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _cuts[out] = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table of cut() before its scope ends; nothing may read it any more. Other frames stay as they are."""
    if (path := _cuts.pop(df, None)) is not None:
        remove(df.sparkSession, path)


def share(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that ends with the scope."""
    held = spark.sparkContext.broadcast(value)
    if _scopes:
        _scopes[-1].append(held)
    return held


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope: what is cut or shared inside goes at its end. It gives a function that cuts a result for the outside."""
    mine: list[str | Broadcast] = []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        _scopes.pop()
        try:
            return cut(df)
        finally:
            _scopes.append(mine)

    try:
        yield keep
    finally:
        _scopes.pop()
        for x in mine:
            if isinstance(x, str):
                remove(spark, x)
            else:
                x.destroy()


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most size bytes, at least one row each; none if it is empty."""
    if batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), size)
        yield from slices(batch.slice(half), size)
    elif batch.num_rows:
        yield batch


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df.mapInArrow with a function from batch to batch; empty batches are passed over."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in slices(batch):
                if (out := fn(part)) is not None and out.num_rows:
                    yield out
        release()

    return df.mapInArrow(run, schema)


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about size bytes each, at least one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


# -- word hashes -------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words, for the two kinds of words that the contracts name.
BLANK_WORDS = np.ones(256, bool)  # [^\x20\x09-\x0D]+
BLANK_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORDS = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_RNG = np.random.Generator(np.random.PCG64(20240229))
_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(2**62, 2**63)) * 8 + 5 & (2**64 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word in order; A-Z lower-cased first. start and end: byte positions in data."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = LOWER[data]
    mask = in_word[low]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    first[cuts] = mask[cuts]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    last[cuts - 1] = mask[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(mask, _CODE[low], np.uint64(0)) * _powers(_BASE, len(data)), out=sums[1:])
    out = mix((sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start])
    return out, np.searchsorted(offsets, start, "right") - 1, start, end


_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words of one array (the caller drops those that cross rows)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += words[j : j + n]
    return mix(out + np.uint64(k))


def strings(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())

"""Shared plumbing of the training-data operators: scratch tables, batch bounds, vectorised byte hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session in one process may go without the setting and then has a temporary folder; on a cluster each
    executor would write to a disk of its own, so the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("scriptorium.scratch.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark.conf.set("scriptorium.scratch.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables that a run of an operator writes to the shared folder: they cut lineage and survive lost executors.

    The end of the ``with`` block deletes all but the kept ones, which the operator's result still reads; those go
    when the application ends. ``tidy``: what a table's job has shuffled goes with the job, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[t for t, _ in self.tables])

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _written(self, df: DataFrame, rows: int | None, options: dict[str, str], stays: bool) -> tuple[DataFrame, str]:
        path = f"{shared_dir(self.spark)}/scriptorium/{uuid.uuid4().hex}"
        fs, at = self._fs(path)
        if stays:
            fs.deleteOnExit(at)
        try:
            with arrow_batches(self.spark, rows), _tidied(self.spark, self.tidy):
                df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        except BaseException:
            fs.delete(at, True)  # what a failed job has written
            raise
        return self.spark.read.schema(df.schema).parquet(path), path

    def write(self, df: DataFrame, rows: int | None = None, **options: str) -> DataFrame:
        """A table for this run alone; ``rows``: at most so many rows in the Arrow batches on the way."""
        self.tables.append(self._written(df, rows, options, False))
        return self.tables[-1][0]

    def keep(self, df: DataFrame, rows: int | None = None, **options: str) -> DataFrame:
        """A table that the result reads after this run."""
        return self._written(df, rows, options, True)[0]

    def folder(self) -> str:
        """An empty place for files that the result reads; it goes when the application ends."""
        path = f"{shared_dir(self.spark)}/scriptorium/{uuid.uuid4().hex}"
        fs, at = self._fs(path)
        fs.deleteOnExit(at)
        return path

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables whose last reader is done."""
        for table in tables:
            n = next(n for n, (t, _) in enumerate(self.tables) if t is table)
            fs, at = self._fs(self.tables.pop(n)[1])
            fs.delete(at, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Bound the Arrow batches of jobs that run inside the block; the session's own setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def _tidied(spark: SparkSession, tidy: bool) -> Iterator[None]:
    """Let jobs inside the block delete the files of their shuffles as they end; the session's own setting comes back after it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    if tidy:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if tidy:
            spark.conf.set(name, before)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows: texts become Python objects a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(name: str, taken: Iterable[str]) -> str:
    """A column name that none of the taken ones equals in Spark's eyes (letter case doesn't tell names apart)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name for select, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def named(frame: DataFrame, name: str) -> str:
    """How a frame spells a column, letter case apart."""
    return next(c for c in frame.columns if c.lower() == name.lower())


def in_arrow(frame: DataFrame, change: Callable, kept: Iterable[T.StructField], added: T.StructType) -> DataFrame:
    """``change`` over the frame's batches, whose columns are named c0, c1, ... on the way, as names may have any characters. It
    gives the columns ``kept`` and then ``added``."""
    fields = [*kept, *added]
    plain = T.StructType([T.StructField(f"c{n}", f.dataType, f.nullable) for n, f in enumerate(fields)])
    return frame.toDF(*[f"c{n}" for n in range(len(frame.columns))]).mapInArrow(change, plain).toDF(*[f.name for f in fields])


_held: list[Callable[[], None]] = []


def hold(drop: Callable[[], None]) -> None:
    """Remember how to drop what the running operator keeps in this worker between its partitions."""
    if drop not in _held:
        release_memory()
        _held.append(drop)


def release_memory() -> None:
    """Drop what another operator has kept in this worker and give freed memory back to the system.

    Spark uses a Python worker again for later stages, so every operator calls this at the start of a partition.
    """
    while _held:
        _held.pop()()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) on an unsigned array; returns a new array."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
#: Powers for texts up to so many bytes stay in a worker (two tables of 16 MB); longer ones are made when needed.
_KEPT_POWERS = 1 << 21
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse modulo 2**64."""
    up, down = _POWERS.get("up", ()), _POWERS.get("down", ())
    if len(up) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        if size <= _KEPT_POWERS:
            _POWERS.update(up=up, down=down)
    return up, down


_rng = np.random.Generator(np.random.PCG64(20240229))
#: Random 64-bit image of each byte value, so that the rolling hash doesn't see byte arithmetic.
BYTE_IMAGE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of byte spans, mixed with their lengths; vectorised over all spans."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_IMAGE[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_IMAGE[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[length:] - sums[:-length]) * down[:n])

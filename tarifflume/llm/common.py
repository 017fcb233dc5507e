"""What several of the operators need: a shared folder, shipped code, word and n-gram hashes."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the array code takes at once; a longer document is taken alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per Spark context, however the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_tarifflume_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tarifflume.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._tarifflume_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors see.

    Only in local mode, where driver and executors are one process, a temporary folder takes
    its place when that is unset; a cluster without the setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder: later jobs start from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder by Spark's file system classes."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def released(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes staged rows that are no longer needed, and lets Spark's cleaner drop old shuffle files."""
    for df in done:
        remove(spark, df._staged_path)
    for _ in range(2):  # references of Python go with the first round, those of the JVM with the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


# --- words and their hashes -------------------------------------------------------------

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    place -= np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = powers[place]
    place += np.repeat(starts, lengths)
    value *= _BYTE[data[place]]
    return mixed(np.add.reduceat(value, first))


class Words:
    """The words of some texts: byte spans in `data`; `first` has the first word of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        edge = np.zeros(len(data) + 2, bool)
        edge[bounds] = True
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_WHITE[self.data]
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-2]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:-1])) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on; also across texts: the caller masks those."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _STEP[k % 64]
    return mixed(total)


def slices(texts: pa.Array, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, where each begins and the last ends), `rows` at most at once; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = min(n, low + (rows or n), max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, "right")) - 1))
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def word_slices(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for low, high, data, bounds in slices(texts):
        yield low, high, Words(data, bounds, lower)

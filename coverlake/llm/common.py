"""Helpers shared by the text operators: bounded Arrow blocks, vectorised
word hashing, shared scratch output."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coverlake.sources.io import scratch_path

BLOCK_BYTES = 1 << 19
"""Text bytes that one vectorised block holds (a single longer text is a block of its own)."""

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = _SPACE.copy()
"""Bytes that separate words when ASCII punctuation does so, too."""
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def importable(spark: SparkSession) -> None:
    """Let Python workers on a shared file system import this package; on a
    cluster without one it is shipped with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage, survives lost executors, and gives the planner the true size."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, since one text can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with a number if needed, as a column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{base}{k or ''}" for k in range(len(taken) + 1)) if n.lower() not in taken)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = np.full(size, _BASE, dtype=np.uint64)
        inverse = np.full(size, _INVERSE, dtype=np.uint64)
        base[0] = inverse[0] = 1
        _powers = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """(first, last) row ranges of at most ``limit`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per text) of the words ``[^\\x20\\x09-\\x0D]+`` of
    consecutive texts; ``offsets`` are relative to ``data``, and ``apart`` holds
    the bytes that separate words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~apart[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def hash_words(data: np.ndarray, offsets: np.ndarray,
               apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, words per text): a 64-bit hash of each word's bytes."""
    start, end, counts = word_bounds(data, offsets, apart)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, counts
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start, end, counts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` word hashes (consecutive words)."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[k:k + m]
    return mix(out)


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())

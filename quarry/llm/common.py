"""Helpers shared by the operators of this subpackage.

``materialise`` cuts lineage with a Parquet table in the shared checkpoint folder.  ``word_chunks`` and
``shingles`` turn Arrow string buffers into flat numpy arrays: whole texts, no Python string per word.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: what separates words: space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INV = pow(_BASE, -1, 1 << 64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


_TABLES: list[str] = []


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _TABLES.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(since: Iterable[str] = ()) -> list[str]:
    """Tables of ``materialise`` that are still there, but for those in ``since``."""
    known = set(since)
    return [t for t in _TABLES if t not in known]


def drop(spark: SparkSession, tables: Iterable[str], keep: tuple[str, ...] = ()) -> None:
    """Deletes ``tables`` but those named in ``keep``; what was to be read from them has been.  The driver's garbage goes too, for
    Spark deletes the shuffle files of finished jobs with it."""
    for path in tables:
        if path in _TABLES and path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            _TABLES.remove(path)
    gc.collect()
    spark._jvm.System.gc()


def roots(df: DataFrame) -> list[str]:
    """Folders of the files that a plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            out += [paths.apply(x).toString() for x in range(paths.size())]
    return out


def named(columns: list[str]) -> list[Column]:
    """Columns by their literal names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def n_words(text: Column) -> Column:
    """Number of words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket(n, *cols) -> Column:
    """0 .. n-1 by the hash of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(n) if isinstance(n, int) else n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0], _POW[1]


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array; a NULL is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return o, b


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (a longer text is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, one past the last, row (from 0) and 64-bit hash of every word, in
    order of the texts.  A-Z are lower-cased."""
    offsets, data = string_buffers(col)
    for i, j in row_chunks(offsets):
        o = offsets[i:j + 1] - offsets[i]
        b = _LOWER[data[offsets[i]:offsets[j]]]
        n = len(b)
        if not n:
            yield i, j, np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        solid = ~_WS[b]
        edge = np.zeros(n + 1, bool)
        edge[o] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:n]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[:n], out=total[1:])
        yield i, j, np.searchsorted(o, s, "right") - 1, mix64((total[e] - total[s]) * inverse[s])


_SH = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(row: np.ndarray, word: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words as (row, 64-bit id), ordered by both; a text of fewer words has
    its whole sequence as one shingle; one without words has none."""
    if not len(word):
        return row[:0], word[:0]
    count = np.bincount(row, minlength=rows)
    length = np.minimum(count, k)[row]
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    start = place <= count[row] - length
    at, size = np.flatnonzero(start), length[start]
    h = size.astype(np.uint64) * _SH[15]
    for d in range(k):
        inside = size > d
        h[inside] += word[at[inside] + d] * _SH[d]
    h, r = mix64(h), row[at]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]

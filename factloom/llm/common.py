"""Shared pieces: table access, bounded Arrow slices, vectorised word hashes, packed exchanges.

A word is ``[^\\x20\\x09-\\x0D]+``. Words, shingles and set classes are carried as 64- or
128-bit hashes made from random byte tables, so equal strings always get equal hashes and
different ones collide with a chance of about pairs / 2**64.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, table

__all__ = ["cut", "table"]

#: Text bytes that one numpy step handles; a longer document is one step of its own.
STEP_BYTES = 2 << 20
#: The same for steps that hold many numbers for each byte: an executor's memory is shared with its workers.
FINE_BYTES = 1 << 19
WORD = r"[^\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _return_memory() -> None:
    """Arrays of 1 MB or more go back to the system when they are freed.

    Left alone, the C library raises that limit to 32 MB as it runs, and a worker keeps what its
    largest task has used. All threads share one arena, and its end goes back when it is free.
    """
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        for name, value in ((-3, 1 << 20), (-1, 1 << 20), (-8, 1)):
            libc.mallopt(name, value)
        pa.set_memory_pool(pa.system_memory_pool())


def trim() -> None:
    """What a worker's tasks before this one have freed goes back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_return_memory()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so they can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        # The driver serves the file for as long as it runs; executors fetch it from the driver.
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, True)
        path = f"{folder}/{root.name}_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python stay small in bytes as well as in rows, so long texts don't add up."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def among(df: DataFrame, h: Column, keys: DataFrame, name: str, bits: int = 25) -> DataFrame:
    """df with a column that is true where the hash h is one of keys (h), and elsewhere with chance n / 2**bits at n keys.

    What is broadcast are 2**bits bits as at most 2**(bits - 6) long integers, whatever the number
    of keys; with many keys more rows are let through to the exact join that follows.
    """
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftrightunsigned(slot, 6).alias("_slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("_slot").agg(F.bit_or("bit").alias("_bits"))
    own = h.bitwiseAND(F.lit((1 << bits) - 1))
    rows = df.withColumn("_h", own).withColumn("_slot", F.shiftrightunsigned(F.col("_h"), 6))
    rows = rows.join(F.broadcast(cut(words)), "_slot", "left")
    test = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_h & 63 as int)) & 1L") == 1, F.lit(False))
    return rows.withColumn(name, test).drop("_h", "_slot", "_bits")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, renamed so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = next((s for s in (FINE_BYTES, STEP_BYTES) if s >= n), n) + 1
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def slices(texts: pa.Array | pa.ChunkedArray, budget: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about budget bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    if len(texts) == 0:
        return
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
        yield lo, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], the same wherever the bytes stand."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of every word; words never cross rows. lower folds A-Z only."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e
    full = ~SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1] | edge[1:-1]
    end[:-1] &= ~full[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return span_hashes(LOWER[buf] if lower else buf, starts, ends), starts, ends, rows


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row; a row of 1 to k-1 words is one shingle."""
    if len(h) >= k:
        inside = rows[: len(h) - k + 1] == rows[k - 1 :]
        acc = np.zeros(len(inside), np.uint64)
        for i in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(inside)]
        sh, sr = mix(acc[inside]), rows[: len(inside)][inside]
    else:
        sh, sr = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=n_rows)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(counts)])
        own = []
        for r in few:
            acc = np.zeros(1, np.uint64)
            for x in h[first[r] : first[r + 1]]:
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + x
            own.append(mix(acc + np.uint64(int(counts[r]) << 1 | 1))[0])
        sh, sr = np.concatenate([sh, np.array(own, np.uint64)]), np.concatenate([sr, few])
    return sh, sr


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted: one flat array and n_rows + 1 offsets."""
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    return v, np.searchsorted(r, np.arange(n_rows + 1))


def split_by(part: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups by part, and the n_parts + 1 offsets of the groups."""
    order = np.argsort(part.astype(np.uint16 if n_parts < 65536 else np.uint32), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """An even spread of hash keys over parts, from their upper bits."""
    return ((keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)

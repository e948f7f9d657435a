"""Words, their 64-bit hashes and hash windows, vectorised over many texts at once.

A word is a maximal run of bytes other than space and U+0009..U+000D in UTF-8. Its hash mixes each
eight of its bytes with their place before they are added up, so that no pattern of letters makes
words collide by rule, as it can with a polynomial modulo a power of two. These helpers
run inside Spark tasks on a few megabytes at a time; nothing here starts a job, except
``total_bytes`` and ``shared_dir``, which the driver calls.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 500_000
NULL_ID = np.iinfo(np.int64).max

_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_POWERS = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-geoloom-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's address; a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri if ":" in uri else os.path.abspath(uri))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def pieces_for(n_bytes: int, each: int) -> int:
    """How many pieces of about ``each`` bytes hold ``n_bytes``."""
    return max(1, math.ceil(n_bytes / each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 1 << 21:  # a table for one very long text is not kept
            _POWERS[base] = have
    return have[:n]


def utf8(value) -> bytes:
    return b"" if value is None else value if isinstance(value, bytes) else value.encode("utf-8", "surrogatepass")


def padded(texts: list[bytes], lower: bool = False) -> np.ndarray:
    """The texts' bytes, a space after each, and eight more bytes that belong to none."""
    data = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << 5) if lower else data


def lanes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place in padded data as one integer, zeros behind ``size`` bytes."""
    every = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return every[at] & _MASKS.take(np.minimum(size, 8))


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each piece data[start:end] of padded data; another (even) seed gives another hash."""
    by_size, by_place = np.uint64(0xD6E8FEB86659FD93 ^ seed), np.uint64(0x9E3779B97F4A7C15 ^ seed)
    size = end - start
    out = mix(lanes(data, start, size) ^ (size.astype(np.uint64) * by_size))
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8
        begin = np.cumsum(more) - more
        owner = np.repeat(long, more)
        place = np.arange(len(owner)) - np.repeat(begin, more) + 1
        found = lanes(data, start[owner] + 8 * place, size[owner] - 8 * place)
        found = mix(found ^ mix(place.astype(np.uint64) * by_place))
        out[long] = mix(out[long] + np.add.reduceat(found, begin))
    return out


class Words:
    """The words of a list of texts: hashes (uint64) in order, and first[i]:first[i + 1] are those of text i."""

    def __init__(self, texts: list[bytes], lower: bool, hashed: bool = True):
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=offsets[1:])
        self.data = padded(texts, lower)
        shown = self.data[:-8]
        space = (shown == 0x20) | (shown - np.uint8(9) < 5)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # starts and ends take turns; the last byte is a space
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            self.hashes = hashes_of(self.data, self.start, self.end)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of ``size`` items, modulo 2**64, spread by ``mix``.

    Each comes from the one before: take the first item off, add the next. The prefix sums do
    this for all windows at once.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes), base), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(n, pow(base, -1, 1 << 64)))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The set of ``size``-word shingles as sorted 64-bit hashes; shorter sequences count as one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes, min(size, len(hashes)), 0xC2B2AE3D27D4EB4F))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    done, out = 1, values
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[:-step] if step else out, out[step:])
        done += step
    return out


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Integer ids; a null becomes the largest integer, so it comes after every other."""
    return column.cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def slices(texts: Iterable, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of about ``limit`` bytes; a longer text is a run alone."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = utf8(text)
        if run and size + len(text) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(text)
        size += len(text) + 1
    if run:
        yield first, run

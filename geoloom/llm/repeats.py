"""Which 64-bit keys occur in more than one document: counted in Spark, carried in packed blocks.

Documents are dealt into batches by a hash of their id and, where many rows may hold one id or none, of
what else tells them apart. A batch sends each distinct key once, with
its smallest document id, to the bucket of the key's leading bits; a bucket finds the keys that
several documents hold and answers each batch with those, and the smallest id of all. Blocks of
sorted keys travel as one binary value, differences by byte plane, so a key costs about six bytes
of shuffle, and a key that a third of all documents hold costs one entry a batch. Where 64 bits may
not tell all keys apart, each carries a second hash, its check, and counts as the same only with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.text import pieces_for

BATCH_BYTES, BUCKET_BYTES, LEAST = 4 << 20, 16 << 20, 256
PACKED = "bucket int, batch int, keys binary, docs binary, several binary, checks binary"
ANSWER = "batch int, keys binary, docs binary, checks binary"


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def batches_of(n_bytes: int) -> int:
    return max(LEAST, pieces_for(n_bytes, BATCH_BYTES))


def bucket_bits(n_bytes: int) -> int:
    return max(LEAST, pieces_for(n_bytes, BUCKET_BYTES)).bit_length() - 1


def with_batch(docs: DataFrame, n: int, *by: str) -> DataFrame:
    return docs.select(F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias("batch"), "*")


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal neighbours."""
    if not len(x):
        return []
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _sorted(keys: np.ndarray, checks: np.ndarray | None, *others: np.ndarray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """keys, checks and the others in order of all of them, and where each key (with its check) begins."""
    order = np.lexsort((*others[::-1], keys) if checks is None else (*others[::-1], checks, keys))
    keys, checks, *others = (x if x is None else x[order] for x in (keys, checks, *others))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    if checks is not None:
        fresh[1:] |= checks[1:] != checks[:-1]
    return [keys, checks, *others], np.flatnonzero(fresh)


def packed(batch: int, keys: np.ndarray, docs: np.ndarray, bits: int, checks: np.ndarray | None = None) -> pa.Table:
    """The batch's rows of schema PACKED for its (key, document) occurrences, of any order: distinct
    keys in order, the smallest document of each, and whether it has several."""
    (keys, checks, docs), first = _sorted(keys, checks, docs)
    last = np.append(first[1:], len(keys))[: len(first)] - 1
    several = docs[last] > docs[first]
    keys, docs = keys[first], docs[first]
    checks = None if checks is None else checks[first]
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    rows = [(int(bucket[a]), batch, pack_sorted(keys[a:b]), planes(docs[a:b]), several[a:b].tobytes(), b"" if checks is None else planes(checks[a:b])) for a, b in runs(bucket)]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "batch", "keys", "docs", "several", "checks"])


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray | None]:
    """Keys block by block; all keys, documents and, where there are any, checks."""
    blocks = [unpack_sorted(x.as_py()) for x in table["keys"]]
    docs = np.concatenate([from_planes(x.as_py(), np.int64) for x in table["docs"]])
    checks = np.concatenate([from_planes(x.as_py()) for x in table["checks"]])
    return blocks, np.concatenate(blocks), docs, checks if len(checks) else None


def _answers(table: pa.Table) -> pa.Table:
    blocks, keys, docs, checks = _unpacked(table)
    owner = np.repeat(table["batch"].to_numpy(), [len(k) for k in blocks])
    several = np.concatenate([np.frombuffer(x.as_py(), np.bool_) for x in table["several"]])
    (keys, checks, docs, owner, several), first = _sorted(keys, checks, docs, owner, several)
    counts = np.diff(np.append(first, len(keys)))
    low = np.repeat(docs[first], counts)
    # several batches, but one and the same id in all of them, is no repeat
    last = np.append(first[1:], len(keys)) - 1
    keep = np.flatnonzero(np.repeat((docs[last] > docs[first]) | np.logical_or.reduceat(several, first), counts))
    keep = keep[np.argsort(owner[keep], kind="stable")]
    keys, low, owner = keys[keep], low[keep], owner[keep]
    checks = None if checks is None else checks[keep]
    rows = [(int(owner[a]), pack_sorted(keys[a:b]), planes(low[a:b]), b"" if checks is None else planes(checks[a:b])) for a, b in runs(owner)]
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["batch", "keys", "docs", "checks"])


def repeated(blocks: DataFrame) -> DataFrame:
    """From rows of schema PACKED: for each batch, its keys that several documents hold, and the smallest document of each."""
    return blocks.groupBy("bucket").applyInArrow(_answers, ANSWER)


def known(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """All of a batch's answers: sorted keys, the smallest document of each, and the checks, if any."""
    if not table.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64), None
    _, keys, docs, checks = _unpacked(table)
    (keys, checks, docs), _ = _sorted(keys, checks, docs)
    return keys, docs, checks


def places(keys: np.ndarray, checks: np.ndarray, own: np.ndarray, own_checks: np.ndarray) -> np.ndarray:
    """Where each own key stands among sorted keys with the same check, or -1."""
    if not len(keys):
        return np.full(len(own), -1)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    while True:  # keys that are equal but for their check stand side by side
        on = (keys[at] == own) & (checks[at] != own_checks) & (at + 1 < len(keys))
        if not on.any():
            return np.where((keys[at] == own) & (checks[at] == own_checks), at, -1)
        at[on] += 1


def rows_of(table: pa.Table, column: str) -> Iterator[bytes]:
    return (x.as_py() for x in table[column])

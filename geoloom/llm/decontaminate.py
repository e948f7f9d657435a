"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

Benchmark items are partitioned by the size of their shingle set (powers of two). For a partition
of items of at most u shingles, documents are seen as overlapping windows of 2 * u shingles, one
every u, so that an item meets sets of its own order of size and even a short item in a long
document has a high similarity with one window. An item is a candidate where one of ``n_hashes``
minhashes equals a window's. Candidates are verified by exact containment: share[1] * |item and
document| >= share[0] * |item|, over the whole document's shingle set. An item copied at 0.8 is missed
with a probability below 0.000002.

Items are broadcast in blocks of a bounded size (``block_bytes`` of text), one pass over the
documents per block. Words are lower-cased (A-Z); a text with fewer words than a shingle is one
shingle, so such an item is found in documents of just its words. Empty items and empty or null
documents match nothing. Rows of equal id are judged each; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.minhash_dedup import _coefficients, shingle_sets
from geoloom.llm.text import Words, in_sorted, new_folder, pieces_for, rolling, slices, total_bytes

LEAST_CLASS = 3
FILTER_BITS = 16


def _coarse(keys: np.ndarray) -> np.ndarray:
    """Which leading bits occur among the keys."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[keys >> np.uint64(64 - FILTER_BITS)] = True
    return out


def _matches(values: np.ndarray, whose: np.ndarray, keys: np.ndarray, members: np.ndarray, coarse: np.ndarray) -> list[tuple[int, int]]:
    """(text, item) where a value of the text is one of the sorted keys, with the item it belongs to."""
    may = np.flatnonzero(coarse[values >> np.uint64(64 - FILTER_BITS)])
    may = may[in_sorted(values[may], keys)]
    found: list[tuple[int, int]] = []
    if len(may):
        lo, hi = np.searchsorted(keys, values[may]), np.searchsorted(keys, values[may], side="right")
        for w, x, y in zip(whose[may].tolist(), lo.tolist(), hi.tolist(), strict=True):
            found += [(w, int(i)) for i in members[x:y]]
    return found


class Items:
    """A block of benchmark items: sets, and minhash tables by size class."""

    def __init__(self, ids: list, texts: list[bytes], words: int, n_hashes: int):
        self.words, self.ids = words, ids
        self.a, self.b = _coefficients(n_hashes)
        self.sets = list(shingle_sets(texts, words))
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        classes: dict[int, list[int]] = {}
        few = [i for i, own in enumerate(self.sets) if 0 < len(own) <= 1 << LEAST_CLASS]
        shingle, member = np.concatenate([np.empty(0, np.uint64), *(self.sets[i] for i in few)]), np.repeat(few, [len(self.sets[i]) for i in few]).astype(np.int64)
        order = np.argsort(shingle, kind="stable")
        self.few = (shingle[order], member[order], _coarse(shingle))
        for i, own in enumerate(self.sets):
            if len(own) > 1 << LEAST_CLASS:
                classes.setdefault((len(own) - 1).bit_length(), []).append(i)
        for c, members in classes.items():
            mins = np.array([(self.a[:, None] * self.sets[i][None, :] + self.b[:, None]).min(axis=1) for i in members])
            rows = []
            for p in range(n_hashes):
                order = np.argsort(mins[:, p], kind="stable")
                rows.append((mins[order, p], np.array(members)[order], _coarse(mins[:, p])))
            self.tables[c] = rows

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, Words]:
        """Distinct (text, item) pairs of which a window and the item share a minhash."""
        found = Words(texts, lower=True)
        n = np.maximum(np.diff(found.first) - self.words + 1, 0)
        short = (n == 0) & (np.diff(found.first) > 0)
        size = np.where(short, 1, n)
        if not size.sum() or not (self.tables or len(self.few[0])):
            return np.empty((0, 2), np.int64), found
        full = rolling(found.hashes, self.words, 0xC2B2AE3D27D4EB4F)
        values = np.empty(int(size.sum()), np.uint64)
        ends = np.cumsum(size)
        text = np.repeat(np.arange(len(texts)), size)
        at = np.arange(len(values)) - (ends - size)[text] + found.first[:-1][text]
        long = ~short[text]
        values[long] = full[at[long]]
        for i in np.flatnonzero(short):
            own = found.of(i)
            values[ends[i] - 1] = rolling(own, len(own), 0xC2B2AE3D27D4EB4F)[0]
        base = 1 << LEAST_CLASS
        blocks = -(-size // base)
        owner = np.repeat(np.arange(len(texts)), blocks)
        within = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]
        starts = (ends - size)[owner] + within * base
        pairs = _matches(values, text, *self.few)
        for p in range(len(self.a) if self.tables else 0):
            mins = np.minimum.reduceat(values * self.a[p] + self.b[p], starts)
            whose, place = owner, within
            for c in range(LEAST_CLASS, max(self.tables) + 1):
                if c > LEAST_CLASS:  # two neighbouring blocks of a text become one of twice the size
                    first = np.flatnonzero(place % 2 == 0)
                    nxt = np.minimum(first + 1, len(mins) - 1)
                    paired = (whose[nxt] == whose[first]) & (nxt > first)
                    mins = np.where(paired, np.minimum(mins[first], mins[nxt]), mins[first])
                    whose, place = whose[first], place[first] // 2
                if c in self.tables:
                    window = mins.copy()
                    same = whose[1:] == whose[:-1]
                    window[:-1][same] = np.minimum(mins[:-1], mins[1:])[same]
                    pairs += _matches(window, whose, *self.tables[c][p])
        return (np.unique(np.array(pairs, np.int64), axis=0) if pairs else np.empty((0, 2), np.int64)), found

    def contained(self, texts: list[bytes], share: tuple[int, int]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of the verified pairs."""
        pairs, found = self.candidates(texts)
        out, last, own = [], -1, None
        for t, i in pairs.tolist():
            if t != last:
                h = found.of(t)
                last, own = t, np.unique(rolling(h, min(self.words, len(h)), 0xC2B2AE3D27D4EB4F))
            shared = int(in_sorted(self.sets[i], own).sum())
            if share[1] * shared >= share[0] * len(self.sets[i]):
                out.append((t, i, shared))
        return out


def _blocks(items: DataFrame, words: int, n_hashes: int, block_bytes: int, id_col: str, text_col: str) -> Iterator:
    n = pieces_for(total_bytes(items, text_col), block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k).select(id_col, F.encode(text_col, "UTF-8").alias("text")).orderBy(id_col, "text")
        held = part.toArrow()  # one block: about block_bytes
        ids, texts = held[id_col].to_pylist(), [x or b"" for x in held["text"].to_pylist()]
        block = items.sparkSession.sparkContext.broadcast(Items(ids, texts, words, n_hashes))
        yield block, n > 1
        if n > 1:
            block.destroy()


def _written(found: DataFrame) -> DataFrame:
    """found, computed now and read back from the shared folder."""
    folder = new_folder(found.sparkSession, "decontaminated")
    found.write.parquet(folder)
    return found.sparkSession.read.schema(found.schema).parquet(folder)


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), n_hashes: int = 64, block_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_id, n_shared, n_item): every item that a document contains. No shuffle of the documents."""
    texts = docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    kinds = [docs.schema[id_col].dataType, items.schema[item_id].dataType, T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip([id_col, item_id, "n_shared", "n_item"], kinds, strict=True)])
    out = None
    for block, several in _blocks(items, words, n_hashes, block_bytes, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            held = block.value
            for batch in batches:
                for first, part in slices(x.as_py() for x in batch.column(1)):
                    found = held.contained(part, share)
                    if found:
                        t, i, shared = zip(*found, strict=True)
                        item_ids = pa.array([held.ids[x] for x in i], batch_kind)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([first + x for x in t])), item_ids, pa.array(shared, pa.int64()), pa.array([len(held.sets[x]) for x in i], pa.int64())], schema.names)

        batch_kind = _arrow_type(items.schema[item_id].dataType)
        part = texts.mapInArrow(run, schema)
        part = _written(part) if several else part
        out = part if out is None else out.unionByName(part)
    return out


def _arrow_type(kind: T.DataType) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "short": pa.int16(), "string": pa.string()}[kind.typeName()]


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), n_hashes: int = 64, block_bytes: int = 16 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns. No shuffle."""
    names = docs.columns
    for block, several in _blocks(items, words, n_hashes, block_bytes, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            at = names.index(text_col)
            for batch in batches:
                for first, part in slices(x.as_py() for x in batch.column(at)):
                    keep = np.ones(len(part), bool)
                    keep[[t for t, _, _ in block.value.contained(part, share)]] = False
                    yield batch.slice(first, len(part)).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        docs = _written(docs) if several else docs
    return docs

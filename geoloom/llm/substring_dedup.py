"""Operator 1: substring dedup by Rabin-Karp hashes of every window of ``window`` words.

A window of a document is removed if its word sequence also starts in a document with a smaller
id; removed windows merge into maximal intervals of words. Windows are judged on the input.

Every window is hashed, but only those that can repeat are sent around. A window's mark is the
smallest Rabin-Karp hash among its runs of ``run`` words; equal windows have equal marks, and
neighbouring windows mostly share theirs, so marks are about one word in eighteen. First the marks
are counted, then the full hashes of the windows whose mark several documents hold, then the
repeated hashes go back to their documents. The sieve loses nothing. All three steps read the
texts from one shuffle. A window counts as repeated only where two hashes of it, 128 bits in all,
agree; both are made of the same 64-bit hashes of its words.

Ids are whole numbers; others are a TypeError. Documents are dealt by id and text, so many rows of a null
or repeated id are many batches. Null and empty texts have no words; they and texts shorter than a window lose nothing. A null id
counts as larger than all others. Rows of equal id keep what they share with each other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import repeats
from geoloom.llm.text import Words, ids_of, in_sorted, mix, rolling, sliding_min, slices, total_bytes

RUN_BASE, WINDOW_BASE, CHECK_BASE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


def _checks(words: Words, window: int) -> np.ndarray:
    """A second hash of each window, from other word hashes and another base."""
    return rolling(mix(words.hashes ^ np.uint64(0x589965CC75374CC3)), window, CHECK_BASE)


def _windows(texts: list[bytes], window: int, run: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; start, text and mark of each whole window."""
    words = Words(texts, lower=False)
    per_text = np.maximum(np.diff(words.first) - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), per_text)
    begin = np.cumsum(per_text) - per_text
    start = np.arange(len(text)) - begin[text] + words.first[:-1][text]
    if not len(start):
        return words, start, text, np.empty(0, np.uint64)
    return words, start, text, sliding_min(rolling(words.hashes, run, RUN_BASE), window - run + 1)[start]


def substring_dedup(docs: DataFrame, window: int = 50, run: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, removed array<struct<start, end>>, kept): a row for each row of docs.

    ``removed`` has the maximal intervals of removed word positions, end exclusive; ``kept`` is the
    words left, joined by one space.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    n_bytes = total_bytes(docs, text_col)
    bits = repeats.bucket_bits(n_bytes)
    keyed = docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    texts = repeats.with_batch(keyed, repeats.batches_of(n_bytes), "id", "text")

    def marks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, found, owners = ids_of(table["id"]), [], []
        for first, part in slices(repeats.rows_of(table, "text")):
            _, _, text, mark = _windows(part, window, run)
            fresh = np.ones(len(mark), bool)
            fresh[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
            found.append(mark[fresh])
            owners.append(ids[first + text[fresh]])
        return repeats.packed(key[0].as_py(), np.concatenate(found), np.concatenate(owners), bits)

    def hashes(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        shared, _, _ = repeats.known(answer)
        ids, found, checks, owners = ids_of(table["id"]), [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for first, part in slices(repeats.rows_of(table, "text")):
            words, start, text, mark = _windows(part, window, run)
            may = in_sorted(mark, shared)
            if may.any():
                found.append(rolling(words.hashes, window, WINDOW_BASE)[start[may]])
                checks.append(_checks(words, window)[start[may]])
                owners.append(ids[first + text[may]])
        return repeats.packed(key[0].as_py(), np.concatenate(found), np.concatenate(owners), bits, np.concatenate(checks))

    def cut(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        again, lowest, again_checks = repeats.known(answer)
        ids, out = ids_of(table["id"]), []
        for first, part in slices(repeats.rows_of(table, "text")):
            words = Words(part, lower=False)
            full = rolling(words.hashes, window, WINDOW_BASE)
            hit = np.flatnonzero(in_sorted(full, again))
            least = np.full(len(full), np.iinfo(np.int64).max)
            if len(hit):
                place = repeats.places(again, again_checks, full[hit], _checks(words, window)[hit])
                least[hit[place >= 0]] = lowest[place[place >= 0]]
            for i, text in enumerate(part):
                a, b = words.first[i], words.first[i + 1]
                gone = np.flatnonzero(least[a : max(a, b - window + 1)] < ids[first + i])
                if not len(gone):
                    out.append((b - a, 0, [], b" ".join(text.split())))
                    continue
                breaks = np.flatnonzero(np.diff(gone) > window)
                starts, ends = gone[np.concatenate([[0], breaks + 1])], gone[np.append(breaks, len(gone) - 1)] + window
                keep = np.ones(b - a, bool)
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    keep[x:y] = False
                intervals = [{"start": x, "end": y} for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                out.append((b - a, int((ends - starts).sum()), intervals, b" ".join(itertools.compress(text.split(), keep.tolist()))))
        n_words, n_removed, removed, kept = zip(*out, strict=True) if out else ((), (), (), ())
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        arrays = [table["id"].combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())]
        return pa.table(arrays, ["id", "n_words", "n_removed", "removed", "kept"])

    first = repeats.repeated(texts.groupBy("batch").applyInArrow(marks, repeats.PACKED))
    second = repeats.repeated(texts.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(hashes, repeats.PACKED))
    schema = T.StructType([keyed.schema["id"], *T._parse_datatype_string("n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept binary").fields])
    found = texts.groupBy("batch").cogroup(second.groupBy("batch")).applyInArrow(cut, schema)
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "removed", F.decode("kept", "UTF-8").alias("kept"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))

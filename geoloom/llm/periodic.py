"""Operator 13: periodic runs of words by sparse diagonal dynamic programming.

A run is a stretch of words with smallest period q, at least ``max(least, 2 * q)`` long, that no
neighbouring word extends. A pair (word, earlier occurrence of it) lies on the diagonal of its lag; a diagonal's match
length grows by one with each next pair on it, and where it ends with length at least
``max(least - q, q)`` it is a run of period q, unless a smaller period has the same stretch.

The matrix is kept sparse by context: a run of period q matches itself for q words or more, so a pair
counts as an occurrence only where the words before agree as well, as many as the lag's level asks for. Lags below
``least`` are looked at one by one; level c = least, 2 * least, ... has the lags from c to 2 * c and asks for
c words. Words without such an earlier occurrence take no part in higher levels, so ordinary text is left early.
Windows of c words inside a run of period up to c / 2 (known from the levels below) would meet at every multiple of
that period: they open no diagonals. A word of any other window has at most three earlier occurrences in its level. What only
such windows could show is a run across the border of two runs of one period that touch; those diagonals
are opened from the border. So the work is about n log n for any text, also for one word repeated.

Texts are read chunk by chunk inside tasks, without a shuffle. Null, empty and short texts have no
runs. Rows are judged alone, so ids play no role: null and repeated ones keep their rows. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import Words, in_sorted, mix, rolling, slices

BASE = 0xDA942042E4DD58B5
STEP = 64


def _place(block: np.ndarray, root: np.ndarray) -> int | None:
    """Where the root first stands in the block."""
    data, wanted, at = block.tobytes(), root.tobytes(), 0
    while (at := data.find(wanted, at)) >= 0:
        if at % 8 == 0:
            return at // 8
        at += 1
    return None


class Diagonals:
    """Runs of a sequence of words (as hashes); ``owner`` tells the texts apart, which lie one behind the other."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, least: int):
        self.words, self.owner, self.least = words, owner, least
        self.start, self.length, self.period = (np.empty(0, np.int64) for _ in range(3))

    def _emit(self, first: np.ndarray, last: np.ndarray, lag: np.ndarray) -> None:
        """Ended diagonals: words first..last equal those ``lag`` before; the long ones are runs, a stretch's smallest period first."""
        m = last - first + 1
        keep = m >= np.maximum(self.least - lag, lag)
        start, length, period = (first - lag)[keep], (m + lag)[keep], lag[keep]
        start, length, period = (np.concatenate(x) for x in ((self.start, start), (self.length, length), (self.period, period)))
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        self.start, self.length, self.period = start[new], length[new], period[new]

    def _small_lags(self) -> None:
        w = self.words
        for lag in range(1, min(self.least, len(w))):
            at = np.flatnonzero((w[lag:] == w[:-lag]) & (self.owner[lag:] == self.owner[:-lag])) + lag
            if len(at):
                cut = np.flatnonzero(np.diff(at) != 1)
                first, last = at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)]
                self._emit(first, last, np.full(len(first), lag))

    def _end(self, at: int, lag: int, step: int) -> int:
        """The last word from ``at`` on, forward or backward, that equals the one ``lag`` before it."""
        w, owner, n = self.words, self.owner, STEP
        while True:
            if step > 0:
                a, b = at + 1, min(at + 1 + n, len(w))
            else:
                a, b = max(lag, at - n), at
            same = (w[a:b] == w[a - lag : b - lag]) & (owner[a:b] == owner[a - lag : b - lag])
            if step < 0:
                same = same[::-1]
            good = len(same) if same.all() else int(same.argmin())
            at += step * good
            if good < n:
                return at
            n *= 2

    def _grow(self, at: np.ndarray, lag: np.ndarray) -> None:
        """Follows the diagonals through the matches (at, lag) from where they begin to where they end."""
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        opens = np.ones(len(at), bool)
        opens[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        first, last, kept, covered, on = [], [], [], -1, -1
        for i, q in zip(at[opens].tolist(), lag[opens].tolist(), strict=True):
            if q == on and i <= covered:
                continue
            on, covered = q, self._end(i, q, 1)
            first.append(self._end(i, q, -1))
            last.append(covered)
            kept.append(q)
        self._emit(*(np.array(x, np.int64) for x in (first, last, kept)))

    def _in_runs(self, at: np.ndarray, c: int) -> np.ndarray:
        """Whether the c words that end at each place lie in a run of period up to c / 2."""
        use = (self.period <= c // 2) & (self.length >= c)
        depth = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(depth, self.start[use] + c - 1, 1)
        np.add.at(depth, self.start[use] + self.length[use], -1)
        return np.cumsum(depth)[at] > 0

    def _borders(self, c: int) -> None:
        """Diagonals with lags from c to 2 * c across the border of two touching runs of one period up to c / 2."""
        w, use = self.words, np.flatnonzero((self.period <= c // 2) & (self.length >= c))
        use = use[np.lexsort((self.start[use], self.period[use]))]
        a, b = use[:-1], use[1:]
        near = (self.period[a] == self.period[b]) & (self.start[b] <= self.start[a] + self.length[a])
        at, lags = [], []
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            p, s, end = int(self.period[i]), int(self.start[j]), int(self.start[i] + self.length[i])
            if self.owner[s] != self.owner[end - 1]:
                continue
            back = _place(w[end - 2 * p : end], w[s : s + p])
            if back is None:
                continue
            lag = s - (end - 2 * p + back)  # the second run's words stand in the first at this lag, and every p more
            lag += -(-(c - lag) // p) * p
            for q in range(lag, min(2 * c, int(self.length[i]) + p), p):
                k = max(s, int(self.start[i]) + q)
                if k < min(end + q, s + int(self.length[j])):
                    at.append(k)
                    lags.append(q)
        if at:
            self._grow(np.array(at, np.int64), np.array(lags, np.int64))

    def find(self) -> None:
        w, c = self.words, self.least
        self._small_lags()
        if len(w) < 2 * c:
            return
        gram = rolling(w, c, BASE)
        at = np.arange(c - 1, len(w))
        inside = self.owner[at] == self.owner[at - c + 1]
        at, gram = at[inside], gram[inside] ^ mix(self.owner[at[inside]].astype(np.uint64) + np.uint64(1))
        while True:
            # windows that occur again in their text
            ordered = np.sort(gram)
            again = in_sorted(gram, np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))
            at, gram = at[again], gram[again]
            if not len(at):
                return
            free = ~self._in_runs(at, c)
            where, key = at[free], gram[free]
            order = np.argsort(key, kind="stable")
            where, key = where[order], key[order]
            found, lags = [], []
            for s in (1, 2, 3):
                lag = where[s:] - where[:-s]
                pair = (key[s:] == key[:-s]) & (lag >= c) & (lag < 2 * c)
                found.append(where[s:][pair])
                lags.append(lag[pair])
            self._grow(np.concatenate(found), np.concatenate(lags))
            self._borders(c)
            # windows twice as long: both halves occur again
            half = np.searchsorted(at, at - c)
            both = at[np.minimum(half, len(at) - 1)] == at - c
            at, gram = at[both], mix(gram[half[both]] * np.uint64(0x9FB21C651E98DF25) ^ mix(gram[both] + np.uint64(c)))
            c *= 2

    def dropped(self) -> np.ndarray:
        """Whether some run holds each word behind its first ``period`` words."""
        depth = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(depth, self.start + self.period, 1)
        np.add.at(depth, self.start + self.length, -1)
        return np.cumsum(depth[:-1]) > 0


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs array<struct<start, length, period>> by start and period, collapsed): a row for each row of docs.

    ``collapsed`` is the text without the words that a run repeats, joined by one space.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at, part in slices(x.as_py() for x in batch.column("text")):
                words = Words(part, lower=False)
                first = words.first
                n_words = np.diff(first)
                seen = Diagonals(words.hashes, np.repeat(np.arange(len(part)), n_words), least)
                seen.find()
                order = np.lexsort((seen.period, seen.start))
                start, length, period = seen.start[order], seen.length[order], seen.period[order]
                begin = np.searchsorted(start, first)
                own = np.repeat(first[:-1], np.diff(begin))
                spans = pa.StructArray.from_arrays([pa.array(start - own), pa.array(length), pa.array(period)], fields=list(run))
                runs = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), spans)
                gone = seen.dropped()
                kept = []
                for i, text in enumerate(part):
                    given = text.split()
                    if begin[i + 1] > begin[i]:
                        given = itertools.compress(given, (~gone[first[i] : first[i + 1]]).tolist())
                    kept.append(b" ".join(given))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(part)), pa.array(n_words), runs, pa.array(kept, pa.binary())], ["id", "n_words", "runs", "kept"])

    schema = T.StructType([keyed.schema["id"], *T._parse_datatype_string("n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary").fields])
    found = keyed.mapInArrow(find, schema)
    return found.select(F.col("id").alias(id_col), "n_words", "runs", F.decode("kept", "UTF-8").alias("collapsed"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    top = found.withColumns({"_top": longest, "_listed": F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")})
    return top.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.start")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.period")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode("_listed", "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )

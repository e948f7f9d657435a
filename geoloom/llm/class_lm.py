"""Operator 5: a Brown class-based bigram model, learnt and scored on whole texts.

Tokens are lower-cased (A-Z) words and one end per text. log10 P(text) is the sum over tokens of
P(class | class before) * P(token | class), both smoothed; the class before a text's first token is
that of the end.

Counts cover every training token: each word's count comes from one distributed count over all of
them. Words are known by 64-bit hashes. Every training word has a class of its own choice:

1. Exchange clustering sorts the ``core`` most frequent words (and the end): sweep by sweep each
   word goes to the class that most raises the likelihood of the class bigrams, from the full matrix
   of their bigram counts, which Spark adds up over all training texts (core**2 cells at most).
2. All other words, however rare, get the class that best explains the classes left and right of
   their occurrences, with the class bigrams of the core held fixed, in two rounds: the first sees
   neighbours from the core, the second all neighbours, by the classes of the first.

Classes are a Spark table with a row for each training word. What stands beside head words is
counted by each task and sent packed, a group of words at a time. Class bigrams are then counted over all
training texts. Words, counts and classes of the ``head`` most frequent are broadcast, for speed
alone: 17 bytes each at most. Rarer words are looked up by joins on their hash, for which the pairs
of neighbours with such a word are written out once; none of these words is frequent, so no key is hot.
Words never trained on have a class of their own that only the smoothing fills.

Null and empty texts consist of the end alone. Rows with a null id are scored, not trained on. With no training
text every class is empty and the smoothing alone gives the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.repeats import runs
from geoloom.llm.text import Words, checkpointed, new_folder, slices

END = np.uint64(0x5851F42D4C957F2D)
SMALL = 0.1
HELD = 1_000_000
NONE = -1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words; and where each text starts (one more entry than texts)."""
    words = Words(texts, lower=True)
    n = len(texts)
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = words.hashes
    return out, first


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("text"))


def _chunks(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at, texts in slices(x.as_py() for x in batch.column(column)):
            yield batch.slice(at, len(texts)), *tokens(texts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): occurrences of every token of the texts; each task sums up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for _, found, _ in _chunks(batches):
            held.append(found)
            size += len(found)
            if size > HELD:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """The most frequent words, sorted by hash, with counts; ``rank`` is the place by frequency."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts, self.rank = words[order], counts[order], order.astype(np.int32)
        bits = max(1, len(words).bit_length())  # hashes are even, so leading bits tell the place but for a word or two
        self.shift = np.uint64(64 - bits)
        self.starts = np.append(np.searchsorted(self.words, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(words)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among ``words``, or -1."""
        out = np.full(len(hashes), -1)
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        left = np.flatnonzero(at < end)
        at = at[left]
        while len(left):
            same = self.words[at] == hashes[left]
            out[left[same]] = at[same]
            left, at = left[~same], at[~same] + 1
            more = at < end[left]
            left, at = left[more], at[more]
        return out


def _pair_counts(texts: DataFrame, carried, n_core: int) -> np.ndarray:
    """Bigram counts among the core words, as a matrix by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, cells = carried.value, np.zeros(n_core * n_core, np.int32)
        for _, found, first in _chunks(batches):
            at = head.find(found)
            rank = np.where(at >= 0, head.rank[at], n_core)
            before = np.empty_like(rank)
            before[1:] = rank[:-1]
            before[first[:-1]] = head.rank[head.find(np.array([END]))[0]]
            both = (rank < n_core) & (before < n_core)
            cells += np.bincount(before[both] * np.int64(n_core) + rank[both], minlength=n_core * n_core).astype(np.int32)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at].astype(np.int64))], ["cell", "n"])

    summed = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_core * n_core)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(n_core, n_core)


def exchange(pairs: np.ndarray, n_classes: int, sweeps: int = 6) -> np.ndarray:
    """Exchange clustering of words 0 .. n-1 from their bigram counts: a class for each.

    Words start in classes by frequency rank modulo ``n_classes`` and move one at a time to where
    sum N(c, d) log N(c, d) - sum N(c) log N(c) over left and right totals is largest.
    """
    n = len(pairs)
    cls = np.arange(n) % n_classes
    left, right = np.zeros((n, n_classes)), np.zeros((n, n_classes))  # counts of a word after, before each class
    for c in range(n_classes):
        left[:, c] = pairs[cls == c].sum(0)
        right[:, c] = pairs[:, cls == c].sum(1)
    table = np.zeros((n_classes, n_classes))
    for c in range(n_classes):
        table[c] = right[cls == c].sum(0)

    def plogp(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(sweeps):
        moves = 0
        for w in range(n):
            old, own = cls[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            r[old] -= own
            l[old] -= own
            table[old] -= r
            table[:, old] -= l
            table[old, old] -= own
            rows, columns = table.sum(1), table.sum(0)
            gain = plogp(table + r[None, :]).sum(1) - plogp(table).sum(1) + plogp(table + l[:, None]).sum(0) - plogp(table).sum(0)
            d = np.diagonal(table)
            gain += plogp(d + r + l + own) - plogp(d + r) - plogp(d + l) + plogp(d)
            gain -= plogp(rows + r.sum() + own) - plogp(rows) + plogp(columns + l.sum() + own) - plogp(columns)
            new = int(np.argmax(gain))
            table[new] += r
            table[:, new] += l
            table[new, new] += own
            if new != old:
                moves += 1
                cls[w] = new
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
        if moves < max(1, n // 200):
            break
    return cls


#: A context row is either one count of a class beside a rare word (spot: its hash), or all a task
#: counted beside the GROUP head words of one group (spot: the group), cells and counts packed.
CONTEXTS = "packed boolean, spot long, side int, n long, cells binary, counts binary"
GROUP = 128


def _bytes_of(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all of them, which packs well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Tally:
    """Counts of classes beside head words, by cell (word * 2k + side), as packed context rows."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(cells)
        self.size += len(cells)
        if self.size > HELD:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            cell, n = np.unique(np.concatenate(self.held), return_counts=True)
            group, within = np.divmod(cell, 2 * self.k * GROUP)
            parts = [(int(group[a]), _bytes_of(within[a:b]), _bytes_of(n[a:b])) for a, b in runs(group)]
            spot, cells, counts = zip(*parts, strict=True)
            none = [None] * len(parts)
            columns = [pa.array([True] * len(parts)), pa.array(spot, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int64()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, CONTEXT_NAMES)
        self.held, self.size = [], 0


CONTEXT_NAMES = ["packed", "spot", "side", "n", "cells", "counts"]


def _rare_pairs(texts: DataFrame, carried) -> DataFrame:
    """(key, other, side, rare): for every occurrence of a word beyond the head, the neighbours; the word stands left (side 0) or right (1) of other; ``rare`` if other is beyond the head too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = carried.value
        for _, found, first in _chunks(batches):
            rare = head.find(found) < 0
            left = np.roll(found, 1)
            left[first[:-1]] = END
            at = np.flatnonzero(rare)  # never the end, so a next token follows in the same text
            key, other = np.concatenate([found[at], found[at]]), np.concatenate([found[at + 1], left[at]])
            side = np.repeat(np.array([0, 1], np.int8), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), pa.array(side), pa.array(head.find(other) < 0)], ["key", "other", "side", "rare"])

    folder = new_folder(texts.sparkSession, "rare-pairs")
    shape = "key long, other long, side byte, rare boolean"
    texts.mapInArrow(run, shape).write.parquet(folder)
    return texts.sparkSession.read.schema(shape).parquet(folder)


def _contexts(texts: DataFrame, carried, by_hash: np.ndarray, n_core: int, k: int) -> DataFrame:
    """Contexts of the head words beyond the core: how often each class stands left (side 0 .. k - 1) and right (k ..) of a word; neighbours of class -1 don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tally = carried.value, _Tally(k)
        for _, found, first in _chunks(batches):
            at = head.find(found)
            open_ = (at >= 0) & (head.rank[at] >= n_core)
            cls = np.where(at >= 0, by_hash[at], -1).astype(np.int64)
            before, after = np.full(len(cls), -1), np.full(len(cls), -1)
            before[1:], after[:-1] = cls[:-1], cls[1:]
            before[first[:-1]] = by_hash[head.find(np.array([END]))[0]]
            for side, shift in ((before, 0), (after, k)):
                use = open_ & (side >= 0)
                yield from tally.add(at[use] * (2 * k) + side[use] + shift)
        yield from tally.rows()

    return texts.mapInArrow(run, CONTEXTS)


def _rare_contexts(pairs: DataFrame, carried, by_hash: np.ndarray, n_core: int, k: int) -> DataFrame:
    """Contexts as above from rare pairs (key, other, side, cls): of each key by its head neighbours and, where the key has a class, of each other beyond the core by the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tally = carried.value, _Tally(k)
        for batch in batches:
            key, other, side, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            at = head.find(other.view(np.uint64))
            cls = np.where(at >= 0, by_hash[at], -1).astype(np.int64)
            known, free = cls >= 0, (own >= 0) & (at < 0)
            word = np.concatenate([key[known], other[free]])
            place = np.concatenate([cls[known] + k * (side[known] == 0), own[free] + k * (side[free] == 1)])
            n, empty = len(word), pa.nulls(len(word), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(word), pa.array(place.astype(np.int32)), pa.array(np.ones(n, np.int64)), empty, empty], CONTEXT_NAMES)
            free = (own >= 0) & (at >= 0) & (head.rank[at] >= n_core)
            yield from tally.add(at[free] * (2 * k) + own[free] + k * (side[free] == 1))
        yield from tally.rows()

    return pairs.select("key", "other", F.col("side").cast("int").alias("side"), F.col("cls").cast("int").alias("cls")).mapInArrow(run, CONTEXTS)


def _chosen(contexts: DataFrame, weights: np.ndarray, carried) -> DataFrame:
    """(word, cls): for each word of the contexts the class that best explains them; ties go to the lower class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(weights)
        last = None  # the rare word whose rows may go on in the next batch, with its counts
        group, table = None, np.zeros((GROUP, width))  # the same for a group of head words

        def best(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.argmax(np.round(counts @ weights, 6), 1).astype(np.int32))], ["word", "cls"])

        def grouped() -> pa.RecordBatch:
            at = np.flatnonzero(table.any(1))
            return best(carried.value.words[group * GROUP + at].view(np.int64), table[at])

        for batch in batches:
            packed = batch.column(0).to_numpy(zero_copy_only=False)
            split = int(packed.sum())  # packed rows come first
            for spot, cells, counts in zip(*(batch.column(c).slice(0, split) for c in (1, 4, 5)), strict=True):
                spot = spot.as_py()
                if spot != group:
                    if group is not None:
                        yield grouped()
                    group = spot
                    table[:] = 0
                table.reshape(-1)[_numbers_of(cells.as_py())] += _numbers_of(counts.as_py())
            if split == batch.num_rows:
                continue
            word, side, n = (batch.column(c).slice(split).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            words, at = np.unique(word, return_inverse=True)
            counts = np.bincount(at * width + side.astype(np.int64), n, len(words) * width).reshape(len(words), width)
            if last and last[0] == words[0]:
                counts[0] += last[1]
            elif last:
                yield best(np.array([last[0]]), last[1][None])
            last = (words[-1], counts[-1])
            if len(words) > 1:
                yield best(words[:-1], counts[:-1])
        if group is not None:
            yield grouped()
        if last:
            yield best(np.array([last[0]]), last[1][None])

    return contexts.repartition("packed", "spot").sortWithinPartitions(F.desc("packed"), "spot").mapInArrow(run, "word long, cls int")


def _head_floor(counts: DataFrame, head: int) -> tuple[int, int]:
    """(n, share): about ``head`` words, at most, are more frequent than n, or of n occurrences and of a hash below share modulo 2**20."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])  # sqrt(2 * tokens) rows at most
    together = np.cumsum(sizes["words"].to_numpy())
    fits = int(np.searchsorted(together, head, side="right"))
    if fits == sizes.num_rows:
        return 0, 0
    left = head - (int(together[fits - 1]) if fits else 0)
    return sizes["n"][fits].as_py(), (left << 20) // sizes["words"][fits].as_py()


def fit(texts: DataFrame, n_classes: int = 48, core: int = 1500, head: int = 1 << 19) -> dict:
    """The model from (id, text) rows; ``classes`` in it is the table (word, n, cls) of all words."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    counts = checkpointed(word_counts(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    floor, share = _head_floor(counts, head)
    in_head = (F.col("n") > floor) | ((F.col("n") == floor) & (F.pmod("word", F.lit(1 << 20)) < share)) | (F.col("word") == int(END.view(np.int64)))
    top = counts.where(in_head).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # about ``head`` rows
    words, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy().astype(np.int64)
    end = np.flatnonzero(words == END)
    if len(end):  # the end always belongs to the core
        order = np.concatenate([end, np.delete(np.arange(len(words)), end)])
        words, n = words[order], n[order]
    known = Head(words, n)
    unseen = n_classes  # the class of words that were not trained on
    k = n_classes + 1
    by_hash = np.full(len(words), -1, np.int16)
    bigrams = np.zeros((k, k))
    class_n, class_v = np.zeros(k), np.zeros(k)
    classes = counts.withColumn("cls", F.lit(0))
    if len(words):
        carried = sc.broadcast(known)
        n_core = min(core, len(words))
        pairs = _pair_counts(texts, carried, n_core)
        core_class = exchange(pairs, n_classes)
        in_core = known.rank < n_core
        by_hash[in_core] = core_class[known.rank[in_core]]
        fixed = spark.createDataFrame(pa.table({"_core": pa.array(known.words[in_core].view(np.int64)), "_cls": pa.array(by_hash[in_core].astype(np.int32))}))
        rare = _rare_pairs(texts, carried)

        def table(chosen: DataFrame | None, otherwise: int) -> DataFrame:
            found = counts.join(F.broadcast(fixed), F.col("word") == F.col("_core"), "left")
            own = F.lit(otherwise)
            if chosen is not None:
                found = found.join(chosen.withColumnsRenamed({"word": "_word", "cls": "_own"}), F.col("word") == F.col("_word"), "left")
                own = F.coalesce("_own", own)
            return checkpointed(found.select("word", "n", F.coalesce("_cls", own).cast("int").alias("cls")))

        def of_head(classes: DataFrame) -> np.ndarray:
            """The classes of the head words, in their order."""
            got = classes.where(in_head).select("word", "cls").toArrow()
            out = np.empty(len(known.words), np.int16)
            out[known.find(got["word"].to_numpy().view(np.uint64))] = got["cls"].to_numpy()
            return out

        if distinct > n_core:
            cells = np.full((n_classes, n_classes), SMALL)
            for c in range(n_classes):
                for d in range(n_classes):
                    cells[c, d] += pairs[np.ix_(core_class == c, core_class == d)].sum()
            forward = np.log(cells / cells.sum(1, keepdims=True))  # left class -> own class
            backward = forward.T  # right class -> own class
            weights = np.concatenate([forward, backward], 0)
            usual = int(np.argmax(cells.sum(1)))
            near = rare.withColumn("cls", F.lit(-1))
            for _ in range(2):
                seen = _contexts(texts, carried, by_hash, n_core, n_classes).unionByName(_rare_contexts(near, carried, by_hash, n_core, n_classes))
                classes = table(_chosen(seen, weights, carried), usual)
                by_hash = of_head(classes)
                near = _with_class(rare, classes, "key")
        else:
            classes = table(None, 0)
            near = _with_class(rare, classes, "key")
        bigrams[:n_classes, :n_classes] = _transitions(texts, near, classes, carried, by_hash, n_classes)
        carried.destroy()  # all that reads it has run
        for c, sum_n, sum_v in classes.groupBy("cls").agg(F.sum("n"), F.count(F.lit(1))).collect():
            class_n[c], class_v[c] = sum_n, sum_v
    move = np.log10((bigrams + SMALL) / (bigrams.sum(1, keepdims=True) + SMALL * k))
    return {"known": known, "cls": by_hash, "k": k, "unseen": unseen, "move": move, "class_n": class_n, "class_v": class_v, "total": int(total), "distinct": int(distinct), "classes": classes}


def _with_class(rows: DataFrame, classes: DataFrame, column: str) -> DataFrame:
    """The rows with the class ``cls`` of the word in the column."""
    found = classes.select(F.col("word").alias("_word"), "cls")
    return rows.join(found, F.col(column) == F.col("_word")).drop("_word")


def _transitions(texts: DataFrame, near: DataFrame, classes: DataFrame, carried, by_hash: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams over all tokens: pairs of head words from the texts, the others from the rare pairs with their key's class."""

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carried.value
        cells = np.zeros(k * k, np.int64)
        for _, found, first in _chunks(batches):
            c = _classes(known, by_hash, found, -1)
            before = _before(c, first, known, by_hash, -1)
            both = (c >= 0) & (before >= 0)
            cells += np.bincount(before[both] * k + c[both], minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(cells)], ["cell", "n"])

    def from_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carried.value
        cells = np.zeros(k * k, np.int64)
        for batch in batches:
            other, side, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            c = _classes(known, by_hash, other.view(np.uint64), -1)
            cells += np.bincount(np.where(side == 0, own * np.int64(k) + c, c * k + own), minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(cells)], ["cell", "n"])

    shape = "cell long, n long"
    single = near.where("NOT rare").select("other", F.col("side").cast("int").alias("side"), "cls").mapInArrow(from_pairs, shape)
    both = near.where("rare AND side = 0").select("other", F.col("cls").alias("_left"))  # each such pair is there from both sides
    double = _with_class(both, classes, "other").groupBy((F.col("_left").cast("long") * k + F.col("cls")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    summed = texts.mapInArrow(from_texts, shape).unionByName(single).unionByName(double).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(k, k)


def _classes(known: Head, by_hash: np.ndarray, found: np.ndarray, other: int) -> np.ndarray:
    at = known.find(found)
    return np.where(at >= 0, by_hash[at], other).astype(np.int64) if len(by_hash) else np.full(len(found), other, np.int64)


def _before(c: np.ndarray, first: np.ndarray, known: Head, by_hash: np.ndarray, other: int) -> np.ndarray:
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[first[:-1]] = _classes(known, by_hash, np.array([END]), other)[0]
    return before


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), a row for each row of docs; base_score is the smoothed unigram model's."""
    sc = docs.sparkSession.sparkContext
    plain = sc.broadcast({x: y for x, y in model.items() if x != "classes"})
    rows = _texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = plain.value
        known, unseen = m["known"], m["unseen"]
        floor = np.log10(m["total"] + SMALL * (m["distinct"] + 1))
        base_of = np.log10(known.counts + SMALL) - floor
        emit_of = np.log10(known.counts + SMALL) - np.log10(m["class_n"][m["cls"]] + SMALL * (m["class_v"][m["cls"]] + 1))
        for part, found, first in _chunks(batches):
            at = known.find(found)
            seen = at >= 0
            if len(known.words):
                c, base, step = np.where(seen, m["cls"][at], -1).astype(np.int64), np.where(seen, base_of[at], 0.0), np.where(seen, emit_of[at], 0.0)
            else:  # no word was trained on; each is looked up in vain
                c, base, step = np.full(len(found), -1, np.int64), np.zeros(len(found)), np.zeros(len(found))
            before = _before(c, first, known, m["cls"], unseen)
            step = step + np.where(seen & (before >= 0), m["move"][before, c], 0.0)
            start, n = first[:-1], np.diff(first)
            rare = np.flatnonzero(~seen)
            owner = np.searchsorted(first, rare, side="right") - 1
            left, after = before[rare], np.minimum(rare + 1, len(found) - 1)
            right = np.where(after < first[owner + 1], c[after], NONE)
            right[rare == len(found) - 1] = NONE
            ahead = np.where(left >= 0, np.int64(0), np.roll(found, 1).view(np.int64)[rare])
            edges = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (found[rare].view(np.int64), left.astype(np.int32), np.where(right < 0, NONE, right).astype(np.int32), ahead)]
            sums = [np.add.reduceat(x, start) for x in (seen.astype(np.int64), base, step)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), *[pa.array(x) for x in sums], *lists], names)

    names = ["id", "row", "n_tokens", "n_known", "base", "step", "word", "left", "right", "ahead"]
    long, double, some = T.LongType(), T.DoubleType(), T.ArrayType
    kinds = [kind, long, long, long, double, double, some(long), some(T.IntegerType()), some(T.IntegerType()), some(long)]
    found = checkpointed(rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])))
    plain.destroy()
    small = {x: model[x] for x in ("move", "class_n", "class_v", "total", "distinct")}  # by class, a few thousand numbers
    each = found.select("row", F.explode(F.arrays_zip("word", "left", "right", "ahead")).alias("x")).select("row", "x.*")
    table = model["classes"].select(F.col("word").alias("_word"), "n", "cls")
    # a word after another rare word: its class is looked up, and the move between them added to the right one
    joined = lambda a, on: a.join(table, F.col(on) == F.col("_word"), "left")
    second = joined(each.where("left < 0").select("row", "word", "ahead"), "ahead").select("row", "word", F.coalesce("cls", F.lit(model["unseen"])).cast("int").alias("left"), F.lit(NONE).alias("right"), F.lit(0).alias("times"))
    first_ = each.select("row", "word", F.when(F.col("left") >= 0, F.col("left")).otherwise(NONE).cast("int").alias("left"), "right", F.lit(1).alias("times"))
    looked = joined(first_.unionByName(second), "word").select("row", "left", "right", "times", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("cls", F.lit(model["unseen"])).cast("int").alias("cls"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = small
        floor = np.log10(m["total"] + SMALL * (m["distinct"] + 1))
        room = np.log10(m["class_n"] + SMALL * (m["class_v"] + 1))
        for batch in batches:
            row, left, right, times, n, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            log_n = np.log10(n + SMALL)
            step = times * (log_n - room[c]) + np.where(left >= 0, m["move"][left, c], 0.0) + np.where(right >= 0, m["move"][c, right], 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, times * (n > 0).astype(np.int64), times * (log_n - floor), step)], ["r", "known", "rbase", "rstep"])

    looked = looked.mapInArrow(add, "r long, known long, rbase double, rstep double").groupBy("r").agg(*[F.sum(c).alias(c) for c in ("known", "rbase", "rstep")])
    both = found.select("id", "row", "n_tokens", "n_known", "base", "step").join(looked, F.col("row") == F.col("r"), "left")
    added = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select(F.col("id").alias(id_col), "n_tokens", added("n_known", "known").alias("n_known"), added("base", "rbase").alias("base_score"), added("step", "rstep").alias("score"))


def held_out(id_col: str = "doc_id", parts: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Learns from the rows that aren't held out and scores all: score()'s columns, held_out and train_tokens."""
    training = docs.where(~held_out(id_col) & F.col(id_col).isNotNull())
    model = fit(_texts(training, id_col, text_col), **settings)
    return score(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col)).withColumn("train_tokens", F.lit(model["total"]).cast("long"))

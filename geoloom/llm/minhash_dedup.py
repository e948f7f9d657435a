"""Operator 2: near-duplicate documents by MinHash with tensored banding, verified on full sets.

Two collections of ``m`` short sketches of ``t`` minhashes each are computed; a table's key joins
sketch i of the first collection and sketch j of the second, so m * m tables of 2 * t rows need
only 2 * m * t minhashes. Two documents meet unless one of the collections misses them altogether.

Every document is verified against the smallest document of each of its buckets, its centre. Where
that leaves the documents of a centre in several components, those of different components are
compared with each other, except within the largest: with x and y in one bucket of centre c, the
symmetric difference of x and y is that of (x - c) and (y - c), so the short differences that the
first comparison left suffice, and no set is sent again. Distance from the centre (1 - similarity is a metric) and
size rule out most pairs first. All of it happens in blocks of bounded size, and only links come
out. No link between different components of a bucket is lost. Documents with equal shingle sets are
one node from the start.

A document's set holds the distinct ``words``-word shingles of its lower-cased (A-Z) words; with
fewer words, the whole sequence; without words or text it is empty and linked with nothing. Rows of
equal id are one document, linked where any of them is; rows with a null id stay by themselves
(component null, kept). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import repeats
from geoloom.llm.text import Words, checkpointed, ids_of, in_sorted, mix, rolling, slices
from geoloom.operators.graph import components


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Each text's set as sorted 64-bit hashes."""
    found = Words(texts, lower=True)
    full = rolling(found.hashes, words, 0xC2B2AE3D27D4EB4F)
    for i in range(len(texts)):
        a, b = int(found.first[i]), int(found.first[i + 1])
        if b - a >= words:
            yield np.unique(full[a : b - words + 1])
        else:
            yield rolling(found.hashes[a:b], b - a, 0xC2B2AE3D27D4EB4F) if b > a else np.empty(0, np.uint64)


def sketches(docs: DataFrame, words: int, n_hashes: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, lo, hi, mins): set size, a 128-bit hash of the set, and its minhashes (32 bits each)."""
    a, b = _coefficients(n_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(x.as_py() for x in batch.column(1)):
                n, lo, hi, mins = [], [], [], []
                for own in shingle_sets(texts, words):
                    n.append(len(own))
                    lo.append(mix(own ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64))
                    hi.append(mix(own ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64))
                    least = np.full(n_hashes, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(own), 4096):
                        least = np.minimum(least, (a[:, None] * own[None, at : at + 4096] + b[:, None]).min(axis=1))
                    mins.append((least >> np.uint64(32)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(np.array(lo, np.uint64).view(np.int64)), pa.array(np.array(hi, np.uint64).view(np.int64)), pa.array(mins, pa.binary())], ["id", "n", "lo", "hi", "mins"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    return keyed.mapInArrow(run, "id long, n long, lo long, hi long, mins binary")


def table_keys(mins: np.ndarray, m: int, t: int) -> np.ndarray:
    """(documents, m * m) keys from (documents, 2 * m * t) minhashes."""
    sums = np.zeros((len(mins), 2 * m), np.uint64)
    for k in range(t):
        sums = mix(sums + mins[:, k::t].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    left, right = sums[:, :m], sums[:, m:]
    cell = np.arange(m * m, dtype=np.uint64).reshape(m, m) * np.uint64(0xD6E8FEB86659FD93)
    return mix(left[:, :, None] * np.uint64(3) + right[:, None, :] * np.uint64(5) + cell).reshape(len(mins), -1)


def _held_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hashes): the full sets of the wanted documents (column want)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(x.as_py() for x in batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([x.tobytes() for x in shingle_sets(texts, words)], pa.binary())], ["id", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    return checkpointed(texts.join(wanted, F.col("id") == F.col("want"), "left_semi").mapInArrow(run, "id long, hashes binary"))


def _compared(pairs: DataFrame, held: DataFrame, share: tuple[int, int]) -> DataFrame:
    """pairs (a, b) with linked (share[1] * |A and B| >= share[0] * |A or B|), |B|, the similarity, and the symmetric difference."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, size, similar, differ = [], [], [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                d = np.setxor1d(x, y, assume_unique=True)
                both, any_ = (len(x) + len(y) - len(d)) // 2, (len(x) + len(y) + len(d)) // 2
                linked.append(both > 0 and share[1] * both >= share[0] * any_)
                size.append(len(y))
                similar.append(both / max(1, any_))
                differ.append(d.tobytes())
            columns = [pa.array(linked, pa.bool_()), pa.array(size, pa.int64()), pa.array(similar, pa.float64()), pa.array(differ, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "linked", "n", "similar", "differ"])

    left = pairs.join(held, pairs.b == held.id).select("a", "b", F.col("hashes").alias("hb"))
    right = held.select(F.col("id").alias("ida"), F.col("hashes").alias("ha"))
    found = left.join(right, left.a == right.ida).select("a", "b", "ha", "hb")
    return checkpointed(found.mapInArrow(compare, "a long, b long, linked boolean, n long, similar double, differ binary"))


def _across(compared: DataFrame, parts: DataFrame, share: tuple[int, int], block: int) -> DataFrame:
    """(a, b): the links between documents of one centre that lie in different components."""
    labelled = compared.join(parts, F.col("b") == F.col("node"), "left").select("a", "b", "n", "similar", "differ", F.coalesce("component", "b").alias("part"))
    labelled = checkpointed(labelled)
    sizes = labelled.groupBy("a", "part").agg(F.count(F.lit(1)).alias("c"))
    stats = sizes.groupBy("a").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    pieces = lambda n: F.ceil(n / F.lit(block)).cast("int")
    stats = checkpointed(stats.select(F.col("a").alias("centre"), F.col("top.part").alias("most"), pieces(F.col("all")).alias("pieces"), pieces(F.col("all") - F.col("top.c")).alias("strays")))
    both = labelled.join(stats, F.col("a") == F.col("centre")).withColumn("stray", F.col("part") != F.col("most"))
    columns = ["a", "i", "j", "b", "n", "similar", "differ", "part", "stray"]
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = both.where("stray").withColumn("i", F.pmod(F.xxhash64("b", F.lit(1)), F.col("strays")).cast("int")).withColumn("j", upto("pieces")).select(*[F.col(c).alias(f"own_{c}") for c in columns])
    right = both.withColumn("j", F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int")).withColumn("i", upto("strays")).select(columns)

    def cross(own: pa.Table, other: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and other.num_rows:
            ids, n, similar, part, stray = (other[c].to_numpy() for c in ("b", "n", "similar", "part", "stray"))
            differ = [np.frombuffer(x.as_py(), np.uint64) for x in other["differ"]]
            lengths = np.array([len(x) for x in differ])
            flat, edges = np.concatenate(differ), np.concatenate([[0], np.cumsum(lengths)])
            for x in own.to_pylist():
                d = np.frombuffer(x["own_differ"], np.uint64)
                b, size = x["own_b"], x["own_n"]
                may = (part != x["own_part"]) & ~(stray & (ids < b)) & (share[1] * np.minimum(n, size) >= share[0] * np.maximum(n, size))
                may &= np.abs(similar - x["own_similar"]) <= 1 - share[0] / share[1] + 1e-9
                if may.any():
                    common = np.concatenate([[0], np.cumsum(in_sorted(flat, d))])
                    apart = len(d) + lengths - 2 * (common[edges[1:]] - common[edges[:-1]])
                    both, any_ = (n + size - apart) // 2, (n + size + apart) // 2
                    found += [(b, int(y)) for y in ids[may & (both > 0) & (share[1] * both >= share[0] * any_)]]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ("a", "i", "j")
    return left.groupBy(*[f"own_{k}" for k in keys]).cogroup(right.groupBy(*keys)).applyInArrow(cross, "a long, b long")


def sketches_for(share: tuple[int, int], t: int, miss: float = 0.0002) -> int:
    """How many sketches a collection needs so that two documents just at the threshold meet but for a chance of ``miss``."""
    m, alike = 1, (share[0] / share[1]) ** t
    while 1 - (1 - (1 - alike) ** m) ** 2 > miss:
        m += 1
    return m


def near_duplicates(docs: DataFrame, words: int = 5, share: tuple[int, int] = (80, 100), m: int | None = None, t: int = 3, block: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept), a row for each row of docs; links where share[1] * |A and B| >= share[0] * |A or B|.

    Unless given, m is such that two documents just at the threshold meet in one of the m * m tables
    with a probability of 0.9998: 10 for 0.85, 13 for 0.8. The more alike, the surer: of 0.9, more than 0.99999.
    """
    m = m or sketches_for(share, t)
    sketched = checkpointed(sketches(docs, words, 2 * m * t, id_col, text_col))
    n_rows = sketched.count()
    some = sketched.where("n > 0 AND id IS NOT NULL")
    equal = ["lo", "hi", "n"]
    firsts = checkpointed(some.groupBy(*equal).agg(F.min("id").alias("first")).select(*[F.col(c).alias(f"f_{c}") for c in equal], "first"))
    classed = checkpointed(some.join(firsts, [F.col(c) == F.col(f"f_{c}") for c in equal]).select("id", "n", "mins", "first"))
    several = classed.where("id = first").select("id", "mins")
    n_batches, bits = repeats.batches_of(n_rows * m * m * 8), repeats.bucket_bits(n_rows * m * m * 8)
    keyed = repeats.with_batch(several, n_batches, "id")

    def band(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        mins = np.frombuffer(b"".join(x.as_py() for x in table["mins"]), "<u4").reshape(table.num_rows, -1)
        return ids_of(table["id"]), table_keys(mins, m, t)

    def emit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, keys = band(table)
        return repeats.packed(key[0].as_py(), keys.reshape(-1), np.repeat(ids, keys.shape[1]), bits)

    def to_centre(key: tuple[pa.Scalar, ...], table: pa.Table, answer: pa.Table) -> pa.Table:
        shared, low, _ = repeats.known(answer)
        pairs = np.empty((0, 2), np.int64)
        if table.num_rows and len(shared):
            ids, keys = band(table)
            keys, ids = keys.reshape(-1), np.repeat(ids, keys.shape[1])
            at = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
            hit = (shared[at] == keys) & (low[at] != ids)
            pairs = np.unique(np.stack([low[at], ids], 1)[hit], axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    answers = checkpointed(repeats.repeated(keyed.groupBy("batch").applyInArrow(emit, repeats.PACKED)))
    pairs = keyed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(to_centre, "a long, b long")
    pairs = checkpointed(pairs.distinct())
    held = _held_sets(docs, pairs.select(F.col("a").alias("want")).union(pairs.select("b")).distinct(), words, id_col, text_col)
    compared = _compared(pairs, held, share)
    linked = compared.where("linked").select("a", "b")
    more = checkpointed(_across(compared, components(linked), share, block))
    parts = components(linked.unionByName(more))
    rooted = classed.select("id", "n", "first").join(parts, F.col("first") == F.col("node"), "left").select("id", F.coalesce("component", "first").alias("root"))
    own = rooted.groupBy("id").agg(F.min("root").alias("root"))
    lone = sketched.where("n = 0 OR id IS NULL").select("id", F.lit(None).cast("long").alias("root"))
    by_id = checkpointed(own.unionByName(lone).groupBy("id").agg(F.min("root").alias("root")))
    out = sketched.select("id", "n").join(by_id.select(F.col("id").alias("rid"), "root"), F.col("id") == F.col("rid"), "left")
    component = F.coalesce("root", "id")
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

"""Operator 12: line dedup by levelled sorted runs of line hashes.

A line's key is the line without white space (space, U+0009..U+000D) at both ends, A-Z lower-cased.
``Runs`` counts in how many documents each key (128 bits of hash) occurs. It is a log-structured set: a run is a
bucketed table sorted by hash; a new batch of documents is first anti-joined with the keys that the
runs already know to be common, which need no more counting, and the rest becomes a run of level 0.
``fanout`` runs of one level are compacted into one of the next, so a key is rewritten as often as
there are levels. Runs of equal buckets merge bucket by bucket, without a shuffle.

``line_dedup`` feeds all documents to the runs in ``batches`` batches, merges what is left and
drops the lines of every common key. Common keys are broadcast if they number at most ``most_broadcast``;
beyond that they go to their documents by a join, with the same result.

Every row is a document of its own, also rows of null or repeated ids. Null and empty texts have
one empty line. Keys of fewer than ``min_chars`` code points are never dropped. Counts are made inside a task first, so a line
that most documents hold is a row a chunk, not a row a document.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import CHUNK_BYTES, hashes_of, new_folder, pieces_for, slices, total_bytes

SECOND_HASH = 0x3C79AC492BA7B653 << 1 & (1 << 64) - 1
BUCKET_BYTES, LEAST_BUCKETS = 2 << 30, 8


class Lines:
    """The lines of a list of texts: two hashes of each line's key, its text, and whether its key counts."""

    def __init__(self, texts: list[bytes], min_chars: int):
        data = np.frombuffer(b"\n".join(texts) + b"\n" + b" " * 8, np.uint8)
        end = np.flatnonzero(data[:-8] == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        stop = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.text = np.searchsorted(stop, end, side="right")
        solid = np.flatnonzero(~((data == 0x20) | (data - np.uint8(9) < 5)))
        edges = np.append(solid, len(data))
        first = np.minimum(edges[np.searchsorted(solid, start)], end)
        last = np.concatenate([[-1], solid])[np.searchsorted(solid, end)] + 1
        last = np.maximum(last, first)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.counts = (chars[last] - chars[first] >= max(1, min_chars)) & (last > first)
        low = data | ((data - np.uint8(65) < 26).view(np.uint8) << 5)
        self.h = hashes_of(low, first, last).view(np.int64)
        self.g = hashes_of(low, first, last, SECOND_HASH).view(np.int64)


def _counts(texts: Iterator[bytes], min_chars: int, chunk: int) -> Iterator[pa.Table]:
    """(h, g, n): in how many of a chunk's texts each key occurs."""
    for _, part in slices(texts, chunk):
        lines = Lines(part, min_chars)
        h, g, text = lines.h[lines.counts], lines.g[lines.counts], lines.text[lines.counts]
        order = np.lexsort((text, g, h))
        h, g, text = h[order], g[order], text[order]
        new_key = np.ones(len(h), bool)
        new_key[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        new_text = new_key.copy()
        new_text[1:] |= text[1:] != text[:-1]
        at = np.flatnonzero(new_key)
        yield pa.table({"h": h[at], "g": g[at], "n": np.add.reduceat(new_text.astype(np.int64), at) if len(at) else np.empty(0, np.int64)})


class Runs:
    """Levelled runs of (h, g, n): key and number of documents. ``levels[k]`` names the tables of level k."""

    def __init__(self, spark: SparkSession, least: int, buckets: int = LEAST_BUCKETS, fanout: int = 2):
        self.spark, self.least, self.buckets, self.fanout = spark, least, buckets, fanout
        self.folder, self.levels = new_folder(spark, "line-runs"), [[]]

    def _written(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "h").sortBy("h", "g").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("n", "_n")
            out = out.join(other.hint("merge"), ["h", "g"], "full").select("h", "g", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
        return out

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch's (h, g, n); a key may have several rows."""
        fresh = batch.groupBy("h", "g").agg(F.sum("n").alias("n"))
        for name in self.tables():
            fresh = fresh.join(self.spark.table(name).where(F.col("n") >= self.least).select("h", "g"), ["h", "g"], "left_anti")
        self.levels[0].append(self._written(fresh.repartition(self.buckets, "h")))
        self._compact()

    def _compact(self) -> None:
        for k in itertools.count():
            if len(self.levels[k]) < self.fanout:
                return
            if len(self.levels) == k + 1:
                self.levels.append([])
            old, self.levels[k] = self.levels[k], []
            self.levels[k + 1].append(self._written(self._merged(old)))
            self._forget(old)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def common(self) -> DataFrame:
        """(h, g) of the keys that at least ``least`` documents hold, as a written table; ends the runs."""
        path = f"{self.folder}/common"
        names = self.tables()
        self._merged(names).where(F.col("n") >= self.least).select("h", "g").write.parquet(path)
        self._forget(names)
        return self.spark.read.parquet(path)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_py() for x in batch.column("text"))


def _dropped(part: list[bytes], lines: Lines, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(lines, dropped lines, what is left) of each text."""
    n_lines = np.bincount(lines.text, minlength=len(part))
    n_gone = np.bincount(lines.text[gone], minlength=len(part))
    first = np.cumsum(n_lines) - n_lines
    for i, text in enumerate(part):
        if n_gone[i]:
            text = b"\n".join(itertools.compress(text.split(b"\n"), (~gone[first[i] : first[i] + n_lines[i]]).tolist()))
        yield int(n_lines[i]), int(n_gone[i]), text


def _among(h: np.ndarray, g: np.ndarray, keys_h: np.ndarray, keys_g: np.ndarray) -> np.ndarray:
    """Which (h, g) occur among the keys, sorted by (h, g)."""
    found = np.zeros(len(h), bool)
    at, end = np.searchsorted(keys_h, h), len(keys_h)
    open_ = np.flatnonzero(at < end)
    while len(open_):  # keys of equal h stand side by side
        open_ = open_[keys_h[at[open_]] == h[open_]]
        found[open_] |= keys_g[at[open_]] == g[open_]
        at[open_] += 1
        open_ = open_[at[open_] < end]
    return found


def line_dedup(
    docs: DataFrame, least: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, most_broadcast: int = 1 << 20, chunk: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_lines, n_dropped, kept): a row for each row of docs, without the lines whose key at least ``least`` rows hold.

    ``chunk`` is about how many bytes of text are counted together before the shuffle.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b"")).alias("text"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in enumerate(t for p in parts for t in _counts(_texts(p), min_chars, chunk)):
            # every chunk goes whole to one of the batches
            yield from table.append_column("batch", pa.array(np.full(len(table), (number + int(table["h"][0].as_py()) if len(table) else 0) % batches, np.int32))).to_batches()

    staged = new_folder(spark, "line-keys")
    keyed.select("text").mapInArrow(count, "h long, g long, n long, batch int").write.partitionBy("batch").parquet(staged)
    runs = Runs(spark, least, max(LEAST_BUCKETS, pieces_for(total_bytes(docs, text_col), BUCKET_BYTES)), fanout)
    keys = spark.read.schema("h long, g long, n long, batch int").parquet(staged)
    for batch in range(batches):
        runs.add(keys.where(F.col("batch") == batch))
    common = runs.common()

    result = T.StructType([keyed.schema["id"], *T._parse_datatype_string("n_lines long, n_dropped long, kept binary").fields])

    def table_of(ids: pa.Array, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "n_lines", "n_dropped", "kept"])

    if common.count() <= most_broadcast:
        known = common.toArrow()
        h, g = known["h"].to_numpy(), known["g"].to_numpy()
        order = np.lexsort((g, h))
        sent = spark.sparkContext.broadcast((h[order], g[order]))

        def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                rows = []
                for _, part in slices(_texts(batch)):
                    lines = Lines(part, min_chars)
                    rows += _dropped(part, lines, lines.counts & _among(lines.h, lines.g, *sent.value))
                yield table_of(batch.column("id"), rows)

        found = keyed.mapInArrow(drop, result)
    else:
        found = _dropped_by_join(keyed, common, min_chars, table_of, result)
    return found.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.decode("kept", "UTF-8").alias("kept"))


def _dropped_by_join(keyed: DataFrame, common: DataFrame, min_chars: int, table_of, result: T.StructType) -> DataFrame:
    """The same where the common keys are too many to broadcast: texts are named by 128 bits of hash, equal texts lose equal lines."""
    named = keyed.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), "text")})

    def keys_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            t, u = batch.column("t").to_numpy(), batch.column("u").to_numpy()
            for first, part in slices(_texts(batch)):
                lines = Lines(part, min_chars)
                own = first + lines.text[lines.counts]
                yield pa.RecordBatch.from_pydict({"t": t[own], "u": u[own], "h": lines.h[lines.counts], "g": lines.g[lines.counts]})

    keys = named.select("t", "u", "text").mapInArrow(keys_of, "t long, u long, h long, g long")
    # a text's list is bounded by its own lines: equal texts share their keys
    gone = keys.join(common, ["h", "g"]).distinct().groupBy("t", "u").agg(F.collect_list(F.struct("h", "g")).alias("gone"))

    def drop(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for text, keys in zip(_texts(batch), batch.column("gone").to_pylist(), strict=True):
                lines = Lines([text], min_chars)
                own = np.array(sorted((x["h"], x["g"]) for x in keys or []), np.int64).reshape(-1, 2)
                rows += _dropped([text], lines, lines.counts & _among(lines.h, lines.g, own[:, 0], own[:, 1]))
            yield table_of(batch.column("id"), rows)

    return named.join(gone, ["t", "u"], "left").select("id", "text", "gone").mapInArrow(drop, result)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))

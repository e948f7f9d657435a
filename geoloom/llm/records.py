"""Operator 4: token ids as length-delimited binary records, with an offset index.

A record is: length of the data (unsigned 64-bit, little-endian), masked CRC-32C of those eight
bytes, the data (ids as unsigned little-endian integers of 16 bits where the vocabulary allows,
else of 32), masked CRC-32C of the data.
Checksums are masked so that data holding checksums of its own stays safe. Files follow the
order of ids; an index in Parquet gives each record's file, offset and length, so that a reader
can fetch records in any order. Each task attempt writes files of its own name, and the index,
committed by Spark, names only those of attempts that counted: a lost executor leaves at most
unreferenced files.

Null and empty texts give records that hold the end id alone. A null id sorts before all others,
rows with equal ids by their text. Empty tables give an empty index.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.bpe import SLICE, encoder
from geoloom.llm.text import open_folder, pieces_for, slices

#: Fixed values of the record format: polynomial of CRC-32C (reflected), and the mask's constant.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
LANE = 256
SPAN, READ_BYTES = 8 << 20, 32 << 20


@functools.lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for two of eight bytes at a time, by place; and for each j, those that append 2**j zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    eight = [one]
    for _ in range(7):
        eight.append((eight[-1] >> 8) ^ one[eight[-1] & 255])
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = (columns >> 8) ^ one[columns & 255]
    zeros = []
    for _ in range(40):
        tables = np.zeros((4, 256), np.uint32)
        for k in range(4):
            for bit in range(8):
                tables[k] ^= np.where(np.arange(256) >> bit & 1, columns[8 * k + bit], 0).astype(np.uint32)
        zeros.append(tables)
        columns = _through(tables, columns)
    low, high = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
    return np.array([eight[7 - 2 * k][low] ^ eight[6 - 2 * k][high] for k in range(4)]), zeros


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _append_zeros(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    zeros = _crc_tables()[1]
    for j in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero(lengths >> j & 1)
        crc[at] = _through(zeros[j], crc[at])
    return crc


def crc32c(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of each of the consecutive pieces of ``data``, all at once.

    Pieces are cut into lanes of equal length, padded in front, whose checksums numpy computes side
    by side; appending zeros to a lane's checksum moves it to its place, and the lanes add up.
    """
    lengths = np.asarray(lengths, np.int64)
    out = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    if not len(lengths):
        return out
    out = _append_zeros(out, lengths)
    lanes = -(-lengths // LANE)
    total = int(lanes.sum())
    if total:
        ends = np.cumsum(lanes)
        padded = np.zeros(total * LANE, np.uint8)
        source, at = np.frombuffer(data, np.uint8), 0
        for n, end in zip(lengths.tolist(), (ends * LANE).tolist(), strict=True):
            padded[end - n : end] = source[at : at + n]
            at += n
        columns = np.ascontiguousarray(padded.view("<u2").reshape(total, LANE // 2).T)
        pairs, _ = _crc_tables()
        state = np.zeros(total, np.uint32)
        for k in range(0, LANE // 2, 4):
            c = columns[k : k + 4]
            state = pairs[0].take(c[0] ^ (state & 0xFFFF)) ^ pairs[1].take(c[1] ^ (state >> 16)) ^ pairs[2].take(c[2]) ^ pairs[3].take(c[3])
        owner = np.repeat(np.arange(len(lengths)), lanes)
        after = (ends[owner] - 1 - np.arange(total)) * LANE
        state = _append_zeros(state, after)
        some = lanes > 0
        out[some] ^= np.bitwise_xor.reduceat(state, (ends - lanes)[some])
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


def frame(pieces: list[bytes]) -> bytes:
    """Pieces of data as consecutive records."""
    lengths = np.array([len(p) for p in pieces], "<u8")
    heads = lengths.tobytes()
    head_sums = masked(crc32c(heads, np.full(len(pieces), 8))).astype("<u4").tobytes()
    sums = masked(crc32c(b"".join(pieces), lengths)).astype("<u4").tobytes()
    out = []
    for i, piece in enumerate(pieces):
        out += [heads[8 * i : 8 * i + 8], head_sums[4 * i : 4 * i + 4], piece, sums[4 * i : 4 * i + 4]]
    return b"".join(out)


def unframe(data: bytes) -> list[bytes]:
    """The data of consecutive records; raises ValueError where a checksum or a length is wrong."""
    found, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        if at + 16 + n > len(data):
            raise ValueError(f"a record ends early at byte {at}")
        found.append((data[at : at + 8], data[at + 8 : at + 12], data[at + 12 : at + 12 + n], data[at + 12 + n : at + 16 + n]))
        at += 16 + n
    heads, head_sums, bodies, sums = zip(*found, strict=True) if found else ((), (), (), ())
    for parts, stored in ((heads, head_sums), (bodies, sums)):
        real = masked(crc32c(b"".join(parts), np.array([len(p) for p in parts], np.int64)))
        if (real != np.frombuffer(b"".join(stored), "<u4")).any():
            raise ValueError("a checksum differs")
    return list(bodies)


def write_records(docs: DataFrame, folder: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes texts with the tokenizers file at ``path``, appends ``end_id`` to each, writes records in ascending order of ids.

    Returns the index: id_col, file, part, position (in the part), offset and n_bytes (of the frame),
    n_tokens, before (ids of the part's earlier records). One shuffle, by ranges of ids.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        files, base = open_folder(folder)
        width = 2 if max(len(coder.table), (end_id or 0) + 1) <= 1 << 16 else 4
        files.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.records"
        out, offset, position, before = None, 0, 0, 0
        for batch in batches:
            for first, texts in slices((x.as_py() for x in batch.column(1)), SLICE):
                ids, counts = coder.encode(texts)
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                data, ends = ids.astype(f"<u{width}").tobytes(), (np.cumsum(counts) * width).tolist()
                found = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(frame(found))
                sizes, n = counts * width + 16, len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array([name] * n), pa.array([part] * n, pa.int32()), pa.array(np.arange(position, position + n)),
                        pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(counts), pa.array(before + np.cumsum(counts) - counts),
                    ],
                    names,
                )
                offset, position, before = offset + int(sizes.sum()), position + n, before + int(counts.sum())
        if out is not None:
            out.close()

    names = [id_col, "file", "part", "position", "offset", "n_bytes", "n_tokens", "before"]
    long = T.LongType()
    kinds = [docs.schema[id_col].dataType, T.StringType(), T.IntegerType(), long, long, long, long, long]
    ordered = docs.select(id_col, F.encode(text_col, "UTF-8").alias(text_col)).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    index = ordered.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The index with each record's ids as read from its file at its offset and checked: binary, 32 bits each."""
    index = spark.read.parquet(f"{folder}/index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        opened, source = None, None
        for batch in batches:
            names, offsets, sizes, counts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "offset", "n_bytes", "n_tokens"))
            a = 0
            while a < len(names):
                b, end = a, offsets[a]
                while b < len(names) and names[b] == names[a] and offsets[b] == end and (b == a or end - offsets[a] < SPAN):
                    end += sizes[b]
                    b += 1
                if names[a] != opened:
                    if source is not None:
                        source.close()
                    opened, source = names[a], files.open_input_file(f"{base}/{names[a]}")
                data = unframe(source.read_at(end - offsets[a], offsets[a]))
                data = [np.frombuffer(x, "<u2").astype("<u4").tobytes() if 2 * n == len(x) else x for x, n in zip(data, counts[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(data, pa.binary())], [*batch.schema.names, "ids"])
                a = b
        if source is not None:
            source.close()

    n = pieces_for(index.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0, READ_BYTES)
    ordered = index.repartitionByRange(n, "part", "offset").sortWithinPartitions("part", "offset")
    return ordered.mapInArrow(run, T.StructType([*index.schema.fields, T.StructField("ids", T.BinaryType())]))


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """records with ``start``: the ids of all records before each. A row per file is all that meets in one task."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return records.join(bases, "part").withColumn("start", F.col("base") + F.col("before")).drop("base")

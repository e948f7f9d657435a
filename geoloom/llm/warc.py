"""Operator 8: WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table (the
seekable format: a skippable frame listing each frame's compressed and plain size), and an index
in Parquet maps each record to its bundle, frame and offset in the plain frame. A reader fetches
one frame to get one record.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id is written as
response, the others as revisits that name it and hold no payload. Nulls count as empty payloads.
A row with a null id never is the one that others revisit unless no id is known; rows of equal id
and payload are all responses if theirs is the smallest id.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import checkpointed, open_folder, pieces_for

#: Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES, READ_BYTES = 1 << 20, 32 << 20


def with_types(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, n_bytes, digest, record_type, refers_to). Payloads of revisits become null before they are sent on."""
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    several = keyed.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = checkpointed(several.where("n > 1").select(F.col("digest").alias("same"), "first"))
    both = keyed.join(first, keyed.digest == first.same, "left")
    later = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    kind = F.when(later, "revisit").otherwise("response")
    return both.select(
        "id", "url", F.when(~later | F.col("first").isNull(), F.col("payload")).alias("payload"), "n_bytes", "digest", kind.alias("record_type"),
        F.when(later, F.col("first")).alias("refers_to"),
    )


def _record(page, url, payload, n_bytes, digest, refers_to, date: str) -> bytes:
    uri = "".join((url or "").split())
    name = "" if page is None else page
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {uri}"] * bool(uri)
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers (names in lower case), length of the full payload, and the payload (null in revisits)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length:")).partition(":")[2])
    return headers, n_bytes, None if headers["warc-type"] == "revisit" else payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame, from each frame's compressed and plain size."""
    body = b"".join(a.to_bytes(4, "little") + b.to_bytes(4, "little") for a, b in frames)
    body += len(frames).to_bytes(4, "little") + b"\0" + SEEKABLE.to_bytes(4, "little")
    return SKIPPABLE.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def read_seek_table(source) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame of an open bundle."""
    size = source.size()
    footer = source.read_at(9, size - 9)
    if int.from_bytes(footer[5:], "little") != SEEKABLE:
        raise ValueError("no seek table")
    n = int.from_bytes(footer[:4], "little")
    body, out, at = source.read_at(8 * n, size - 9 - 8 * n), [], 0
    for i in range(n):
        packed, plain = (int.from_bytes(body[8 * i + k : 8 * i + k + 4], "little") for k in (0, 4))
        out.append((at, packed, plain))
        at += packed
    return out


def write_bundles(typed: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records of with_types() and returns their index: id, file, part, frame, offset, n_record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base, recursive=True)
        part, name = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        packer = zstandard.ZstdCompressor(level=3)
        out, frames, open_frame, size = None, [], [], 0

        def close_frame() -> None:
            nonlocal out, size
            plain = b"".join(open_frame)
            packed = packer.compress(plain)
            out = out or files.open_output_stream(f"{base}/{name}", compression=None)
            out.write(packed)
            frames.append((len(packed), len(plain)))
            open_frame.clear()
            size = 0

        for batch in batches:
            ids, where = batch.column(0), []
            for page, url, payload, n, digest, _, refers_to in zip(*(c for c in map(_values, batch.columns)), strict=True):
                record = _record(page, url, payload, n, digest, refers_to, date)
                where.append((name, part, len(frames), size, len(record)))
                open_frame.append(record)
                size += len(record)
                if size >= frame_bytes:
                    close_frame()
            if where:
                columns = [pa.array(c, t) for c, t in zip(zip(*where, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names)
        if open_frame:
            close_frame()
        if out is not None:
            out.write(seek_table(frames))
            out.close()

    names = ["id", "file", "part", "frame", "offset", "n_record"]
    kinds = [typed.schema["id"].dataType, T.StringType(), T.IntegerType(), *[T.LongType()] * 3]
    index = typed.select("id", "url", "payload", "n_bytes", "digest", "record_type", "refers_to").mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))
    index.write.parquet(f"{folder}/index")
    return typed.sparkSession.read.parquet(f"{folder}/index")


def _values(column: pa.Array) -> Iterator:
    return (x.as_py() for x in column)


@functools.lru_cache(maxsize=1)
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the index, fetched by its frame and offset: id, payload, payload_bytes, payload_digest, record_type, refers_to."""
    index = spark.read.parquet(f"{folder}/index")
    kind = index.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        opened, at, source, table, plain = None, None, None, [], b""
        for batch in batches:
            rows, size = [], 0
            for row in batch.to_pylist():
                if row["file"] != opened:
                    if source is not None:
                        source.close()
                    source = files.open_input_file(f"{base}/{row['file']}")
                    opened, at, table = row["file"], None, read_seek_table(source)
                if row["frame"] != at:
                    offset, packed, full = table[row["frame"]]
                    at, plain = row["frame"], _unpacker().decompress(source.read_at(packed, offset), max_output_size=full)
                headers, n_bytes, payload = parse_record(plain[row["offset"] : row["offset"] + row["n_record"]])
                page, first = (headers.get(k, "").removeprefix("<urn:page:").removesuffix(">") or None for k in ("warc-record-id", "warc-refers-to"))
                rows.append((page, payload, n_bytes, headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"], first))
                size += n_bytes
                if size > (8 << 20):
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)
        if source is not None:
            source.close()

    n = pieces_for(index.agg(F.sum("n_record").alias("n")).first()["n"] or 0, READ_BYTES)
    ordered = index.repartitionByRange(n, "part", "frame").sortWithinPartitions("part", "frame", "offset")
    found = ordered.mapInArrow(run, "id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumn("id", F.col("id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = ["id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

"""Operator 11: k-means over integer vectors with heap-ordered bounds.

Vectors stay in blocks of a few thousand; each block keeps one heap for each cluster. An entry's key is the vector's
gap (a lower bound of the distance to any other centroid, less an upper bound of that to its own) plus
the drift that its cluster had accumulated when the entry was made. A round moves the centroids, adds
to each cluster's drift how far its own centroid and the farthest-moved other one went, and pops
only the entries whose key the drift has reached: these vectors are compared with all centroids again,
exactly, and go back with a new key; all others can't have changed sides. Ties have a gap of 0, so they are
compared each round. A round writes blocks to the shared folder and sends back only what moved: sums of
components and counts, added up in each task, then in Spark.

Vectors with exactly ``dims`` components take part if none is null or non-finite; a component x counts as
floor(scale * x). Rows of null or repeated ids take part like others; starts are the ``k`` rows
of smallest sha256 of "1:<id>", null ids last, ties by vector. With fewer rows there are fewer
centroids; an empty table gives no rows. A component beyond 2**27 after scaling is an error, since
distances must fit 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geoloom.llm.text import new_folder

BLOCK, LARGEST = 2048, 1 << 27
#: Room for rounding in square roots and sums of bounds.
SLACK = 1e-9


def valid(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(v) == dims) & fine).select(F.col(id_col).alias("id"), v.alias("v"))


def scaled(rows: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(rows * scale)
    if np.abs(out).max(initial=0) > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}")
    return out.astype(np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each point to each centroid."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 20 and points.shape[1] < 1 << 9:
        a, b = points.astype(np.float64), centroids.astype(np.float64)  # all sums stay below 2**53
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1)


class Block:
    """Some vectors with their clusters and one heap of (key, place) for each cluster."""

    def __init__(self, points: np.ndarray, k: int):
        self.points, self.cluster = points, np.full(len(points), -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    def assign(self, at: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Compares the vectors at these places with all centroids and puts them into the heaps of the nearest."""
        if not len(at):
            return
        found = squared(self.points[at], centroids)
        own = found.argmin(1).astype(np.int32)
        if len(centroids) > 1:
            two = np.sqrt(np.partition(found, 1, axis=1)[:, :2].astype(np.float64))
            gap = two[:, 1] - two[:, 0] - SLACK * (1 + two[:, 1])
        else:
            gap = np.full(len(at), np.inf)
        self.cluster[at] = own
        for key, c, i in zip((gap + drift[own]).tolist(), own.tolist(), at.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, i))

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Pops the vectors whose gap the drift has used up."""
        out = []
        for heap, gone in zip(self.heaps, drift.tolist(), strict=True):
            while heap and heap[0][0] <= gone:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def packed(self) -> dict:
        """As values of one row; heaps lie one behind the other, each in its own order."""
        kind = np.result_type(np.int8, *map(np.min_scalar_type, (int(self.points.min()), int(self.points.max()))))
        kind = kind if kind.kind == "i" else np.dtype(np.int64)
        entries = [e for heap in self.heaps for e in heap]
        return {
            "kind": kind.str,
            "points": self.points.astype(kind).tobytes(),
            "cluster": self.cluster.tobytes(),
            "keys": np.array([e[0] for e in entries], np.float64).tobytes(),
            "places": np.array([e[1] for e in entries], np.int32).tobytes(),
            "sizes": np.array([len(h) for h in self.heaps], np.int32).tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict, dims: int) -> Block:
        sizes = np.frombuffer(row["sizes"], np.int32)
        block = cls(np.frombuffer(row["points"], row["kind"]).reshape(-1, dims).astype(np.int64), len(sizes))
        block.cluster = np.frombuffer(row["cluster"], np.int32).copy()
        entries = list(zip(np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["places"], np.int32).tolist(), strict=True))
        ends = np.cumsum(sizes).tolist()
        block.heaps = [entries[b - n : b] for b, n in zip(ends, sizes.tolist(), strict=True)]
        return block


PARTS = ("kind", "points", "cluster", "keys", "places", "sizes")
KINDS = {"kind": pa.string()} | dict.fromkeys(PARTS[1:], pa.binary())


class Totals:
    """Count and sum of components of what joined each cluster, less what left it."""

    def __init__(self, k: int, dims: int):
        self.values = np.zeros((k, dims + 1), np.int64)

    def moved(self, points: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
        go = np.flatnonzero(old != new)
        for labels, sign in ((old[go], -1), (new[go], 1)):
            for c in np.unique(labels[labels >= 0]).tolist():
                own = points[go[labels == c]]
                self.values[c, 0] += sign * len(own)
                self.values[c, 1:] += sign * own.sum(0)


def _state(ids: pa.Array, block: Block, id_type: pa.DataType) -> pa.RecordBatch:
    row = block.packed()
    columns = [pa.array([ids.to_pylist()], pa.list_(id_type)), *(pa.array([row[p]], KINDS[p]) for p in PARTS), pa.array([None], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["ids", *PARTS, "totals"])


def _sums(totals: Totals, id_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([None], pa.list_(id_type)), *(pa.array([None], KINDS[p]) for p in PARTS), pa.array([totals.values.ravel().tolist()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["ids", *PARTS, "totals"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, dict]]:
    for i in range(len(batch)):
        yield batch.column("ids")[i].values, {p: batch.column(p)[i].as_py() for p in PARTS}


def _moved_centroids(centroids: list[list[int]], totals: list[list[int]]) -> list[list[int]]:
    return [[s // n for s in sums] if n else own for own, (n, *sums) in zip(centroids, totals, strict=True)]


def _more_drift(old: list[list[int]], new: list[list[int]]) -> list[float]:
    """For each cluster: how far its own centroid and the farthest-moved other one went, a little more."""
    went = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(old, new, strict=True)]
    others = [max((w for j, w in enumerate(went) if j != i), default=0.0) for i in range(len(went))]
    return [(a + b) * (1 + SLACK) for a, b in zip(went, others, strict=True)]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(id_col, cluster, distance) for each row that takes part, and the final centroids."""
    spark = vectors.sparkSession
    rows = valid(vectors, dims, id_col, vector_col)
    id_field = rows.schema["id"]
    id_type = to_arrow_type(id_field.dataType)
    order = [F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).asc_nulls_last(), F.col("v")]
    starts = rows.orderBy(*order).limit(k).collect()
    centroids = [scaled(np.array([r.v]), scale)[0].tolist() for r in starts]
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_field.dataType)), *T._parse_datatype_string("kind string, points binary, cluster binary, keys binary, places binary, sizes binary, totals array<long>").fields])
    assigned = T.StructType([T.StructField("id", id_field.dataType), *T._parse_datatype_string("cluster int, distance long").fields])
    if not centroids:
        return spark.createDataFrame([], assigned).withColumnRenamed("id", id_col), []
    n = len(centroids)
    totals = [[0] * (dims + 1) for _ in range(n)]
    drift = [0.0] * n

    def first(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, sums = np.array(centroids, np.int64), Totals(n, dims)
        for batch in parts:
            for a in range(0, len(batch), BLOCK):
                part = batch.slice(a, BLOCK)
                block = Block(scaled(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale), n)
                old = block.cluster.copy()
                block.assign(np.arange(len(part)), middle, np.zeros(n))
                sums.moved(block.points, old, block.cluster)
                yield _state(part.column("id"), block, id_type)
        yield _sums(sums, id_type)

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, gone, sums = np.array(centroids, np.int64), np.array(drift), Totals(n, dims)
        for batch in parts:
            for ids, row in _rows(batch):
                block = Block.unpacked(row, dims)
                old = block.cluster.copy()
                block.assign(block.expired(gone), middle, gone)
                sums.moved(block.points, old, block.cluster)
                yield _state(ids, block, id_type)
        yield _sums(sums, id_type)

    def last(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, gone = np.array(centroids, np.int64), np.array(drift)
        for batch in parts:
            for ids, row in _rows(batch):
                block = Block.unpacked(row, dims)
                block.assign(block.expired(gone), middle, gone)
                own = ((block.points - middle[block.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(block.cluster), pa.array(own)], ["id", "cluster", "distance"])

    state, blocks = rows.mapInArrow(first, schema), None
    for _ in range(rounds):
        folder = new_folder(spark, "clusters")
        state.write.parquet(folder)
        blocks = spark.read.schema(schema).parquet(folder)
        moved = blocks.where("totals IS NOT NULL").select(F.posexplode("totals").alias("at", "n"))
        for r in moved.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            totals[r["at"] // (dims + 1)][r["at"] % (dims + 1)] += int(r["n"])
        found = _moved_centroids(centroids, totals)
        drift = [a + b for a, b in zip(drift, _more_drift(centroids, found), strict=True)]
        centroids = found
        blocks = blocks.where("totals IS NULL")
        state = blocks.mapInArrow(step, schema)
    if blocks is None:
        final = rows.mapInArrow(first, schema).where("totals IS NULL").mapInArrow(last, assigned)
    else:
        final = blocks.mapInArrow(last, assigned)
    folder = new_folder(spark, "clusters")
    final.write.parquet(folder)
    return spark.read.schema(assigned).parquet(folder).withColumnRenamed("id", id_col), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the distance summed over each row's cluster and over all rows, and the digest of its centroid."""
    spark = assigned.sparkSession
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids]
    own = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row a cluster
    few = [(c, n, sum(own.values()), digests[c]) for c, n in own.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(few, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")

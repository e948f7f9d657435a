"""Operator 10: approximate nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample of the vectors (``sample`` of them, chosen by a hash of
the id); every vector is indexed. A query walks all trees through one priority queue, best margin
first, until the leaves it has taken hold ``reach`` entries; all their vectors are ranked exactly.
Unless given, ``reach`` comes from a measurement: a bounded number of queries is compared with all
vectors, and the reach at which ``target`` of their true neighbours are found is used for all.
Largest inner product becomes nearest direction by one more coordinate, which gives every vector
the same length.

Vectors keep their own precision (others than float become double). Each is sent once to be grouped
with its equals and once per tree; queries are sent to the leaves they take.

Equal vectors (by 128 bits of hash) are indexed once, with their ``k + 1`` smallest ids; no more can be among the k
nearest. Entries of a leaf are dealt into blocks of a bounded size, so a leaf that outgrew the
sample is many tasks' work, not a dropped one. A query vector is searched once for all rows that hold it.

Vectors null, empty, zero, or holding null or non-finite components take no part, nor do rows with
a null id; shorter vectors count as if filled up with zeros; rows of equal id and vector count once, an
id with several vectors with each. ``target=1.0`` searches every leaf, which makes the result exact. With
fewer candidates than k, all are returned; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import checkpointed

BLOCK = 4096


class Forest:
    """Trees of hyperplanes. Node j of a tree: children 2 * j + 1 and 2 * j + 2; all trees have one depth."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        # a power of two near the largest component: dividing by it is exact, and squares stay in range
        most = float(np.abs(sample.astype(np.float64)).max()) if sample.size else 0.0
        self.scale = float(2.0 ** np.floor(np.log2(most))) if most > 0 else 1.0
        self.longest = float(np.sqrt((self.scaled(sample) ** 2).sum(1).max())) if sample.size else 1.0
        points = self.lifted(sample)
        self.depth = max(0, int(np.ceil(np.log2(max(1.0, len(points) / max(leaf, 1.0))))))
        n = (1 << self.depth) - 1
        self.normal = np.zeros((trees, n, points.shape[1]), np.float32)
        self.offset = np.zeros((trees, n), np.float32)
        for t in range(trees):
            node = np.zeros(len(points), np.int64)
            for j in range(n):
                own = points[node == j]
                if len(own) >= 2:
                    a, b = own[rng.choice(len(own), 2, replace=False)]
                    normal = a - b
                else:
                    normal = rng.standard_normal(points.shape[1])
                size = np.linalg.norm(normal)
                normal = (normal / size if size > 0 else rng.standard_normal(points.shape[1])).astype(np.float32)
                self.normal[t, j] = normal
                if len(own):
                    self.offset[t, j] = np.median(own @ normal)
                    at = np.flatnonzero(node == j)
                    node[at] = 2 * j + 1 + (own @ normal > self.offset[t, j])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """x over the scale; what is far larger than all of the sample is held where floats can carry it."""
        with np.errstate(over="ignore"):
            return np.clip(x.astype(np.float64) / self.scale, -1e15, 1e15)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x**2).sum(1)))
        return np.concatenate([x, rest[:, None]], 1).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (0 .. 2**depth - 1) of each vector in each tree."""
        points, trees = self.lifted(x), len(self.normal)
        out = np.zeros((len(points), trees), np.int64)
        for t in range(trees):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", points, self.normal[t][node]) > self.offset[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def search(self, q: np.ndarray, counts: np.ndarray, reach: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs by best margin until their entries number ``reach``."""
        q = self.scaled(q)
        size = float(np.linalg.norm(q)) or 1.0
        point = np.concatenate([q * (self.longest / size), [0.0]]).astype(np.float32)
        margins = self.normal @ point - self.offset
        inner, found, held = (1 << self.depth) - 1, [], 0
        queue = [(-np.inf, t, 0) for t in range(len(self.normal))]
        heapq.heapify(queue)
        while queue and held < reach:
            worst, t, node = heapq.heappop(queue)
            while node < inner:
                m = float(margins[t, node])
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(worst, abs(m)), t, far))
                node = near
            leaf = node - inner
            if counts[t, leaf]:
                found.append((t, leaf))
                held += int(counts[t, leaf])
        return found


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows that take part, vectors of one length."""
    given = vectors.schema[vector_col].dataType.elementType
    kind = given if isinstance(given, T.FloatType) else T.DoubleType()
    v = F.col(vector_col).cast(T.ArrayType(kind))
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least == most:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(most) - F.size("v"))))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision of each query with its own list of vectors, added in the order of the components."""
    out = np.zeros(vectors.shape[:2])
    for d in range(vectors.shape[2]):
        out += queries[:, d, None].astype(np.float64) * vectors[:, :, d].astype(np.float64)
    return out


def best_of(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's k best vectors (all, if fewer), best first and ties in their order, and the exact scores.

    A fast product finds all that can be among them, the exact one ranks these.
    """
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    k = min(k, len(v))
    rough = q @ v.T
    floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    room = 1e-12 * v.shape[1] * np.abs(q).max(1) * np.abs(v).max()
    may = rough >= (floor - room)[:, None]
    width = int(may.sum(1).max())
    at = np.sort(np.argsort(~may, axis=1, kind="stable")[:, :width], axis=1) if width < len(v) else np.broadcast_to(np.arange(len(v)), may.shape)
    places, scores = np.empty((len(q), k), np.int64), np.empty((len(q), k))
    for a in range(0, len(q), step := max(1, (1 << 22) // max(1, width * v.shape[1]))):
        own = at[a : a + step]
        exact = products(q[a : a + step], v[own])
        best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        places[a : a + step], scores[a : a + step] = np.take_along_axis(own, best, 1), np.take_along_axis(exact, best, 1)
    return places, scores


def _exact(groups: DataFrame, queries: np.ndarray, k: int) -> pa.Table:
    """The k nearest of all vectors for a bounded block of queries: (q, v), 0 <= q < len(queries)."""
    carried = groups.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, scores = best_of(carried.value, _matrix(batch.column(1)), k)
                at = pa.array(best.reshape(-1))
                q = np.repeat(np.arange(len(best), dtype=np.int32), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores.reshape(-1)), batch.column(0).take(at), batch.column(1).take(at)], ["q", "score", "gid", "v"])

    found = groups.select("gid", "v").mapInArrow(run, T.StructType([*_fields("q int, score double, gid long"), groups.schema["v"]]))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "v").toArrow()


def needed_reach(forest: Forest, counts: np.ndarray, queries: np.ndarray, truth: pa.Table, target: float) -> int:
    """The least reach at which ``target`` of the true neighbours lie in a leaf taken."""
    if not truth.num_rows:
        return 1
    orders = []
    for q in queries:
        held, before = 0, {}
        for t, leaf in forest.search(q, counts, np.inf):
            before[t, leaf] = held
            held += int(counts[t, leaf])
        orders.append(before)
    leaves = forest.leaves(_matrix(truth["v"]))
    needed = [min(orders[q][t, leaf] for t, leaf in enumerate(row)) + 1 for q, row in zip(truth["q"].to_pylist(), leaves.tolist(), strict=True)]
    return int(np.quantile(needed, target, method="higher"))


def _fields(shape: str) -> list[T.StructField]:
    return T._parse_datatype_string(shape).fields


def nearest(vectors: DataFrame, is_query, k: int = 20, trees: int = 2, leaf: int = 4096, reach: int | None = None, target: float = 0.97, tuning: int = 128, sample: int = 32_768, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row for which ``is_query(vec_id)`` holds."""
    spark = vectors.sparkSession
    v, same = F.col("v"), ["k1", "k2"]
    asks = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    rows = valid_vectors(vectors, id_col, vector_col).select("vec_id", "v", F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(1), v).alias("k2"), asks.alias("asks"))
    once = rows.groupBy(*same, "vec_id").agg(F.max("asks").alias("asks"))
    few = once.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = few.groupBy(*same).agg(F.min("vec_id").alias("gid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    whole = rows.groupBy(*same).agg(F.first("v").alias("v"), F.max("asks").alias("asked"))
    groups = checkpointed(whole.join(ids, same).withColumn("g", F.monotonically_increasing_id()))
    n, held_v = groups.count(), groups.schema["v"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, 1.2 * sample / n)
    picked = groups.where(F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(sample).toArrow()
    forest = Forest(_matrix(picked["v"]), trees, leaf * min(1.0, max(picked.num_rows, 1) / n))
    carried = spark.sparkContext.broadcast(forest)  # trees * sample / leaf hyperplanes at most

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = carried.value.leaves(_matrix(batch.column(2)))
                for t in range(trees):
                    place = [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(found[:, t].astype(np.int32)), pa.array((batch.column(0).to_numpy() % blocks.value[t, found[:, t]]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*place, *batch.columns], ["tree", "leaf", "block", "g", "gid", "v"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((trees, 1 << forest_depth), np.int64)
        for batch in batches:
            if batch.num_rows:
                found = carried.value.leaves(_matrix(batch.column(0)))
                for t in range(trees):
                    held[t] += np.bincount(found[:, t], minlength=held.shape[1])
        t, at = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(held[t, at])], ["tree", "leaf", "n"])

    forest_depth = forest.depth
    counted = groups.select("v").mapInArrow(tally, "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toArrow()  # a row per leaf: bounded by the sample
    counts = np.zeros((trees, 1 << forest.depth), np.int64)
    counts[counted["tree"].to_numpy(), counted["leaf"].to_numpy()] = counted["n"].to_numpy()
    blocks = spark.sparkContext.broadcast(np.maximum(1, -(-counts // BLOCK)))
    carried_counts = spark.sparkContext.broadcast(counts)
    owners = checkpointed(once.where("asks").join(groups.select(*same, "g"), same).select("vec_id", "g"))
    asked = groups.where("asked").select("g", "v")
    if reach is None and target >= 1:
        reach = np.inf
    elif reach is None:
        tried = _matrix(asked.orderBy(F.xxhash64("g"), "g").limit(tuning).select("v").toArrow()["v"])
        reach = needed_reach(forest, counts, tried, _exact(groups, tried, k + 1), target) if len(tried) else 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _matrix(batch.column(1))
            rows = [(t, leaf, b, i) for i, q in enumerate(vecs) for t, leaf in carried.value.search(q, carried_counts.value, reach) for b in range(int(blocks.value[t, leaf]))]
            if rows:
                t, leaf, b, i = (np.array(c, np.int32) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(leaf), pa.array(b), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], ["tree", "leaf", "block", "qid", "q"])

    def rank(key: tuple[pa.Scalar, ...], probes: pa.Table, held: pa.Table) -> pa.Table:
        qids, g, gids = probes["qid"].to_numpy(), held["g"].to_numpy(), held["gid"].to_numpy()
        by_id = np.lexsort((g, gids))
        g, gids, vecs, queries = g[by_id], gids[by_id], _matrix(held["v"])[by_id], _matrix(probes["q"])
        found = []
        for a in range(0, len(qids) if len(g) else 0, 256):
            best, scores = best_of(queries[a : a + 256], vecs, k + 1)
            found += [(x.tobytes(), y.tobytes(), z.tobytes()) for x, y, z in zip(g[best], gids[best], scores, strict=True)]
        columns = list(zip(*found, strict=True)) or [[]] * 3
        return pa.table([pa.array(qids[: len(found)]), *[pa.array(c, pa.binary()) for c in columns]], ["qid", "g", "gids", "scores"])

    def merge(lists: pa.Table) -> pa.Table:
        g, gids, scores = (np.frombuffer(b"".join(x.as_py() for x in lists[c]), kind) for c, kind in (("g", np.int64), ("gids", np.int64), ("scores", np.float64)))
        g, at = np.unique(g, return_index=True)
        best = np.lexsort((gids[at], -scores[at]))[: k + 1]
        return pa.table({"qid": np.full(len(best), lists["qid"][0].as_py(), np.int64), "g": g[best], "score": scores[at][best]})

    place = _fields("tree int, leaf int, block int")
    probes = asked.mapInArrow(probe, T.StructType([*place, *_fields("qid long"), T.StructField("q", held_v.dataType)]))
    held = groups.select("g", "gid", "v").mapInArrow(index, T.StructType([*place, *_fields("g long, gid long"), held_v]))
    keys = ("tree", "leaf", "block")
    found = probes.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(rank, "qid long, g binary, gids binary, scores binary")
    top = found.groupBy("qid").applyInArrow(merge, "qid long, g long, score double")  # a row per block of a leaf taken
    members = top.join(groups.select("g", "ids"), "g").select("qid", "score", F.explode("ids").alias("vec_id"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")))
    lists = checkpointed(members.groupBy("qid").agg(F.slice(ordered, 1, k + 1).alias("best")))
    own = owners.select(F.col("vec_id").alias("query_id"), "g").join(lists, F.col("g") == F.col("qid"))
    best = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    flat = own.select("query_id", F.posexplode(best).alias("pos", "hit"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))

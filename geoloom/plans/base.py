"""The driver's tables in map roles, as DataFrames and as SQL: parts are nodes, line items the vertices of ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NODES = "nodes AS (SELECT p_partkey AS id, (p_partkey * 7919) % 100000 AS x, (p_partkey * 104729) % 100000 AS y FROM part)"
WAY_NODES = "way_nodes AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq, l_partkey AS ref FROM lineitem)"
LINES = f"{NODES}, {WAY_NODES}, lines AS (SELECT w.id, seq, ref, x, y FROM way_nodes w JOIN nodes n ON w.ref = n.id)"
SEGS = f"{LINES}, segs AS (SELECT * FROM (SELECT id, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM lines WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE x2 IS NOT NULL)"
ARCS = f"{SEGS}, lens AS (SELECT *, sqrt(CAST((x2 - x) AS DOUBLE) * (x2 - x) + CAST((y2 - y) AS DOUBLE) * (y2 - y)) AS len FROM segs), arcs AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"at\", sum(len) OVER (PARTITION BY id) AS total FROM lens)"
# The map grows with the tables: each block of 12,000 holds 375 customers and 25 suppliers, so density stays the same at every size.
SHOPS = "shops AS (SELECT s_suppkey AS id, (CAST(s_suppkey AS BIGINT) * 7907) % 10000 + s_suppkey // 25 * 12000 AS x, (CAST(s_suppkey AS BIGINT) * 10007) % 10000 AS y FROM supplier)"
HOMES = "homes AS (SELECT c_custkey AS id, (CAST(c_custkey AS BIGINT) * 6007) % 10000 + c_custkey // 375 * 12000 AS x, (CAST(c_custkey AS BIGINT) * 9001) % 10000 AS y FROM customer)"
BOXES = "boxes AS (SELECT id, x0, y0, x0 + 500 + 60 * (id % 25) AS x1, y0 + 1900 - 50 * (id % 25) AS y1 FROM (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey % 25 * 1709 % 8000 + s_suppkey // 25 * 12000 AS x0, s_suppkey % 25 * 2903 % 8000 AS y0 FROM supplier))"
NEAR_SEGS = f"{WAY_NODES}, near AS (SELECT id, seq, ref, id % 1000 * 250 + ref * 131 % 500 AS x, id // 1000 * 250 + ref * 977 % 500 AS y FROM way_nodes), segs AS (SELECT * FROM (SELECT id, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM near WINDOW w AS (PARTITION BY id ORDER BY seq)) WHERE x2 IS NOT NULL)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query, with its oracle SQL if it has one."""
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _points(df: DataFrame, key: str, a: int, b: int, size: int, block: int | None = None) -> DataFrame:
    k = F.col(key).cast("bigint")
    x = (k * a) % size
    return df.select(k.alias("id"), (x + F.floor(k / block) * 12_000 if block else x).alias("x"), ((k * b) % size).alias("y"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return _points(table(spark, d, "part"), "p_partkey", 7919, 104729, 100_000)


def shops(spark: SparkSession, d: str) -> DataFrame:
    return _points(table(spark, d, "supplier"), "s_suppkey", 7907, 10007, 10_000, 25)


def homes(spark: SparkSession, d: str) -> DataFrame:
    return _points(table(spark, d, "customer"), "c_custkey", 6007, 9001, 10_000, 375)


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("bigint")
    x, y = k % 25 * 1709 % 8000 + F.floor(k / 25) * 12_000, k % 25 * 2903 % 8000
    return table(spark, d, "supplier").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + 500 + 60 * (k % 25)).alias("x1"), (y + 1900 - 50 * (k % 25)).alias("y1"))


def box_edges(spark: SparkSession, d: str) -> DataFrame:
    """The boxes as rings of four edges."""
    corner = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    from geoloom.operators.sequences import segments

    pts = boxes(spark, d).select("id", F.posexplode(corner).alias("seq", "p")).select("id", "seq", "p.x", "p.y")
    return segments(pts, closed=True)


def way_nodes(spark: SparkSession, d: str) -> DataFrame:
    # named first: what follows by way then needs no other shuffle
    order = Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id").select("id", F.row_number().over(order).cast("bigint").alias("seq"), F.col("l_partkey").alias("ref"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return way_nodes(spark, d).join(nodes(spark, d).withColumnRenamed("id", "node"), F.col("ref") == F.col("node")).select("id", "seq", "ref", "x", "y")


def near_lines(spark: SparkSession, d: str) -> DataFrame:
    """Ways of short steps: each vertex lies within 500 of a corner of a grid of 250 that comes from the way's key, so the map grows with the ways and their density doesn't."""
    way, ref = F.col("id").cast("bigint"), F.col("ref").cast("bigint")
    x, y = (way % 1000) * 250 + (ref * 131) % 500, F.floor(way / 1000) * 250 + (ref * 977) % 500
    return way_nodes(spark, d).select("id", "seq", "ref", x.alias("x"), y.alias("y"))

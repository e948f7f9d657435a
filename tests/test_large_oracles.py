"""The SQL of queries states the query's own rule: in double precision, with ties settled and all faults named."""

import duckdb
import numpy as np

from geoloom.plans import catalog


def tables(**given):
    con = duckdb.connect()
    for name, sql in given.items():
        con.sql(f"CREATE TABLE {name} AS {sql}")
    return con


def test_grounded_heights_are_rounded_in_double_precision():
    # 0.00035 as a float lies above it, its product in single precision on the half
    con = tables(embeddings="SELECT 0::BIGINT AS vec_id, [CAST(i * 0.00001 - 0.2 AS FLOAT) FOR i IN range(64)] AS embedding UNION ALL SELECT k, [CAST((k * 64 + i) * 0.00005 AS FLOAT) FOR i IN range(64)] FROM range(1, 2000) r(k)", customer="SELECT k AS c_custkey FROM range(2000) r(k)")
    got = dict(con.sql(catalog.ORACLES["agg25_grounded"]).fetchall())
    want = dict(con.sql("SELECT vec_id, CAST(round(10000 * CAST(embedding[vec_id % 70 + 1] AS DOUBLE)) AS BIGINT) FROM embeddings").fetchall())
    single = dict(con.sql("SELECT vec_id, CAST(round(10000 * embedding[vec_id % 70 + 1]) AS BIGINT) FROM embeddings").fetchall())
    assert got == want != single


def test_nearest_line_takes_the_smaller_of_equals():
    # where the nearest place is a shop, two lines meet there
    con = tables(supplier="SELECT k AS s_suppkey FROM range(200) r(k)", customer="SELECT k AS c_custkey FROM range(3000) r(k)")
    s, h = np.arange(200), np.arange(3000)
    ax, ay, x, y = s * 7907 % 10000 + s // 25 * 12000, s * 10007 % 10000, h * 6007 % 10000 + h // 375 * 12000, h * 9001 % 10000
    dx, dy = np.diff(ax).astype(float), np.diff(ay).astype(float)
    ax, ay, x, y = ax[:-1], ay[:-1], x[:, None], y[:, None]
    p = np.clip(((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy), 0, 1)
    d2 = (x - (ax + p * dx)) ** 2 + (y - (ay + p * dy)) ** 2
    want = {int(i): int(d2[i].argmin()) for i in h if d2[i].min() <= 160000}
    assert dict(con.sql(catalog.ORACLES["jon19_nearest_line"]).fetchall()) == want


def test_heights_out_of_range_are_faults():
    con = tables(lineitem="SELECT 3 AS l_orderkey, 1 AS l_linenumber, 10001 AS l_partkey, 1 AS l_suppkey, 1.0 AS l_quantity, 1.0 AS l_extendedprice, DATE '2024-01-01' AS l_shipdate")
    assert con.sql(catalog.ORACLES["prj17_vertical_faults"]).fetchall() == [(3, "range")]


def test_equal_intervals_stay_with_their_first():
    # many equal rows, whose order two sorts need not agree on
    con = tables(lineitem="SELECT k % 5 AS l_suppkey, k % 7 * 100 AS l_partkey, 3.0 AS l_quantity FROM range(400000) r(k)")
    assert all(hi == lo + 3 for _, lo, hi, _ in con.sql(catalog.ORACLES["win06_merge_intervals"]).fetchall())
    assert len(con.sql(catalog.ORACLES["win06_merge_intervals"]).fetchall()) == 35

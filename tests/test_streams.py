"""Streams with kept state against the same operators over tables, with late and repeated events."""

import random
from datetime import datetime, timedelta

import pytest

from geoloom.streaming import progress as R

SCHEMA = "request string, stage string, ts timestamp, event long, seq long"
START = datetime(2024, 1, 1)


def events():
    rng, out, number = random.Random(4), [], 0
    for request in ("a", "b", "c"):
        seq = 0
        for stage in ("read", "build"):
            for _ in range(25):
                number += 1
                seq += rng.choice([1, 1, 1, 1, 2])
                out.append((request, stage, START + timedelta(milliseconds=number * 20 + rng.randrange(15)), number, seq))
    return out + [out[7], out[30]]


def batches(rows):
    """Rows in parts, a few of them seconds late, and one far ahead that moves the watermark on."""
    rng = random.Random(2)
    parts = [[] for _ in range(5)]
    for i, row in enumerate(rows):
        k = i * 4 // len(rows)
        parts[min(3, k + (rng.random() < 0.2))].append(row)
    parts[4] = [("z", "end", START + timedelta(hours=9), 10**6, 1)]
    return parts


@pytest.fixture
def stream(spark, tmp_path):
    rows = events()
    for part in batches(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    def run(name, f):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = f(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return [tuple(r) for r in spark.table(name).where("request <> 'z'").collect()]
    return rows, run


def test_throttled_stream_equals_table(spark, stream):
    rows, run = stream
    got = run("throttled", lambda e: R.throttled_stream(e, ["request", "stage"], "ts", "event", 100, "20 seconds"))
    once = spark.createDataFrame(sorted(set(rows)), SCHEMA)
    want = R.throttled(once, ["request", "stage"], "ts", "event", 0.1).select("request", "stage", "ts", "event").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) < len(rows)
    first = {(r, s): min(e for a, b, _, e, _ in rows if (a, b) == (r, s)) for r, s, *_ in rows}
    assert {(r, s, e) for (r, s), e in first.items()} <= {(r, s, e) for r, s, _, e in got}


def test_sequence_stream_equals_table(spark, stream):
    rows, run = stream
    got = run("sequences", lambda e: R.sequence_stream(e, "request", "seq", "ts", "event", "20 seconds"))
    last, want = {}, []
    for request, _, ts, event, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        if request in last and last[request] + 1 != seq:
            want.append((request, seq, ts, event))
        last[request] = seq
    assert sorted(got) == sorted(want) and len(want) > 10

"""Progress logs: throttling and sequence checks, for tables and for streams.

The streams keep state per key across micro-batches. An event is held until the watermark has passed it (or its interval), so late and
repeated events give what the table's form gives; those that come behind the watermark are dropped by Spark. A key
whose watermark moves ``idle`` milliseconds on without an event is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def throttled(events: DataFrame, keys: list[str], ts: str, order: str, seconds: float) -> DataFrame:
    """At most one event (the last) per key and interval; the first and last of each key always stay."""
    by = Window.partitionBy(*keys)
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / int(seconds * 1e6))
    numbered = events.withColumn("_bucket", bucket).withColumns(
        {
            "_first": F.row_number().over(by.orderBy(ts, order)),
            "_last": F.row_number().over(by.orderBy(F.desc(ts), F.desc(order))),
            "_kept": F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(F.desc(ts), F.desc(order))),
        }
    )
    return numbered.where("_first = 1 OR _last = 1 OR _kept = 1").drop("_bucket", "_first", "_last", "_kept")


def sequence_faults(events: DataFrame, request: str, seq: str, order: str) -> DataFrame:
    """Events whose sequence number is not one more than the one before of the same request."""
    before = F.lag(seq).over(Window.partitionBy(request).orderBy(order))
    return events.withColumn("_before", before).where(F.col("_before") + 1 != F.col(seq)).drop("_before")


def _held(events: DataFrame, keys: list[str], ts: str, late: str, *columns: str) -> DataFrame:
    """keys, event time in microseconds (_us) and the columns, as longs, with a watermark."""
    marked = events.withWatermark(ts, late)
    return marked.select(*keys, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), *[F.col(c).cast("long").alias(c) for c in columns])


def _schema(events: DataFrame, keys: list[str], *columns: str) -> T.StructType:
    return T.StructType([*[events.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in columns]])


def _wake(state: Any, at: int) -> None:
    """Sets the key's time-out, which must lie behind the watermark."""
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def throttled_stream(events: DataFrame, keys: list[str], ts: str, order: str, interval: int = 100, late: str = "10 seconds", idle: int = 3_600_000) -> DataFrame:
    """The stream of (keys, ts, order) that ``throttled`` keeps: the last event of each key and interval (milliseconds), and the first of each key.

    An interval is given out when the watermark passes its end. The first event of a key comes with its first interval; the last one is the last of its interval anyway.
    """
    held = _held(events, keys, ts, late, order)
    out = _schema(held, keys, "_us", order)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        started, rows = (state.get[0], list(zip(state.get[1], state.get[2], strict=True))) if state.exists else (False, [])
        for part in parts:
            rows += zip(part["_us"].tolist(), part[order].tolist(), strict=True)
        by: dict[int, list[tuple[int, int]]] = {}
        for row in sorted(rows):
            by.setdefault(row[0] // (interval * 1000), []).append(row)
        mark, found = state.getCurrentWatermarkMs(), []
        while by and (min(by) + 1) * interval <= mark:
            own = by.pop(min(by))
            found += [own[-1]] if started or len(own) == 1 else [own[0], own[-1]]
            started = True
        if state.hasTimedOut and not by and not found:
            state.remove()
            return
        left = [r for own in by.values() for r in own]
        state.update((started, [r[0] for r in left], [r[1] for r in left]))
        _wake(state, (min(by) + 1) * interval if by else mark + idle)
        if found:
            yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key, strict=True)}, "_us": [r[0] for r in found], order: [r[1] for r in found]})

    kept = "started boolean, us array<long>, ord array<long>"
    given = held.groupBy(*keys).applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")
    return given.select(*keys, F.timestamp_micros("_us").alias(ts), order)


def sequence_stream(events: DataFrame, request: str, seq: str, ts: str, order: str, late: str = "10 seconds", idle: int = 3_600_000) -> DataFrame:
    """The stream of (request, seq, ts, order) that ``sequence_faults`` finds, events of a request in order of (ts, order).

    An event is judged when the watermark passes it; the last sequence number judged is kept per request.
    """
    held = _held(events, [request], ts, late, seq, order)
    out = _schema(held, [request], "_us", seq, order)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last, rows = (state.get[0], list(zip(*state.get[1:], strict=True))) if state.exists else (None, [])
        for part in parts:
            rows += zip(part["_us"].tolist(), part[order].tolist(), part[seq].tolist(), strict=True)
        rows.sort()
        mark, found = state.getCurrentWatermarkMs(), []
        n = sum(us < mark * 1000 for us, _, _ in rows)
        for row in rows[:n]:
            if last is not None and row[2] != last + 1:
                found.append(row)
            last = row[2]
        left = rows[n:]
        if state.hasTimedOut and not n and not left:
            state.remove()
            return
        state.update((last, *([r[i] for r in left] for i in range(3))))
        _wake(state, left[0][0] // 1000 + 1 if left else mark + idle)
        if found:
            yield pd.DataFrame({request: [key[0]] * len(found), "_us": [r[0] for r in found], seq: [r[2] for r in found], order: [r[1] for r in found]})

    kept = "last long, us array<long>, ord array<long>, seq array<long>"
    given = held.groupBy(request).applyInPandasWithState(step, out, kept, "append", "EventTimeTimeout")
    return given.select(request, seq, F.timestamp_micros("_us").alias(ts), order)

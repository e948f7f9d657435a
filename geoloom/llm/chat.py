"""Operator 3: chat formatting with minimum-cost role repair.

A legal chat has at most one system turn, first, then user and assistant turns in alternation, and ends
with the assistant. Each input turn is kept, relabelled, merged into the turn before, or preceded
by an inserted empty turn; an empty assistant turn (after an empty user turn if need be) may close the
chat. Dynamic programming over the automaton's states (nothing yet, system, user, assistant) finds
the cheapest repair; of equally cheap ones, that whose sequence of states, read from the end, is
smallest. The repaired turns are then rendered.

Costs add up along states, so a stretch of turns acts as a matrix of least costs between states, and
stretches combine like matrix products. Conversations are therefore cut into chunks of at most
``chunk`` turns wherever they lie in an even range partitioning: one of any length is many tasks'
work. A first pass gives every chunk's matrix, a second joins the chunks of each conversation (a
row per chunk), a third traces each chunk between its known ends. The result doesn't depend on the cuts.

Turns are ordered by (turn, role, text), nulls first; repeated rows are turns of their own. A role other
than system, user and assistant, or null, must be relabelled or merged; a null text is empty. Rows whose
conversation id is null form one conversation. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import checkpointed

ROLES = ("system", "user", "assistant")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
COSTS = {"keep": 0, "merge": 1, "insert": 2, "relabel": 3, "mixed merge": 4}
HEAD, TAIL = "<|im_start|>{role}\n", "<|im_end|>\n"


@functools.lru_cache(maxsize=8)
def steps(role: int) -> tuple[tuple[tuple[int, str, int] | None, ...], ...]:
    """For a turn of this role (0: none of the three), by state before and after: (cost, action, role inserted before)."""
    table: list[list[tuple[int, str, int] | None]] = [[None] * 4 for _ in range(4)]

    def offer(s: int, t: int, cost: int, action: str, inserted: int = 0) -> None:
        if table[s][t] is None or cost < table[s][t][0]:
            table[s][t] = (cost, action, inserted)

    for s in range(4):
        for t in NEXT[s]:
            offer(s, t, *((COSTS["keep"], "keep") if t == role else (COSTS["relabel"], "relabel")))
            if role in NEXT[t]:
                offer(s, role, COSTS["insert"], "insert", t)
        if s != NOTHING:
            offer(s, s, *((COSTS["merge"], "merge") if s == role else (COSTS["mixed merge"], "merge")))
    return tuple(map(tuple, table))


#: What closing the chat costs from each state, and the empty turns that do it.
CLOSING = {NOTHING: (0, ()), SYSTEM: (2 * COSTS["insert"], (USER, ASSISTANT)), USER: (COSTS["insert"], (ASSISTANT,)), ASSISTANT: (0, ())}


def trace(roles: list[int], start: int) -> tuple[list[int], list[list[int]]]:
    """Least cost to each state from ``start``, and for each turn and state the state before (the smallest of the best)."""
    best = [FAR] * 4
    best[start] = 0
    back = []
    for role in roles:
        table, new, at = steps(role), [FAR] * 4, [0] * 4
        for s in range(4):
            if best[s] < FAR:
                for t in range(4):
                    step = table[s][t]
                    if step is not None and best[s] + step[0] < new[t]:
                        new[t], at[t] = best[s] + step[0], s
        best = new
        back.append(at)
    return best, back


def path(back: list[list[int]], end: int) -> list[int]:
    """States after each turn, from the back pointers."""
    out = [end]
    for at in reversed(back[1:]):
        out.append(at[out[-1]])
    return out[::-1]


def added_turns(roles: list[int], states: list[int], start: int) -> int:
    n = 0
    for role, s, t in zip(roles, [start, *states], states, strict=False):
        _, action, _ = steps(role)[s][t]
        n += {"merge": 0, "insert": 2}.get(action, 1)
    return n


def chunk_matrix(roles: list[int], starts: tuple[int, ...]) -> list[int]:
    """By state before and after, flat: least cost, place of the path among those to the same state (read from the end), output turns."""
    cost, order, count = [FAR] * 16, [0] * 16, [0] * 16
    reverse: dict[int, list[tuple[list[int], int]]] = {t: [] for t in range(4)}
    for s in starts:
        best, back = trace(roles, s)
        for t in range(4):
            if best[t] < FAR:
                states = path(back, t)
                cost[4 * s + t], count[4 * s + t] = best[t], added_turns(roles, states, s)
                reverse[t].append((states[::-1], s))
    for t, found in reverse.items():
        for place, (_, s) in enumerate(sorted(found)):
            order[4 * s + t] = place
    return cost + order + count


def join_chunks(matrices: list[list[int]]) -> list[tuple[int, int, int]]:
    """For a conversation's chunks in order: (state before, state after, output turns before) of the best repair."""
    best, back = [0, FAR, FAR, FAR], []
    for m in matrices:
        new, at = [FAR] * 4, [0] * 4
        for t in range(4):
            options = [(best[s] + m[4 * s + t], m[16 + 4 * s + t], s) for s in range(4) if best[s] < FAR and m[4 * s + t] < FAR]
            if options:
                new[t], _, at[t] = min(options)
        best = new
        back.append(at)
    end = min(range(4), key=lambda t: (best[t] + CLOSING[t][0], t))
    ends = [end]
    for at in reversed(back):
        ends.append(at[ends[-1]])
    ends.reverse()
    out, turns = [], 0
    for m, s, t in zip(matrices, ends, ends[1:], strict=False):
        out.append((s, t, turns))
        turns += m[32 + 4 * s + t]
    return out


def _head(role: int) -> str:
    return HEAD.format(role=ROLES[role - 1])


def render_chunk(roles: list[int], texts: list[str], start: int, end: int, turns: int, last: bool) -> Iterator[tuple[int, int, str, str, int, str]]:
    """(input turn in the chunk or -1, output turn, action, role, cost, rendered) of each piece, in order.

    A piece's text closes the turn before it when it begins one, so pieces concatenate to the chat.
    """
    _, back = trace(roles, start)
    states, before = path(back, end), start
    for i, (role, after) in enumerate(zip(roles, states, strict=True)):
        cost, action, inserted = steps(role)[before][after]
        if action == "merge":
            yield i, turns - 1, action, ROLES[after - 1], cost, "\n" + texts[i]
        else:
            open_turn = before != NOTHING
            if inserted:
                yield -1, turns, "insert", ROLES[inserted - 1], cost, TAIL * open_turn + _head(inserted)
                turns, open_turn, cost, action = turns + 1, True, 0, "keep"
            yield i, turns, action, ROLES[after - 1], cost, TAIL * open_turn + _head(after) + texts[i]
            turns += 1
        before = after
    if last:
        for t in CLOSING[before][1]:
            yield -1, turns, "insert", ROLES[t - 1], COSTS["insert"], TAIL + _head(t)
            turns += 1
        yield -1, turns - 1, "close", "", 0, TAIL


def repair_chats(turns: DataFrame, chunk: int = 4096, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, piece, turn, out_turn, action, role, cost, rendered): the repaired chats, piece by piece.

    ``turn`` is the input turn of a piece (null for inserted turns and the closing mark). The
    renderings of a conversation's pieces, in order of ``piece``, concatenate to its chat.
    """
    if not 0 < chunk <= 8000:
        raise ValueError("chunk must be from 1 to 8000, so that piece numbers of chunks stay apart")
    id_kind, turn_kind = turns.schema[id_col].dataType, turns.schema[turn_col].dataType
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col(role_col)), F.lit(0)).cast("int")
    flat = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("r"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    keys = ["id", "turn", "role", "text"]
    # the beginning of a text stands in its order before the whole of it, and is bounded where ranges are sampled
    dealt = flat.withColumn("text_head", F.substring("text", 1, 200)).repartitionByRange("id", "turn", "role", "text_head").sortWithinPartitions(*keys)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, size, piece = TaskContext.get().partitionId(), object(), 0, -1
        for batch in batches:
            numbers = []
            for x in batch.column(0).to_pylist():
                if x != now or size == chunk:
                    now, size, piece = x, 0, piece + 1
                size += 1
                numbers.append(piece)
            yield _numbered(batch, part, numbers)

    def _numbered(batch: pa.RecordBatch, part: int, numbers: list[int]) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([part] * n, pa.int32()), pa.array(numbers, pa.int32())], [*batch.schema.names[:5], "part", "chunk"])

    text = T.StringType()
    numbered = T.StructType([T.StructField("id", id_kind), T.StructField("turn", turn_kind), T.StructField("r", T.IntegerType()), T.StructField("role", text), T.StructField("text", text), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType())])
    staged = checkpointed(dealt.mapInArrow(number, numbered))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = False
        for rows in _chunks(batches, 3):
            roles = [x for b in rows for x in b.column(1).to_pylist()]
            first = rows[0]
            # only a partition's first chunk, and one after a full chunk, can continue a conversation
            starts = (NOTHING,) if begins else (NOTHING, SYSTEM, USER, ASSISTANT)
            yield pa.RecordBatch.from_arrays([first.column(0).slice(0, 1), first.column(2).slice(0, 1), first.column(3).slice(0, 1), pa.array([chunk_matrix(roles, starts)], pa.list_(pa.int64()))], ["id", "part", "chunk", "matrix"])
            begins = len(roles) < chunk

    shape = T.StructType([T.StructField("id", id_kind), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("matrix", T.ArrayType(T.LongType()))])
    chunks = staged.select("id", "r", "part", "chunk").mapInArrow(matrices, shape)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        for _, own in itertools.groupby(rows, key=lambda x: x[0]):
            own = list(own)
            found = join_chunks([x[3] for x in own])
            s, t, n = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in own], pa.int32()), pa.array([x[2] for x in own], pa.int32()), *[pa.array(x, pa.int64()) for x in (s, t, n)], pa.array([False] * (len(own) - 1) + [True])], ["p", "c", "s", "t", "before", "last"])

    # a number of its own: rows are few bytes but much work, so adaptive execution would put them into one task
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decided = chunks.repartition(n, "id").sortWithinPartitions("id", "part", "chunk").mapInArrow(decide, "p int, c int, s long, t long, before long, last boolean")
    joined = staged.join(checkpointed(decided), (F.col("part") == F.col("p")) & (F.col("chunk") == F.col("c")))
    ordered = joined.select("id", "turn", "r", "text", "part", "chunk", "s", "t", "before", "last", "role").repartition("part", "chunk").sortWithinPartitions("part", "chunk", "id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, 5, 4):
            whole = pa.Table.from_batches(rows)
            turn, roles, texts = (whole.column(c).to_pylist() for c in (1, 2, 3))
            s, t, before, last, part, at = (whole.column(c)[0].as_py() for c in (6, 7, 8, 9, 4, 5))
            pieces = list(render_chunk(roles, texts, s, t, before, last))
            i, out, action, role, cost, rendered = zip(*pieces, strict=True)
            base = (part << 40) + (at << 14)  # a chunk has at most 2 * chunk + 4 pieces
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([whole.column(0).chunk(0).slice(0, 1)] * len(i)), pa.array([base + k for k in range(len(i))], pa.int64()), pa.array([turn[x] if x >= 0 else None for x in i], whole.schema.field(1).type),
                    pa.array(out, pa.int64()), pa.array(action, pa.string()), pa.array([x or None for x in role], pa.string()), pa.array(cost, pa.int32()), pa.array(rendered, pa.string()),
                ],
                ["id", "piece", "turn", "out_turn", "action", "role", "cost", "rendered"],
            )

    out = T.StructType([T.StructField("id", id_kind), T.StructField("piece", T.LongType()), T.StructField("turn", turn_kind), T.StructField("out_turn", T.LongType()), T.StructField("action", text), T.StructField("role", text), T.StructField("cost", T.IntegerType()), T.StructField("rendered", text)])
    found = ordered.mapInArrow(render, out)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("turn", turn_col)


def _chunks(batches: Iterator[pa.RecordBatch], at: int, also: int | None = None) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows of equal chunk number (and part), which may reach over several batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(at).to_numpy().astype(np.int64)
        if also is not None:
            key = key + (batch.column(also).to_numpy().astype(np.int64) << 32)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and key[a] != now:
                yield held
                held = []
            now = key[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held

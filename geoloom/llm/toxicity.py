"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: words, word pairs, pairs with one word between
(skip-grams), and words cut to their first five letters; lower-cased, hashed into 2**bits slots. The
learner keeps a learning rate for each slot and an L1 penalty that leaves most weights at zero, so
a model is a few thousand (slot, weight) pairs, which are broadcast: their number is bounded by
2**bits whatever the corpus.

Training is spread over a fixed number of shards. Each pass, every shard continues from the common
state and goes through its rows in a fixed order; the states are then averaged (parameter mixing).
States travel as files in the shared folder: what a shard changed as (slot, z, n), a name per task
attempt, and the average of all, 2**bits slots. The driver reads one shard's file at a time.
Training uses at most ``max_train`` labelled rows, chosen by a hash of the id; scoring covers all.

Null and empty texts have the bias alone and get its score. Rows without a label, or with a null id, are not
trained on; an id with several labels counts with each. With no rows to train on every score is 0.5.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import Words, checkpointed, mix, new_folder, open_folder, slices

STEM = 5
BIAS = 0


def features(texts: list[bytes], bits: int) -> Iterator[np.ndarray]:
    """Each text's distinct slots, the bias first."""
    words = Words(texts, lower=True)
    h = words.hashes
    stems = _stems(words)
    gap1, gap2 = np.zeros_like(h), np.zeros_like(h)
    gap1[:-1] = mix(h[:-1] * np.uint64(3) + h[1:])
    gap2[:-2] = mix(h[:-2] * np.uint64(5) + h[2:] + np.uint64(1))
    shift = np.uint64(64 - bits)
    for i in range(len(texts)):
        a, b = int(words.first[i]), int(words.first[i + 1])
        own = np.concatenate([h[a:b], stems[a:b], gap1[a : max(a, b - 1)], gap2[a : max(a, b - 2)]]) >> shift
        own = np.unique(own).astype(np.int64)
        yield np.concatenate([[BIAS], own[own != BIAS]])


def _stems(words: Words) -> np.ndarray:
    """Hashes of the words' first letters, as far as STEM bytes go."""
    out = np.zeros(len(words.start), np.uint64)
    for k in range(STEM):
        at = words.start + k
        inside = at < words.end
        out = out * np.uint64(257) + np.where(inside, words.data[np.minimum(at, len(words.data) - 1)], 0).astype(np.uint64) + np.uint64(1)
    return mix(out ^ np.uint64(0xA4093822299F31D0))


class Ftrl:
    """FTRL-proximal state over 2**bits slots: z, the sums n of squared gradients, and the weights they give."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


CHANGED = np.dtype([("slot", "<u4"), ("z", "<f4"), ("n", "<f4")])


def _shard_pass(start: str | None, folder: str, settings: tuple):
    """Goes through each shard's rows, which lie together in one partition, and writes what of the state changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        shard, own, first = None, None, None

        def begun() -> Ftrl:
            out = Ftrl(*settings)
            if start is not None:
                with files.open_input_file(f"{base}/{start}") as source:
                    out.z[:], out.n[:] = np.frombuffer(source.read(), "<f8").reshape(2, -1)
            return out

        def ended() -> pa.RecordBatch:
            at = np.flatnonzero(own.n != first)
            changed = np.empty(len(at), CHANGED)
            changed["slot"], changed["z"], changed["n"] = at, own.z[at], own.n[at]
            name = f"shard-{shard}-{uuid.uuid4().hex}"
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(changed.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name])], ["shard", "file"])

        for batch in batches:
            shards, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, found in enumerate(batch.column(2)):
                if shards[i] != shard:
                    if own is not None:
                        yield ended()
                    shard, own = shards[i], begun()
                    first = own.n.copy()
                own.learn(np.frombuffer(found.as_py(), "<u4").astype(np.int64), labels[i])
        if own is not None:
            yield ended()

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, shards: int = 4, passes: int = 4, max_train: int = 40_000, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> dict[str, np.ndarray]:
    """Weights (slots, weights) learnt from docs that have a label in ``labels``."""
    marks = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("label")).where("lid IS NOT NULL AND label IN (0, 1)")
    marks = marks.orderBy(F.xxhash64("lid", F.lit(7)), "lid", "label").limit(max_train)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(x.as_py() for x in batch.column(2)):
                found = [x.astype("<u4").tobytes() for x in features(texts, bits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(found, pa.binary())], ["id", "label", "slots"])

    # at most max_train ids and labels are broadcast, so the texts stay where they are
    texts = docs.select(F.col(id_col).alias("id"), F.encode(text_col, "UTF-8").alias("text"))
    rows = texts.join(F.broadcast(marks), F.col("id") == F.col("lid")).select("id", "label", "text")
    rows = rows.mapInArrow(slots, T.StructType([rows.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("slots", T.BinaryType())]))
    rows = rows.withColumn("turn", F.xxhash64("id", "label")).withColumn("shard", F.pmod(F.col("turn"), F.lit(shards)).cast("int"))
    rows = checkpointed(rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "turn", "slots").select("shard", "label", "slots"))
    state, start, folder = Ftrl(bits, alpha, beta, l1, l2), None, new_folder(docs.sparkSession, "ftrl")
    files, base = open_folder(folder)
    files.create_dir(base, recursive=True)
    for k in range(passes):
        ended = sorted(rows.mapInArrow(_shard_pass(start, folder, (bits, alpha, beta, l1, l2)), "shard int, file string").collect())  # a row a shard
        z, n, met = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits, np.int32)
        for _, name in ended:  # a slot's state is averaged over the shards that changed it
            with files.open_input_file(f"{base}/{name}") as source:
                changed = np.frombuffer(source.read(), CHANGED)
            at = changed["slot"]
            z[at] += changed["z"] - state.z[at]
            n[at] += changed["n"] - state.n[at]
            met[at] += 1
            files.delete_file(f"{base}/{name}")
        state.z += z / np.maximum(1, met)
        state.n += n / np.maximum(1, met)
        if start is not None:
            files.delete_file(f"{base}/{start}")
        if not ended or k == passes - 1:
            break
        start = f"state-{k}"
        with files.open_output_stream(f"{base}/{start}", compression=None) as out:
            out.write(np.stack([state.z, state.n]).astype("<f8").tobytes())
    at = np.arange(1 << bits)
    w = state.weights(at)
    return {"slots": at[w != 0].astype(np.int64), "weights": w[w != 0], "bits": bits}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with one more column: the model's probability of label 1. No shuffle."""
    carried = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    if score_col in names:
        raise ValueError(f"docs already has a column {score_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << carried.value["bits"])
        dense[carried.value["slots"]] = carried.value["weights"]
        at = names.index(text_col)
        for batch in batches:
            for first, texts in slices(x.as_py() for x in batch.column(at)):
                found = [dense[x].sum() for x in features(texts, carried.value["bits"])]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns, pa.array(sigmoid(np.array(found)))], [*names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id", parts: int = 5):
    """Whether a row is kept from training: crc32 of its id as text, modulo ``parts``, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))

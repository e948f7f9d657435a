"""Operator 7: byte-pair encoding and decoding, with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be covered by a
merge, so every encoding has a boundary there. Texts are cut at such pairs; the short fragments
are encoded one by one and their ids are put together again. A task remembers the ids of fragments
of up to sixteen bytes in a table of bounded size, compared byte for byte and looked up for a
whole slice of texts at once. The result is the library's own for the whole text. A tokenizers
file whose normalizer and pre-tokenizer are not of the two kinds known here goes to the library
text by text.

Nulls and empty texts give empty id lists; repeated rows are encoded each; empty tables give
empty results; only the named columns are read, so other columns never clash.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.text import Words, lanes, mix, slices

SLICE, SLOTS, SHORT, PIECES, JOINED = 1 << 20, 1 << 21, 16, 300_000, 2000
#: The pattern of the word-level vocabulary, and the same for texts of ASCII and Latin-1 letters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PIECE = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+")
ODD = re.compile(f"^[^\n]*(?:[^{PLAIN}\n]|<\\|)[^\n]*$", re.MULTILINE)
#: Stands between words; no id's bytes look like it.
BETWEEN = b"\xff" * 4


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next unused from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _token_bytes(tokenizer) -> dict[int, bytes]:
    alphabet = byte_alphabet()
    added = {a["content"] for a in json.loads(tokenizer.to_str())["added_tokens"]}
    out = {}
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        plain = token in added or any(c not in alphabet for c in token)
        out[i] = token.encode() if plain else bytes(alphabet[c] for c in token)
    return out


def forced_pairs(tokens) -> np.ndarray:
    """256 x 256: True where no token holds the two bytes side by side."""
    free = np.ones((256, 256), bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            free[b[:-1], b[1:]] = False
    return free


def safe_pairs(tokens) -> np.ndarray:
    """The forced pairs at which the pre-tokenizer, too, sees each side as it would see the whole.

    Left out: places inside a character; before an apostrophe, which may begin a contraction;
    after white space, whose last character belongs to the word that follows. A space is safe
    after any byte that isn't itself white space.
    """
    safe = forced_pairs(tokens)
    safe[:, 0x80:0xC0] = False
    safe[:, 0x27] = False
    safe[:0x21, :] = False
    beyond = safe[0x80:, 0x20].copy()
    safe[0x80:, :] = False
    safe[0x80:, 0x20] = beyond
    return safe


class Known:
    """The ids of fragments of at most SHORT bytes, by open addressing; half of the slots are used at most."""

    def __init__(self, slots: int = SLOTS):
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.size, self.n, self.at = np.zeros(slots, np.uint8), np.zeros(slots, np.uint8), np.zeros(slots, np.int32)
        self.ids, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.last, self.shift = slots - 1, np.uint64(65 - slots.bit_length())

    def _slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high + size.astype(np.uint64))) >> self.shift).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each fragment, or -1."""
        slot, out = self._slots(low, high, size), np.full(len(low), -1)
        there = self.size[slot]
        same = (there == size) & (self.low[slot] == low) & (self.high[slot] == high)
        out[same] = slot[same]
        left = np.flatnonzero(~same & (there > 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & self.last
            there = self.size[at]
            same = (there == size[left]) & (self.low[at] == low[left]) & (self.high[at] == high[left])
            out[left[same]] = at[same]
            left = left[~same & (there > 0)]
        return out

    def stage(self, ids: np.ndarray) -> int:
        """Puts ids behind those that are kept, and says where; they stay if add() follows."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        return self.used

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Keeps different fragments, not yet there, whose ids have been staged."""
        slot, left = self._slots(low, high, size), np.arange(len(low))
        while len(left):
            free = left[self.size[slot[left]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            to = slot[free]
            self.low[to], self.high[to], self.size[to], self.at[to], self.n[to] = low[free], high[free], size[free], at[free], n[free]
            left = np.setdiff1d(left, free, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.last
        self.held += len(low)


class Encoder:
    """Encodes texts with a tokenizers file, fragment by fragment."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.cutting = _cutting(spec)
        tokens = _token_bytes(self.tokenizer)
        self.safe = safe_pairs(tokens.values()) if self.cutting == "pairs" else np.zeros((256, 256), bool)
        self.table = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.known = Known()
        if self.cutting == "words":
            bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(bare))  # the merges alone, on pieces whose bytes are shown as characters
            self.shown = {b: c for c, b in byte_alphabet().items()} | {32: " "}
            suffix = spec["model"]["end_of_word_suffix"]
            self.final = np.zeros(len(self.table), bool)
            self.final[[i for t, i in self.merges.get_vocab().items() if t.endswith(suffix)]] = True
            self.pieces: dict[str, bytes] = {}

    def fragments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Padded bytes; start and end of each fragment; and how many come before each text (one more entry than texts)."""
        if self.cutting == "words":
            found = Words(texts, lower=False, hashed=False)
            return found.data, found.start, found.end, found.first
        data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
        cut = np.zeros(len(data) - 7, bool)
        cut[1:-1] = self.safe[data[:-9], data[1:-8]]
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=edges[1:])
        cut[edges] = True
        at = np.flatnonzero(cut)
        return data, at[:-1], at[1:], np.searchsorted(at, edges)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned, 32 bits) of the texts in order, and how many belong to each text."""
        data, start, end, first = self.fragments(texts)
        known, size = self.known, end - start
        low, high = lanes(data, start, size), np.zeros(len(start), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = lanes(data, start[more] + 8, size[more] - 8)
        slot = known.find(low, high, np.where(size <= SHORT, size, 255))
        at, n = known.at[slot].astype(np.int64), known.n[slot].astype(np.int64)
        late = np.flatnonzero(slot < 0)
        if len(late):
            whole = data.tobytes()
            parts = [whole[a:b] for a, b in zip(start[late].tolist(), end[late].tolist(), strict=True)]
            place = {p: i for i, p in enumerate(dict.fromkeys(parts))}
            ids, counts = self._by_pieces(list(place)) if self.cutting == "words" else self._by_library(list(place))
            base = known.stage(ids) + np.cumsum(counts) - counts
            which = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
            at[late], n[late] = base[which], counts[which]
            fresh = late[np.unique(which, return_index=True)[1]]
            fresh = fresh[(size[fresh] <= SHORT) & (n[fresh] < 256)]
            if known.held + len(fresh) <= len(known.size) // 2:
                known.add(low[fresh], high[fresh], size[fresh], at[fresh], n[fresh])
                known.used += len(ids)
        ends = np.cumsum(n)
        out = known.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.diff(np.concatenate([[0], ends])[first])

    def _by_library(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([f.decode("utf-8", "replace") for f in fragments], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _by_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain Latin letters, digits and signs are cut as the tokenizer's own pattern
        cuts them, and go straight to its merges; others take the library's whole way."""
        texts = b"\n".join(words).decode("utf-8", "replace").split("\n")
        odd = set(ODD.findall("\n".join(texts)))
        out: list = [None] * len(words)
        other = [i for i, t in enumerate(texts) if t in odd] if odd else []
        if other:
            ids, counts = self._by_library([words[i] for i in other])
            ends = np.cumsum(counts).tolist()
            for i, a, b in zip(other, [0, *ends], ends, strict=False):
                out[i] = ids[a:b].tobytes()
        plain = [i for i, t in enumerate(texts) if t not in odd] if odd else range(len(words))
        if len(plain):
            pieces = PIECE.findall("\n".join([texts[i] for i in plain]).lower())
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            self._learn(list(set(pieces).difference(self.pieces, "\n")))
            self.pieces["\n"] = BETWEEN
            for i, x in zip(plain, b"".join(map(self.pieces.__getitem__, pieces)).split(BETWEEN), strict=True):
                out[i] = x
        counts = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), "<u4"), counts

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces, many in one string; each ends with the one token of it that carries the suffix."""
        joined = [" ".join(pieces[a : a + JOINED]).encode().decode("latin-1").translate(self.shown) for a in range(0, len(pieces), JOINED)]
        for k, e in enumerate(self.merges.encode_batch_fast(joined, add_special_tokens=False)):
            own, ids = pieces[k * JOINED : (k + 1) * JOINED], np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(own):
                raise ValueError("the vocabulary's word ends are not those of its words")
            data, edges = ids.tobytes(), (4 * ends).tolist()
            self.pieces.update(zip(own, [data[a:b] for a, b in zip([0, *edges], edges, strict=False)], strict=True))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; an id outside the vocabulary gives nothing."""
        table, size = self.table, len(self.table)
        return b"".join([table[i] for i in ids.tolist() if 0 <= i < size]).decode("utf-8", "replace")


def _cutting(spec: dict) -> str:
    """Where texts may be cut: "words" between words, "pairs" at forced boundaries, else "texts"."""
    way, before = spec["normalizer"], spec["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [])
    if way is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "pairs"
    folds = way is not None and [x["type"] for x in way.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    if folds and (way["normalizers"][1]["pattern"], way["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ") and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
        split, level = steps
        if split["pattern"] == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"] and not level["use_regex"] and not level["add_prefix_space"] and spec["model"]["end_of_word_suffix"]:
            return "words"
    return "texts"


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(ids: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    edges = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.view(np.int32))), edges


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>), a row for each row of docs. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            keys = batch.column(0)
            for first, texts in slices((x.as_py() for x in batch.column(1)), SLICE):
                ids, _ = _lists(*coder.encode(texts))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(texts)), ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, text_col).withColumn(text_col, F.encode(text_col, "UTF-8")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, text_col): the ids with the text that they stand for. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            edges, flat = ids.offsets.to_numpy(), ids.values.fill_null(-1).to_numpy()
            for a in range(0, len(keys), 256):
                b = min(a + 256, len(keys))
                texts = [coder.decode(flat[edges[i] : edges[i + 1]]) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), ids.slice(a, b - a), pa.array(texts, pa.string())], [id_col, "ids", text_col])

    kind = encoded.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(text_col, T.StringType())])
    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task needs one Python worker instead of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first, texts in slices((x.as_py() for x in batch.column(1)), SLICE):
                found, counts = coder.encode(texts)
                ids, edges = _lists(found, counts)
                decoded = [coder.decode(found[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), ids, pa.array(decoded, pa.string())], [id_col, "ids", text_col])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField(text_col, T.StringType())])
    return docs.select(id_col, F.encode(text_col, "UTF-8").alias(text_col)).mapInArrow(run, schema)


def digests(decoded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode(text_col, "UTF-8"), 256).alias("decoded_sha256"),
    )

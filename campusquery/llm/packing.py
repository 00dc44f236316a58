"""Bounded-space online packing of token sequences.

Every partition keeps a fixed number of open windows. A piece goes to the window where the least room is
left (best fit); where none has room, the fullest is topped up with the head of the piece, emitted full,
and the rest goes on. At its end a partition pours its open windows together, so that at most one is left
that isn't full; these left-overs, which carry their ids, are poured together in groups of 256 partitions
until one window is left of the whole table.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, table

CAPACITY, OPEN, GROUP = 1024, 64, 256
#: The vocabulary of byte_bpe_50k.json, as ranks; both libraries give the same ids.
RANKS = "byte_bpe_50k.tiktoken"
#: The tokenizer itself, for its added tokens, which the ranks lack.
TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids binary"


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(n) for word, n in map(bytes.split, lines)}
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as own:
        added = {t["content"]: t["id"] for t in json.load(own)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str | None, path: str, encode_special_tokens: bool = True) -> np.ndarray:
    """Ids of the whole text (null: empty), then id 0.

    ``encode_special_tokens`` is the switch of tokenizers: strings of added tokens are ordinary text with it,
    and get the token's own id without it, which is that library's default.
    """
    special = set() if encode_special_tokens else "all"
    return np.append(encoding(path).encode_to_numpy(text or "", allowed_special=special, disallowed_special=()), 0).astype("<u4")


class Packer:
    """Windows of ``capacity`` ids, ``slots`` of them open; ``emit(pieces)`` gets each that is full.

    A piece is (doc_id, start, doc_tokens, ids).
    """

    def __init__(self, emit, capacity: int = CAPACITY, slots: int = OPEN):
        self.emit, self.capacity, self.slots = emit, capacity, slots
        self.windows: dict[int, list] = {}
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.made = 0

    def add(self, piece) -> None:
        doc, start, total, ids = piece
        while len(ids) >= self.capacity:
            self.emit([(doc, start, total, ids[: self.capacity])])
            start, ids = start + self.capacity, ids[self.capacity :]
        while len(ids):
            at = bisect_left(self.rooms, (len(ids), -1))
            if at < len(self.rooms):
                self._put(at, (doc, start, total, ids))
                return
            if len(self.rooms) < self.slots:
                self.made += 1
                self.windows[self.made] = []
                insort(self.rooms, (self.capacity, self.made))
            else:
                room = self.rooms[0][0]
                self._put(0, (doc, start, total, ids[:room]))
                start, ids = start + room, ids[room:]

    def _put(self, at: int, piece) -> None:
        room, window = self.rooms.pop(at)
        self.windows[window].append(piece)
        if room > len(piece[3]):
            insort(self.rooms, (room - len(piece[3]), window))
        else:
            self.emit(self.windows.pop(window))

    def close(self) -> list:
        """Pours the open windows together; the pieces of the one that isn't full."""
        room, window = self.capacity, []
        for piece in (p for w in self.windows.values() for p in w):
            doc, start, total, ids = piece
            if len(ids) >= room:
                window.append((doc, start, total, ids[:room]))
                self.emit(window)
                start, ids, room, window = start + room, ids[room:], self.capacity, []
            if len(ids):
                window.append((doc, start, total, ids))
                room -= len(ids)
        self.windows, self.rooms = {}, []
        return window


class Rows:
    """Pieces of emitted windows as columns; sequence ids start at ``first``."""

    def __init__(self, first: int):
        self.next, self.cols = first, [[] for _ in range(8)]

    def add(self, window, keep: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in window:
            row = (doc, start, len(ids), crc32(ids.tobytes()), total, self.next, offset, ids.tobytes() if keep else None)
            for col, x in zip(self.cols, row, strict=True):
                col.append(x)
            offset += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n != "ids" else pa.binary()) for n, c in zip(names, self.cols, strict=True)], list(names))
        self.cols = [[] for _ in names]
        return out


def pack_partition(path: str, capacity: int, slots: int, encode_special_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(TaskContext.get().partitionId() << 33)
        packer = Packer(rows.add, capacity, slots)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), path, encode_special_tokens)
                packer.add((doc, 0, len(ids), ids))
            yield rows.batch()
        rows.add(packer.close(), keep=True)
        yield rows.batch()

    return run


def merge_group(capacity: int, slots: int, level: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = Rows((level << 56) + (key[0].as_py() << 33))
        packer = Packer(rows.add, capacity, slots)
        for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            packer.add((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")))
        rows.add(packer.close(), keep=True)
        return pa.Table.from_batches([rows.batch()])

    return run


def pack(work: Work, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slots: int = OPEN, encode_special_tokens: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of the windows of ``docs``.

    A null text is empty and still has the closing id; null ids and repeated rows are packed like others.
    Every window is full but one of the whole table. The partitions' result is saved before it is used, so a
    lost executor repeats only its own partitions.
    """
    path = path or public_tokenizers.path(RANKS)
    left = work.save(docs.select("doc_id", "text").mapInArrow(pack_partition(path, capacity, slots, encode_special_tokens), SCHEMA), "pack0")
    pid = F.shiftright("sequence_id", 33)
    groups, level, done = (left.agg(F.max(pid)).first()[0] or 0) + 1, 1, [left.filter("ids is null")]
    left = left.filter("ids is not null").withColumn("_group", pid)
    while groups > 1:
        groups = -(-groups // GROUP)
        grouped = left.withColumn("_group", F.floor(F.col("_group") / GROUP)).groupBy("_group")
        merged = work.save(grouped.applyInArrow(merge_group(capacity, slots, level), SCHEMA), f"pack{level}")
        done.append(merged.filter("ids is null"))
        left = merged.filter("ids is not null").withColumn("_group", F.shiftright("sequence_id", 33).bitwiseAND(2**23 - 1))
        level += 1
    return reduce(DataFrame.unionAll, [*done, left.drop("_group")]).drop("ids")


def op2_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, with the tokenizer's default settings."""
    return pack(Work(spark), table(spark, sf_dir, "documents"), encode_special_tokens=False)

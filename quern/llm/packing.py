"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed within their task, so nothing is shuffled. A document longer than a
sequence gives full sequences first; what is left joins, uncut, a group of pieces that fills about ``GROUP`` windows.
Differencing starts from one partial partition for each piece, and merges the two with the largest spread
again and again: the largest window of the one goes with the smallest of the other. The result is near-equal
windows, as few as hold the group's tokens; wherever one exceeds the capacity, the window count rises and the
group is divided anew. No piece is cut for it, since each fits a window and there may be as many windows as pieces.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base, tokens

LENGTH = 2048
GROUP = 128


def karmarkar_karp(sizes: list[int], windows: int) -> list[list[int]]:
    """The items of each of ``windows`` windows of near-equal sum. Ties go by the items' order."""
    if windows <= 0 or not sizes:
        return [[] for _ in range(windows)]
    # A partial partition: its non-empty windows by sum, largest first; sums are relative once no window is empty.
    heap = [(-s, i, [(s, (i, None, None))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:  # the smallest of either meet: a's last with b's last but reversed
            free_a, free_b = len(a) - over, len(b) - over
            merged = a[:free_a] + b[:free_b]
            merged += [(x + y, (-1, p, q)) for (x, p), (y, q) in zip(a[free_a:], reversed(b[free_b:]), strict=True)]
        merged.sort(key=_sum, reverse=True)
        least = merged[-1][0] if len(merged) == windows else 0
        if least:
            merged = [(s - least, t) for s, t in merged]
        heapq.heappush(heap, (-merged[0][0], serial, merged))
        serial += 1
    out = []
    for _, tree in heap[0][2]:
        items, left = [], [tree]
        while left:
            i, p, q = left.pop()
            if i >= 0:
                items.append(i)
            else:
                left += [p, q]
        out.append(sorted(items))
    return out + [[] for _ in range(windows - len(out))]


def _sum(x: tuple) -> int:
    return x[0]


Piece = tuple[int, int, int]  # place of the document in the group, start, length


def pack_group(pieces: list[Piece], capacity: int = LENGTH) -> list[list[Piece]]:
    """Windows of ``pieces`` of at most ``capacity`` tokens, from the least number that holds them upwards; no piece may be larger."""
    windows = -(-sum(p[2] for p in pieces) // capacity)
    while True:
        got = karmarkar_karp([p[2] for p in pieces], windows)
        if all(sum(pieces[i][2] for i in w) <= capacity for w in got):
            return [[pieces[i] for i in w] for w in got if w]
        windows += 1


SCHEMA = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class Packer:
    """Packs a stream of (key, ids) and yields (key, start, length, doc_tokens, sequence, offset, ids)."""

    def __init__(self, first: int, capacity: int = LENGTH, group: int = GROUP):
        self.sequence, self.capacity, self.room = first, capacity, group * capacity
        self.docs: list[tuple] = []
        self.pieces: list[Piece] = []
        self.size = 0

    def _emit(self, windows: list[list[Piece]]) -> Iterator[tuple]:
        for window in windows:
            at = 0
            for d, start, n in window:
                key, tail, before, total = self.docs[d]
                yield key, start, n, total, self.sequence, at, tail[4 * (start - before) : 4 * (start - before + n)]
                at += n
            self.sequence += 1

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        n, start = len(ids) // 4, 0
        while n - start >= self.capacity:
            yield key, start, self.capacity, n, self.sequence, 0, ids[4 * start : 4 * (start + self.capacity)]
            self.sequence, start = self.sequence + 1, start + self.capacity
        if start < n:
            if self.size + n - start > self.room:
                yield from self.close()
            self.docs.append((key, ids[4 * start :], start, n))  # a group holds tails only, however long their documents are
            self.pieces.append((len(self.docs) - 1, start, n - start))
            self.size += n - start

    def close(self) -> Iterator[tuple]:
        yield from self._emit(pack_group(self.pieces, self.capacity))
        self.docs, self.pieces, self.size = [], [], 0


def pack(docs: DataFrame, path: str, *, end: int | None = tokens.END, capacity: int = LENGTH, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pieces of the documents in their sequences: ``keys``, start, length, doc_tokens, sequence_id, offset and ids.

    Null texts count as empty and consist of the end id. Repeated rows are packed one by one. A text of any length is
    encoded whole and gives full sequences at once. Columns of ``docs`` other than ``keys`` and text aren't kept,
    whatever their names. A sequence's id holds the number of its partition in the upper bits, so ids are unique, but not gapless.
    """
    tail = b"" if end is None else struct.pack("<I", end)
    chosen = docs.select(*keys, "text")
    schema = T.StructType([*[chosen.schema[k] for k in keys], *SCHEMA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 33, capacity)
        kinds: list[pa.DataType] = []
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array([k[i] for k in cols[0]], kinds[i]) for i in range(len(keys))]
            arrays += [pa.array(c, pa.int64()) for c in cols[1:6]] + [pa.array(cols[6], pa.binary())]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in range(len(keys))]
            for at in range(0, batch.num_rows, tokens._STEP):
                part = batch.slice(at, tokens._STEP)
                names = zip(*[part.column(i).to_pylist() for i in range(len(keys))], strict=True)
                for key, ids in zip(names, own.encode(_base.texts_of(part, "text")), strict=True):
                    rows.extend(packer.add(key, ids + tail))
                    if len(rows) >= 2000:
                        yield out()
            _base.trim()
        rows.extend(packer.close())
        if rows:
            yield out()
        _base.trim()

    return chosen.mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_base.read(spark, sf_dir, "documents"), public_tokenizers.path(tokens.VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def padding(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens and padding of the result of ``pack`` or its query; powers of two aren't padded."""
    n = F.sum("length")
    per = pieces.groupBy("sequence_id").agg(n.alias("n"))
    pad = F.when(F.expr("bit_count(n) = 1"), 0).otherwise(capacity - F.col("n"))
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))

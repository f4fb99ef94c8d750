"""Best-fit packing of documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins is open. Their free spaces are the
bits of one integer; the tightest bin that holds a piece is the lowest set bit at or above
its length, found by a shift and a mask. When too many bins are open the fullest closes,
which is the lowest set bit of all.

Texts are encoded where they are read; only a small row a piece moves. Full pieces are
sequences of their own. The others are dealt to packers of a bounded number of rows, by a
hash of the id, and arrive there in the order of another hash. A packer looks WINDOW pieces
ahead and places these longest first: long ones open bins, short ones fill them up. That
many bins are not kept open, so the fullest of earlier windows close. A lost executor
repeats its packer with the same rows in the same order, so sequence ids do not change.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, trimmed
from .vocab import byte_encoder, path

CAPACITY = 1024
#: About half of the pieces of a window open a bin before short ones fill them, so a packer
#: keeps half as many bins open as it looks ahead; half of that cost a tenth more sequences.
WINDOW, OPEN_BINS = 4096, 2048
PACKER_ROWS = 32768

PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


class BestFit:
    """Open bins by free space. place(length) -> (bin number, offset in it)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits = self.open = self.made = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece must have 1 to {self.capacity} ids")
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if free > length:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.bins[free - length].append(number)
            self.bits |= 1 << (free - length)
            self.open += 1
        return number, self.capacity - free


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: the first takes what full pieces leave."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def _pieces(file: str, end_id: int, capacity: int):
    end = struct.pack("<I", end_id)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(file)
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                ids, at = ids + end, 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), place))
                    at, place = at + n, place + 1
            if rows:
                yield _batch(zip(*rows, strict=True), PIECE_COLUMNS)

    return read


def _batch(columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "piece" else pa.int64()) for x, n in zip(columns, names, strict=True)], names)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of window rows, the last one of fewer, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= window:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield rows.slice(0, window).to_batches()[0]
            held = rows.slice(window).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(capacity: int, open_bins: int, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 33
        for batch in _windows(batches, window):
            lengths = batch.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            placed = [fit.place(n) for n in lengths[order].tolist()]
            found = [first + number for number, _ in placed], [offset for _, offset in placed]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(order)).columns, *map(pa.array, found)], [*batch.schema.names, "sequence_id", "offset"])

    return pack


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    packer_rows: int = PACKER_ROWS,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than capacity are cut from their end into full pieces; the first may
    be shorter. A null text counts as empty: its end id alone is a piece. Null ids are
    kept. Rows that repeat are packed once each. Further columns are not read. An empty
    table gives an empty result. Sequence ids of full pieces are below zero.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(trimmed(_pieces(tokenizer or path("byte_bpe_50k.json"), end_id, capacity), "byte_encoder"), PIECE_SCHEMA))
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-F.col("place") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = pieces.filter(F.col("length") < capacity)
    packers = max(1, -(-short.count() // packer_rows))
    dealt = short.repartition(packers, F.xxhash64("doc_id", "place")).sortWithinPartitions(F.xxhash64("place", "doc_id"), "doc_id", "place")
    packed = dealt.mapInArrow(trimmed(_packed(capacity, open_bins, window)), f"{PIECE_SCHEMA}, sequence_id long, offset long").drop("place")
    return full.unionByName(packed)

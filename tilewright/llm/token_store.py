"""Token ids in directly addressable codes.

An id is split into chunks of a few bits, low ones first. Level l holds the l-th chunk of
every id that has one, a bitmap that says which of them go on, and a rank directory over
that bitmap, so that the place of an id's next chunk is one rank away. Any token is read
by touching one chunk a level; no block is decoded.

A shard is one such file over the ids of consecutive documents, with their ids and bounds.
Shards are rows of a Parquet table, written by Spark's committer to the shared folder, so
that lost executors leave no half-written shard behind.

A shard holds at most SHARD_TOKENS ids and the rest of its last document. Documents are
dealt by ranges of doc_id, so shards in (part, number) order hold them in ascending order.
Only the number of ids of each range partition comes to the driver: a row a partition.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, spread, text_of, trimmed
from .vocab import path, word_encoder

MAGIC = b"DAC1"
RANK_BITS = 512
SHARD_TOKENS = 1 << 20


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def pack(ids: np.ndarray, width: int = 8) -> bytes:
    """ids (below 2**32) as directly addressable codes; width: bits of a chunk, 1 to 8."""
    if not 1 <= width <= 8:
        raise ValueError("width must be 1 to 8")
    rest = np.asarray(ids, np.uint64)
    if rest.size and int(rest.max()) >> 32:
        raise ValueError("ids must be below 2**32")
    levels = []
    while rest.size or not levels:
        chunk = (rest & np.uint64((1 << width) - 1)).astype(np.uint8)
        more = (rest >> np.uint64(width)) > 0
        bits = np.packbits(more, bitorder="little")
        per = np.add.reduceat(more.astype(np.uint32), np.arange(0, more.size, RANK_BITS)) if more.size else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per)]).astype("<u4")
        levels.append((rest.size, _pad(chunk.tobytes()) + _pad(bits.tobytes()) + _pad(ranks.tobytes())))
        rest = rest[more] >> np.uint64(width)
    head = MAGIC + struct.pack("<BBxx", width, len(levels)) + b"".join(struct.pack("<Q", n) for n, _ in levels)
    return head + b"".join(body for _, body in levels)


class Packed:
    """Read access to what pack() wrote."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.width, levels = struct.unpack_from("<BB", data, 4)
        sizes = struct.unpack_from(f"<{levels}Q", data, 8)
        at, self.levels = 8 + 8 * levels, []
        for n in sizes:
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, (n + 7) // 8), (np.dtype("<u4"), (n + RANK_BITS - 1) // RANK_BITS + 1)):
                parts.append(np.frombuffer(data, kind, count, at))
                at += -(-parts[-1].nbytes // 8) * 8
            self.levels.append(parts)

    def __len__(self) -> int:
        return self.levels[0][0].size

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, bits, ranks = self.levels[level]
        block = i // RANK_BITS
        start = block * RANK_BITS // 8
        ones = np.unpackbits(bits[start : (i + 7) // 8], bitorder="little")[: i - block * RANK_BITS]
        return int(ranks[block]) + int(ones.sum())

    def __getitem__(self, i: int) -> int:
        """The id at place i: one chunk and one rank a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (self.width * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids of places start to stop, from the chunks of those places alone."""
        start, stop = max(0, start), min(stop, len(self))
        if start >= stop:
            return np.zeros(0, np.uint32)
        chunks, bits, _ = self.levels[0]
        out = chunks[start:stop].astype(np.uint32)
        at = np.arange(out.size)
        for level in range(1, len(self.levels)):
            first = start - start % 8
            more = np.unpackbits(self.levels[level - 1][1][first // 8 : (stop + 7) // 8], bitorder="little")[start - first : stop - first]
            at = at[more.astype(bool)]
            start = self._rank(level - 1, start)
            stop = start + at.size
            if not at.size:
                break
            out[at] |= self.levels[level][0][start:stop].astype(np.uint32) << np.uint32(self.width * level)
        return out


def _shards(file: str, end_id: int, width: int, shard_tokens: int):
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(file)
        part = TaskContext.get().partitionId()
        docs: list = []
        blobs: list[bytes] = []
        size = start = number = 0

        def shard():
            ids = np.frombuffer(b"".join(blobs), "<u4")
            bounds = np.cumsum([0, *(len(b) // 4 for b in blobs)])
            row = [part], [number], [start], [ids.size], [docs], [bounds.tolist()], [pack(ids, width)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, SHARD_TYPES, strict=True)], SHARD_COLUMNS)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), strict=True):
                docs.append(doc_id)
                blobs.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield shard()
                    start, number, size = start + size, number + 1, 0
                    docs, blobs = [], []
        if docs:
            yield shard()

    return write


SHARD_COLUMNS = ["part", "number", "start", "n_tokens", "doc_ids", "bounds", "codes"]
SHARD_TYPES = [*[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2, pa.binary()]
SHARD_SCHEMA = "part long, number long, start long, n_tokens long, doc_ids array<long>, bounds array<long>, codes binary"


def write_tokens(
    docs: DataFrame,
    to: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    width: int = 8,
    shard_tokens: int = SHARD_TOKENS,
) -> str:
    """Encode every whole text, append end_id, and write shards in ascending id order.

    A null text counts as empty and has the end id alone. Null ids come first; rows with
    equal ids stay neighbours, ordered by text. Further columns are not read. An empty
    table makes an empty table of shards. to: a folder, by default a new one beside the
    checkpoints. Returns the folder.
    """
    to = to or f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange(spread(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(trimmed(_shards(tokenizer or path("word_bpe_49k.json"), end_id, width, shard_tokens), "word_encoder"), SHARD_SCHEMA)
    shards.write.mode("overwrite").option("compression", "none").parquet(to)
    return to


def _documents(first: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, doc_ids, bounds, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = Packed(codes)
                crc = [zlib.crc32(packed.read(a, b).astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                at = first[part] + start + np.asarray(bounds[:-1], np.int64)
                columns = [pa.array(doc_ids, pa.int64()), pa.array(at), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the shards alone."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    first, total = {}, 0
    for row in sorted(shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        first[row["part"]] = total
        total += row["n"]
    return shards.select("part", "start", "doc_ids", "bounds", "codes").mapInArrow(trimmed(_documents(first)), "doc_id long, start long, n_tokens long, ids_crc32 long")

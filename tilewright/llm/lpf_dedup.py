"""Removal of repeated passages with longest-previous-factor arrays.

A byte goes when a string of LENGTH bytes that covers it also starts earlier: in a document
with a smaller id, or further up in the same one. That is so for the strings whose longest
previous factor has LENGTH bytes or more. In suffix order, the candidates for the longest
previous factor are the nearest entries above and below with a smaller position.

A suffix array of a whole corpus fits no task, so strings are first dealt by an anchor: of
the runs of GRAM bytes in a string, the one with the lowest hash. Equal strings have equal
anchors. Neighbouring strings share an anchor; their union, an extent, is a record of some
40 bytes, one for about 40 bytes of text, sent in packed columns. An extent is named by two
independent 64-bit hashes of all its bytes, under its anchor. In the order of names, extents
with a previous smaller position of the same name have only repeated strings. An anchor that
occurs in a single extent has nothing to add. What is left are the extents of anchors that
occur in several forms, at the edges of common passages: their bytes are brought together
by anchor, and the previous factors come from their suffix array, cut off at LENGTH.

Large groups: copies within a task count as one before anything moves. Anchors that a sample
of documents shows to be frequent, and those that turn out to have more than FORMS forms, are
dealt string by string, by a name of 128 bits of the whole string, which spreads them; the
sample decides the way alone, not the result. So whatever bytes do not decide, names of 128
bits do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, mix, spread, text_of, trimmed

LENGTH = 100
GRAM = 24
#: Documents that are looked at for frequent anchors, in how many of them such an anchor is, and how many anchors at most go that way.
SAMPLE, FREQUENT, ANCHORS = 4096, 12, 1 << 20
FORMS = 2000
#: Bytes of text whose records make a bucket, and that are hashed at once; records that a task holds.
BUCKET_BYTES, SLICE, HELD = 16 << 20, 1 << 20, 1 << 20

_U = np.uint64
_ODD = np.random.default_rng(LENGTH).integers(1, 1 << 63, 8).astype(_U) * _U(2) + _U(1)
#: Numbers of the byte values, for each of the two hashes.
_BYTE = np.random.default_rng(GRAM).integers(1, 1 << 63, (2, 256)).astype(_U)
_LOW = _U((1 << 24) - 1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of one of two odd numbers and of its inverse modulo 2**64."""
    if which not in _POWERS or _POWERS[which][0].size < n:
        with np.errstate(over="ignore"):
            both = []
            for base in (int(_ODD[7 - which]), pow(int(_ODD[7 - which]), -1, 1 << 64)):
                x = np.full(n, base, _U)
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            _POWERS[which] = tuple(both)
    return _POWERS[which][0][:n], _POWERS[which][1][:n]


class Slice:
    """Anchors and extents of some consecutive documents in one buffer of bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        """starts, stops: the documents' bounds in data. gram: 24, or less for short lengths."""
        self.length, self.starts = length, starts
        whole = stops - starts >= length
        inside = np.zeros(data.size + 1, np.int32)
        np.add.at(inside, starts[whole], 1)
        np.add.at(inside, stops[whole] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]))
        self.first = self.count = self.anchor = self.form = self.twin = np.zeros(0, _U)
        if not at.size:
            return
        with np.errstate(over="ignore"):
            self.down, self.sums = [], []
            for which in (0, 1):
                up, down = _powers(data.size + 1, which)
                self.down.append(down)
                self.sums.append(np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[which][data] * up[: data.size])]))
            self.grams = mix((self.sums[0][gram:] - self.sums[0][:-gram]) * self.down[0][: data.size - gram + 1])
            width = length - gram + 1
            key = (self.grams & ~_LOW) | np.arange(self.grams.size, dtype=_U)
            blocks = -(-key.size // width) * width
            key = np.concatenate([key, np.full(blocks - key.size, np.iinfo(_U).max, _U)]).reshape(-1, width)
            ahead = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
            behind = np.minimum.accumulate(key, 1).ravel()
            place = (np.minimum(ahead[at], behind[at + width - 1]) & _LOW).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
            self.first = at[new]
            self.count = np.diff(np.append(new, at.size))
            place = place[new]
            self.anchor = self.grams[place]
            shape = (place - self.first).astype(_U) * _ODD[0] + self.count.astype(_U) * _ODD[1]
            self.form, self.twin = (mix(self._hash(self.first, self.count + (length - 1), which) + shape) for which in (0, 1))

    def _hash(self, at: np.ndarray, size, which: int) -> np.ndarray:
        return (self.sums[which][at + size] - self.sums[which][at]) * self.down[which][at]

    def strings(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, and the two hashes, of every string in these extents."""
        n = self.count[rows]
        at = np.repeat(self.first[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        with np.errstate(over="ignore"):
            return at, *(mix(self._hash(at, self.length, which) + _ODD[2]) for which in (0, 1))


def slices(texts: pa.Array, length: int = LENGTH, size: int = SLICE):
    """(numbers of the texts, data, starts, stops, offset of data in its text); long texts come in overlapping parts."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        if bounds[i + 1] - bounds[i] > size:
            for at in range(int(bounds[i]), int(bounds[i + 1]) - length + 1, size):
                part = data[at : min(at + size + length - 1, int(bounds[i + 1]))]
                yield np.array([i]), part, np.array([0]), np.array([part.size]), at - int(bounds[i])
            i += 1
            continue
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = max(i + 1, min(j, len(texts)))
        yield np.arange(i, j), data[bounds[i] : bounds[j]], bounds[i:j] - bounds[i], bounds[i + 1 : j + 1] - bounds[i], 0
        i = j


# records: packed columns (anchor, form, twin, doc, first, count)
_TYPES = (_U, _U, _U, np.int64, np.int32, np.int16)


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate([p[i] for p in parts]).astype(t, copy=False) for i, t in enumerate(_TYPES)) if parts else tuple(np.zeros(0, t) for t in _TYPES)


def _firsts(records: tuple) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Records in the order of anchors and names; which of them have no previous one of their name, and which are the first of their anchor."""
    anchor, form, twin, doc, first, _ = records
    order = np.lexsort((first, doc, twin, form, anchor))
    records = tuple(x[order] for x in records)
    anchor, form, twin = records[:3]
    new = lambda x: np.concatenate([[True], x[1:] != x[:-1]])[: x.size]
    new_anchor = new(anchor)
    return records, new_anchor | new(form) | new(twin), new_anchor


def _take(records: tuple, rows) -> tuple:
    return tuple(x[rows] for x in records)


def _pack(records: tuple) -> bytes:
    return b"".join(np.ascontiguousarray(x).tobytes() for x in records)


def _unpack(data: bytes) -> tuple:
    n, at, out = len(data) // sum(np.dtype(t).itemsize for t in _TYPES), 0, []
    for t in _TYPES:
        out.append(np.frombuffer(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return tuple(out)


def _anchored(length: int, gram: int, buckets: int, often: np.ndarray, held_records: int):
    """(doc, text) -> (bucket, sure, records): to a bucket by anchor; sure: repeated for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent():
            records, new_form, _ = _firsts(_joined(held))
            bucket = (records[0] % _U(buckets)).astype(np.int64)
            rows = []
            for sure, some in ((True, ~new_form), (False, new_form)):
                at = np.flatnonzero(some)
                at = at[np.argsort(bucket[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1) if at.size else []:
                    rows.append((int(bucket[part[0]]), sure, _pack(_take(records, part))))
            yield from _batches(rows)

        for batch in batches:
            doc = batch.column(0).to_numpy()
            for numbers, data, starts, stops, offset in slices(batch.column(1), length):
                s = Slice(data, starts, stops, length, gram)
                if not s.first.size:
                    continue
                hot = np.isin(s.anchor, often)
                calm = np.flatnonzero(~hot)
                for first, count, anchor, form, twin in (
                    (s.first[calm], s.count[calm], s.anchor[calm], s.form[calm], s.twin[calm]),
                    # a string has no anchor: its first hash deals it
                    *([(at, np.ones(at.size, np.int16), a, a, b) for at, a, b in [s.strings(np.flatnonzero(hot))]] if hot.any() else []),
                ):
                    owner = np.searchsorted(starts, first, "right") - 1
                    held.append((anchor, form, twin, doc[numbers[owner]], (first - starts[owner] + offset).astype(np.int32), count.astype(np.int16)))
                    size += first.size
                if size >= held_records:
                    yield from sent()
                    held, size = [], 0
        if held:
            yield from sent()

    def _batches(rows):
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.bool_()), pa.array([r[2] for r in part], pa.binary())], ["bucket", "sure", "records"])

    return run


_FOUND = "doc long, first int, count int, anchor long, forms int"


def _found(records: tuple, forms: np.ndarray) -> pa.RecordBatch:
    anchor, _, _, doc, first, count = records
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(first), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(forms.astype(np.int32))], ["doc", "first", "count", "anchor", "forms"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of records -> repeated extents (forms 0) and first ones of anchors with several forms."""
    for t in by_group(batches, ["bucket"]):
        sure = t["sure"].to_numpy()
        blobs = t["records"].to_pylist()
        told = [_unpack(b) for b, s in zip(blobs, sure, strict=True) if s]
        if told:
            done = _joined(told)
            yield _found(done, np.zeros(done[0].size))
        records, new_form, new_anchor = _firsts(_joined([_unpack(b) for b, s in zip(blobs, sure, strict=True) if not s]))
        if not records[0].size:
            continue
        forms = np.add.reduceat(new_form.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
        again = ~new_form
        if again.any():
            yield _found(_take(records, again), np.zeros(int(again.sum())))
        several = new_form & (forms > 1)
        if several.any():
            yield _found(_take(records, several), forms[several])


_BROUGHT = "bucket long, doc long, first int, count int, anchor long, form long, bytes binary"


def _brought(length: int, gram: int, buckets: int, most_forms: int):
    """(doc, text, asked) -> the bytes of extents, by anchor; or, for anchors of many forms, strings by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows: list[tuple] = []
            for doc, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for x in asked:
                    first, count, anchor = x["first"], x["count"], x["anchor"]
                    part = text[first : first + count + length - 1]
                    if x["forms"] <= most_forms:
                        rows.append(((anchor & (2**64 - 1)) % buckets, doc, first, count, anchor, 0, part))
                        continue
                    for k in range(count):
                        d = hashlib.blake2b(part[k : k + length], digest_size=16).digest()
                        a = int.from_bytes(d[:8], "little", signed=True)
                        rows.append(((a & (2**64 - 1)) % buckets, doc, first + k, 1, a, int.from_bytes(d[8:], "little", signed=True), b""))
                if len(rows) > 20_000:
                    yield _rows_of(rows)
                    rows = []
            if rows:
                yield _rows_of(rows)

    def _rows_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _BROUGHT.split(", ")])

    return run


def truncated_suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The places at in the order of the length bytes there, and (size, ranks by that many bytes) of all places, the last for length.

    Ranks of 8 bytes are doubled up to the largest power of two times 8 within length and
    overlapped once for the rest. Every place needs length bytes after it.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = min(8, length)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: data.size]).view(">u8").ravel().astype(_U)
    if size < 8:
        words >>= _U(64 - 8 * size)
    _, rank = np.unique(words, return_inverse=True)
    ranks = [(size, rank)]
    while size < length:
        step = min(size, length - size)
        other = np.zeros(rank.size, np.int64)
        other[: rank.size - step] = rank[step:]
        _, rank = np.unique(rank.astype(np.int64) * (int(rank.max()) + 1) + other, return_inverse=True)
        size += step
        ranks.append((size, rank))
    return np.argsort(rank[at], kind="stable"), ranks


def previous_smaller(p: np.ndarray) -> np.ndarray:
    """By entry, the nearest one before it with a smaller number; -1 where there is none. Numbers differ.

    Every entry points to the one before it and goes on along the pointers of those that
    are larger; what lies between an entry and where it points is always larger.
    """
    to = np.arange(p.size) - 1
    open_ = np.flatnonzero(to >= 0)
    while open_.size:
        open_ = open_[p[to[open_]] > p[open_]]
        to[open_] = to[to[open_]]
        open_ = open_[to[open_] >= 0]
    return to


def previous_factors(order: np.ndarray, ranks: list[tuple[int, np.ndarray]], at: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The longest previous factor of each place, cut off at the last size of ranks.

    order, ranks: the suffix order; at: the places; position: which comes earlier. The
    longest previous factor is shared with the nearest entry above or below in suffix order
    whose position is smaller.
    """
    n, length = order.size, ranks[-1][0]
    p = position[order]
    above, below = previous_smaller(p), n - 1 - previous_smaller(p[::-1])[::-1]
    longest = np.zeros(n, np.int64)
    for near, there in ((above, above >= 0), (below, below < n)):
        mine, other = at[order[there]], at[order[near[there]]]
        common = np.zeros(mine.size, np.int64)
        for size, rank in reversed(ranks):
            fits = common + size <= length
            x, y = mine[fits] + common[fits], other[fits] + common[fits]
            common[fits] += np.where(rank[x] == rank[y], size, 0)
        longest[there] = np.maximum(longest[there], common)
    out = np.empty(n, np.int64)
    out[order] = longest
    return out


def _repeated(length: int):
    """Buckets of brought extents -> (doc, first, count) of strings with a previous factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, ["bucket"]):
            doc, first, count = (t[c].to_numpy() for c in ("doc", "first", "count"))
            anchor, form = t["anchor"].to_numpy(), t["form"].to_numpy()
            blobs = t["bytes"].to_pylist()
            size = np.array([len(b) for b in blobs], np.int64)
            alone = np.flatnonzero(size == 0)
            if alone.size:
                order = alone[np.lexsort((first[alone], doc[alone], form[alone], anchor[alone]))]
                again = np.concatenate([[False], (anchor[order][1:] == anchor[order][:-1]) & (form[order][1:] == form[order][:-1])])
                yield _covered(doc[order][again], first[order][again], count[order][again])
            some = np.flatnonzero(size)
            if not some.size:
                continue
            data = np.frombuffer(b"".join([blobs[i] for i in some]), np.uint8)
            stops = np.cumsum(size[some])
            n = count[some].astype(np.int64)
            at = np.repeat(stops - size[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            owner = np.repeat(some, n)
            place = first[owner] + (at - np.repeat(stops - size[some], n))
            order, ranks = truncated_suffix_order(data, at, length)
            # positions in the order of documents and, within one, of places
            position = np.empty(at.size, np.int64)
            position[np.lexsort((place, doc[owner]))] = np.arange(at.size)
            hit = np.flatnonzero(previous_factors(order, ranks, at, position) >= length)
            if hit.size:
                o, p = owner[hit], place[hit]
                new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)]))
                yield _covered(doc[o[new]], p[new], np.diff(np.append(new, hit.size)))

    return run


def _covered(doc, first, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.asarray(first).astype(np.int32)), pa.array(np.asarray(count).astype(np.int32))], ["doc", "first", "count"])


def _small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def removed(n: int, spans: list, length: int = LENGTH) -> np.ndarray:
    """Which of n bytes are covered by strings that start at first, first + 1, ... (count of them)."""
    edges = np.zeros(n + 1, np.int32)
    if spans:
        first = np.array([s["first"] for s in spans], np.int64)
        stop = first + np.array([s["count"] for s in spans], np.int64) + (length - 1)
        np.add.at(edges, first, 1)
        np.add.at(edges, stop, -1)
    return np.cumsum(edges[:-1]) > 0


def _assembled(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sizes, gone, runs, digests, left = [], [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                mask = removed(len(text), spans or [], length)
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if mask.any() else text
                sizes.append(len(text))
                gone.append(len(text) - len(kept))
                runs.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    left.append(kept)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                columns.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Buckets in turn to the partitions, so that each has as many."""
    return rows.repartitionById(parts, F.pmod(F.col("bucket"), F.lit(parts)).cast("int")).sortWithinPartitions("bucket")


def _frequent(rows: DataFrame, count: int, length: int, gram: int, sample: int, frequent: int) -> np.ndarray:
    """Anchors that are in at least frequent of about sample documents; the most frequent ANCHORS of them."""
    share = min(1.0, sample / max(1, count))
    some = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, starts, stops, _ in slices(batch.column(1), length):
                s = Slice(data, starts, stops, length, gram)
                owner = np.searchsorted(starts, s.first.astype(np.int64), "right") - 1
                pairs = np.unique(np.stack([s.anchor.view(np.int64), owner]), axis=1)[0] if s.first.size else np.zeros(0, np.int64)
                anchor, n = np.unique(pairs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(n, pa.int64())], ["anchor", "n"])

    found = some.mapInArrow(trimmed(run), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent)
    return found.orderBy(F.desc("n"), "anchor").limit(ANCHORS).select("anchor").toPandas()["anchor"].to_numpy(np.int64).view(_U)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    texts: bool = False,
    sample: int = SAMPLE,
    frequent: int = FREQUENT,
    forms: int = FORMS,
    held: int = HELD,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if texts).

    Strings are judged on the input, overlaps count, none crosses documents. The first
    occurrence stays: smaller ids are earlier; null ids come first; rows with equal ids
    are ordered by their place in the table. A null text counts as empty. Further columns
    are not read. An empty table gives an empty result. docs must be stable when read twice.
    """
    if not 8 <= gram < length < 1 << 14:
        raise ValueError("8 <= gram < length < 16384 is needed")
    rows = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc"]
    by_id = rows.groupBy("doc").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    said = by_id.agg(F.max("rows"), F.count_if(F.col("doc").isNull()), F.sum("rows"), F.sum("bytes")).first()
    most, nulls, count, total = (x or 0 for x in said)
    if most <= 1 and not nulls and kind in ("bigint", "int", "smallint", "tinyint"):
        # the filter drops nothing; it is there in both joins below, so that they share one exchange of the texts
        rows = rows.select(F.col("doc").cast("long").alias("doc"), "text").filter("doc is not null")
    else:  # number the rows in their order
        placed = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("doc").alias("id"), "text")
        ranks = placed.select("uid", "id").repartitionByRange(spread(docs), "id", "uid").sortWithinPartitions("id", "uid")
        ranks = cut(ranks.select("uid", F.monotonically_increasing_id().alias("doc")))
        rows = placed.join(ranks, "uid").select("doc", "text", "id")
    plain = rows.select("doc", "text")
    parts = spread(docs, 8)
    buckets = max(8 * parts, -(-total // BUCKET_BYTES))
    often = _frequent(plain, count, length, gram, sample, frequent)
    records = plain.mapInArrow(trimmed(_anchored(length, gram, buckets, often, held)), "bucket long, sure boolean, records binary")
    records = _dealt(records, parts)
    found = cut(records.mapInArrow(trimmed(_compared), _FOUND))

    asked = found.filter("forms > 0").groupBy("doc").agg(F.collect_list(F.struct("first", "count", "anchor", "forms")).alias("asked"))
    brought = rows.join(asked, "doc").select("doc", "text", "asked", *rows.columns[2:]).mapInArrow(trimmed(_brought(length, gram, buckets, forms)), _BROUGHT)
    brought = _dealt(brought, parts)
    more = brought.mapInArrow(trimmed(_repeated(length)), "doc long, first int, count int")
    every = found.filter("forms = 0").select("doc", "first", "count").unionByName(more)
    spans = every.groupBy("doc").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    shown = "id" if "id" in rows.columns else "doc"
    schema = "doc_id " + dict(rows.dtypes)[shown] + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return rows.join(spans, "doc", "left").select(shown, "text", "spans").mapInArrow(trimmed(_assembled(length, texts)), schema)

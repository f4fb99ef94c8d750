"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: After so many cuts the driver looks for shuffles that nothing needs any more.
LOOK = 6
_CUTS = itertools.count(1)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a private one only where a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not (sc.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tilewright-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    Files of shuffles that led to it go when the JVM finds them without a reference, which
    a driver with memory to spare does late; so it is asked to look, every few times.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_CUTS) % LOOK == 0:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


def spread(df: DataFrame, least: int = 2) -> int:
    """How many partitions an explicit repartition should have."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_U = np.uint64
#: Odd factors of a 64-bit mixer.
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _MIX[0]
        x = (x ^ (x >> _U(29))) * _MIX[1]
        return x ^ (x >> _U(32))


def portions(of, rows: int, size: int, text: int | str | None = None) -> Iterator:
    """Consecutive parts of an array of texts, or of batches with a column of them: at most rows, and about size bytes of text."""
    for whole in [of] if text is None else of:
        texts = whole if text is None else whole.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = max(at + 1, min(stop, at + rows))
            yield whole.slice(at, stop - at)
            at = stop


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about rows consecutive rows that hold their groups whole, and where in them groups start and the last ends."""
    held: list[pa.RecordBatch] = []

    def cut_up(last: bool):
        t = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([t.column(n).to_numpy() for n in keys])
        starts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist()]
        stop = t.num_rows if last else starts[-1]
        held[:] = t.slice(stop).to_batches()
        return t.slice(0, stop), np.array([*starts, *([stop] if last else [])])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t, starts = cut_up(False)
            if t.num_rows:
                yield t, starts
    if held:
        yield cut_up(True)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_REMEMBERED: dict[str, Callable] = {}


def remembered(make: Callable) -> Callable:
    """make, called once in a worker for the same arguments, until a task that does not use it starts there."""
    _REMEMBERED[make.__name__] = lru_cache(maxsize=2)(make)
    return _REMEMBERED[make.__name__]


def trimmed(run: Callable, uses: str = "") -> Callable:
    """run (batches -> batches) in a worker that holds nothing but what run uses: the name of a remembered function.

    Workers live on between stages. What other stages remember is dropped when a task
    starts, and what a task has freed is given back to the system when it ends.
    """

    @wraps(run)
    def ends(batches):
        for name, make in _REMEMBERED.items():
            if name != uses:
                make.cache_clear()
        yield from run(batches)
        give_back()

    return ends


def give_back() -> None:
    """Return this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

"""The content-addressed cache: keys, hits, eviction and reuse of encoded results."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.settle import settle

HEADER_BYTES = 24
DEFAULT_CAP = 512 * 1024 * 1024
FORMATS = ("bc1", "bc7")


def content_key(content: Column, quality: Column | int, backend: str = "s") -> Column:
    """SHA-256 of the pixels before any bleed, with the quality, the backend's letter and the version."""
    return F.concat(F.sha2(content.cast("binary"), 256), F.lit("-q"), F.lit(quality).cast("string") if isinstance(quality, int) else quality.cast("string"), F.lit(backend + "v2"))


def sound() -> Column:
    """Whether an entry's header holds, and as many bytes follow it as it declares: a known format, dimensions, a payload."""
    header = F.col("format").isin(*FORMATS) & (F.col("declared") > 0) & (F.col("width") > 0) & (F.col("height") > 0)
    return header & (F.col("size") >= HEADER_BYTES + F.col("declared"))


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests with hit and last_access: (key, format, width, height, quality) must agree with a sound entry.

    Entries share keys when contents do; the entry that was used last answers.
    """
    keys = ["key", "format", "width", "height", "quality"]
    best = entries.filter(sound()).groupBy(*keys).agg(F.max("last_access").alias("last_access"))
    return requests.join(best, keys, "left").withColumn("hit", F.col("last_access").isNotNull())


def touched(entries: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """entries with last_access set to now where a hit used them."""
    used = hits.filter("hit").select("key", "format").distinct().withColumn("used", F.lit(True))
    fresh = F.when(F.col("used"), F.lit(now).cast("long")).otherwise(F.col("last_access"))
    return entries.join(used, ["key", "format"], "left").withColumn("last_access", fresh).drop("used")


def write(entries: DataFrame, folder: str) -> None:
    """Entries as Parquet, a folder for each format; Spark's committer renames finished files only."""
    entries.write.mode("overwrite").partitionBy("format").parquet(folder)


def kept_after_prune(entries: DataFrame, cap: int = DEFAULT_CAP, now: int | None = None, stale: int = 3_600_000) -> DataFrame:
    """(entry_id, kept): oldest first go until the rest fits; unfinished files go when stale; other files stay.

    A running sum from the newest to the oldest decides. It is taken over range partitions
    (a sum within each, and before each the sums of those newer), so no task sees all rows.
    """
    spark = entries.sparkSession
    files = entries.filter(F.col("format").isin(*FORMATS)).select("entry_id", "size", "last_access")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = files.repartitionByRange(parts, F.desc("last_access"), F.desc("entry_id")).sortWithinPartitions(F.desc("last_access"), F.desc("entry_id"))
    ordered = settle(ordered.withColumn("part", F.spark_partition_id()))
    before, sums = 0, []
    for row in sorted(ordered.groupBy("part").agg(F.sum("size").alias("n")).collect()):
        sums.append((row["part"], before))
        before += row["n"]
    base = spark.createDataFrame(sums, "part int, newer long")
    inside = Window.partitionBy("part").orderBy(F.desc("last_access"), F.desc("entry_id")).rowsBetween(Window.unboundedPreceding, 0)
    run = ordered.withColumn("run", F.sum("size").over(inside)).join(F.broadcast(base), "part")
    kept = run.select("entry_id", (F.col("run") + F.col("newer") <= cap).alias("kept"))
    other = entries.filter(~F.col("format").isin(*FORMATS))
    old = F.lit(False) if now is None else (F.col("format") == "tmp") & (F.col("last_access") < now - stale)
    return kept.unionByName(other.select("entry_id", (~old).alias("kept")))


def invalidated(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """entries without those of keys, as after an upload that replaces what they were made from."""
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def encoded_once(contents: DataFrame, encode, keys: list[str]) -> DataFrame:
    """contents with what encode (a function from distinct contents to keys and results) gives, each content encoded once."""
    return contents.join(encode(contents.dropDuplicates(keys)), keys)


def lru_contents(accesses: DataFrame, capacity: int) -> DataFrame:
    """(key, last): what a map that drops its least recently used entry holds after accesses (key, seq)."""
    return accesses.groupBy("key").agg(F.max("seq").alias("last")).orderBy(F.desc("last"), "key").limit(capacity)


class _Recent:
    """The keys that a map of some capacity holds, by their last use."""

    def __init__(self, capacity: int):
        self.capacity, self.keys = capacity, OrderedDict()

    def use(self, key, seq: int) -> bool:
        """Whether key was there."""
        hit = self.keys.pop(key, None) is not None
        self.keys[key] = seq
        if len(self.keys) > self.capacity:
            self.keys.popitem(last=False)
        return hit


def _last_keys(capacity: int):
    """(part, key, seq) by seq -> the last keys of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, part = _Recent(capacity), None
        for batch in batches:
            for part, key, seq in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "seq")), strict=True):
                recent.use(key, seq)
        if recent.keys:
            yield _rows([part] * len(recent.keys), list(recent.keys), list(recent.keys.values()))

    def _rows(part, key, seq):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(key), pa.array(seq, pa.int64())], ["part", "key", "seq"])

    return run


def _held_before(capacity: int):
    """Last keys by (part, seq) -> what the map holds when each later part begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, last = _Recent(capacity), None
        for batch in batches:
            for part, key, seq in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "seq")), strict=True):
                if last is not None and part != last:
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(recent.keys), pa.int32()), pa.array(list(recent.keys)), pa.array(list(recent.keys.values()), pa.int64())], ["part", "key", "seq"])
                last = part
                recent.use(key, seq)

    return run


def _hits(capacity: int):
    """What the map holds, then accesses, by (part, seq) -> (seq, key, hit) of the accesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, last = _Recent(capacity), None
        for batch in batches:
            said = []
            for part, key, seq in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "seq")), strict=True):
                if part != last:
                    recent, last = _Recent(capacity), part
                said.append(recent.use(key, seq))
            out = pa.RecordBatch.from_arrays([batch.column("seq"), batch.column("key"), pa.array(said, pa.bool_())], ["seq", "key", "hit"])
            yield out.filter(batch.column("own"))

    return run


def lru_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """(seq, key, hit) of accesses (key, seq) to such a map; keys and seqs are not null, seqs differ.

    The accesses are cut into ranges of seq. The map's content when a range begins is the
    last keys used before it, merged from the last keys of each earlier range, of which
    there are at most capacity; so ranges are gone through side by side, each once.
    """
    spark = accesses.sparkSession
    kind = dict(accesses.dtypes)["key"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = accesses.select("key", F.col("seq").cast("long").alias("seq")).repartitionByRange(parts, "seq")
    rows = settle(rows.withColumn("part", F.spark_partition_id()))
    schema = f"part int, key {kind}, seq long"
    tails = rows.sortWithinPartitions("seq").mapInArrow(_last_keys(capacity), schema)
    held = tails.coalesce(1).sortWithinPartitions("part", "seq").mapInArrow(_held_before(capacity), schema)
    both = rows.select("part", "key", "seq").withColumn("own", F.lit(True)).unionByName(held.withColumn("own", F.lit(False)))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "own", "seq")
    return dealt.mapInArrow(_hits(capacity), f"seq long, key {kind}, hit boolean")

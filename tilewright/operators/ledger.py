"""Resident bytes, budgets and savings: ledgers in which a later row replaces an earlier one.

Rows are (atlas, bucket, ts, event_id, bytes, reset); (ts, event_id) orders them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1024 * 1024


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, bytes): the last row of each key, unless it has no bytes or is a reset."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct("bytes", "reset"), F.struct("ts", "event_id")).alias("x"))
    return last.filter("x.bytes > 0 and not x.reset").select(*keys, F.col("x.bytes").alias("bytes"))


def bucket_ledger(events: DataFrame) -> DataFrame:
    """(atlas, bucket, bytes) after resets, each of which removes an atlas and all its buckets."""
    resets = events.filter("reset").groupBy("atlas").agg(F.max(F.struct("ts", "event_id")).alias("reset_at"))
    alive = events.filter("not reset").join(resets, "atlas", "left").filter(F.col("reset_at").isNull() | (F.struct("ts", "event_id") > F.col("reset_at")))
    return latest(alive, "atlas", "bucket")


def without(ledger: DataFrame, prefix: str) -> DataFrame:
    """A ledger by key without the keys that start so; what is left says whether anything is active."""
    return ledger.filter(~F.col("key").startswith(prefix))


def total(ledger: DataFrame) -> DataFrame:
    """One row: the sum of a ledger and whether anything is left."""
    return ledger.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total"), (F.count("*") > 0).alias("active"))


def effective_budget(forced: Column, hardware: Column, configured: Column) -> Column:
    """In MB: what is forced, else three quarters of the hardware's memory if known, else the configured."""
    return F.coalesce(forced, F.when(hardware > 0, F.floor(hardware * 0.75).cast("int")), configured)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(device, atlas, event_id, bytes, budget) by device and time -> (event_id, admitted)."""
    device, total, held = object(), 0, {}
    for batch in batches:
        said = []
        for d, atlas, size, budget in zip(*(batch.column(c).to_pylist() for c in ("device", "atlas", "bytes", "budget")), strict=True):
            if d != device:
                device, total, held = d, 0, {}
            rest = total - held.get(atlas, 0)
            said.append(rest + size <= budget)
            if said[-1]:
                total = rest + size
                if size:
                    held[atlas] = size
                else:
                    held.pop(atlas, None)
        yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(said, pa.bool_())], ["event_id", "admitted"])


def admit(requests: DataFrame, budget: Column | int, fold_key: str | None = None) -> DataFrame:
    """(event_id, admitted): requests in order, each admitted if the others' and its own bytes stay within budget.

    requests: (atlas, ts, event_id, bytes), bytes being the new size of the atlas. What is
    rejected takes no room, so the fold depends on the order. Requests fold one after the
    other within a value of fold_key (a device, say); the values fold side by side, each
    read as a sorted stream of which only the sizes of the atlases held are kept. Without
    fold_key there is one fold over all requests, and so one task. An atlas of nothing gives
    its room back.
    """
    group = F.col(fold_key) if fold_key else F.lit(0)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    rows = requests.select(group.alias("device"), "ts", "event_id", F.col("atlas").cast("string").alias("atlas"), "bytes", limit.cast("long").alias("budget"))
    rows = rows.repartition("device") if fold_key else rows.coalesce(1)
    return rows.sortWithinPartitions("device", "ts", "event_id").drop("ts").mapInArrow(_fold, "event_id long, admitted boolean")


def savings_summary(ledger: DataFrame) -> DataFrame:
    """One row of (saved, resident) sums: megabytes, percent saved, and the text that shows them."""
    sums = ledger.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), F.coalesce(F.sum("resident"), F.lit(0)).alias("resident"))
    original = F.col("saved") + F.col("resident")
    out = sums.select((F.col("saved") / MB).alias("saved_mb"), (F.col("resident") / MB).alias("resident_mb"), (original / MB).alias("original_mb"), F.when(original == 0, 0.0).otherwise(F.col("saved") * 100.0 / original).alias("percent"))
    return out.withColumn("shown", F.format_string("%.2f MB instead of %.2f MB (%.1f%% saved)", "resident_mb", "original_mb", "percent"))


def ranked(ledger: DataFrame) -> DataFrame:
    """Atlases by saved bytes, and below each that has several its buckets: (rank, atlas, bucket, saved, resident).

    ledger: (atlas, bucket, saved, resident). bucket is null in an atlas's own row.
    """
    atlas = ledger.groupBy("atlas").agg(F.sum("saved").cast("long").alias("saved"), F.sum("resident").cast("long").alias("resident"), F.count("*").alias("buckets"))
    several = ledger.join(atlas.filter("buckets > 1").select("atlas"), "atlas", "left_semi")
    rows = atlas.select("atlas", F.lit(None).cast("string").alias("bucket"), "saved", "resident").unionByName(several.select("atlas", "bucket", "saved", "resident"))
    order = atlas.select("atlas", F.col("saved").alias("atlas_saved"))
    return rows.join(order, "atlas").orderBy(F.desc("atlas_saved"), "atlas", F.col("bucket").isNotNull(), F.desc("saved"), "bucket").select("atlas", "bucket", "saved", "resident")


def accounting(levels: DataFrame) -> DataFrame:
    """(image_id, resident, uncompressed, saved) from uploaded (image_id, w, h, size)."""
    out = levels.groupBy("image_id").agg(F.sum("size").cast("long").alias("resident"), F.sum(F.expr("cast(w as bigint) * h * 4")).cast("long").alias("uncompressed"))
    return out.withColumn("saved", F.col("uncompressed") - F.col("resident"))


def encode_statistics(durations: DataFrame, window: int) -> DataFrame:
    """(atlas, calls, total, longest, per_tick) of (atlas, event_id, nanos, registered): since the last registration."""
    start = durations.filter("registered").groupBy("atlas").agg(F.max("event_id").alias("since"))
    rows = durations.filter("not registered").join(start, "atlas", "left").filter("since is null or event_id > since")
    return rows.groupBy("atlas").agg(F.count("*").alias("calls"), F.sum("nanos").alias("total"), F.max("nanos").alias("longest"), (F.sum("nanos") / F.greatest(F.lit(1), F.lit(window))).alias("per_tick"))

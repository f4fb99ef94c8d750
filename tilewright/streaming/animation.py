"""Animation state: frame cursors, redraws, key frames, settled atlases; in batch and as streams.

Rows are ticks (sprite_id, tick, frame, sub_frame, frame_time, frames, row_size, interpolated).
A tick is a counter, not a time, so streams need no watermark; state is a few numbers a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUIET_TICKS, GIVE_UP_TICKS = 200, 6000


def cursor(ticks: DataFrame) -> DataFrame:
    """Grid cells of the frame now and next, and the progress between them in thousandths (0 unless interpolated)."""
    nxt = "pmod(frame + 1, frames)"
    progress = F.when(F.col("interpolated"), (F.floor(F.expr("sub_frame * 1000D / frame_time")) / 1000).cast("float")).otherwise(F.lit(0.0).cast("float"))
    return ticks.select(
        "sprite_id", "tick", F.expr("frame % row_size").alias("col"), F.expr("cast(frame div row_size as int)").alias("row"),
        F.expr(f"{nxt} % row_size").alias("next_col"), F.expr(f"cast({nxt} div row_size as int)").alias("next_row"), progress.alias("progress"), "interpolated",
    )


def redraws(ticks: DataFrame, everything: bool = False) -> DataFrame:
    """Ticks at which a sprite must be drawn: it interpolates, its frame changed, it is new, or all are asked for."""
    if everything:
        return ticks
    before = F.lag("frame").over(Window.partitionBy("sprite_id").orderBy("tick"))
    return ticks.withColumn("before", before).filter(F.col("interpolated") | F.col("before").isNull() | (F.col("before") != F.col("frame"))).drop("before")


def redraw_stream(ticks: DataFrame) -> DataFrame:
    """The same over a stream: the last frame of each sprite is its state. Ticks of a batch are taken in order."""
    columns = ticks.columns
    schema = ", ".join(f"{n} {t}" for n, t in ticks.dtypes)

    def run(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("tick")
        last = state.get[0] if state.exists else -1
        before = rows["frame"].shift(1, fill_value=last)
        state.update((int(rows["frame"].iloc[-1]),))
        yield rows[rows["interpolated"] | (before != rows["frame"])][columns]

    return ticks.groupBy("sprite_id").applyInPandasWithState(run, schema, "last int", "append", "NoTimeout")


def blended(a: Column, b: Column, progress: Column) -> Column:
    """A channel between two frames (0 to 1 each) as a byte, rounded half up and clamped."""
    mixed = a.cast("float") * (F.lit(1).cast("float") - progress) + b.cast("float") * progress
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(mixed * F.lit(255).cast("float") + F.lit(0.5).cast("float")))).cast("int")


def padded_lookup(i: Column, region: Column, pad: Column, size: Column) -> Column:
    """The texel that place i of a padded region shows: its edge is repeated by the padding's share."""
    uv = (i + 0.5) / region
    at = F.floor((uv + pad * (2 * uv - 1)) * size)
    return F.greatest(F.lit(0), F.least(size - 1, at)).cast("int")


def aligned_level(rects: DataFrame, requested: int) -> DataFrame:
    """(atlas_id, aligned_level): the highest level on which all rectangles, halved so often, lie on the block grid.

    A rectangle's level is the highest on which it is aligned (0 if on none); an atlas has the lowest of its rectangles'.
    """
    at = rects.select("atlas_id", "rect_id", "x", "y", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(requested))).alias("l"))
    part = lambda c: f"shiftright({c}, l)"
    fits = F.expr(f"{part('w')} > 0 and {part('h')} > 0 and (({part('x')} | {part('y')} | {part('w')} | {part('h')}) & 3) = 0")
    own = at.groupBy("atlas_id", "rect_id").agg(F.max(F.when(fits, F.col("l")).otherwise(0)).alias("l"))
    return own.groupBy("atlas_id").agg(F.min("l").alias("aligned_level"))


def retained_levels(levels: DataFrame) -> DataFrame:
    """(atlas_id, last_level): how far levels go on without a gap after the aligned one; from (atlas_id, aligned_level, level)."""
    after = levels.filter("level > aligned_level").select("atlas_id", "aligned_level", "level").distinct()
    place = F.row_number().over(Window.partitionBy("atlas_id").orderBy("level"))
    run = after.withColumn("n", place).filter("level = aligned_level + n").groupBy("atlas_id").agg(F.max("level").alias("last"))
    return levels.select("atlas_id", "aligned_level").distinct().join(run, "atlas_id", "left").select("atlas_id", F.coalesce("last", "aligned_level").alias("last_level"))


def patch_rects(rects: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles grown to the 4-grid and cut at the image: what must be encoded anew when they change."""
    low = lambda c: F.expr(f"cast({c} div 4 * 4 as int)")
    high = lambda c, s, n: F.least(F.lit(n), F.expr(f"cast(({c} + {s} + 3) div 4 * 4 as int)"))
    out = rects.withColumns({"x0": low("x"), "y0": low("y"), "x1": high("x", "w", width), "y1": high("y", "h", height)})
    return out.filter("x1 > x0 and y1 > y0").select("atlas_id", "rect_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def keyframes(ticks: DataFrame) -> DataFrame:
    """(sprite_id, frame, tick): the first tick at which each frame was drawn, when it is encoded; later ones reuse it."""
    return ticks.groupBy("sprite_id", "frame").agg(F.min("tick").alias("tick"))


def keyframe_stream(ticks: DataFrame) -> DataFrame:
    """The same over a stream; the frames that a sprite has shown are its state."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("tick").drop_duplicates("frame")
        seen = list(state.get[0]) if state.exists else []
        new = rows[~rows["frame"].isin(seen)]
        state.update((seen + [int(f) for f in new["frame"]],))
        yield new[["sprite_id", "frame", "tick"]]

    return ticks.groupBy("sprite_id").applyInPandasWithState(run, "sprite_id long, frame int, tick long", "seen array<int>", "append", "NoTimeout")


def upgraded(entries: DataFrame, results: DataFrame) -> DataFrame:
    """(sprite_id, frame, version, blocks): a better result replaces an entry only while that still has the version the result was made for."""
    made = results.groupBy("sprite_id", "frame", "version").agg(F.max("blocks").alias("better"))
    return entries.join(made, ["sprite_id", "frame", "version"], "left").select(
        "sprite_id", "frame", (F.col("version") + F.col("better").isNotNull().cast("long")).alias("version"), F.coalesce("better", "blocks").alias("blocks")
    )


def current_results(results: DataFrame) -> DataFrame:
    """Results of the newest generation of each key; others are stale."""
    newest = results.groupBy("key").agg(F.max("generation").alias("generation"))
    return results.join(newest, ["key", "generation"], "left_semi")


def registered(events: DataFrame) -> DataFrame:
    """(atlas, registrations): atlases whose last event is a registration, with how many they had; from (atlas, seq, register)."""
    out = events.groupBy("atlas").agg(F.max_by("register", "seq").alias("on"), F.sum(F.col("register").cast("long")).alias("registrations"))
    return out.filter("on").select("atlas", "registrations")


def settled(events: DataFrame, quiet: int = QUIET_TICKS, give_up: int = GIVE_UP_TICKS) -> DataFrame:
    """(atlas, settled_at): the tick at which an atlas has been quiet for so long, at most give_up.

    events: (atlas, tick), an event at a tick; if there is a column until, work that is
    pending from tick until then; if there is a column seen, the tick at which the atlas's
    target was seen (null: never), before which nothing is settled.
    """
    stop = F.greatest("tick", "until") if "until" in events.columns else F.col("tick")
    seen = F.max(F.col("seen") if "seen" in events.columns else F.lit(0)).over(Window.partitionBy("atlas"))
    order = Window.partitionBy("atlas").orderBy("tick")
    rows = events.select("atlas", "tick", F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("busy"), F.lead("tick").over(order).alias("next"), seen.alias("seen"))
    done = F.greatest(F.col("busy") + quiet, "seen")
    ends = F.when(F.col("seen").isNotNull() & (F.col("next").isNull() | (F.col("next") > done)), done)
    return rows.groupBy("atlas").agg(F.least(F.min(ends), F.lit(give_up)).alias("settled_at"))


def upgrade_stream(changes: DataFrame) -> DataFrame:
    """(sprite_id, frame, version, blocks) after each change of an entry, over a stream of (sprite_id, frame, tick, blocks, made_for).

    A fast result (made_for is null) is written at once as a new version. A better one takes
    its place only while the entry still has the version that it was made for. Changes come
    in the order of ticks; an entry's version and blocks are its state.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("tick")
        version, blocks = state.get if state.exists else (0, -1)
        changed = False
        for new, made in zip(rows["blocks"].tolist(), rows["made_for"].tolist(), strict=True):
            if pd.isna(made) or int(made) == version:
                version, blocks, changed = version + 1, int(new), True
        if changed:
            state.update((version, blocks))
            yield pd.DataFrame({"sprite_id": [key[0]], "frame": [key[1]], "version": [version], "blocks": [blocks]})

    return changes.groupBy("sprite_id", "frame").applyInPandasWithState(run, "sprite_id long, frame int, version long, blocks long", "version long, blocks long", "update", "NoTimeout")


def ledger_stream(events: DataFrame) -> DataFrame:
    """(atlas, bytes, resident) after every batch that changes an atlas: the last event by (ts, event_id) wins."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = rows.iloc[-1]
        stamp = (int(last["ts"].value), int(last["event_id"]))
        if not state.exists or stamp > tuple(state.get[:2]):
            size = 0 if last["reset"] else int(last["bytes"])
            state.update((*stamp, size))
            yield pd.DataFrame({"atlas": [key[0]], "bytes": [size], "ts_ns": [stamp[0]], "event_id": [stamp[1]]})

    return events.groupBy("atlas").applyInPandasWithState(run, "atlas long, bytes long, ts_ns long, event_id long", "ts long, event_id long, bytes long", "update", "NoTimeout")



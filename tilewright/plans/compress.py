"""The whole plan: policy, budget, mip chain, cache, encoding of misses, accounting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import bc1 as bc1_kernel
from tilewright.functions import bc7
from tilewright.operators import bc1, cache, image
from tilewright.plans.settle import settle
from tilewright.streaming import animation

#: Blocks that go to the kernel in one call.
TOGETHER = 4096


def _bc7(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            texels = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, 16, 4)
            words, mode = bc7.encode(texels)
            signed = words.view(np.int64)
            columns = [part.column(0), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), pa.array(mode.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["texels", "lo", "hi", "mode"])


def packed(blocks: DataFrame) -> DataFrame:
    """blocks with their texels as 64 bytes."""
    one = lambda t: F.concat(*[F.lpad(F.hex(t[c].cast("long")), 2, "0") for c in image.CHANNELS])
    return blocks.withColumn("texels", F.unhex(F.array_join(F.transform("texels", one), "")))


def encode_bc7(blocks: DataFrame) -> DataFrame:
    """(image_id, by, bx, lo, hi, mode): each distinct block of 16 texels is encoded once and joined back."""
    rows = settle(packed(blocks))  # read twice: for what is distinct, and to join it back
    done = rows.select("texels").distinct().mapInArrow(_bc7, "texels binary, lo long, hi long, mode int")
    return rows.join(done, "texels").select("image_id", "by", "bx", "lo", "hi", "mode")


def _bc7_pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.stack([batch.column("lo").to_numpy().view(np.uint64), batch.column("hi").to_numpy().view(np.uint64)], 1)
        texels = bc7.decode(words).reshape(-1, 64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t.tobytes() for t in texels], pa.binary())], ["image_id", "by", "bx", "texels"])


def decode_bc7(encoded: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, a)."""
    rows = encoded.select(F.col("image_id").cast("long").alias("image_id"), "by", "bx", "lo", "hi").mapInArrow(_bc7_pixels, "image_id long, by int, bx int, texels binary")
    texel = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    value = lambda k: F.expr(f"cast(conv(hex(substring(texels, i * 4 + {k + 1}, 1)), 16, 10) as int)")
    return texel.select("image_id", F.expr("cast(bx * 4 + i % 4 as int)").alias("x"), F.expr("cast(by * 4 + i div 4 as int)").alias("y"), *[value(k).alias(c) for k, c in enumerate(image.CHANNELS)])


def routed(images: DataFrame, policy: DataFrame, supported: tuple[str, ...] = ("BC1", "BC7"), disabled: bool = False) -> DataFrame:
    """images with format: BC7 unless the policy (image_id, format, cancelled) says otherwise; cancelled or unsupported ones are left out, all if disabled."""
    images = images.limit(0) if disabled else images
    out = images.join(policy, "image_id", "left").withColumn("format", F.coalesce("format", F.lit("BC7")))
    return out.filter(~F.coalesce("cancelled", F.lit(False)) & F.col("format").isin(*supported)).drop("cancelled")


def uploaded(levels: DataFrame) -> DataFrame:
    """(image_id, bytes): levels (image_id, level, w, h, size, block_bytes) go up in order until one has a wrong size; -1 if that is the first."""
    exact = F.expr("size = cast((w + 3) div 4 * ((h + 3) div 4) * block_bytes as bigint)")
    bad = levels.groupBy("image_id").agg(F.min(F.when(~exact, F.col("level"))).alias("bad"), F.min("level").alias("first"))
    good = levels.join(bad, "image_id").filter("bad is null or level < bad")
    size = good.groupBy("image_id").agg(F.sum("size").cast("long").alias("bytes"))
    return bad.join(size, "image_id", "left").select("image_id", F.coalesce("bytes", F.lit(-1).cast("long")).alias("bytes"))


def updated_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks (image_id, level, by, bx, block) with new ones in their places."""
    keys = ["image_id", "level", "by", "bx"]
    return old.join(new, keys, "left_anti").unionByName(new)


def kept_levels(levels: DataFrame) -> DataFrame:
    """Levels (image_id, level, ok) before the first that failed."""
    failed = levels.filter(~F.col("ok")).groupBy("image_id").agg(F.min("level").alias("failed"))
    return levels.join(failed, "image_id", "left").filter("failed is null or level < failed").drop("failed")


def atlas_levels(sprites: DataFrame, pixels: DataFrame, width: int, height: int, max_level: int) -> DataFrame:
    """(level, w, h, x, y, r, g, b, a) of the atlas and its smaller levels."""
    base = image.assemble(sprites, pixels, width, height)
    base = base.select(F.lit(0).cast("long").alias("image_id"), F.lit(width).alias("w"), F.lit(height).alias("h"), "x", "y", *image.CHANNELS)
    return image.mip_chain(base, max_level)


def compressed(levels: DataFrame, target: str = "BC7") -> DataFrame:
    """(image_id, by, bx, ...) blocks of each level; image_id is the level.

    Transparent texels bleed before encoding; a cached level would be looked up by its content before that.
    """
    own = levels.select(F.col("level").cast("long").alias("image_id"), "w", "h", "x", "y", *image.CHANNELS)
    sizes = own.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    cells = image.blocks(image.bleed(own).join(sizes, "image_id"))
    return encode_bc7(cells) if target == "BC7" else bc1.encode(cells)


def packed_images(pixels: DataFrame) -> DataFrame:
    """(image_id, w, h, rgba) from (image_id, w, h, x, y, r, g, b, a)."""
    texel = F.struct("y", "x", *image.CHANNELS)
    one = lambda t: F.concat(*[F.lpad(F.hex(t[c].cast("long")), 2, "0") for c in image.CHANNELS])
    rows = pixels.groupBy("image_id", "w", "h").agg(F.sort_array(F.collect_list(texel)).alias("t"))
    return rows.select("image_id", "w", "h", F.unhex(F.array_join(F.transform("t", one), "")).alias("rgba"))


#: Rows of texels in a strip: one row of blocks.
STRIP = 4


def packed_strips(pixels: DataFrame) -> DataFrame:
    """(image_id, strip, w, h, rgba) from (image_id, w, h, x, y, r, g, b, a): rows of blocks, so that no row holds a whole image.

    w and h are the strip's; the last strip of an image may have fewer than STRIP rows.
    """
    strip = F.expr(f"cast(y div {STRIP} as int)")
    cut = pixels.select("image_id", strip.alias("strip"), "w", F.least(F.lit(STRIP), F.col("h") - strip * STRIP).alias("h"), "x", (F.col("y") % STRIP).alias("y"), *image.CHANNELS)
    texel = F.struct("y", "x", *image.CHANNELS)
    one = lambda t: F.concat(*[F.lpad(F.hex(t[c].cast("long")), 2, "0") for c in image.CHANNELS])
    rows = cut.groupBy("image_id", "strip", "w", "h").agg(F.sort_array(F.collect_list(texel)).alias("t"))
    return rows.select("image_id", "strip", "w", "h", F.unhex(F.array_join(F.transform("t", one), "")).alias("rgba"))


def texels_of(rgba: bytes, w: int, h: int) -> np.ndarray:
    """(blocks, 16, 4): rows of 4 x 4 blocks, edges repeated, after transparent texels have bled."""
    x = np.frombuffer(rgba, np.uint8, w * h * 4).reshape(h, w, 4).astype(np.int64)
    out = np.pad(x, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    inside = np.zeros(out.shape[:2], bool)
    inside[:h, :w] = True
    cells = lambda v: v.reshape(out.shape[0] // 4, 4, out.shape[1] // 4, 4, *v.shape[2:]).swapaxes(1, 2).reshape(-1, 16, *v.shape[2:])
    t, real = cells(out), cells(inside)
    seen = real & (t[..., 3] > 0)
    mean = (t[..., :3] * seen[..., None]).sum(1) // np.maximum(1, seen.sum(1))[:, None]
    hidden = t[..., 3] == 0
    return np.where(np.concatenate([np.repeat(hidden[..., None], 3, -1), np.zeros_like(hidden)[..., None]], -1), np.concatenate([np.repeat(mean[:, None], 16, 1), t[..., 3:]], -1), t).astype(np.uint8)


def numpy_encoder(target: str) -> Callable[[np.ndarray], bytes]:
    """The engine's own encoder: texels to a stream of little-endian blocks."""
    if target == "BC7":
        return lambda t: bc7.encode(t)[0].astype("<u8").tobytes()
    return lambda t: bc1_kernel.encode(t).astype("<u8").tobytes()


def compress_images(images: DataFrame, target: str = "BC7", preferred: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """(image_id, blocks, reason) of (image_id, w, h, rgba); a failure costs its own row only.

    An image without a size or with too few bytes is invalid. What the preferred encoder
    refuses (an exception, or None) the engine's own encoder does; if that fails too, blocks
    is null and reason says why. Without a preferred encoder the blocks of many images go
    to the kernel in one call; only where that fails are images taken one by one.
    """
    own, block = numpy_encoder(target), image.BLOCK_BYTES[target]

    def one(texels: np.ndarray):
        reason = None
        for encoder in (preferred, own):
            if encoder is None:
                continue
            try:
                blocks = encoder(texels)
            except Exception as e:  # the next encoder gets its turn
                blocks, reason = None, f"{type(e).__name__}: {e}"
            if blocks is not None:
                return blocks, None if encoder is own and preferred is None or encoder is preferred else "second encoder"
        return None, reason or "no encoder took it"

    def several(texels: list[np.ndarray]) -> list:
        if preferred is None:
            try:
                stream = own(np.concatenate(texels))
            except Exception:  # whose fault it is shows when each is taken by itself
                return [one(t) for t in texels]
            ends = np.cumsum([0, *(len(t) * block for t in texels)]).tolist()
            return [(stream[a:b], None) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [one(t) for t in texels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, waiting, size = [(None, "invalid image")] * batch.num_rows, [], 0

            def flush():
                if waiting:
                    for (k, _), result in zip(waiting, several([t for _, t in waiting]), strict=True):
                        done[k] = result  # noqa: B023
                    waiting.clear()

            for k, (w, h, rgba) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("w", "h", "rgba")), strict=True)):
                if w is None or h is None or rgba is None or w <= 0 or h <= 0 or len(rgba) < w * h * 4:
                    continue
                waiting.append((k, texels_of(rgba, w, h)))
                size += len(waiting[-1][1])
                if size >= TOGETHER:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in done], pa.binary()), pa.array([r for _, r in done], pa.string())], ["image_id", "blocks", "reason"])

    kind = dict(images.dtypes)["image_id"]
    return images.select("image_id", "w", "h", "rgba").mapInArrow(run, f"image_id {kind}, blocks binary, reason string")


def driver(strips: DataFrame, stored: DataFrame | None, quality: int, target: str = "BC7") -> DataFrame:
    """(image_id, strip, w, h, key, blocks, source) of (image_id, strip, w, h, rgba), the levels of one atlas by number.

    A strip whose key, size and payload are stored comes from there; of the others, each
    distinct content is encoded once. Levels from the first with a strip that fails on are
    left out.
    """
    block = image.BLOCK_BYTES[target]
    keyed = strips.withColumn("key", cache.content_key(F.col("rgba"), quality)).withColumn("key", F.concat_ws(":", "key", "w", "h"))
    size = F.expr(f"cast((w + 3) div 4 * ((h + 3) div 4) * {block} as bigint)")
    if stored is None:
        known, missing = keyed.limit(0).select("image_id", "strip", "w", "h", "key", F.lit(None).cast("binary").alias("blocks")), keyed
    else:
        sound = stored.filter(F.length("blocks") == size).select("key", "blocks").dropDuplicates(["key"])
        known = keyed.join(sound, "key").select("image_id", "strip", "w", "h", "key", "blocks")
        missing = keyed.join(sound.select("key"), "key", "left_anti")

    def encode(contents: DataFrame) -> DataFrame:
        done = compress_images(contents.select(F.col("key").alias("image_id"), "w", "h", "rgba"), target)
        return done.select(F.col("image_id").alias("key"), "blocks")

    fresh = cache.encoded_once(missing, encode, ["key"]).select("image_id", "strip", "w", "h", "key", "blocks")
    every = known.withColumn("source", F.lit("cache")).unionByName(fresh.withColumn("source", F.lit("encoded")))
    every = every.withColumn("ok", F.coalesce(F.length("blocks") == size, F.lit(False)))
    failed = every.filter(~F.col("ok")).agg(F.min("image_id").alias("failed"))  # one row
    return every.crossJoin(F.broadcast(failed)).filter("failed is null or image_id < failed").drop("failed", "ok")


def post_records(done: DataFrame, target: str = "BC7") -> DataFrame:
    """(image_id, format, saved, resident): what is told of each compressed image, from the strips of driver()."""
    sums = done.groupBy("image_id").agg(F.sum(F.length("blocks").cast("long")).alias("resident"), F.sum(F.expr("cast(w as bigint) * h * 4")).alias("full"))
    return sums.select("image_id", F.lit(target).alias("format"), (F.col("full") - F.col("resident")).alias("saved"), "resident")


def patched(retained: DataFrame, frame: DataFrame, rects: DataFrame) -> DataFrame:
    """Texels (image_id, x, y, r, g, b, a) of retained, with those of frame in the rectangles (image_id, x, y, w, h)."""
    at = frame.join(rects.select("image_id", F.col("x").alias("rx"), F.col("y").alias("ry"), "w", "h"), "image_id").filter("x >= rx and x < rx + w and y >= ry and y < ry + h")
    new = at.select("image_id", "x", "y", *image.CHANNELS).dropDuplicates(["image_id", "x", "y"])
    keys = ["image_id", "x", "y"]
    return retained.select(*keys, *image.CHANNELS).join(new, keys, "left_anti").unionByName(new.join(retained.select(*keys), keys, "left_semi"))


def touched_blocks(rects: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, by, bx): the blocks that rectangles (image_id, x, y, w, h) touch, which must be encoded anew."""
    grown = animation.patch_rects(rects.withColumnsRenamed({"image_id": "atlas_id"}).withColumn("rect_id", F.lit(0)), width, height)
    by = grown.select(F.col("atlas_id").alias("image_id"), "x", "w", F.explode(F.expr("transform(sequence(y div 4, (y + h - 1) div 4), v -> cast(v as int))")).alias("by"))
    return by.select("image_id", "by", F.explode(F.expr("transform(sequence(x div 4, (x + w - 1) div 4), v -> cast(v as int))")).alias("bx")).distinct()


def patched_blocks(retained: DataFrame, frame: DataFrame, rects: DataFrame, width: int, height: int, target: str = "BC7") -> DataFrame:
    """New blocks (image_id, by, bx, ...) after a frame was written into the retained texels: those touched, and no others."""
    dirty = touched_blocks(rects, width, height)
    texels = patched(retained, frame, rects).join(dirty.withColumnsRenamed({"by": "dy", "bx": "dx"}), "image_id").filter("y div 4 = dy and x div 4 = dx").drop("dy", "dx")
    cells = image.blocks(texels.withColumns({"w": F.lit(width), "h": F.lit(height)})).join(dirty, ["image_id", "by", "bx"], "left_semi")
    return encode_bc7(cells) if target == "BC7" else bc1.encode(cells)

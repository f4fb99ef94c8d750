"""Image operators on pixels in long form (image_id, level, x, y, r, g, b, a), all built-in expressions.

Aggregations are partial before they shuffle, keyed by image and cell; only sprite tables,
never pixels, are broadcast, and only while Spark's own size estimate allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.plans.settle import settle

CHANNELS = ("r", "g", "b", "a")
BLOCK_BYTES = {"BC1": 8, "BC7": 16}


def swap_red_blue(p: Column) -> Column:
    """ARGB to ABGR and back, as 32-bit integers."""
    p = p.cast("int")
    return p.bitwiseAND(F.lit(-16711936)).bitwiseOR(F.shiftrightunsigned(p, 16).bitwiseAND(F.lit(255))).bitwiseOR(F.shiftleft(p.bitwiseAND(F.lit(255)), 16))


def abgr(r: str = "r", g: str = "g", b: str = "b", a: str = "a") -> Column:
    """Four channels as one 32-bit integer, red in the low byte."""
    return F.col(r).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16)).bitwiseOR(F.shiftleft(a, 24))


def padded(sprites: DataFrame, pixels: DataFrame) -> DataFrame:
    """Sprites with a ring of repeated edge texels: (sprite_id, x, y, r, g, b, a) of (w + 2p) x (h + 2p)."""
    cells = (
        sprites.select("sprite_id", "w", "h", "padding", F.explode(F.expr("sequence(0, w + 2 * padding - 1)")).alias("x"))
        .select("*", F.explode(F.expr("sequence(0, h + 2 * padding - 1)")).alias("y"))
        .select(F.col("sprite_id").alias("image_id"), "x", "y", F.expr("greatest(0, least(w - 1, x - padding))").alias("sx"), F.expr("greatest(0, least(h - 1, y - padding))").alias("sy"))
    )
    source = pixels.select("image_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *CHANNELS)
    return cells.join(source, ["image_id", "sx", "sy"]).select(F.col("image_id").alias("sprite_id"), "x", "y", *CHANNELS)


def assemble(sprites: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """One canvas of zeros with the sprites on it: (x, y, r, g, b, a), later sprites (by seq) above.

    A sprite that would reach over the canvas is left out whole.
    """
    fits = sprites.filter((F.col("dest_x") + F.col("w") <= width) & (F.col("dest_y") + F.col("h") <= height))
    placed = pixels.join(fits.select(F.col("sprite_id").alias("image_id"), "seq", "dest_x", "dest_y"), "image_id")
    placed = placed.select((F.col("x") + F.col("dest_x")).alias("x"), (F.col("y") + F.col("dest_y")).alias("y"), "seq", *CHANNELS)
    spark = sprites.sparkSession
    rows = spark.range(height).select(F.col("id").cast("int").alias("y"))
    grid = rows.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    empty = grid.select("x", "y", F.lit(None).cast("long").alias("seq"), *[F.lit(0).alias(c) for c in CHANNELS])
    # the zero canvas is the lowest layer, so one aggregation replaces a join
    top = placed.unionByName(empty).groupBy("x", "y").agg(F.max_by(F.struct(*CHANNELS), F.coalesce("seq", F.lit(-1))).alias("t"))
    return top.select("x", "y", "t.*")


def downsample(pixels: DataFrame) -> DataFrame:
    """Half the size by box filter, rounded to nearest: (image_id, w, h, x, y, r, g, b, a) in and out.

    An odd size loses its last row or column; a size of 1 stays and counts its texel twice.
    """
    p = pixels.withColumns({"ow": F.expr("greatest(w div 2, 1)"), "oh": F.expr("greatest(h div 2, 1)")})
    p = p.filter("x < 2 * ow and y < 2 * oh")
    twice = F.expr("if(w = 1, 2, 1) * if(h = 1, 2, 1)")
    mean = [F.expr("cast({0} as int)".format(f"(sum({c} * f) + 2) div 4")).alias(c) for c in CHANNELS]
    p = p.select("image_id", F.col("ow").cast("int").alias("w"), F.col("oh").cast("int").alias("h"), F.expr("cast(x div 2 as int)").alias("x"), F.expr("cast(y div 2 as int)").alias("y"), *CHANNELS, twice.alias("f"))
    return p.groupBy("image_id", "w", "h", "x", "y").agg(*mean)


def mip_chain(pixels: DataFrame, max_level: int) -> DataFrame:
    """All levels from (image_id, w, h, x, y, r, g, b, a): each from the rounded one before, until 1 x 1.

    A level is a quarter of the last; each is settled so that the next does not recompute the chain.
    """
    levels = [pixels.withColumn("level", F.lit(0))]
    last = pixels
    for level in range(1, max_level + 1):
        more = last.filter("w > 1 or h > 1")
        last = settle(downsample(more))
        if last.isEmpty():
            break
        levels.append(last.withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, levels)


def mip_bytes(images: DataFrame, block_bytes: int) -> DataFrame:
    """(image_id, levels, bytes) of compressed chains, from (image_id, w, h, max_level)."""
    level = images.select("image_id", "w", "h", F.explode(F.expr("sequence(0, max_level)")).alias("l"))
    level = level.select("image_id", "l", F.expr("greatest(1, shiftright(w, l))").alias("lw"), F.expr("greatest(1, shiftright(h, l))").alias("lh"), "w", "h")
    # the chain ends after 1 x 1, which level l first reaches when the size before it was larger
    level = level.filter("l = 0 or shiftright(w, l - 1) > 1 or shiftright(h, l - 1) > 1")
    size = F.expr(f"cast((lw + 3) div 4 * ((lh + 3) div 4) * {block_bytes} as bigint)")
    return level.groupBy("image_id").agg(F.count("*").alias("levels"), F.sum(size).alias("bytes"))


def alpha_shape(pixels: DataFrame) -> DataFrame:
    """(image_id, shape, has_alpha)."""
    blended, clear = F.bool_or(~F.col("a").isin(0, 255)), F.bool_or(F.col("a") == 0)
    out = pixels.groupBy("image_id").agg(F.when(blended, "BLENDED").when(clear, "PUNCH_THROUGH").otherwise("FULLY_OPAQUE").alias("shape"))
    return out.withColumn("has_alpha", F.col("shape") != "FULLY_OPAQUE")


def bleed(pixels: DataFrame) -> DataFrame:
    """Transparent texels take the mean colour (truncated) of their 4 x 4 block's visible ones, or black.

    Blocks are clipped at the edge of the image; alpha stays.
    """
    block = Window.partitionBy("image_id", F.expr("x div 4"), F.expr("y div 4"))
    seen = F.sum(F.when(F.col("a") > 0, 1).otherwise(0)).over(block)
    out = pixels.withColumn("seen", seen)
    for c in "rgb":
        out = out.withColumn(f"sum_{c}", F.sum(F.when(F.col("a") > 0, F.col(c)).otherwise(0)).over(block))
    new = [F.expr(f"cast(case when a > 0 then {c} when seen = 0 then 0 else sum_{c} div seen end as int)").alias(c) for c in "rgb"]
    return out.select("image_id", "x", "y", *new, "a")


def blocks(pixels: DataFrame) -> DataFrame:
    """(image_id, by, bx, texels): 4 x 4 blocks of 16 structs, coordinates clamped at the edge.

    pixels: (image_id, w, h, x, y, r, g, b, a).
    """
    # an edge texel also fills the places that are clamped to it
    copies = lambda v, n: F.expr(f"if({v} = {n} - 1, sequence({v}, ({n} + 3) div 4 * 4 - 1), array({v}))")
    wide = pixels.withColumn("px", F.explode(copies("x", "w"))).withColumn("py", F.explode(copies("y", "h")))
    texel = F.struct(F.expr("cast(py % 4 * 4 + px % 4 as int)").alias("i"), *CHANNELS)
    grouped = wide.groupBy("image_id", F.expr("cast(py div 4 as int)").alias("by"), F.expr("cast(px div 4 as int)").alias("bx"))
    return grouped.agg(F.sort_array(F.collect_list(texel)).alias("texels"))


def aligned(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    """Whether a rectangle lies on the block grid and is not empty."""
    return F.expr(f"{w} > 0 and {h} > 0 and (({x} | {y} | {w} | {h}) & 3) = 0")


def valid_image(w: str, h: str, size: Column) -> Column:
    """Whether an image has a size and as many bytes as that needs."""
    return (F.col(w) > 0) & (F.col(h) > 0) & (size >= F.col(w).cast("long") * F.col(h) * 4)


def full_chain(levels: DataFrame) -> DataFrame:
    """(image_id, complete) from (image_id, w, h, max_level, level, size, block_bytes): every level once, of the exact size."""
    lw, lh = "greatest(1, shiftright(w, level))", "greatest(1, shiftright(h, level))"
    exact = F.expr(f"size = cast(({lw} + 3) div 4 * (({lh} + 3) div 4) * block_bytes as bigint)")
    return levels.groupBy("image_id").agg(
        ((F.count("*") == F.max("max_level") + 1) & (F.countDistinct("level") == F.count("*")) & (F.min("level") == 0) & (F.max("level") == F.max("max_level")) & F.bool_and(exact)).alias("complete")
    )


def psnr(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per image the mean squared error and PSNR over four channels of texels that are expected to be visible.

    Both have keys, x, y, r, g, b, a. Infinite when nothing differs or nothing is visible.
    """
    other = actual.select(*keys, "x", "y", *[F.col(c).alias(f"{c}2") for c in CHANNELS])
    both = expected.filter("a <> 0").join(other, [*keys, "x", "y"])
    square = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in CHANNELS), F.lit(0))
    out = both.groupBy(*keys).agg(F.sum(square.cast("long")).alias("error"), F.count("*").alias("texels"))
    mse = F.col("error") / (F.col("texels") * 4)
    return out.select(*keys, "texels", mse.alias("mse"), F.when(F.col("error") == 0, float("inf")).otherwise(10 * F.log10(65025 / mse)).alias("psnr"))


def changed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, changed): whether any texel differs between two snapshots."""
    other = after.select(*keys, "x", "y", *[F.col(c).alias(f"{c}2") for c in CHANNELS])
    differs = reduce(lambda p, q: p | q, [F.col(c) != F.col(f"{c}2") for c in CHANNELS])
    return before.join(other, [*keys, "x", "y"]).groupBy(*keys).agg(F.bool_or(differs).alias("changed"))

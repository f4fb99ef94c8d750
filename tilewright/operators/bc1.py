"""BC1 blocks in built-in expressions: (image_id, by, bx, texels) -> one 64-bit number a block.

The low 16 bits are the first colour, the next 16 the second, then two bits for each of the 16 texels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantised(v: str, bits: int) -> str:
    """SQL for an 8-bit value in fewer bits, rounded half up."""
    top = (1 << bits) - 1
    return f"((2 * {v} * {top} + 255) div 510)"


def expanded(v: str, bits: int) -> str:
    """SQL for a value of 5 or 6 bits in 8, its high bits repeated below."""
    return f"(shiftleft({v}, {8 - bits}) | shiftright({v}, {2 * bits - 8}))"


def endpoints(blocks: DataFrame) -> DataFrame:
    """blocks with c0 and c1, the largest and smallest of each channel in 5, 6 and 5 bits, never equal."""
    out = blocks
    for c in "rgb":
        values = F.col(f"texels.{c}")
        out = out.withColumns({f"lo_{c}": F.array_min(values), f"hi_{c}": F.array_max(values)})
    pack = lambda s: F.expr(f"cast(shiftleft({quantised(f'{s}_r', 5)}, 11) | shiftleft({quantised(f'{s}_g', 6)}, 5) | {quantised(f'{s}_b', 5)} as int)")
    out = out.withColumns({"top": pack("hi"), "low": pack("lo")})
    c0 = F.expr("if(top = low and top = 0, 1, top)")
    c1 = F.expr("if(top = low, if(top = 0, 0, top - 1), low)")
    return out.select(*blocks.columns, c0.alias("c0"), c1.alias("c1"))


def encode(blocks: DataFrame) -> DataFrame:
    """(image_id, by, bx, c0, c1, block): the nearest of four colours for each texel, the lowest index of equals."""
    out = endpoints(blocks)
    parts = {"r": ("shiftright({c}, 11)", 5), "g": ("shiftright({c}, 5) & 63", 6), "b": ("{c} & 31", 5)}
    for ch, (cut, bits) in parts.items():
        for c in ("c0", "c1"):
            out = out.withColumn(f"{c}_{ch}", F.expr(expanded(f"({cut.format(c=c)})", bits)))
    palette = [("c0_{0}", "c1_{0}", 3, 0), ("c0_{0}", "c1_{0}", 0, 3), ("c0_{0}", "c1_{0}", 2, 1), ("c0_{0}", "c1_{0}", 1, 2)]
    colours = []
    for a, b, m, n in palette:
        colours.append("named_struct(" + ", ".join(f"'{ch}', ({m} * {a.format(ch)} + {n} * {b.format(ch)}) div 3" for ch in "rgb") + ")")
    out = out.withColumn("palette", F.expr(f"array({', '.join(colours)})"))
    distance = " + ".join(f"(t.{ch} - p.{ch}) * (t.{ch} - p.{ch})" for ch in "rgb")
    best = f"aggregate(transform(palette, (p, k) -> ({distance}) * 4 + k), 2147483647L, (m, v) -> least(m, v), m -> m & 3)"
    indices = f"aggregate(texels, 0L, (bits, t) -> bits | shiftleft({best}, 2 * t.i))"
    return out.select("image_id", "by", "bx", "c0", "c1", F.expr(f"cast(c0 as bigint) | shiftleft(cast(c1 as bigint), 16) | shiftleft({indices}, 32)").alias("block"))


def decode(encoded: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, a) from (image_id, by, bx, c0, c1, block)."""
    texel = encoded.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    texel = texel.withColumn("k", F.expr("cast(shiftrightunsigned(block, 32 + 2 * i) & 3 as int)"))
    parts = {"r": ("shiftright({c}, 11)", 5), "g": ("shiftright({c}, 5) & 63", 6), "b": ("{c} & 31", 5)}
    out = []
    for ch, (cut, bits) in parts.items():
        a, b = (expanded(f"({cut.format(c=c)})", bits) for c in ("c0", "c1"))
        out.append(F.expr(f"cast(case k when 0 then {a} when 1 then {b} when 2 then (2 * {a} + {b}) div 3 else ({a} + 2 * {b}) div 3 end as int)").alias(ch))
    return texel.select("image_id", F.expr("cast(bx * 4 + i % 4 as int)").alias("x"), F.expr("cast(by * 4 + i div 4 as int)").alias("y"), *out, F.lit(255).alias("a"))

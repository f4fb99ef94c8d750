"""Perceptual fingerprints of images, and families of images with near fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import connected
from tilewright.plans.settle import settle

CELLS = 8
BITS = 63
#: Bits that may differ within a family.
NEAR = 6


def luminance(pixels: DataFrame) -> DataFrame:
    """(image_id, cy, cx, luma): mean luminance of 8 x 8 cells, from (image_id, w, h, x, y, r, g, b).

    Cell c of an axis of n texels spans c * n div 8 up to (c + 1) * n div 8, at least one
    texel; cells of images below 8 texels share them. The sum is kept in whole numbers.
    """

    def cells(v: str, n: str):
        inside = f"filter(sequence(0, 7), c -> {v} >= c * {n} div 8 and {v} < greatest((c + 1) * {n} div 8, c * {n} div 8 + 1))"
        return F.explode(F.expr(inside))

    wide = pixels.withColumn("cx", cells("x", "w")).withColumn("cy", cells("y", "h"))
    bright = F.sum((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")).cast("long"))
    return wide.groupBy("image_id", "cy", "cx").agg((bright / (F.count("*") * 1000)).alias("luma"))


def _cosines() -> np.ndarray:
    u, x = np.arange(CELLS)[:, None], np.arange(CELLS)[None]
    scale = np.where(u == 0, np.sqrt(0.5), 1.0) * 0.5
    return scale * np.cos((2 * x + 1) * u * np.pi / 16)


def fingerprints_of(luma: np.ndarray) -> np.ndarray:
    """(n, 64) cell means -> 63-bit numbers: bit i is set where coefficient i + 1 of the cosine transform is above the median of all but the first."""
    c = _cosines()
    coefficients = np.einsum("uy,nyx,vx->nuv", c, luma.reshape(-1, CELLS, CELLS), c).reshape(-1, CELLS * CELLS)[:, 1:]
    above = coefficients > np.median(coefficients, axis=1, keepdims=True)
    return (above.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(1).astype(np.int64)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        luma = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, CELLS * CELLS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(luma), pa.int64())], ["image_id", "fp"])


def fingerprints(luma: DataFrame) -> DataFrame:
    """(image_id, fp) from (image_id, cy, cx, luma)."""
    cells = luma.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("cy", "cx", "luma"))).alias("cells"))
    return cells.select(F.col("image_id").cast("long").alias("image_id"), F.col("cells.luma").alias("luma")).mapInArrow(_run, "image_id long, fp long")


#: Bands that a key joins, and up to how many differing bits that selects.
JOINED, SELECTIVE = 3, 8


def _bands(near: int) -> list[tuple[int, int]]:
    """(shift, bits) of disjoint bands, so many that JOINED of them are untouched by near differing bits."""
    n = near + JOINED
    edges = [k * BITS // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def near_pairs(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b, distance) of rows (id, tinted, fp) with a < b, equal tinted and at most near differing bits.

    Numbers that differ in at most near bits agree in JOINED of near + JOINED bands at
    least, so an equi-join on every choice of so many bands finds every pair; a pair
    counts at the first choice that it agrees on. For near up to SELECTIVE a key has 15
    bits or more (21 for 6, which makes 84 keys a row). Beyond, no key of a few bands
    selects, as most numbers of 63 bits are that near to a good part of the others, and
    all pairs of equal tinted are compared.
    """
    rows = prints.select("id", "tinted", "fp")
    left = rows.select(F.col("id").alias("a"), F.col("fp").alias("fa"), "tinted")
    right = rows.select(F.col("id").alias("b"), F.col("fp").alias("fb"), "tinted")
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    keys = ["tinted"]
    first = F.lit(True)
    if near <= SELECTIVE:
        bands = _bands(near)
        masks = [((1 << n) - 1) << s for s, n in bands]
        chosen = list(combinations(range(len(bands)), JOINED))
        by_choice = F.array(*[F.struct(F.lit(k).alias("choice"), F.lit(sum(masks[i] for i in c)).cast("long").alias("mask")) for k, c in enumerate(chosen)])

        def keyed(side: DataFrame, fp: str) -> DataFrame:
            out = side.withColumn("c", F.explode(by_choice))
            # Spark takes a side for as large as it was before the choices, and would broadcast it from the driver
            return out.select(*side.columns, F.col("c.choice").alias("choice"), F.col(fp).bitwiseAND(F.col("c.mask")).alias("value")).hint("merge")

        left, right, keys = keyed(left, "fa"), keyed(right, "fb"), ["tinted", "choice", "value"]
        agreeing = F.concat(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")) for k, m in enumerate(masks)])
        choices = F.array(*[F.array(*[F.lit(i) for i in c]) for c in chosen])
        first = F.slice(agreeing, 1, JOINED) == F.element_at(choices, F.col("choice") + 1)
    distance = F.bit_count(differ)
    pairs = left.join(right, keys).filter((F.col("a") < F.col("b")) & (distance <= near) & first)
    return pairs.select("a", "b", distance.alias("distance"))


def families(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(sprite_id, family_id) of (id, tinted, fp): connected by near pairs, named by the smallest id.

    Rows with equal tinted and fingerprint are one class before pairs are made, so many
    copies of an image make no pairs among themselves.
    """
    prints = settle(prints.select("id", "tinted", "fp"))
    classes = prints.groupBy("tinted", "fp").agg(F.min("id").alias("rep"))
    roots = connected(near_pairs(classes.withColumnRenamed("rep", "id"), near).select("a", "b"))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("tinted", "fp", F.coalesce("root", "rep").alias("family_id"))
    return prints.join(named, ["tinted", "fp"]).select(F.col("id").alias("sprite_id"), "family_id")


def duplicate_count(members: DataFrame) -> DataFrame:
    """One row: sprites, families and how many sprites others stand for."""
    out = members.agg(F.count("*").alias("sprites"), F.countDistinct("family_id").alias("families"))
    return out.withColumn("duplicates", F.greatest(F.lit(0), F.col("sprites") - F.col("families")))

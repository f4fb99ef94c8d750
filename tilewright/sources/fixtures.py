"""Image, ledger, cache and animation tables derived from the generic test tables.

An embedding of 64 numbers is an 8 x 8 sprite; events are uploads and ticks; documents are
cache files. Each table has an SQL twin of the same name for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, COLUMNS = 8, 25


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte(e: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255))).cast("int")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, level, x, y, r, g, b, a): every sprite's texels in long form."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("i", "v"))
    at = lambda k: _byte(F.element_at("embedding", ((F.col("i") + k) % 64 + 1).cast("int")))
    alpha = F.when(F.col("vec_id") % 3 == 0, 255).when(F.col("vec_id") % 3 == 1, F.when(F.col("v") < 0, 0).otherwise(255)).otherwise(at(3))
    return e.select(
        F.col("vec_id").alias("image_id"), F.lit(0).alias("level"), (F.col("i") % SIDE).cast("int").alias("x"), F.expr(f"cast(i div {SIDE} as int)").alias("y"),
        at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), alpha.cast("int").alias("a"),
    )


PIXEL_SQL = """
pixel AS (
  SELECT image_id, 0 AS level, x, y, r, g, b, CAST(CASE image_id % 3 WHEN 0 THEN 255 WHEN 1 THEN CASE WHEN v < 0 THEN 0 ELSE 255 END ELSE n END AS INTEGER) AS a
  FROM (SELECT vec_id AS image_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, embedding[i + 1] AS v,
          CAST(least(255, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS r,
          CAST(least(255, greatest(0, floor((CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS g,
          CAST(least(255, greatest(0, floor((CAST(embedding[(i + 2) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS b,
          CAST(least(255, greatest(0, floor((CAST(embedding[(i + 3) % 64 + 1] AS DOUBLE) + 0.5) * 255))) AS INTEGER) AS n
        FROM embeddings, range(64) t(i)))"""


def sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sprite_id, seq, w, h, dest_x, dest_y, tinted, padding): sprites in rows of 25."""
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    n = F.col("vec_id")
    return e.select(
        n.alias("sprite_id"), n.alias("seq"), F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"), (n % COLUMNS * SIDE).cast("int").alias("dest_x"),
        F.expr(f"cast(vec_id div {COLUMNS} * {SIDE} as int)").alias("dest_y"), (n % 2 == 1).alias("tinted"), (n % 3).cast("int").alias("padding"),
    )


SPRITE_SQL = """
sprite AS (
  SELECT vec_id AS sprite_id, vec_id AS seq, 8 AS w, 8 AS h, CAST(vec_id % 25 * 8 AS INTEGER) AS dest_x, CAST(vec_id // 25 * 8 AS INTEGER) AS dest_y,
         vec_id % 2 = 1 AS tinted, CAST(vec_id % 3 AS INTEGER) AS padding
  FROM embeddings)"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(atlas, bucket, ts, event_id, bytes, reset): uploads; an error event resets its atlas."""
    e = read(spark, sf_dir, "events")
    size = F.floor(F.col("value") * 1024 + 0.5).cast("long")
    reset = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("atlas"), F.col("event_type").alias("bucket"), "ts", "event_id", F.when(reset, 0).otherwise(size).cast("long").alias("bytes"), reset.alias("reset")
    )


LEDGER_SQL = """
ledger AS (
  SELECT user_id AS atlas, event_type AS bucket, ts, event_id, event_type = 'error' AS reset,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 1024 + 0.5) END AS BIGINT) AS bytes
  FROM events)"""


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, format, width, height, quality, size, declared, last_access, entry_id): a cache file a document, some cut short."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.when(n % 4 == 0, "bc1").when(n % 11 == 5, "tmp").otherwise("bc7").alias("format"),
        (n % 7 * 4).cast("int").alias("width"), (n % 5 * 4 + 4).cast("int").alias("height"), (n % 3 + 3).cast("int").alias("quality"),
        (F.coalesce("n_chars", F.lit(0)) + 24 - F.when(n % 13 == 4, 1).otherwise(0)).cast("long").alias("size"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("declared"), n.alias("last_access"), n.alias("entry_id"),
    )


CACHE_SQL = """
cache AS (
  SELECT sha256(coalesce(text, '')) AS key, CASE WHEN doc_id % 4 = 0 THEN 'bc1' WHEN doc_id % 11 = 5 THEN 'tmp' ELSE 'bc7' END AS format,
         CAST(doc_id % 7 * 4 AS INTEGER) AS width, CAST(doc_id % 5 * 4 + 4 AS INTEGER) AS height, CAST(doc_id % 3 + 3 AS INTEGER) AS quality,
         CAST(coalesce(n_chars, 0) + 24 - CASE WHEN doc_id % 13 = 4 THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(coalesce(n_chars, 0) AS BIGINT) AS declared, doc_id AS last_access, doc_id AS entry_id
  FROM documents)"""


def frame_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sprite_id, tick, frame, sub_frame, frame_time, frames, row_size, interpolated): animation states by tick."""
    e = read(spark, sf_dir, "events")
    user, n = F.col("user_id"), F.col("event_id")
    return e.select(
        user.alias("sprite_id"), n.alias("tick"), F.expr("cast(pmod(event_id div 3, user_id % 6 + 2) as int)").alias("frame"), (n % 5).cast("int").alias("sub_frame"),
        F.lit(5).alias("frame_time"), (user % 6 + 2).cast("int").alias("frames"), (user % 3 + 1).cast("int").alias("row_size"), (user % 4 == 0).alias("interpolated"),
    )


TICK_SQL = """
tick AS (
  SELECT user_id AS sprite_id, event_id AS tick, CAST((event_id // 3) % (user_id % 6 + 2) AS INTEGER) AS frame, CAST(event_id % 5 AS INTEGER) AS sub_frame,
         5 AS frame_time, CAST(user_id % 6 + 2 AS INTEGER) AS frames, CAST(user_id % 3 + 1 AS INTEGER) AS row_size, user_id % 4 = 0 AS interpolated
  FROM events)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(atlas_id, rect_id, x, y, w, h): animated rectangles, some off the block grid."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    four = lambda c: (c * 4).cast("int")
    return p.select(
        (k % 40).alias("atlas_id"), k.alias("rect_id"), four(k % 16 * 4).alias("x"), four(k % 8 * 8 + (k % 9 == 0).cast("int")).alias("y"),
        (four(F.lit(8)) + F.when(k % 23 == 0, 2).otherwise(0)).cast("int").alias("w"), four(k % 3 * 4 + 4).alias("h"),
    )


RECT_SQL = """
rect AS (
  SELECT p_partkey % 40 AS atlas_id, p_partkey AS rect_id, CAST(p_partkey % 16 * 16 AS INTEGER) AS x,
         CAST((p_partkey % 8 * 8 + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END) * 4 AS INTEGER) AS y,
         CAST(32 + CASE WHEN p_partkey % 23 = 0 THEN 2 ELSE 0 END AS INTEGER) AS w, CAST((p_partkey % 3 * 4 + 4) * 4 AS INTEGER) AS h
  FROM part)"""

"""All registered queries of the engine and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.config import Config
from tilewright.functions import content
from tilewright.operators import bc1, cache, fingerprint, image, ledger
from tilewright.plans import compress
from tilewright.plans.settle import settle
from tilewright.sources import fixtures as fx
from tilewright.streaming import animation

QUERIES: dict = {}
SQL: dict[str, str] = {}
WIDTH, LEVELS = 200, 7


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of 25 sprites make the atlas; one number comes to the driver."""
    top = fx.sprites(spark, sf_dir).agg(F.max("dest_y")).first()[0]
    return (top or 0) + fx.SIDE


def _sized(spark, sf_dir) -> DataFrame:
    return fx.pixels(spark, sf_dir).select("image_id", F.lit(8).alias("w"), F.lit(8).alias("h"), "x", "y", *image.CHANNELS)


def _atlas(spark, sf_dir) -> DataFrame:
    return image.assemble(fx.sprites(spark, sf_dir), fx.pixels(spark, sf_dir), WIDTH, _height(spark, sf_dir))


def _chain(spark, sf_dir, levels: int = LEVELS) -> DataFrame:
    return compress.atlas_levels(fx.sprites(spark, sf_dir), fx.pixels(spark, sf_dir), WIDTH, _height(spark, sf_dir), levels)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


# scans, sources and sinks


@query(_with(fx.PIXEL_SQL) + " SELECT image_id, x, y, r, g, b, a FROM pixel")
def sprite_scan(spark, sf_dir):
    return fx.pixels(spark, sf_dir).select("image_id", "x", "y", *image.CHANNELS)


_ABGR = "CAST(r + g * 256 + b * 65536 + CAST(a AS BIGINT) * 16777216 AS BIGINT)"


@query(_with(fx.PIXEL_SQL) + f" SELECT image_id, x, y, {_ABGR} AS abgr, CAST(b + g * 256 + r * 65536 + CAST(a AS BIGINT) * 16777216 AS BIGINT) AS argb FROM pixel")
def argb_swizzle(spark, sf_dir):
    p = fx.pixels(spark, sf_dir).withColumn("abgr", image.abgr())
    whole = lambda c: F.expr(f"cast({c} as bigint) & 4294967295L").alias(c)
    return p.withColumn("argb", image.swap_red_blue(F.col("abgr"))).select("image_id", "x", "y", whole("abgr"), whole("argb"))


@query(
    _with(fx.PIXEL_SQL, fx.SPRITE_SQL)
    + """ SELECT s.sprite_id, CAST(i.i AS INTEGER) AS x, CAST(j.j AS INTEGER) AS y, p.r, p.g, p.b, p.a FROM sprite s, range(14) i(i), range(14) j(j), pixel p
  WHERE i.i < 8 + 2 * s.padding AND j.j < 8 + 2 * s.padding AND p.image_id = s.sprite_id
    AND p.x = greatest(0, least(7, i.i - s.padding)) AND p.y = greatest(0, least(7, j.j - s.padding))"""
)
def padding_ring(spark, sf_dir):
    return image.padded(fx.sprites(spark, sf_dir), fx.pixels(spark, sf_dir))


_REQUESTS = """request AS (SELECT entry_id AS request_id, key, format, width, height, CAST(CASE WHEN entry_id % 5 = 0 THEN quality + 1 ELSE quality END AS INTEGER) AS quality FROM cache)"""


def _requests(spark, sf_dir):
    return fx.cache_entries(spark, sf_dir).select(F.col("entry_id").alias("request_id"), "key", "format", "width", "height", F.expr("if(entry_id % 5 = 0, quality + 1, quality)").alias("quality"))


@query(
    _with(fx.CACHE_SQL, _REQUESTS)
    + """ SELECT request_id, b.last_access IS NOT NULL AS hit, coalesce(b.last_access, -1) AS last_access FROM request r LEFT JOIN (
    SELECT key, format, width, height, quality, max(last_access) AS last_access FROM cache
    WHERE format IN ('bc1', 'bc7') AND declared > 0 AND size >= 24 + declared AND width > 0 AND height > 0 GROUP BY ALL) b USING (key, format, width, height, quality)"""
)
def cache_read(spark, sf_dir):
    return cache.lookup(_requests(spark, sf_dir), fx.cache_entries(spark, sf_dir)).select("request_id", "hit", F.coalesce("last_access", F.lit(-1)).alias("last_access"))


@query(
    _with(fx.CACHE_SQL, _REQUESTS)
    + """, hits AS (SELECT DISTINCT r.key, r.format FROM request r JOIN cache c USING (key, format, width, height, quality)
    WHERE format IN ('bc1', 'bc7') AND declared > 0 AND size >= 24 + declared AND width > 0 AND height > 0)
  SELECT entry_id, CASE WHEN h.key IS NULL THEN last_access ELSE 9999999 END AS last_access FROM cache LEFT JOIN hits h USING (key, format)"""
)
def cache_touch(spark, sf_dir):
    entries = fx.cache_entries(spark, sf_dir)
    return cache.touched(entries, cache.lookup(_requests(spark, sf_dir), entries), 9999999).select("entry_id", "last_access")


@query(_with(fx.CACHE_SQL) + " SELECT format, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM cache WHERE format IN ('bc1', 'bc7') GROUP BY format")
def cache_write(spark, sf_dir):
    settled_dir = f"{_shared(spark)}/cache-{uuid.uuid4().hex}"
    cache.write(fx.cache_entries(spark, sf_dir).filter(F.col("format").isin(*cache.FORMATS)), settled_dir)
    return spark.read.parquet(settled_dir).groupBy("format").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def _shared(spark) -> str:
    settle(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


_LEVEL_TABLE = """level AS (SELECT p_partkey // 5 AS image_id, CAST(p_partkey % 5 AS INTEGER) AS level, greatest(1, CAST(64 >> CAST(p_partkey % 5 AS INTEGER) AS INTEGER)) AS w,
    greatest(1, CAST(40 >> CAST(p_partkey % 5 AS INTEGER) AS INTEGER)) AS h, CAST(16 AS INTEGER) AS block_bytes FROM part),
  sized AS (SELECT *, CAST((w + 3) // 4 * ((h + 3) // 4) * block_bytes - CASE WHEN (image_id * 7 + level) % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size FROM level)"""


def _level_table(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part").select(F.expr("p_partkey div 5").alias("image_id"), F.expr("cast(p_partkey % 5 as int)").alias("level"))
    p = p.select("image_id", "level", F.expr("greatest(1, shiftright(64, level))").alias("w"), F.expr("greatest(1, shiftright(40, level))").alias("h"), F.lit(16).alias("block_bytes"))
    return p.withColumn("size", F.expr("cast((w + 3) div 4 * ((h + 3) div 4) * block_bytes - if((image_id * 7 + level) % 13 = 0, 1, 0) as bigint)"))


_EXACT = "size = (w + 3) // 4 * ((h + 3) // 4) * block_bytes"


@query(
    _with(_LEVEL_TABLE)
    + f""", bad AS (SELECT image_id, min(level) FILTER (WHERE NOT ({_EXACT})) AS bad FROM sized GROUP BY image_id)
  SELECT image_id, CAST(coalesce(sum(size) FILTER (WHERE bad IS NULL OR level < bad), -1) AS BIGINT) AS bytes FROM sized JOIN bad USING (image_id) GROUP BY image_id"""
)
def upload_levels(spark, sf_dir):
    return compress.uploaded(_level_table(spark, sf_dir))


@query(
    _with(_LEVEL_TABLE)
    + f" SELECT image_id, count(*) = 5 AND count(DISTINCT level) = count(*) AND min(level) = 0 AND max(level) = 4 AND bool_and({_EXACT}) AS complete FROM sized GROUP BY image_id"
)
def full_chain(spark, sf_dir):
    return image.full_chain(_level_table(spark, sf_dir).withColumns({"w": F.lit(64), "h": F.lit(40), "max_level": F.lit(4)}))


@query(
    _with(_LEVEL_TABLE)
    + f""" SELECT image_id, level FROM sized JOIN (SELECT image_id, min(level) FILTER (WHERE NOT ({_EXACT})) AS bad FROM sized GROUP BY image_id) USING (image_id) WHERE bad IS NULL OR level < bad"""
)
def levels_before_failure(spark, sf_dir):
    ok = F.expr("size = cast((w + 3) div 4 * ((h + 3) div 4) * block_bytes as bigint)")
    return compress.kept_levels(_level_table(spark, sf_dir).withColumn("ok", ok)).select("image_id", "level")


@query(
    _with(fx.PIXEL_SQL)
    + """, old AS (SELECT image_id, level, y // 4 AS "by", x // 4 AS bx, CAST(sum(r) AS BIGINT) AS block FROM pixel GROUP BY ALL),
  new AS (SELECT image_id, level, "by", bx, -block AS block FROM old WHERE image_id % 3 = 0 AND bx = 1)
  SELECT image_id, level, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, block FROM (
    SELECT * FROM old WHERE NOT (image_id % 3 = 0 AND bx = 1) UNION ALL SELECT * FROM new)"""
)
def block_update(spark, sf_dir):
    p = fx.pixels(spark, sf_dir)
    old = p.groupBy("image_id", "level", F.expr("cast(y div 4 as int)").alias("by"), F.expr("cast(x div 4 as int)").alias("bx")).agg(F.sum("r").alias("block"))
    new = old.filter("image_id % 3 = 0 and bx = 1").withColumn("block", -F.col("block"))
    return compress.updated_blocks(old, new)


# projections, filters, predicates


@query(
    _with(fx.TICK_SQL, fx.SPRITE_SQL)
    + """ SELECT sprite_id, dest_x AS x, dest_y AS y, CAST(w + 2 * padding AS INTEGER) AS w, CAST(h + 2 * padding AS INTEGER) AS h
  FROM sprite JOIN (SELECT sprite_id FROM tick GROUP BY sprite_id HAVING count(DISTINCT frame) > 1) USING (sprite_id)"""
)
def animated_rects(spark, sf_dir):
    moving = fx.frame_ticks(spark, sf_dir).groupBy("sprite_id").agg((F.min("frame") < F.max("frame")).alias("moves")).filter("moves").select("sprite_id")
    s = fx.sprites(spark, sf_dir).join(moving, "sprite_id", "left_semi")
    return s.select("sprite_id", F.col("dest_x").alias("x"), F.col("dest_y").alias("y"), (F.col("w") + 2 * F.col("padding")).alias("w"), (F.col("h") + 2 * F.col("padding")).alias("h"))


@query(_with(fx.TICK_SQL) + " SELECT DISTINCT sprite_id, frame FROM tick")
def unique_frames(spark, sf_dir):
    return fx.frame_ticks(spark, sf_dir).select("sprite_id", "frame").distinct()


@query(_with(fx.RECT_SQL) + " SELECT rect_id, w > 0 AND h > 0 AND ((x | y | w | h) & 3) = 0 AS aligned FROM rect")
def aligned_rects(spark, sf_dir):
    return fx.rects(spark, sf_dir).select("rect_id", image.aligned().alias("aligned"))


@query(_with(fx.CACHE_SQL) + " SELECT entry_id, width > 0 AND height > 0 AND size >= CAST(width AS BIGINT) * height * 4 AS valid FROM cache")
def valid_images(spark, sf_dir):
    return fx.cache_entries(spark, sf_dir).select("entry_id", image.valid_image("width", "height", F.col("size")).alias("valid"))


@query(
    _with(fx.SPRITE_SQL)
    + """, policy AS (SELECT vec_id AS image_id, CASE WHEN vec_id % 14 = 0 THEN 'ETC2' ELSE 'BC1' END AS format, vec_id % 21 = 0 AS cancelled FROM embeddings WHERE vec_id % 7 = 0)
  SELECT sprite_id AS image_id, coalesce(format, 'BC7') AS format FROM sprite LEFT JOIN policy ON sprite_id = image_id WHERE NOT coalesce(cancelled, FALSE) AND coalesce(format, 'BC7') IN ('BC1', 'BC7')"""
)
def format_routing(spark, sf_dir):
    n = F.col("vec_id")
    policy = fx.read(spark, sf_dir, "embeddings").filter(n % 7 == 0).select(n.alias("image_id"), F.when(n % 14 == 0, "ETC2").otherwise("BC1").alias("format"), (n % 21 == 0).alias("cancelled"))
    return compress.routed(fx.sprites(spark, sf_dir).select(F.col("sprite_id").alias("image_id")), policy, disabled=Config.of(spark).disabled)


@query(
    """SELECT event_id FROM (SELECT event_id, event_id % 4 AS generation, max(event_id % 4) OVER (PARTITION BY user_id) AS newest FROM events) WHERE generation = newest"""
)
def stale_results(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 4).alias("generation"), "event_id")
    return animation.current_results(e).select("event_id")


@query(_with(fx.SPRITE_SQL) + " SELECT sprite_id FROM sprite WHERE dest_x + w <= 120 AND dest_y + h <= 100")
def placement_filter(spark, sf_dir):
    return fx.sprites(spark, sf_dir).filter("dest_x + w <= 120 and dest_y + h <= 100").select("sprite_id")


@query("SELECT event_id FROM events WHERE NOT contains(props, '1')")
def log_filter(spark, sf_dir):
    return fx.read(spark, sf_dir, "events").filter(~F.col("props").contains("1")).select("event_id")


# images

_ATLAS = """size AS (SELECT CAST(max(dest_y) + 8 AS INTEGER) AS height FROM sprite),
top AS (SELECT dest_x + x AS x, dest_y + y AS y, r, g, b, a, row_number() OVER (PARTITION BY dest_x + x, dest_y + y ORDER BY seq DESC) AS n
        FROM pixel JOIN sprite ON image_id = sprite_id, size WHERE dest_x + w <= 200 AND dest_y + h <= height),
atlas AS (SELECT CAST(i.i AS INTEGER) AS x, CAST(j.j AS INTEGER) AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a
          FROM range(200) i(i) CROSS JOIN (SELECT unnest(range(height)) AS j FROM size) j LEFT JOIN (SELECT * FROM top WHERE n = 1) t ON t.x = i.i AND t.y = j.j)"""


def _mip_sql(levels: int) -> str:
    out = ["m0 AS (SELECT CAST(200 AS INTEGER) AS w, height AS h, x, y, r, g, b, a FROM atlas, size)"]
    for k in range(1, levels + 1):
        f = "CASE WHEN w = 1 THEN 2 ELSE 1 END * CASE WHEN h = 1 THEN 2 ELSE 1 END"
        mean = ", ".join(f"CAST((sum({c} * {f}) + 2) // 4 AS INTEGER) AS {c}" for c in "rgba")
        out.append(
            f"""m{k} AS (SELECT CAST(greatest(w // 2, 1) AS INTEGER) AS w, CAST(greatest(h // 2, 1) AS INTEGER) AS h, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, {mean}
  FROM m{k - 1} WHERE (w > 1 OR h > 1) AND x < 2 * greatest(w // 2, 1) AND y < 2 * greatest(h // 2, 1) GROUP BY ALL)"""
        )
    return ",\n".join(out) + ",\nmip AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS level, * FROM m{k}" for k in range(levels + 1)) + ")"


@query(_with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS) + " SELECT x, y, r, g, b, a FROM atlas")
def atlas_assemble(spark, sf_dir):
    return _atlas(spark, sf_dir)


@query(_with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS, _mip_sql(1)) + " SELECT w, h, x, y, r, g, b, a FROM mip WHERE level = 1")
def downsample(spark, sf_dir):
    height = _height(spark, sf_dir)
    base = _atlas(spark, sf_dir).select(F.lit(0).alias("image_id"), F.lit(WIDTH).alias("w"), F.lit(height).alias("h"), "x", "y", *image.CHANNELS)
    return image.downsample(base).drop("image_id")


@query(_with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS, _mip_sql(LEVELS)) + " SELECT level, w, h, x, y, r, g, b, a FROM mip")
def mip_chain(spark, sf_dir):
    return _chain(spark, sf_dir).select("level", "w", "h", "x", "y", *image.CHANNELS)


@query(
    _with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS, _mip_sql(LEVELS))
    + """ SELECT level, w, h, CAST((w + 3) // 4 * ((h + 3) // 4) * 16 AS BIGINT) AS compressed, CAST(w AS BIGINT) * h * 4 AS uncompressed, CAST(w AS BIGINT) * h * 4 - (w + 3) // 4 * ((h + 3) // 4) * 16 AS saved,
  CAST(sum(a) AS BIGINT) AS alpha_sum FROM mip GROUP BY level, w, h"""
)
def atlas_bytes(spark, sf_dir):
    """Assemble the atlas, build its levels, and account for the bytes that BC7 saves on each."""
    levels = _chain(spark, sf_dir).groupBy("level", "w", "h").agg(F.sum("a").alias("alpha_sum"))
    size, full = F.expr("cast((w + 3) div 4 * ((h + 3) div 4) * 16 as bigint)"), F.expr("cast(w as bigint) * h * 4")
    return levels.select("level", "w", "h", size.alias("compressed"), full.alias("uncompressed"), (full - size).alias("saved"), "alpha_sum")


@query(
    """WITH img AS (SELECT p_partkey AS image_id, CAST(p_size AS INTEGER) AS w, CAST(p_partkey % 37 + 1 AS INTEGER) AS h, CAST(p_partkey % 9 AS INTEGER) AS max_level FROM part),
  lv AS (SELECT image_id, w, h, l, greatest(1, w >> l) AS lw, greatest(1, h >> l) AS lh FROM img, (SELECT CAST(i AS INTEGER) AS l FROM range(9) t(i)) WHERE l <= max_level)
  SELECT image_id, count(*) AS levels, CAST(sum((lw + 3) // 4 * ((lh + 3) // 4) * 8) AS BIGINT) AS bytes FROM lv WHERE l = 0 OR (w >> (l - 1)) > 1 OR (h >> (l - 1)) > 1 GROUP BY image_id"""
)
def mip_bytes(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part")
    img = p.select(F.col("p_partkey").alias("image_id"), F.col("p_size").cast("int").alias("w"), (F.col("p_partkey") % 37 + 1).cast("int").alias("h"), (F.col("p_partkey") % 9).cast("int").alias("max_level"))
    return image.mip_bytes(img, image.BLOCK_BYTES["BC1"])


@query(
    _with(fx.PIXEL_SQL)
    + """, s AS (SELECT image_id, CASE WHEN bool_or(a NOT IN (0, 255)) THEN 'BLENDED' WHEN bool_or(a = 0) THEN 'PUNCH_THROUGH' ELSE 'FULLY_OPAQUE' END AS shape FROM pixel GROUP BY image_id)
  SELECT image_id, shape, shape <> 'FULLY_OPAQUE' AS has_alpha FROM s"""
)
def alpha_shape(spark, sf_dir):
    return image.alpha_shape(fx.pixels(spark, sf_dir))


_BLEED = """bled AS (SELECT image_id, x, y, a, """ + ", ".join(
    f"CAST(CASE WHEN a > 0 THEN {c} WHEN count(*) FILTER (WHERE a > 0) OVER k = 0 THEN 0 ELSE sum({c}) FILTER (WHERE a > 0) OVER k // count(*) FILTER (WHERE a > 0) OVER k END AS INTEGER) AS {c}" for c in "rgb"
) + " FROM pixel WINDOW k AS (PARTITION BY image_id, x // 4, y // 4))"


@query(_with(fx.PIXEL_SQL, _BLEED) + " SELECT image_id, x, y, r, g, b, a FROM bled")
def alpha_bleed(spark, sf_dir):
    return image.bleed(fx.pixels(spark, sf_dir))


@query(
    _with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS, _mip_sql(LEVELS))
    + """, cell AS (SELECT level, w, h, CAST(i AS INTEGER) AS px, CAST(j AS INTEGER) AS py FROM (SELECT DISTINCT level, w, h FROM mip), range(200) i(i), range(4096) j(j) WHERE i < (w + 3) // 4 * 4 AND j < (h + 3) // 4 * 4)
  SELECT CAST(c.level AS BIGINT) AS image_id, CAST(py // 4 AS INTEGER) AS by, CAST(px // 4 AS INTEGER) AS bx, count(*) AS texels, CAST(sum((py % 4 * 4 + px % 4 + 1) * (r + 2 * g + 3 * b + 5 * a)) AS BIGINT) AS digest
  FROM cell c JOIN mip m ON m.level = c.level AND m.x = least(c.px, c.w - 1) AND m.y = least(c.py, c.h - 1) GROUP BY ALL"""
)
def block_partition(spark, sf_dir):
    cells = image.blocks(_chain(spark, sf_dir).drop("image_id").withColumn("image_id", F.col("level").cast("long")))
    digest = F.aggregate("texels", F.lit(0).cast("long"), lambda s, t: s + (t["i"] + 1) * (t["r"] + 2 * t["g"] + 3 * t["b"] + 5 * t["a"]))
    return cells.select("image_id", "by", "bx", F.size("texels").cast("long").alias("texels"), digest.alias("digest"))


@query(
    _with(fx.PIXEL_SQL)
    + " SELECT image_id, CAST(y AS INTEGER) AS cy, CAST(x AS INTEGER) AS cx, CAST(299 * r + 587 * g + 114 * b AS DOUBLE) / 1000 AS luma FROM pixel"
)
def luma_8x8(spark, sf_dir):
    return fingerprint.luminance(_sized(spark, sf_dir))


_PRINT = """luma AS (SELECT image_id, x, y, CAST(299 * r + 587 * g + 114 * b AS DOUBLE) / 1000 AS l FROM pixel),
coef AS (SELECT image_id, CAST(u AS INTEGER) * 8 + CAST(v AS INTEGER) - 1 AS i, (CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END) * (CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END)
           * sum(l * cos((2 * y + 1) * u * pi() / 16) * cos((2 * x + 1) * v * pi() / 16)) AS c FROM luma, range(8) a(u), range(8) b(v) WHERE u + v > 0 GROUP BY image_id, u, v),
print AS (SELECT image_id AS id, image_id % 2 = 1 AS tinted, CAST(sum(CASE WHEN c > m THEN CAST(1 AS BIGINT) << i ELSE 0 END) AS BIGINT) AS fp
          FROM coef JOIN (SELECT image_id, median(c) AS m FROM coef GROUP BY image_id) USING (image_id) GROUP BY image_id)"""
_FAMILIES = """edge AS (SELECT p.id AS a, q.id AS b FROM print p JOIN print q ON p.tinted = q.tinted AND bit_count(xor(p.fp, q.fp)) <= 6),
reach AS (SELECT id AS a, id AS b FROM print UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
family AS (SELECT a AS sprite_id, min(b) AS family_id FROM reach GROUP BY a)"""


def _prints(spark, sf_dir):
    prints = fingerprint.fingerprints(fingerprint.luminance(_sized(spark, sf_dir)))
    return prints.select(F.col("image_id").alias("id"), (F.col("image_id") % 2 == 1).alias("tinted"), "fp")


@query(_with(fx.PIXEL_SQL, _PRINT) + " SELECT id, tinted, fp FROM print")
def phash(spark, sf_dir):
    return _prints(spark, sf_dir)


@query(
    _with(fx.PIXEL_SQL, _PRINT)
    + " SELECT p.id AS a, q.id AS b, CAST(bit_count(xor(p.fp, q.fp)) AS INTEGER) AS distance FROM print p JOIN print q ON p.id < q.id AND p.tinted = q.tinted AND bit_count(xor(p.fp, q.fp)) <= 6"
)
def phash_pairs(spark, sf_dir):
    return fingerprint.near_pairs(_prints(spark, sf_dir), Config.of(spark).near)


@query(_with(fx.PIXEL_SQL, _PRINT, _FAMILIES) + " SELECT sprite_id, family_id FROM family")
def phash_families(spark, sf_dir):
    return fingerprint.families(_prints(spark, sf_dir), Config.of(spark).near)


@query(
    _with(fx.PIXEL_SQL, _PRINT, _FAMILIES)
    + " SELECT count(*) AS sprites, count(DISTINCT family_id) AS families, greatest(0, count(*) - count(DISTINCT family_id)) AS duplicates FROM family"
)
def phash_duplicates(spark, sf_dir):
    return fingerprint.duplicate_count(fingerprint.families(_prints(spark, sf_dir), Config.of(spark).near))


# families over numbers that SQL can make too: hashes of keys in place of fingerprints
_FAKE = "print AS (SELECT vec_id AS id, vec_id % 2 = 1 AS tinted, (vec_id * 2654435761) % 4096 * 16777259 + vec_id % 5 AS fp FROM embeddings)"


def _fake(spark, sf_dir):
    return fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 2 == 1).alias("tinted"), F.expr("(vec_id * 2654435761L) % 4096 * 16777259L + vec_id % 5").alias("fp"))


@query(_with(_FAKE) + " SELECT p.id AS a, q.id AS b, CAST(bit_count(xor(p.fp, q.fp)) AS INTEGER) AS distance FROM print p JOIN print q ON p.id < q.id AND p.tinted = q.tinted AND bit_count(xor(p.fp, q.fp)) <= 4")
def near_pairs(spark, sf_dir):
    return fingerprint.near_pairs(_fake(spark, sf_dir), 4)


@query(
    _with(
        _FAKE,
        """ edge AS (SELECT p.id AS a, q.id AS b FROM print p JOIN print q ON p.tinted = q.tinted AND bit_count(xor(p.fp, q.fp)) <= 3),
  reach AS (SELECT id AS a, id AS b FROM print UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)""",
    )
    + " SELECT a AS sprite_id, min(b) AS family_id FROM reach GROUP BY a"
)
def near_families(spark, sf_dir):
    return fingerprint.families(_fake(spark, sf_dir), 3)


_BC1 = """
ends AS (SELECT image_id, y // 4 AS "by", x // 4 AS bx, min(r) AS lr, min(g) AS lg, min(b) AS lb, max(r) AS hr, max(g) AS hg, max(b) AS hb FROM pixel GROUP BY ALL),
packed AS (SELECT image_id, "by", bx, ((2 * hr * 31 + 255) // 510 << 11) | ((2 * hg * 63 + 255) // 510 << 5) | ((2 * hb * 31 + 255) // 510) AS t,
                  ((2 * lr * 31 + 255) // 510 << 11) | ((2 * lg * 63 + 255) // 510 << 5) | ((2 * lb * 31 + 255) // 510) AS l FROM ends),
pair AS (SELECT image_id, "by", bx, CASE WHEN t = l AND t = 0 THEN 1 ELSE t END AS c0, CASE WHEN t <> l THEN l WHEN t = 0 THEN 0 ELSE t - 1 END AS c1 FROM packed),
wide AS (SELECT *, ((c0 >> 11) << 3) | (c0 >> 13) AS r0, (((c0 >> 5) & 63) << 2) | (((c0 >> 5) & 63) >> 4) AS g0, ((c0 & 31) << 3) | ((c0 & 31) >> 2) AS b0,
                   ((c1 >> 11) << 3) | (c1 >> 13) AS r1, (((c1 >> 5) & 63) << 2) | (((c1 >> 5) & 63) >> 4) AS g1, ((c1 & 31) << 3) | ((c1 & 31) >> 2) AS b1 FROM pair),
pal AS (SELECT image_id, "by", bx, k, (m * r0 + n * r1) // 3 AS pr, (m * g0 + n * g1) // 3 AS pg, (m * b0 + n * b1) // 3 AS pb FROM wide, (VALUES (0, 3, 0), (1, 0, 3), (2, 2, 1), (3, 1, 2)) v(k, m, n)),
near AS (SELECT p.image_id, p.y // 4 AS "by", p.x // 4 AS bx, p.y % 4 * 4 + p.x % 4 AS i, min(((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 4 + k) & 3 AS k
         FROM pixel p JOIN pal ON pal.image_id = p.image_id AND pal."by" = p.y // 4 AND pal.bx = p.x // 4 GROUP BY ALL),
bits AS (SELECT image_id, "by", bx, CAST(sum(CAST(k AS HUGEINT) * (CAST(1 AS HUGEINT) << (2 * CAST(i AS INTEGER)))) AS HUGEINT) AS ix FROM near GROUP BY ALL)"""


@query(_with(fx.PIXEL_SQL, _BC1) + " SELECT image_id, CAST(\"by\" AS INTEGER) AS \"by\", CAST(bx AS INTEGER) AS bx, CAST(c0 AS INTEGER) AS c0, CAST(c1 AS INTEGER) AS c1 FROM pair")
def bc1_endpoints(spark, sf_dir):
    return bc1.endpoints(image.blocks(_sized(spark, sf_dir))).select("image_id", "by", "bx", "c0", "c1")


@query(
    _with(fx.PIXEL_SQL, _BC1)
    + """ SELECT image_id, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS block
  FROM (SELECT image_id, "by", bx, c0 + CAST(c1 AS HUGEINT) * 65536 + ix * 4294967296 AS v FROM pair JOIN bits USING (image_id, "by", bx))"""
)
def bc1_blocks(spark, sf_dir):
    return bc1.encode(image.blocks(_sized(spark, sf_dir))).select("image_id", "by", "bx", "block")


@query()
def bc7_blocks(spark, sf_dir):
    return compress.encode_bc7(image.blocks(_sized(spark, sf_dir)))


@query()
def bc7_atlas(spark, sf_dir):
    """Every block of every level of the atlas."""
    return compress.compressed(_chain(spark, sf_dir))


@query()
def bc7_psnr(spark, sf_dir):
    cells = image.blocks(_sized(spark, sf_dir))
    return image.psnr(fx.pixels(spark, sf_dir), compress.decode_bc7(compress.encode_bc7(cells)), ["image_id"])


@query()
def compress_images(spark, sf_dir):
    """Packed images, some with a wrong size, through the engine's encoder."""
    images = compress.packed_images(_sized(spark, sf_dir)).withColumn("w", F.expr("if(image_id % 50 = 7, 9, w)"))
    return compress.compress_images(images).select("image_id", F.length("blocks").alias("size"), F.sha2("blocks", 256).alias("digest"), "reason")


_DRIVEN = """driven AS (SELECT level, w, h, CAST((w + 3) // 4 * ((h + 3) // 4) * 16 AS BIGINT) AS size, CAST(w AS BIGINT) * h * 4 AS whole FROM (SELECT DISTINCT level, w, h FROM mip) WHERE level < 6)"""


def _driven(spark, sf_dir) -> DataFrame:
    """The whole plan: levels in strips, those that the cache holds (the even ones), the rest encoded, up to the first that fails (the sixth)."""
    quality = Config.of(spark).quality
    strips = compress.packed_strips(_chain(spark, sf_dir).drop("image_id").withColumnRenamed("level", "image_id"))
    strips = settle(strips.withColumn("rgba", F.expr("if(image_id = 6, substring(rgba, 1, 3), rgba)")))
    folder = f"{_shared(spark)}/blocks-{uuid.uuid4().hex}"
    first = compress.driver(strips.filter("image_id % 2 = 0"), None, quality)
    first.select("key", "w", "h", "blocks").write.parquet(folder)
    return compress.driver(strips, spark.read.parquet(folder), quality)


@query(
    _with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS, _mip_sql(LEVELS), _DRIVEN)
    + " SELECT level, w, h, level % 2 = 0 AS cached, size, level >= 3 AS retained FROM driven"
)
def compress_driver(spark, sf_dir):
    done = _driven(spark, sf_dir).groupBy(F.col("image_id").alias("level"), "w").agg(
        F.sum("h").cast("int").alias("h"), F.bool_and(F.col("source") == "cache").alias("cached"), F.sum(F.length("blocks").cast("long")).alias("size")
    )
    return done.select("level", "w", "h", "cached", "size", (F.col("level") >= 3).alias("retained"))


@query(_with(fx.PIXEL_SQL, fx.SPRITE_SQL, _ATLAS, _mip_sql(LEVELS), _DRIVEN) + " SELECT level AS image_id, 'BC7' AS format, whole - size AS saved, size AS resident FROM driven")
def compress_post(spark, sf_dir):
    return compress.post_records(_driven(spark, sf_dir))


@query(
    _with(
        fx.PIXEL_SQL,
        """word AS (SELECT image_id, CAST((y * 8 + x) // 2 AS INTEGER) AS k, sum(CAST(r + g * 256 + b * 65536 + CAST(a AS BIGINT) * 16777216 AS HUGEINT) * CASE WHEN x % 2 = 1 THEN 4294967296 ELSE 1 END)::UHUGEINT AS v FROM pixel GROUP BY ALL)""",
        f"""fold AS (SELECT DISTINCT image_id, 0 AS k, xor({content.SEED}::UHUGEINT, {8 << 32 | 8 << 1}::UHUGEINT) AS z FROM word
    UNION ALL SELECT image_id, k, xor(z, z >> 31) FROM (SELECT image_id, k, (xor(z, z >> 27) * {content.FACTORS[1]}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM (
      SELECT image_id, k, (xor(z, z >> 30) * {content.FACTORS[0]}::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM (
        SELECT f.image_id, f.k + 1 AS k, xor(f.z, w.v) AS z FROM fold f JOIN word w ON w.image_id = f.image_id AND w.k = f.k))))""",
    )
    + " SELECT image_id, CAST(CASE WHEN z >= 9223372036854775808::UHUGEINT THEN z::HUGEINT - 18446744073709551616::HUGEINT ELSE z::HUGEINT END AS BIGINT) AS hash FROM fold WHERE k = 32"
)
def content_hash64(spark, sf_dir):
    return content.content_hash(compress.packed_images(_sized(spark, sf_dir)))


# what a sound encoder stays well below: the error of one colour a block
_FLAT = """flat AS (SELECT image_id, x // 4 AS bx, y // 4 AS "by", round(avg(r)) AS mr, round(avg(g)) AS mg, round(avg(b)) AS mb, round(avg(a)) AS ma FROM pixel GROUP BY ALL),
worst AS (SELECT p.image_id, CAST(sum((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb) + (a - ma) * (a - ma)) AS BIGINT) AS flat_error FROM pixel p JOIN flat f ON f.image_id = p.image_id AND f.bx = p.x // 4 AND f."by" = p.y // 4 WHERE p.image_id % 3 = 0 GROUP BY p.image_id)"""


@query(_with(fx.PIXEL_SQL, _FLAT) + " SELECT image_id, flat_error, TRUE AS better FROM worst")
def bc7_bound(spark, sf_dir):
    """Of opaque images, the error of one colour a block, and whether BC7 blocks, decoded again, have at most three quarters of it.

    The channels of these images are independent, so one line takes a third of the error away at least.
    """
    p = fx.pixels(spark, sf_dir).filter("image_id % 3 = 0").select("image_id", "x", "y", *image.CHANNELS)
    at = p.withColumns({"bx": F.expr("x div 4"), "by": F.expr("y div 4")})
    mean = at.groupBy("image_id", "bx", "by").agg(*[F.round(F.avg(c)).alias(f"m{c}") for c in image.CHANNELS])
    error = lambda other: sum(((F.col(c) - F.col(other + c)) * (F.col(c) - F.col(other + c)) for c in image.CHANNELS), F.lit(0))
    flat = at.join(mean, ["image_id", "bx", "by"]).groupBy("image_id").agg(F.sum(error("m")).cast("long").alias("flat_error"))
    again = compress.decode_bc7(compress.encode_bc7(image.blocks(p.withColumns({"w": F.lit(8), "h": F.lit(8)}))))
    again = again.select("image_id", "x", "y", *[F.col(c).alias(f"d{c}") for c in image.CHANNELS])
    coded = p.join(again, ["image_id", "x", "y"]).groupBy("image_id").agg(F.sum(error("d")).alias("error"))
    return flat.join(coded, "image_id").select("image_id", "flat_error", (4 * F.col("error") <= 3 * F.col("flat_error")).alias("better"))


@query(
    _with(
        fx.PIXEL_SQL,
        """hit AS (SELECT image_id, CAST(image_id % 5 AS INTEGER) AS rx, CAST(image_id % 3 AS INTEGER) AS ry, 3 AS w, CAST(image_id % 2 * 4 + 1 AS INTEGER) AS h FROM pixel WHERE x = 0 AND y = 0 AND image_id % 4 = 1)""",
        """mixed AS (SELECT p.image_id, p.x, p.y, CASE WHEN q.image_id IS NULL THEN p.r ELSE q.r END AS r, CASE WHEN q.image_id IS NULL THEN p.g ELSE q.g END AS g, CASE WHEN q.image_id IS NULL THEN p.b ELSE q.b END AS b, p.a
    FROM pixel p JOIN hit ON hit.image_id = p.image_id LEFT JOIN pixel q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y AND p.x >= rx AND p.x < rx + w AND p.y >= ry AND p.y < least(8, ry + h)
    WHERE p.x // 4 BETWEEN rx // 4 AND (rx + w - 1) // 4 AND p.y // 4 BETWEEN ry // 4 AND (least(8, ry + h) - 1) // 4)""",
        _BC1.replace("FROM pixel ", "FROM mixed "),
    )
    + """ SELECT image_id, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT) AS block
  FROM (SELECT image_id, "by", bx, c0 + CAST(c1 AS HUGEINT) * 65536 + ix * 4294967296 AS v FROM pair JOIN bits USING (image_id, "by", bx))"""
)
def deep_patch(spark, sf_dir):
    """The next image's texels written into a rectangle of each fourth image, and the touched blocks encoded anew."""
    p = fx.pixels(spark, sf_dir).select("image_id", "x", "y", *image.CHANNELS)
    rects = p.filter("x = 0 and y = 0 and image_id % 4 = 1").selectExpr("image_id", "cast(image_id % 5 as int) as x", "cast(image_id % 3 as int) as y", "3 as w", "cast(image_id % 2 * 4 + 1 as int) as h")
    return compress.patched_blocks(p, p.withColumn("image_id", F.col("image_id") - 1), rects, 8, 8, "BC1").select("image_id", "by", "bx", "block")


# metrics

_OTHER = "other AS (SELECT image_id, x, y, CAST(r // 2 * 2 AS INTEGER) AS r, g, CAST(CASE WHEN image_id % 5 = 0 THEN b ELSE 255 - b END AS INTEGER) AS b, a FROM pixel)"


def _other(spark, sf_dir):
    return fx.pixels(spark, sf_dir).withColumns({"r": F.expr("cast(r div 2 * 2 as int)"), "b": F.expr("if(image_id % 5 = 0, b, 255 - b)")})


_PSNR = """err AS (SELECT image_id, count(*) AS texels, CAST(sum((p.r - o.r) * (p.r - o.r) + (p.g - o.g) * (p.g - o.g) + (p.b - o.b) * (p.b - o.b)) AS BIGINT) AS e
  FROM pixel p JOIN other o USING (image_id, x, y) WHERE p.a <> 0 GROUP BY image_id),
quality AS (SELECT image_id, texels, CAST(e AS DOUBLE) / (texels * 4) AS mse, CASE WHEN e = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 10 * log10(65025 / (CAST(e AS DOUBLE) / (texels * 4))) END AS psnr FROM err)"""


@query(_with(fx.PIXEL_SQL, _OTHER, _PSNR) + " SELECT image_id, texels, mse, round(psnr, 9) AS psnr FROM quality")
def psnr(spark, sf_dir):
    return image.psnr(fx.pixels(spark, sf_dir), _other(spark, sf_dir), ["image_id"]).withColumn("psnr", F.round("psnr", 9))


@query(_with(fx.PIXEL_SQL, _OTHER, _PSNR) + " SELECT image_id // 4 AS sprite, round(max(psnr), 9) AS best, max(psnr) >= 20 AS pass FROM quality GROUP BY image_id // 4")
def best_frame(spark, sf_dir):
    q = image.psnr(fx.pixels(spark, sf_dir), _other(spark, sf_dir), ["image_id"])
    return q.groupBy(F.expr("image_id div 4").alias("sprite")).agg(F.round(F.max("psnr"), 9).alias("best"), (F.max("psnr") >= 20).alias("pass"))


@query(_with(fx.PIXEL_SQL, _OTHER) + " SELECT image_id, bool_or(p.r <> o.r OR p.g <> o.g OR p.b <> o.b OR p.a <> o.a) AS changed FROM pixel p JOIN other o USING (image_id, x, y) GROUP BY image_id")
def change_detection(spark, sf_dir):
    return image.changed(fx.pixels(spark, sf_dir), _other(spark, sf_dir), ["image_id"])


@query(_with(fx.PIXEL_SQL, _OTHER, _PSNR) + " SELECT CASE WHEN min(psnr) >= 28 THEN 'static sprites: PASS' ELSE 'static sprites: FAIL' END AS verdict, count(*) AS sprites FROM quality")
def report(spark, sf_dir):
    q = image.psnr(fx.pixels(spark, sf_dir), _other(spark, sf_dir), ["image_id"])
    return q.agg(F.when(F.min("psnr") >= 28, "static sprites: PASS").otherwise("static sprites: FAIL").alias("verdict"), F.count("*").alias("sprites"))


@query(
    _with(fx.PIXEL_SQL, _OTHER, _PSNR)
    + """ SELECT unnest([CASE WHEN min(psnr) >= 28 THEN 'PASS' ELSE 'FAIL' END, 'sprites: ' || count(*), 'at or above 28 dB: ' || count(*) FILTER (WHERE psnr >= 28)]) AS value FROM quality"""
)
def report_text(spark, sf_dir):
    """The report as a text file whose first line is the verdict, written and read again."""
    q = image.psnr(fx.pixels(spark, sf_dir), _other(spark, sf_dir), ["image_id"])
    counted = q.agg(F.min("psnr").alias("least"), F.count("*").alias("n"), F.count_if(F.col("psnr") >= 28).alias("good"))
    lines = counted.select(F.concat_ws("\n", F.when(F.col("least") >= 28, "PASS").otherwise("FAIL"), F.concat(F.lit("sprites: "), "n"), F.concat(F.lit("at or above 28 dB: "), "good")).alias("value"))
    folder = f"{_shared(spark)}/report-{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(folder)
    return spark.read.text(folder)


_LATEST = "last AS (SELECT atlas, arg_max(bytes, (ts, event_id)) AS bytes, arg_max(reset, (ts, event_id)) AS reset FROM ledger GROUP BY atlas), resident AS (SELECT atlas, bytes FROM last WHERE bytes > 0 AND NOT reset)"


@query(_with(fx.LEDGER_SQL, _LATEST) + " SELECT atlas, bytes FROM resident")
def ledger_latest(spark, sf_dir):
    return ledger.latest(fx.ledger_events(spark, sf_dir), "atlas")


@query(_with(fx.LEDGER_SQL, _LATEST) + " SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total, count(*) > 0 AS active FROM resident")
def ledger_total(spark, sf_dir):
    return ledger.total(ledger.latest(fx.ledger_events(spark, sf_dir), "atlas"))


_BUCKETS = """reset_at AS (SELECT atlas, max((ts, event_id)) AS last_reset FROM ledger WHERE reset GROUP BY atlas),
alive AS (SELECT l.* FROM ledger l LEFT JOIN reset_at USING (atlas) WHERE NOT reset AND (last_reset IS NULL OR (ts, event_id) > last_reset)),
buckets AS (SELECT atlas, bucket, bytes FROM (SELECT atlas, bucket, arg_max(bytes, (ts, event_id)) AS bytes FROM alive GROUP BY atlas, bucket) WHERE bytes > 0)"""


@query(_with(fx.LEDGER_SQL, _BUCKETS) + " SELECT atlas, bucket, bytes FROM buckets")
def bucket_ledger(spark, sf_dir):
    return ledger.bucket_ledger(fx.ledger_events(spark, sf_dir))


@query(_with(fx.LEDGER_SQL, _BUCKETS) + " SELECT concat(atlas, '/', bucket) AS key, bytes FROM buckets WHERE NOT starts_with(concat(atlas, '/', bucket), '1')")
def ledger_reset_prefix(spark, sf_dir):
    keyed = ledger.bucket_ledger(fx.ledger_events(spark, sf_dir)).select(F.concat_ws("/", "atlas", "bucket").alias("key"), "bytes")
    return ledger.without(keyed, "1")


def _savings(spark, sf_dir):
    return ledger.bucket_ledger(fx.ledger_events(spark, sf_dir)).select("atlas", "bucket", (F.col("bytes") * 3).alias("saved"), F.col("bytes").alias("resident"))


@query(
    _with(fx.LEDGER_SQL, _BUCKETS)
    + """, s AS (SELECT coalesce(sum(bytes * 3), 0) AS saved, coalesce(sum(bytes), 0) AS resident FROM buckets)
  SELECT saved / 1048576.0::DOUBLE AS saved_mb, resident / 1048576.0::DOUBLE AS resident_mb, (saved + resident) / 1048576.0::DOUBLE AS original_mb,
    CASE WHEN saved + resident = 0 THEN 0.0::DOUBLE ELSE saved * 100.0::DOUBLE / (saved + resident) END AS percent,
    printf('%.2f MB instead of %.2f MB (%.1f%% saved)', resident / 1048576.0::DOUBLE, (saved + resident) / 1048576.0::DOUBLE, saved * 100.0::DOUBLE / (saved + resident)) AS shown FROM s"""
)
def savings_summary(spark, sf_dir):
    return ledger.savings_summary(_savings(spark, sf_dir))


@query(
    _with(fx.LEDGER_SQL, _BUCKETS)
    + """, t AS (SELECT atlas, CAST(sum(bytes * 3) AS BIGINT) AS saved, CAST(sum(bytes) AS BIGINT) AS resident, count(*) AS n FROM buckets GROUP BY atlas)
  SELECT atlas, NULL AS bucket, saved, resident FROM t UNION ALL SELECT atlas, bucket, bytes * 3, bytes FROM buckets JOIN t USING (atlas) WHERE n > 1"""
)
def savings_ranked(spark, sf_dir):
    return ledger.ranked(_savings(spark, sf_dir))


@query(
    """SELECT s_suppkey AS device, CAST(coalesce(CASE WHEN s_suppkey % 10 = 0 THEN 512 END, CASE WHEN s_suppkey % 4 > 0 THEN CAST(floor(s_suppkey % 4 * 1001 * 0.75) AS INTEGER) END, 2048) AS INTEGER) AS budget_mb FROM supplier"""
)
def effective_budget(spark, sf_dir):
    s = fx.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("device"), ledger.effective_budget(F.when(k % 10 == 0, 512), (k % 4 * 1001).cast("int"), F.lit(Config.of(spark).budget_mb)).alias("budget_mb"))


def _requests_to_admit(spark, sf_dir):
    e = fx.ledger_events(spark, sf_dir).filter("not reset and bytes > 0")
    return e.withColumn("device", F.col("atlas") % 25)


@query(
    _with(
        fx.LEDGER_SQL,
        """ asked AS (SELECT atlas % 25 AS device, row_number() OVER (PARTITION BY atlas % 25 ORDER BY ts, event_id) AS n, atlas, event_id, bytes FROM ledger WHERE NOT reset AND bytes > 0),
  fold AS (SELECT DISTINCT device, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(k BIGINT, v BIGINT)[]) AS held, CAST(0 AS BIGINT) AS event_id, FALSE AS admitted FROM asked
    UNION ALL SELECT device, n, CASE WHEN fits THEN list_append(others, {'k': atlas, 'v': bytes}) ELSE held END, event_id, fits FROM (
      SELECT *, coalesce(list_sum(list_transform(others, lambda e: e.v)), 0) + bytes <= 300000 AS fits FROM (
        SELECT a.device, a.n, a.atlas, a.event_id, a.bytes, f.held, list_filter(f.held, lambda e: e.k <> a.atlas) AS others FROM fold f JOIN asked a ON a.device = f.device AND a.n = f.n + 1)))""",
    )
    + " SELECT event_id, admitted FROM fold WHERE n > 0"
)
def budget_admission(spark, sf_dir):
    return ledger.admit(_requests_to_admit(spark, sf_dir), 300_000, "device")


@query(_with(_LEVEL_TABLE) + " SELECT image_id, CAST(sum(size) AS BIGINT) AS resident, CAST(sum(CAST(w AS BIGINT) * h * 4) AS BIGINT) AS uncompressed, CAST(sum(CAST(w AS BIGINT) * h * 4) - sum(size) AS BIGINT) AS saved FROM sized GROUP BY image_id")
def upload_accounting(spark, sf_dir):
    return ledger.accounting(_level_table(spark, sf_dir))


@query(
    """WITH d AS (SELECT user_id AS atlas, event_id, event_id * 37 % 5000 AS nanos, event_type = 'signup' AS registered FROM events),
  s AS (SELECT atlas, max(event_id) AS since FROM d WHERE registered GROUP BY atlas)
  SELECT atlas, count(*) AS calls, CAST(sum(nanos) AS BIGINT) AS total, max(nanos) AS longest, CAST(sum(nanos) AS DOUBLE) / 60 AS per_tick FROM d LEFT JOIN s USING (atlas) WHERE NOT registered AND (since IS NULL OR event_id > since) GROUP BY atlas"""
)
def encode_statistics(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("atlas"), "event_id", (F.col("event_id") * 37 % 5000).alias("nanos"), (F.col("event_type") == "signup").alias("registered"))
    return ledger.encode_statistics(d, 60)


# hashing and caching


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, concat(sha256(coalesce(text, '')), '-q4sv2') AS key FROM documents")
def content_keys(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), cache.content_key(F.col("text"), Config.of(spark).quality).alias("key"))


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS encoded FROM documents")
def content_dedup(spark, sf_dir):
    d = fx.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("hash", F.sha2("text", 256))
    return cache.encoded_once(d, lambda x: x.select("hash", F.length("text").alias("encoded")), ["hash"]).select("doc_id", "encoded")


@query(
    _with(fx.CACHE_SQL)
    + """ SELECT entry_id, sum(size) OVER (ORDER BY last_access DESC, entry_id DESC ROWS UNBOUNDED PRECEDING) <= 400000 AS kept FROM cache WHERE format IN ('bc1', 'bc7')
  UNION ALL SELECT entry_id, NOT (format = 'tmp' AND last_access < 900 - 500) FROM cache WHERE format NOT IN ('bc1', 'bc7')"""
)
def cache_lru_keep(spark, sf_dir):
    return cache.kept_after_prune(fx.cache_entries(spark, sf_dir), 400_000, now=900, stale=500)


@query(_with(fx.CACHE_SQL) + " SELECT entry_id FROM cache WHERE key NOT IN (SELECT key FROM cache WHERE entry_id % 10 = 0)")
def cache_invalidate(spark, sf_dir):
    entries = fx.cache_entries(spark, sf_dir)
    return cache.invalidated(entries, entries.filter("entry_id % 10 = 0").select("key")).select("entry_id")


@query("SELECT user_id AS key, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC, key LIMIT 64")
def lru_contents(spark, sf_dir):
    return cache.lru_contents(fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")), 64)


@query(
    """WITH a AS (SELECT user_id AS key, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
  SELECT a.seq, a.key, coalesce(a.prev IS NOT NULL AND count(DISTINCT b.key) < 40, FALSE) AS hit FROM a LEFT JOIN a b ON b.seq > a.prev AND b.seq < a.seq GROUP BY a.seq, a.key, a.prev"""
)
def lru_hits(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    return cache.lru_hits(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")), 40)


# animation


@query(
    _with(fx.TICK_SQL)
    + """ SELECT sprite_id, tick, CAST(frame % row_size AS INTEGER) AS col, CAST(frame // row_size AS INTEGER) AS row, CAST((frame + 1) % frames % row_size AS INTEGER) AS next_col,
  CAST((frame + 1) % frames // row_size AS INTEGER) AS next_row, CAST(CASE WHEN interpolated THEN floor(sub_frame * 1000.0::DOUBLE / frame_time) / 1000 ELSE 0 END AS FLOAT) AS progress, interpolated FROM tick"""
)
def frame_cursor(spark, sf_dir):
    return animation.cursor(fx.frame_ticks(spark, sf_dir))


@query(_with(fx.TICK_SQL) + " SELECT sprite_id, tick FROM (SELECT *, lag(frame) OVER (PARTITION BY sprite_id ORDER BY tick) AS before FROM tick) WHERE interpolated OR before IS NULL OR before <> frame")
def frame_redraw(spark, sf_dir):
    return animation.redraws(fx.frame_ticks(spark, sf_dir)).select("sprite_id", "tick")


_BLEND = ", ".join(
    f"CAST(greatest(0, least(255, floor(((p.{c} / 256.0)::FLOAT * (1::FLOAT - 0.25::FLOAT) + (q.{c} / 256.0)::FLOAT * 0.25::FLOAT) * 255::FLOAT + 0.5::FLOAT))) AS INTEGER) AS {c}" for c in "rgba"
)


@query(_with(fx.PIXEL_SQL) + f" SELECT p.image_id, p.x, p.y, {_BLEND} FROM pixel p JOIN pixel q ON q.image_id = p.image_id + 1 AND q.x = p.x AND q.y = p.y")
def frame_blend(spark, sf_dir):
    p = fx.pixels(spark, sf_dir).select("image_id", "x", "y", *image.CHANNELS)
    q = p.select((F.col("image_id") - 1).alias("image_id"), "x", "y", *[F.col(c).alias(f"{c}2") for c in image.CHANNELS])
    one = lambda c: (F.col(c) / 256.0).cast("float")
    share = F.lit(0.25).cast("float")
    return p.join(q, ["image_id", "x", "y"]).select("image_id", "x", "y", *[animation.blended(one(c), one(f"{c}2"), share).alias(c) for c in image.CHANNELS])


@query(
    """SELECT p_partkey AS i, CAST(greatest(0, least(15, floor(((p_partkey % 20 + 0.5::DOUBLE) / 20 + 0.125::DOUBLE * (2 * ((p_partkey % 20 + 0.5::DOUBLE) / 20) - 1)) * 16))) AS INTEGER) AS texel FROM part"""
)
def padded_lookup(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("i"), animation.padded_lookup(F.col("p_partkey") % 20, F.lit(20), F.lit(0.125), F.lit(16)).alias("texel"))


@query(
    _with(fx.RECT_SQL)
    + """, own AS (SELECT atlas_id, rect_id, max(CASE WHEN (w >> l) > 0 AND (h >> l) > 0 AND (((x >> l) | (y >> l) | (w >> l) | (h >> l)) & 3) = 0 THEN l ELSE 0 END) AS l
    FROM rect, (SELECT CAST(i AS INTEGER) AS l FROM range(5) t(i)) GROUP BY ALL)
  SELECT atlas_id, min(l) AS aligned_level FROM own GROUP BY atlas_id"""
)
def aligned_levels(spark, sf_dir):
    return animation.aligned_level(fx.rects(spark, sf_dir), 4)


_RETAINED = "lv AS (SELECT DISTINCT p_partkey % 40 AS atlas_id, CAST(p_partkey % 40 % 3 AS INTEGER) AS aligned_level, CAST(p_partkey // 40 * (p_partkey % 40 % 6 + 1) % 12 AS INTEGER) AS level FROM part)"


@query(
    _with(_RETAINED)
    + """ SELECT atlas_id, CAST(coalesce(max(level) FILTER (WHERE level = aligned_level + n), max(aligned_level)) AS INTEGER) AS last_level
  FROM (SELECT *, CASE WHEN level > aligned_level THEN row_number() OVER (PARTITION BY atlas_id, level > aligned_level ORDER BY level) END AS n FROM lv) GROUP BY atlas_id"""
)
def retained_levels(spark, sf_dir):
    p = fx.read(spark, sf_dir, "part")
    # multiples of 1 to 6 modulo 12: what levels an atlas lacks depends on its number
    lv = p.selectExpr("p_partkey % 40 as atlas_id", "cast(p_partkey % 40 % 3 as int) as aligned_level", "cast(p_partkey div 40 * (p_partkey % 40 % 6 + 1) % 12 as int) as level").distinct()
    return animation.retained_levels(lv)


@query(
    _with(fx.RECT_SQL)
    + """ SELECT atlas_id, rect_id, CAST(x // 4 * 4 AS INTEGER) AS x, CAST(y // 4 * 4 AS INTEGER) AS y, CAST(least(250, (x + w + 3) // 4 * 4) - x // 4 * 4 AS INTEGER) AS w, CAST(least(150, (y + h + 3) // 4 * 4) - y // 4 * 4 AS INTEGER) AS h
  FROM rect WHERE least(250, (x + w + 3) // 4 * 4) > x // 4 * 4 AND least(150, (y + h + 3) // 4 * 4) > y // 4 * 4"""
)
def patch_rects(spark, sf_dir):
    return animation.patch_rects(fx.rects(spark, sf_dir), 250, 150)


@query(_with(fx.TICK_SQL) + " SELECT sprite_id, frame, min(tick) AS tick FROM tick GROUP BY sprite_id, frame")
def keyframes(spark, sf_dir):
    return animation.keyframes(fx.frame_ticks(spark, sf_dir))


@query(
    _with(fx.TICK_SQL)
    + """, e AS (SELECT sprite_id, frame, min(tick) AS blocks, count(*) % 3 AS version FROM tick GROUP BY sprite_id, frame),
  r AS (SELECT sprite_id, frame, blocks + 1000000 AS blocks, CAST(frame % 3 AS BIGINT) AS version FROM e)
  SELECT e.sprite_id, e.frame, CASE WHEN r.blocks IS NULL THEN e.version ELSE e.version + 1 END AS version, coalesce(r.blocks, e.blocks) AS blocks FROM e LEFT JOIN r USING (sprite_id, frame, version)"""
)
def quality_upgrade(spark, sf_dir):
    e = fx.frame_ticks(spark, sf_dir).groupBy("sprite_id", "frame").agg(F.min("tick").alias("blocks"), (F.count("*") % 3).alias("version"))
    r = e.select("sprite_id", "frame", (F.col("frame") % 3).cast("long").alias("version"), (F.col("blocks") + 1000000).alias("blocks"))
    return animation.upgraded(e, r)


@query("""SELECT user_id AS atlas, count(*) FILTER (WHERE event_type = 'signup') AS registrations FROM events GROUP BY user_id HAVING arg_max(event_type = 'signup', event_id)""")
def registrations(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("atlas"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("register"))
    return animation.registered(e)


@query(
    """SELECT user_id AS atlas, least(min(event_id) + 200, 6000) AS settled_at FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events)
  WHERE gap IS NULL OR gap > 200 GROUP BY user_id"""
)
def settling(spark, sf_dir):
    return animation.settled(fx.read(spark, sf_dir, "events").select(F.col("user_id").alias("atlas"), F.col("event_id").alias("tick")))


_WORK = """work AS (SELECT user_id AS atlas, event_id AS tick, event_id + CASE WHEN event_type = 'click' THEN event_id % 7 * 90 ELSE 0 END AS until, CASE WHEN event_type = 'signup' THEN event_id END AS seen FROM events),
run AS (SELECT atlas, max(until) OVER (PARTITION BY atlas ORDER BY tick) AS busy, lead(tick) OVER (PARTITION BY atlas ORDER BY tick) AS next, max(seen) OVER (PARTITION BY atlas) AS seen FROM work)"""


@query(_with(_WORK) + " SELECT atlas, least(min(CASE WHEN seen IS NOT NULL AND (next IS NULL OR next > greatest(busy + 200, seen)) THEN greatest(busy + 200, seen) END), 6000) AS settled_at FROM run GROUP BY atlas")
def settling_pending(spark, sf_dir):
    """Settled atlases where clicks leave work pending and a signup is the target to be seen."""
    e = fx.read(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    return animation.settled(e.select(F.col("user_id").alias("atlas"), n.alias("tick"), (n + F.when(kind == "click", n % 7 * 90).otherwise(0)).alias("until"), F.when(kind == "signup", n).alias("seen")))


def _streamed(spark, sf_dir, name, build, mode: str) -> DataFrame:
    """Run a stream over a table's files to its end and read what it wrote."""
    folder = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(fx.read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")
    out = build(source)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{folder}/out")

    run = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return spark.read.schema(T.StructType([*out.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(f"{folder}/out")


class _Stream:
    """Lets fixtures read a stream in place of a table."""

    def __init__(self, source: DataFrame):
        self.read = self
        self.parquet = lambda _: source


@query(SQL["frame_redraw"])
def stream_redraw(spark, sf_dir):
    out = _streamed(spark, sf_dir, "events", lambda s: animation.redraw_stream(fx.frame_ticks(_Stream(s), "")), "append")
    return out.select("sprite_id", "tick")


@query(SQL["keyframes"])
def stream_keyframes(spark, sf_dir):
    return _streamed(spark, sf_dir, "events", lambda s: animation.keyframe_stream(fx.frame_ticks(_Stream(s), "")), "append").drop("epoch")


@query(SQL["ledger_latest"])
def stream_ledger(spark, sf_dir):
    out = _streamed(spark, sf_dir, "events", lambda s: animation.ledger_stream(fx.ledger_events(_Stream(s), "")), "update")
    last = out.groupBy("atlas").agg(F.max_by("bytes", F.struct("epoch", "ts_ns", "event_id")).alias("bytes"))
    return last.filter("bytes > 0")


@query(
    _with(
        fx.TICK_SQL,
        """change AS (SELECT sprite_id, frame, list({'tick': tick, 'version': CAST(CASE WHEN tick % 3 = 0 THEN -1 ELSE tick % 4 END AS BIGINT), 'blocks': tick} ORDER BY tick) AS c FROM tick GROUP BY sprite_id, frame)""",
        """done AS (SELECT sprite_id, frame, list_reduce(c, lambda s, x: CASE WHEN x.version = -1 OR x.version = s.version THEN {'tick': x.tick, 'version': s.version + 1, 'blocks': x.blocks} ELSE s END,
      {'tick': CAST(-1 AS BIGINT), 'version': CAST(0 AS BIGINT), 'blocks': CAST(-1 AS BIGINT)}) AS s FROM change)""",
    )
    + " SELECT sprite_id, frame, s.version AS version, s.blocks AS blocks FROM done WHERE s.version > 0"
)
def stream_upgrade(spark, sf_dir):
    """Fast results, and better ones that replace an entry only in the version they were made for, as a stream."""

    def build(source):
        t = fx.frame_ticks(_Stream(source), "")
        made = F.when(F.col("tick") % 3 != 0, F.col("tick") % 4)
        return animation.upgrade_stream(t.select("sprite_id", "frame", "tick", F.col("tick").alias("blocks"), made.alias("made_for")))

    out = _streamed(spark, sf_dir, "events", build, "update")
    last = out.groupBy("sprite_id", "frame").agg(F.max_by(F.struct("version", "blocks"), "version").alias("s"))
    return last.select("sprite_id", "frame", "s.*")

"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into fixed-size byte blocks. The distinct blocks are sorted and
numbered; a document is then a string of numbers. Adjacent numbers are paired, the
distinct pairs sorted and numbered again, until one number is left: two texts have the
same length in blocks and the same last number exactly when they are identical.

A block travels once, to the dictionary, after map-side distinct. It is ordered and
looked up by a 64-bit hash there; where two different blocks share a hash (counted for
every hash), the blocks themselves decide, so that no collision can merge two texts.

Only the block dictionary moves texts; all later rounds move numbers, and only of
documents longer than a block. Copies are counted with partial aggregation; joins back
to rows are sort-merge joins whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, spread, text_of

BLOCK_BYTES = 4096


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int, hashed) -> DataFrame:
    """(uid, id, sha, blocks, i, h, block): a row for each block; an empty text has one empty block."""
    base = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).alias("id"),
        text_of(text_col).cast("binary").alias("bytes"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int")
    base = base.select("uid", "id", "bytes", F.sha2("bytes", 256).alias("sha"), count.alias("blocks"))
    cells = base.select("uid", "id", "sha", "blocks", "bytes", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    piece = F.expr(f"substring(bytes, i * {block} + 1, {block})")
    cells = cells.select("uid", "id", "sha", "blocks", "i", piece.alias("block"))
    return cells.withColumn("h", hashed(F.col("block")))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort distinct rows by keys over range partitions and number them from 1, once and for all."""
    ordered = distinct.repartitionByRange(spread(distinct), *keys).sortWithinPartitions(*keys)
    return cut(ordered.withColumn("name", F.monotonically_increasing_id() + 1))


def name_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK_BYTES,
    hashed=lambda c: F.xxhash64(c),
) -> DataFrame:
    """(uid, id, sha, blocks, name): equal (blocks, name) exactly for equal texts.

    hashed: the hash by which blocks are ordered and looked up; any function gives the
    same classes.
    """
    cells = _blocks(docs, id_col, text_col, block, hashed)
    distinct = cells.select("h", "block").distinct()
    names = _numbered(distinct.groupBy("h").agg(F.count("*").alias("texts")), ["h"])
    light = cells.select("uid", "id", F.when(F.col("i") == 0, F.col("sha")).alias("sha"), "blocks", "i", "h")
    level = light.join(names.filter("texts = 1").select("h", "name"), "h").drop("h")
    shared = names.filter("texts > 1").select("h")
    if not shared.isEmpty():
        # different blocks with one hash: ranked among themselves, numbered below zero
        ranked = distinct.join(shared, "h").withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("block")))
        own = _numbered(ranked.select("h", "rank", "block"), ["h", "rank"]).select("h", "block", (-F.col("name")).alias("name"))
        rest = cells.join(own, ["h", "block"])
        level = level.unionByName(rest.select("uid", "id", F.when(F.col("i") == 0, F.col("sha")).alias("sha"), "blocks", "i", "name"))
    level = cut(level.select("uid", "id", "sha", "blocks", "i", "name"))

    done = level.filter("blocks = 1").select("uid", "id", "sha", "blocks", "name")
    open_ = level.filter("blocks > 1").withColumn("left", F.col("blocks"))
    most = open_.agg(F.max("left")).first()[0] or 1
    while most > 1:
        pairs = open_.groupBy("uid", "id", "blocks", "left", F.expr("i div 2").cast("int").alias("i")).agg(
            F.max("sha").alias("sha"),
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"),
        )
        pair_names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        named = pairs.join(pair_names, ["a", "b"]).withColumn("left", F.expr("cast(ceil(left / 2) as int)"))
        named = cut(named.select("uid", "id", "sha", "blocks", "left", "i", "name"))
        done = done.unionByName(named.filter("left = 1").select("uid", "id", "sha", "blocks", "name"))
        open_ = named.filter("left > 1")
        most = (most + 1) // 2
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES, **how) -> DataFrame:
    """One row per row of docs: uid, doc_id, keep_id, group_size, kept, text_sha256.

    Of identical texts the row with the largest id stays. A null text counts as empty;
    empty texts form one class. A null id sorts below all others; of rows with equal ids
    and texts the one that comes last in the table stays, so every class keeps exactly
    one row. keep_id is the id of the row that stays. Only id_col and text_col are read,
    so further columns never clash. An empty table gives an empty result.
    """
    named = name_documents(docs, id_col, text_col, block, **how)
    groups = named.groupBy("blocks", "name").agg(
        F.max(F.struct("id", "uid")).alias("keep"), F.count("*").alias("group_size")
    )
    # an exchange of its own on either side, so that adaptive execution may split a large group
    rows = named.join(groups.hint("rebalance"), ["blocks", "name"])
    return rows.select(
        "uid",
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("keep.uid") == F.col("uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, all columns unchanged.

    docs must be stable when read twice (a file scan is): rows are matched by their place.
    """
    uid = free_name(docs, "uid")
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("uid").alias(uid))
    return docs.withColumn(uid, F.monotonically_increasing_id()).join(kept, uid, "left_semi").drop(uid)


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

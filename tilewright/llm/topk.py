"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers. A block of candidates is held as postings: for each dimension the
rows that are not zero there, with their weights. A block of queries walks the dimensions;
each scatters its weighted postings into a dense array of scores. A partition selection
keeps the best few of a block, these are merged over the blocks of a task, and a window
over queries merges the tasks. Queries are turned into sparse rows once a task, candidates
into postings once a block.

Candidates are never shuffled. Queries go to the executors a chunk at a time, at most
CHUNK_QUERIES or QUERY_BYTES each, whatever their number; every chunk is one pass over the
candidates, and its answers are written before the next one starts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, trimmed

CHUNK_QUERIES, QUERY_BYTES = 65536, 64 << 20
QUERY_BLOCK = 64
CANDIDATE_BLOCK = 4096
SCALE = 256
LARGEST = 2**63 - 1


def _whole(col: str) -> Column:
    """No null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(col).isNotNull() & F.forall(col, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(uid, id, v): the vectors that take part, as integers."""
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    whole = rows.filter(_whole("v") & F.col("id").isNotNull())
    return whole.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows as one array; shorter ones end in zeros, components beyond width meet zeros only."""
    out = np.zeros((len(rows), width), np.int64)
    for k, v in enumerate(rows):
        out[k, : min(len(v), width)] = v[:width]
    return out


def terms(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By dimension, the rows that are not zero there, with their weights: postings, or what queries ask for."""
    at = [np.flatnonzero(column) for column in rows.T]
    return [(k, rows[k, d]) for d, k in enumerate(at)]


def accumulate(asked: list, postings: list, shape: tuple[int, int]) -> np.ndarray:
    """Scores of a block of queries against a block of candidates, one term after the other; sums beyond 64 bits stay at their ends."""
    most = lambda side: max((int(np.abs(w).max()) for _, w in side if w.size), default=0)
    exact = max(1, len(asked)) * most(asked) * most(postings) < 2**62
    scores = np.zeros(shape, np.int64 if exact else object)
    for (asking, weight), (posting, value) in zip(asked, postings, strict=True):
        if not asking.size or not posting.size:
            continue
        part = np.outer(weight, value) if exact else np.outer(weight.astype(object), value.astype(object))
        if part.size == scores.size:
            scores += part
        else:
            scores[np.ix_(asking, posting)] += part
    return scores if exact else np.clip(scores, -LARGEST, LARGEST).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row, the places of the k highest scores, ties to smaller ids; in no order."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((np.arange(len(ids)), ids))] = np.arange(len(ids))[::-1]
    if np.abs(scores).max() < 2**62 // len(ids):
        return np.argpartition(scores * len(ids) + rank, -k, axis=1)[:, -k:]
    return np.stack([np.lexsort((rank, row))[-k:] for row in scores])


def _search(q_uids: np.ndarray, q: np.ndarray, k: int, block: int):
    width = q.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(q)
        asked = [(s, terms(q[s : s + QUERY_BLOCK])) for s in range(0, n, QUERY_BLOCK)]
        row_of = {u: i for i, u in enumerate(q_uids.tolist())}
        uids, ids, scores = np.full((n, 0), -1, np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        for batch in batches:
            for at in range(0, len(batch), block):
                part = batch.iloc[at : at + block]
                c_uids, c_ids = part["uid"].to_numpy(np.int64), part["id"].to_numpy(np.int64)
                postings = terms(_matrix(part["v"].tolist(), width))
                own = {row_of[u]: j for j, u in enumerate(c_uids.tolist()) if u in row_of}  # by query, its own place here
                new = [[], [], []]
                for s, block_asked in asked:
                    rows = min(QUERY_BLOCK, n - s)
                    got = accumulate(block_asked, postings, (rows, len(c_ids)))
                    places = best(got, c_ids, min(k + 1, len(c_ids)))  # one more: the query itself may be there
                    top = np.take_along_axis(got, places, 1)
                    taken = c_uids[places]
                    for i in range(rows):
                        if s + i in own:
                            taken[i][places[i] == own[s + i]] = -1
                    for out, x in zip(new, (taken, c_ids[places], top), strict=True):
                        out.append(x)
                uids, ids, scores = (np.concatenate([old, np.concatenate(x)], 1) for old, x in zip((uids, ids, scores), new, strict=True))
                # merge: best first, absent places last
                order = np.lexsort((uids, ids, -scores, uids < 0), axis=1)[:, :k]
                uids, ids, scores = (np.take_along_axis(x, order, 1) for x in (uids, ids, scores))
        there = uids >= 0
        yield pd.DataFrame({"query_uid": np.repeat(q_uids, there.sum(1)), "uid": uids[there], "vec_id": ids[there], "score": scores[there]})

    return run


def exact_top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    chunk: int = CHUNK_QUERIES,
    block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner products.

    queries: a condition on the column "id" that marks the query rows. Every row but the
    query's own is a candidate, also one with the same id or vector. Ties go to the
    smaller id, then to the row that comes first. Rows whose id or vector is null, or that
    hold null or non-finite components, take no part. Vectors of unequal length are as if
    filled up with zeros. Without queries or candidates the result is empty. Components
    beyond 64 bits when scaled, and scores beyond them, count as the largest or smallest
    such number. Further columns are not read. vectors must be stable when read twice (a
    file scan is).
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = rows.filter(queries)
    many = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = many["width"] or 0
    chunks = max(1, -(-many["n"] // max(1, min(chunk, QUERY_BYTES // (8 * max(1, width))))))
    folder = f"{ensure_checkpoint_dir(spark)}/top-k-{uuid.uuid4().hex}"
    for c in range(chunks):
        q = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(chunks)) == c).toPandas()
        if not len(q):
            continue
        q = q.sort_values("uid")
        names = spark.createDataFrame(q[["uid", "id"]].astype("int64").rename(columns={"uid": "query_uid", "id": "query_id"}), "query_uid long, query_id long")
        run = _search(q["uid"].to_numpy(np.int64), _matrix(q["v"].tolist(), width), k, block)
        part = rows.mapInPandas(trimmed(run), "query_uid long, uid long, vec_id long, score long")
        order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
        ranked = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = ranked.join(names, "query_uid").select("query_id", "rank", "vec_id", "score")
        if chunks == 1:
            return found
        found.write.mode("append").parquet(folder)  # the driver holds one chunk at a time
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(folder) if many["n"] else spark.createDataFrame([], schema)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, unnest(e) AS w, generate_subscripts(e, 1) AS d FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, unnest(e) AS w, generate_subscripts(e, 1) AS d FROM v),
s AS (SELECT query_id, vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
      FROM q JOIN c ON q.d = c.d AND query_id <> vec_id GROUP BY query_id, vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

import hashlib
import random

import numpy as np
import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from tilewright.llm import lpf_dedup, queries, topk


def test_top_k_against_sql(spark):
    same(spark, SF, "op4", queries.op4_exact_top_k, topk.OP4_SQL)


@pytest.mark.parametrize("how", [{}, {"chunk": 3, "block": 7}, {"k": 1}, {"k": 1000}])
def test_top_k_against_brute_force(stored, how):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.choice([-1, -0.5, 0, 0.25, 1], 6)]) for i in rng.permutation(120)]
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (504, []), (505, [1.0]), (550, [1.0] * 9), (3, [1.0] * 6), (100, [0.0] * 6)]
    df = stored(rows, "vec_id long, embedding array<double>", clash=False).selectExpr("*", "1 as uid", "2 as id", "3 as score", "4 as v")
    k = how.get("k", 5)
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("id") % 50 == 0, **how).collect()))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(whole):
        if i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(whole) if m != n)[:k]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    assert got == sorted(want)


def test_top_k_holds_one_chunk(stored, monkeypatch):
    rows = [(k, [float(k % 7), 1.0]) for k in range(40)]
    df = stored(rows, "vec_id long, embedding array<double>", clash=False)
    whole = sorted(map(tuple, topk.exact_top_k(df, F.col("id") % 2 == 0).collect()))
    monkeypatch.setattr(topk, "QUERY_BYTES", 3 * 2 * 8)  # three queries a chunk
    found = topk.exact_top_k(df, F.col("id") % 2 == 0)
    plan = found._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Union" not in plan  # chunks are written; nothing of them is left to run
    assert sorted(map(tuple, found.collect())) == whole and len(whole) == 100


def test_top_k_of_huge_components(stored):
    rows = [(0, [1e16, 1.0]), (1, [1e15, 1.0]), (2, [-1e16, 0.0]), (3, [1e300, 0.0]), (4, [2.0, 3.0])]
    df = stored(rows, "vec_id long, embedding array<double>", clash=False)
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("id") == 0).collect())
    most = 2**63 - 1
    assert got == [(1, 1, most), (2, 3, most), (3, 4, 256 * 10**16 * 512 + 256 * 768 if 256 * 10**16 * 512 < most else most), (4, 2, -most)]


def test_top_k_empty(stored):
    df = stored([(7, [1.0])], "vec_id long, embedding array<double>", clash=False)
    assert topk.exact_top_k(df, F.col("id") % 50 == 0).count() == 0
    assert topk.exact_top_k(df, F.col("id") > 0).count() == 0
    assert topk.exact_top_k(df.limit(0), F.col("id") > 0).count() == 0


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((str(rows[k][0]), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    common = ["".join(rng.choices("abcd efgh", k=rng.randint(30, 260))) for _ in range(10)]

    def one():
        parts = [rng.choice([rng.choice(common), rng.choice(common)[10:150], "".join(rng.choices("xyzw uvé", k=rng.randint(0, 80)))]) for _ in range(rng.randint(0, 7))]
        return "".join(parts)

    return [(k, one()) for k in range(n)] + [(400, None), (401, ""), (402, "a" * 1000), (403, "ab" * 400), (404, "q" * 99), (405, "q" * 100), (406, "é" * 120)]


@pytest.mark.parametrize("how", [{}, {"forms": 1}, {"frequent": 2}, {"held": 50}, {"length": 20, "gram": 8}])
def test_passages_against_brute_force(stored, how):
    rows = texts()
    got = lpf_dedup.remove_repeats(stored(rows), **how).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, how.get("length", 100))


def test_passages_in_parts_of_long_texts(spark, monkeypatch):
    import pyarrow as pa

    rows = texts(8, 20)
    blob = pa.array(["".join(t or "" for _, t in rows), "short", "", "".join(t or "" for _, t in rows)[50:]])

    def strings(size):
        out = []
        for numbers, data, starts, stops, offset in lpf_dedup.slices(blob, 100, size):
            s = lpf_dedup.Slice(data, starts, stops)
            if s.first.size:
                at, a, b = s.strings(np.arange(s.first.size))
                owner = np.searchsorted(starts, at, "right") - 1
                out += list(zip(numbers[owner].tolist(), (at - starts[owner] + offset).tolist(), a.tolist(), b.tolist()))
        return sorted(out)

    assert strings(300) == strings(1 << 20)


def test_passages_with_null_and_repeated_ids(edges, empty, stored):
    got = lpf_dedup.remove_repeats(edges).collect()
    assert len(got) == 15
    long = "This sentence is said more than once, and it is long enough to be seen as a passage of a hundred bytes or so."
    twice = lpf_dedup.remove_repeats(stored([(1, long), (1, long), (None, long)], parts=1), texts=True).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in twice) == [("1", len(long)), ("1", len(long)), ("None", 0)]
    assert {bytes(r.kept) for r in twice} == {b"", long.encode()}
    assert lpf_dedup.remove_repeats(empty).count() == 0


def test_suffix_order_and_previous_factors():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    text = data.tobytes()
    for length in (1, 5, 8, 9, 16, 20):
        at = np.arange(400 - length + 1)
        order, ranks = lpf_dedup.truncated_suffix_order(data, at, length)
        parts = [text[p : p + length] for p in at]
        assert [parts[p] for p in order] == sorted(parts)
        position = rng.permutation(at.size)
        got = lpf_dedup.previous_factors(order, ranks, at, position)
        common = lambda p, q: next((k for k in range(length) if parts[p][k] != parts[q][k]), length)
        want = np.array([max((common(p, q) for q in at if position[q] < position[p]), default=0) for p in at])
        assert ((got >= length) == (want >= length)).all()
        assert (got <= want).all() and (got >= want - 7).all()  # shorter ones to within the eight bytes of a first rank


def test_previous_smaller():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 400):
        for p in (rng.permutation(n), np.arange(n), np.arange(n)[::-1]):
            want = [next((j for j in range(i - 1, -1, -1) if p[j] < p[i]), -1) for i in range(n)]
            assert lpf_dedup.previous_smaller(p).tolist() == want


def test_extents_are_named_by_two_hashes(monkeypatch):
    data = np.frombuffer(bytes(range(97, 117)) * 10 + b"x" + bytes(range(97, 117)) * 10, np.uint8)
    s = lpf_dedup.Slice(data, np.array([0]), np.array([data.size]))
    assert (s.form != s.twin).all()
    _, a, b = s.strings(np.arange(s.first.size))
    strings = {data[k : k + 100].tobytes() for k in range(data.size - 99)}
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(strings)
    # a collision of the first hash alone does not make two strings one
    records = tuple(np.array(x, t) for x, t in zip(([1, 1], [2, 2], [3, 4], [0, 1], [0, 0], [1, 1]), lpf_dedup._TYPES))
    assert lpf_dedup._firsts(records)[1].all()


def test_query(spark):
    from tilewright.llm.common import table

    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op10_passage_dedup(spark, SF).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows, 100)

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, same
from pyspark.sql import functions as F

from tilewright.llm import exact_dedup, jaccard_join, queries


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_against_sql(spark):
    same(spark, SF, "op1", queries.op1_exact_dedup, exact_dedup.OP1_SQL)


@pytest.mark.parametrize("how", [{}, {"block": 8}, {"block": 8, "hashed": lambda c: F.xxhash64(c) % 3}, {"hashed": lambda c: F.lit(1).cast("long")}])
def test_exact_edges_and_collisions(stored, how):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices("ab", k=rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 40, 41])))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (None, "ab"), (7, rows[7][1]), (7, rows[7][1]), (1002, "é" * 9), (1003, "é" * 9)]
    got = exact_dedup.exact_dedup(stored(rows), **how).collect()
    assert len(got) == len(rows)
    size = Counter(t or "" for _, t in rows)
    best = {}
    for i, t in rows:
        if i is not None:
            best[t or ""] = max(best.get(t or "", -(2**63)), i)
    by_sha = {sha(t): t for t in size}
    for r in got:
        t = by_sha[r.text_sha256]
        assert r.group_size == size[t] and r.keep_id == best.get(t)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(size)


def test_exact_edge_table_and_empty(edges, empty):
    got = exact_dedup.exact_dedup(edges).collect()
    assert len(got) == 15 and sum(r.kept for r in got) == 11
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_first_copies(edges)
    assert kept.count() == 11 and kept.columns == edges.columns


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(rows):
    s = sets_of(rows)
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if (not s[i] and not s[j]) or (s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j])):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


def linked_right(got, links, root):
    """Classes, and links: those of each row, or where pivots found some of a class, its other rows."""
    assert {i: got[i].class_id for i in got} == dict(enumerate(root))
    size = Counter(root)
    assert {i: got[i].n_links for i in got} == {i: links[i] if got[i].direct else size[root[i]] - 1 for i in got}
    assert all(len({got[i].direct for i in got if root[i] == c}) == 1 for c in size)


def corpus(seed=5, groups=12, copies=7):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for _ in range(groups):
        text = rng.choices(words, k=rng.randint(5, 200))
        for _ in range(rng.randint(1, copies)):
            t = list(text)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    for _ in range(15):  # one passage in all of these, and little else
        rows.append((len(rows), " ".join(rng.choices(words, k=10) + passage + rng.choices(words, k=10))))
    return rows + [(len(rows) + k, t) for k, t in enumerate([None, "", "  ", "one two", "one two", "two one", rows[0][1], rows[0][1].replace(" ", "\n")])]


@pytest.mark.parametrize("how", [{}, {"limit": 2, "tile": 3}, {"limit": 1}, {"tile": 2}])
def test_near_against_brute_force(stored, how):
    rows = corpus()
    links, root = brute(rows)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(stored(rows), **how).collect()}
    assert len(got) == len(rows)
    linked_right(got, links, root)
    assert {i for i in got if got[i].kept} == set(root)
    if "limit" not in how:
        assert all(r.direct for r in got.values())


def test_a_large_group_of_near_copies(stored):
    rng = random.Random(1)
    text = [f"a{k}" for k in range(120)]
    rows = []
    for k in range(150):
        t = list(text)
        t[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(t)))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(stored(rows), limit=16, tile=40).collect()}
    linked_right(got, *brute(rows))
    assert not any(r.direct for r in got.values())


def masks(rows):
    """Sets as rows of zeros and ones, and their sizes."""
    number = {}
    m = [[number.setdefault(x, len(number)) for x in s] for s in sets_of(rows)]
    out = np.zeros((len(rows), len(number)), np.float32)
    for i, x in enumerate(m):
        out[i, x] = 1
    return out, out.sum(1)


def brute_fast(rows):
    m, size = masks(rows)
    common = m @ m.T
    linked = 10 * common >= 8 * (size[:, None] + size[None] - common)
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(rows)).min(1))
        if (new == label).all():
            return linked.sum(1).tolist(), label.tolist()
        label = new


def test_pivots_lose_no_link_of_5000_near_copies(stored):
    """Near copies of one text, some of them far from each other, a chain away from it, a second group that one text bridges, and a passage in all."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(14)]
    texts = []
    for name, n in (("a", 4000), ("b", 1000)):
        base = [f"{name}{k}" for k in range(70)]
        for _ in range(n):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 1, 2, 2, 3])):
                t[rng.randrange(70)] = f"x{rng.randrange(10**6)}"
            texts.append(passage + t)
    t = list(texts[0])
    for k in range(0, 60, 5):  # each step is linked to the last
        t = t[:14] + [f"y{k + i}" if k <= i < k + 5 else w for i, w in enumerate(t[14:])]
        texts.append(t)
    texts += [passage + rng.choices([f"z{k}" for k in range(5000)], k=rng.randint(20, 90)) for _ in range(1500)]
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(stored(rows, parts=6)).collect()}
    links, root = brute_fast(rows)
    linked_right(got, links, root)
    assert not all(r.direct for r in got.values()) and any(r.direct and r.n_links for r in got.values())


def test_recall_through_splits(stored):
    """Pairs at the threshold in texts that share a passage, so that they meet only in leaves of split buckets."""
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(34)]
    rows = []
    for k in range(600):
        own = [f"w{k}.{i}" for i in range(90)]
        for other in (own, [*own[:-12], *[f"v{k}.{i}" for i in range(12)]]):  # 108 of 132 runs in common
            rows.append((len(rows), " ".join(passage + other)))
    got = jaccard_join.jaccard_join(stored(rows), limit=8).collect()
    links, root = brute_fast(rows)
    assert sum(links) == 1200 and sum(r.class_id == root[r.doc_id] for r in got) >= 0.99 * len(rows)
    assert all(r.n_links == links[r.doc_id] for r in got if r.direct and r.class_id == root[r.doc_id] and r.n_links)


def test_near_query(spark):
    from tilewright.llm.common import table

    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    links, root = brute(rows)
    got = {r.doc_id: r for r in queries.op3_jaccard_join(spark, SF).collect()}
    assert {i: (got[i].class_id, got[i].n_links) for i in got} == {i: (rows[r][0], n) for (i, _), r, n in zip(rows, root, links)}


def test_near_edges_and_empty(edges, empty):
    got = jaccard_join.jaccard_join(edges).collect()
    assert len(got) == 15 and sum(r.kept for r in got) == len({(r.class_id, r.n_links) for r in got if r.kept})
    assert sorted(r.n_links for r in got if r.doc_id in (1, 2)) == [2, 2, 2]
    assert sorted(r.n_links for r in got if r.doc_id in (3, 4, 5)) == [3, 3, 3]  # no words: one class with the null id's
    kept = jaccard_join.keep_one_of_each(edges)
    assert kept.columns == edges.columns and kept.count() == sum(r.kept for r in got)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_runs_reach_the_recall():
    assert jaccard_join.runs(0.99) < jaccard_join.runs(0.9999)
    rng = np.random.default_rng(2)
    met = 0
    for k in range(400):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[:267], rng.integers(0, 2**63, 33).astype(np.uint64)]))  # Jaccard 0.8
        n = jaccard_join.runs()
        x, y = (jaccard_join.chosen(s, jaccard_join._share(s.size, 0.8, 2.0), n) for s in (a, b))
        met += bool(np.intersect1d(x, y).size)
    assert met >= 399


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 300), (300, 250)], "a long, b long")
    assert {r.node: r.root for r in jaccard_join.connect(edges).collect()} == {k: 0 for k in range(101)} | {200: 200, 250: 200, 300: 200}
    assert jaccard_join.connect(edges.limit(0)).count() == 0


def short_texts(n, words_, differ, rng):
    """Texts of so many words around one phrase, of which some positions at the ends differ."""
    phrase = [f"p{k}" for k in range(words_)]
    rows = []
    for _ in range(n):
        t = list(phrase)
        for k in rng.sample(differ, rng.randint(0, len(differ))):
            t[k] = rng.choice(["", *[f"x{rng.randrange(40)}" for _ in range(3)]])
        rows.append(" ".join(w for w in t if w))
    return rows


@pytest.mark.parametrize("depth", [3, 4, 6])
def test_short_texts_around_a_frequent_phrase(stored, depth):
    rng = random.Random(depth)
    a8, a9 = [f"a{k}" for k in range(8)], [f"b{k}" for k in range(9)]
    texts = [" ".join(a8), " ".join([*a8, "z"]), " ".join(a9), " ".join([*a9, "z"]), " ".join(["y", *a9])]  # 4/5 and 5/6
    texts += [" ".join(rng.choices(a8, k=2) + a8) + f" q{k}" for k in range(20)] + [" ".join(a9) + f" r{k} s{k}" for k in range(20)]
    for n in range(5, 22):
        texts += short_texts(14, n, [0, 1, n - 2, n - 1], rng)
    texts += texts[:9]
    rows = list(enumerate(texts))
    links, root = brute(rows)
    # the hottest bucket holds about 100 sets or more; a lower limit makes for a deeper split
    limit = {3: 5, 4: 2, 6: 1}[depth]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(stored(rows), limit=limit).collect()}
    linked_right(got, links, root)


@pytest.mark.parametrize("size", [12, 13, 16, 24])
def test_sets_above_the_small_ones_meet_at_the_deepest_split(size):
    n, depth, missed = jaccard_join.runs(), jaccard_join.DEEPEST, 0
    for k in range(6):
        rng = np.random.default_rng(1000 * size + k)
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.sort(a[: -(-size * 4 // 5)])  # the least part with a Jaccard similarity of 0.8
        if b.size <= jaccard_join.small_size(0.8):
            b = a[:-1]
        below = []
        for s in (a, b):
            own = jaccard_join.chosen(s, jaccard_join._share(s.size, 0.8, 2.0), n)
            with np.errstate(over="ignore"):
                below.append({x for t in own.tolist() for x in jaccard_join.split(s, t, 0.8, 2.0, depth)})
        missed += not (below[0] & below[1])
    assert missed == 0


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9, 1.0])
def test_short_texts_at_other_similarities(stored, similarity):
    rng = random.Random(9)
    texts = [t for n in range(5, 24, 3) for t in short_texts(12, n, [0, 1, n - 1], rng)]
    rows = list(enumerate(texts))
    s = sets_of(rows)
    per_million = round(similarity * 1_000_000)
    links = {i: sum(i != j and len(a & b) * 1_000_000 >= per_million * len(a | b) for j, b in enumerate(s)) for i, a in enumerate(s)}
    got = jaccard_join.jaccard_join(stored(rows), similarity=similarity, limit=2).collect()
    size = Counter(r.class_id for r in got)
    assert {r.doc_id: r.n_links for r in got} == {r.doc_id: links[r.doc_id] if r.direct else size[r.class_id] - 1 for r in got}


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9, 1.0])
def test_linked_sets_choose_a_token_in_common_whatever_is_frequent(similarity):
    """No link is left to chance: also where all common tokens but one are frequent, or come last by hash."""
    rng = np.random.default_rng(3)
    none = np.zeros(0, np.uint64)
    for size in [12, 13, 40, 101, 300]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            common = -(-round(similarity * 1_000_000) * size // 1_000_000)
            last = a[np.argsort(jaccard_join.mix(a))][size - common :]  # the part whose hashes are the largest
            for b in (np.sort(last), np.sort(rng.permutation(a)[:common])):
                for frequent in (none, np.sort(b[1:]), np.sort(b)):
                    x, y = (jaccard_join.firsts(s, similarity, frequent) for s in (a, b))
                    assert np.intersect1d(x, y).size


def test_sketches_rule_out_only_what_cannot_be_by_chance():
    """A pair at the threshold has so few equal bins with a chance below DOUBT; five standard deviations were one in a million."""
    assert jaccard_join._alike(np.array([34, 30, 20]), np.array([64, 64, 64]), 0.8).all()
    assert not jaccard_join._alike(np.array([5]), np.array([64]), 0.8).any()


def test_no_link_is_lost_in_texts_that_share_a_passage(stored):
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(34)]
    rows = []
    for k in range(250):
        own = [f"w{k}.{i}" for i in range(90)]
        for other in (own, [*own[:-12], *[f"v{k}.{i}" for i in range(12)]]):
            rows.append((len(rows), " ".join(passage + other if rng.random() < 0.99 else other)))
    links, root = brute_fast(rows)
    linked_right({r.doc_id: r for r in jaccard_join.jaccard_join(stored(rows), limit=8).collect()}, links, root)


def test_frequent_tokens_come_last_before_any_set_is_moved(stored, monkeypatch):
    """A passage in more sets than the limit: sets choose once, where all memberships were moved again for each hot bucket found."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for _ in range(1500):
        own = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for other in (own, [*own[:-8], *[f"v{rng.randrange(10**6)}" for _ in range(8)]])[: rng.choice([1, 1, 2])]:
            rows.append((len(rows), " ".join(passage + other)))
    moved, shared = [], jaccard_join._Join.shared
    monkeypatch.setattr(jaccard_join._Join, "shared", lambda self, lists: moved.append(1) or shared(self, lists))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(stored(rows), limit=64).collect()}
    links, root = brute_fast(rows)
    linked_right(got, links, root)
    assert len(moved) == 1


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_frequent_tokens_of_a_sample(stored, most):
    """All tokens of a passage, none of the rest; of too many, the most frequent ones."""
    common, rare = [f"p{k}" for k in range(20)], [f"q{k}" for k in range(40)]
    rows = [(k, " ".join([*common, *(rare if k % 4 == 0 else []), *[f"w{k}.{i}" for i in range(30)]])) for k in range(800)]
    docs = stored(rows)
    tables = jaccard_join._Tables(docs.sparkSession)
    got = jaccard_join.frequent_tokens(docs.selectExpr("monotonically_increasing_id() uid", "text"), tables, 0.8, 5, 64, 4, most)
    tables.drop()
    of = lambda t: set(next(jaccard_join.shingle_sets(pa.array([" ".join(t)]))).tolist())
    assert (np.diff(got.astype(object)) > 0).all() and of(common) <= set(got.tolist())
    assert set(got.tolist()) & of(rare) == (of(rare) if most > 30 else set())
    assert not set(got.tolist()) & of([f"w5.{i}" for i in range(30)])

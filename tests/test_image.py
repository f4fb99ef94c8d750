import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.config import Config
from tilewright.functions import bc7
from tilewright.operators import bc1, cache, fingerprint, image, ledger
from tilewright.plans import compress


def frame(spark, array, image_id=0):
    h, w, _ = array.shape
    rows = [(image_id, w, h, x, y, *map(int, array[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, w int, h int, x int, y int, r int, g int, b int, a int")


def array_of(df, w, h):
    out = np.zeros((h, w, 4), int)
    for r in df.collect():
        out[r.y, r.x] = r.r, r.g, r.b, r.a
    return out


def halved(a):
    h, w, _ = a.shape
    out = np.zeros((max(h // 2, 1), max(w // 2, 1), 4), int)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            taps = [a[min(2 * y + j, h - 1), min(2 * x + i, w - 1)] for j in (0, 1) for i in (0, 1)]
            out[y, x] = (np.sum(taps, 0) + 2) // 4
    return out


@pytest.mark.parametrize("w,h", [(1, 1), (1, 7), (7, 1), (2, 2), (3, 5), (25, 20), (12, 10), (6, 5)])
def test_downsample(spark, w, h):
    a = np.random.default_rng(w * 31 + h).integers(0, 256, (h, w, 4))
    want = halved(a)
    assert (array_of(image.downsample(frame(spark, a)), want.shape[1], want.shape[0]) == want).all()


def test_chain_ends_at_one_texel(spark):
    a = np.random.default_rng(0).integers(0, 256, (6, 10, 4))
    chain = image.mip_chain(frame(spark, a), 9)
    assert [tuple(r) for r in chain.select("level", "w", "h").distinct().orderBy("level").collect()] == [(0, 10, 6), (1, 5, 3), (2, 2, 1), (3, 1, 1)]
    assert image.mip_chain(frame(spark, a), 0).count() == 60


def test_blocks_are_clamped_and_bleed_is_clipped(spark):
    a = np.random.default_rng(1).integers(0, 256, (5, 6, 4))
    a[..., 3] = np.where(a[..., 3] < 100, 0, 255)
    a[4, :, 3] = 0
    cells = {(r.by, r.bx): r.texels for r in image.blocks(frame(spark, a)).collect()}
    assert len(cells) == 4
    for (by, bx), texels in cells.items():
        assert [t.i for t in texels] == list(range(16))
        for t in texels:
            assert (t.r, t.g, t.b, t.a) == tuple(a[min(by * 4 + t.i // 4, 4), min(bx * 4 + t.i % 4, 5)])
    bled = array_of(image.bleed(frame(spark, a)), 6, 5)
    for y in range(5):
        for x in range(6):
            part = a[y // 4 * 4 : y // 4 * 4 + 4, x // 4 * 4 : x // 4 * 4 + 4].reshape(-1, 4)
            seen = part[part[:, 3] > 0]
            want = a[y, x, :3] if a[y, x, 3] else seen[:, :3].sum(0) // len(seen) if len(seen) else [0, 0, 0]
            assert list(bled[y, x]) == [*want, a[y, x, 3]]


def test_assembly_overlap_bounds_and_empty(spark):
    px = spark.createDataFrame([(k, x, 0, k, k, k, 255) for k in (1, 2, 3) for x in (0, 1)], "image_id long, x int, y int, r int, g int, b int, a int")
    s = spark.createDataFrame([(1, 1, 2, 1, 0, 0), (2, 2, 2, 1, 1, 0), (3, 3, 2, 1, 3, 0)], "sprite_id long, seq long, w int, h int, dest_x int, dest_y int")
    got = {(r.x, r.y): r.r for r in image.assemble(s, px, 4, 2).collect()}
    assert got == {(0, 0): 1, (1, 0): 2, (2, 0): 2, (3, 0): 0} | {(x, 1): 0 for x in range(4)}
    assert image.assemble(s.limit(0), px, 3, 1).count() == 3


def test_alpha_shapes(spark):
    px = spark.createDataFrame([(1, 255), (1, 255), (2, 0), (2, 255), (3, 0), (3, 7)], "image_id long, a int")
    assert {r.image_id: r.shape for r in image.alpha_shape(px).collect()} == {1: "FULLY_OPAQUE", 2: "PUNCH_THROUGH", 3: "BLENDED"}


def gradient(n=32):
    y, x = np.mgrid[0:n, 0:n]
    return np.stack([x * 255 // n, y * 255 // n, (x + y) * 127 // n, np.full_like(x, 255)], -1)


def test_bc1_flat_blocks_and_quality(spark):
    flat = np.zeros((4, 8, 4), int)
    flat[:, 4:] = 200, 100, 50, 255
    rows = {r.bx: r for r in bc1.encode(image.blocks(frame(spark, flat))).collect()}
    assert (rows[0].c0, rows[0].c1) == (1, 0)
    assert rows[1].c1 == rows[1].c0 - 1
    g = gradient()
    out = bc1.decode(bc1.encode(image.blocks(frame(spark, g))))
    q = image.psnr(frame(spark, g), out, ["image_id"]).first()
    assert q.psnr >= 28


def test_bc7_round_trip_quality(spark):
    g = gradient()
    g[..., 3] = np.where(np.add.outer(np.arange(32), np.arange(32)) % 5 == 0, 128, 255)
    cells = image.blocks(frame(spark, g))
    encoded = compress.encode_bc7(cells)
    q = image.psnr(frame(spark, g), compress.decode_bc7(encoded), ["image_id"]).first()
    assert q.texels == 1024 and q.psnr >= 28
    assert {r["mode"] for r in encoded.select("mode").distinct().collect()} <= {4, 5, 6}


def test_bc7_kernel_edges():
    same = np.full((2, 16, 4), 77, np.uint8)
    words, mode = bc7.encode(same)
    assert (mode == 6).all() and np.abs(bc7.decode(words).astype(int) - 77).max() <= 1
    noise = np.random.default_rng(2).integers(0, 256, (500, 16, 4)).astype(np.uint8)
    words, mode = bc7.encode(noise)
    err = ((bc7.decode(words).astype(float) - noise) ** 2).mean()
    assert 10 * np.log10(65025 / err) > 12
    alone, _ = bc7.encode(noise[:1])
    assert (alone[0] == words[0]).all()  # blocks do not depend on each other


def test_fingerprints_and_families_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 64))
    luma = np.concatenate([b + rng.normal(scale=0.05, size=(8, 64)) for b in base])
    fp = fingerprint.fingerprints_of(luma)
    assert all(bin(int(f)).count("1") == 31 for f in fp) and (fp >= 0).all()
    for near in (0, 3, 6, 12, 20):
        rows = [(i, bool(i % 2), int(f)) for i, f in enumerate(fp)] + [(100, False, int(fp[0]))]
        prints = spark.createDataFrame(rows, "id long, tinted boolean, fp long")
        want = {(a, b) for a, s, f in rows for b, t, g in rows if a < b and s == t and bin(f ^ g).count("1") <= near}
        assert {(r.a, r.b) for r in fingerprint.near_pairs(prints, near).collect()} == want
    root = {i: i for i, _, _ in rows}
    for _ in rows:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.sprite_id: r.family_id for r in fingerprint.families(prints, 20).collect()} == root


def test_admission_folds_in_order(spark):
    rows = [(1, 10, 60), (2, 11, 50), (1, 12, 45), (2, 13, 50), (3, 14, 6), (1, 15, 100)]
    df = spark.createDataFrame([(a, s, s, b) for a, s, b in rows], "atlas long, ts long, event_id long, bytes long")
    held, want = {}, {}
    for a, s, b in rows:
        want[s] = sum(held.values()) - held.get(a, 0) + b <= 100
        if want[s]:
            held[a] = b
    assert {r.event_id: r.admitted for r in ledger.admit(df, 100).collect()} == want


def test_prune_and_lru_match_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "bc7", int(rng.integers(1, 50)), int(t)) for i, t in enumerate(rng.permutation(60))]
    left = sorted(rows, key=lambda r: (r[3], r[0]))
    while sum(r[2] for r in left) > 500:
        left.pop(0)
    got = cache.kept_after_prune(spark.createDataFrame(rows, "entry_id long, format string, size long, last_access long"), 500)
    assert {r.entry_id for r in got.filter("kept").collect()} == {r[0] for r in left}
    uses = [(int(k), s) for s, k in enumerate(rng.integers(0, 12, 300))]
    df = spark.createDataFrame(uses, "key long, seq long")
    held, want = [], {}
    for k, s in uses:
        want[s] = k in held
        held = [x for x in held if x != k][-4:] + [k]
    assert {r.seq: r.hit for r in cache.lru_hits(df, 5).collect()} == want
    assert {r.key for r in cache.lru_contents(df, 5).collect()} == set(held)


def test_lru_over_many_ranges_and_admission_by_device(spark):
    rng = np.random.default_rng(12)
    uses = [(f"k{int(k)}", int(s)) for s, k in enumerate(rng.zipf(1.3, 3000) % 200)]
    df = spark.createDataFrame(uses, "key string, seq long").repartition(7)
    for capacity in (1, 5, 60):
        held, want = [], {}
        for k, s in uses:
            want[s] = k in held
            held = [x for x in held if x != k] + [k]
            held = held[-capacity:]
        assert {r.seq: r.hit for r in cache.lru_hits(df, capacity).collect()} == want
    rows = [(int(rng.integers(0, 9)), int(s) // 3, int(s), int(rng.integers(0, 60)), int(rng.integers(0, 4))) for s in rng.permutation(600)]
    df = spark.createDataFrame(rows, "atlas long, ts long, event_id long, bytes long, device long")
    held, want = {}, {}
    for atlas, _, event, size, device in sorted(rows, key=lambda r: (r[1], r[2])):
        own = held.setdefault(device, {})
        want[event] = sum(own.values()) - own.get(atlas, 0) + size <= 150
        if want[event]:
            own[atlas] = size
    assert {r.event_id: r.admitted for r in ledger.admit(df, 150, "device").collect()} == want


def test_near_pairs_meet_in_few_keys(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 62, 300)
    rows = [(k, bool(k % 2), int(b)) for k, b in enumerate(base)]
    for k in range(300):  # some that differ in up to eight bits
        flip = sum(1 << int(i) for i in rng.choice(63, int(rng.integers(0, 9)), replace=False))
        rows.append((1000 + k, bool(k % 2), int(base[k]) ^ flip))
    prints = spark.createDataFrame(rows, "id long, tinted boolean, fp long")
    for near in (0, 1, 6, 8, 9):
        want = {(a, b, bin(f ^ g).count("1")) for a, s, f in rows for b, t, g in rows if a < b and s == t and bin(f ^ g).count("1") <= near}
        got = [tuple(r) for r in fingerprint.near_pairs(prints, near).collect()]
        assert set(got) == want and len(got) == len(want)


def test_driver_encodes_each_content_once_and_stops_at_a_failure(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (10, 6, 4))
    df = frame(spark, a, 0).unionByName(frame(spark, a, 1)).unionByName(frame(spark, a[:, ::-1], 2)).unionByName(frame(spark, a, 3))
    strips = compress.packed_strips(df)
    assert strips.count() == 12 and {(r.strip, r.h) for r in strips.collect()} == {(0, 4), (1, 4), (2, 2)}
    broken = strips.withColumn("rgba", F.expr("if(image_id = 3 and strip = 1, substring(rgba, 1, 5), rgba)"))
    done = compress.driver(broken, None, 4).collect()
    assert {r.image_id for r in done} == {0, 1, 2} and all(r.source == "encoded" for r in done)
    whole = compress.compress_images(compress.packed_images(frame(spark, a, 0))).first().blocks
    for image_id in (0, 1):
        assert b"".join(r.blocks for r in sorted((r for r in done if r.image_id == image_id), key=lambda r: r.strip)) == whole
    stored = spark.createDataFrame([(r.key, r.w, r.h, r.blocks) for r in done if r.image_id == 0], "key string, w int, h int, blocks binary")
    again = compress.driver(strips, stored, 4).collect()
    assert {(r.image_id, r.source) for r in again} == {(0, "cache"), (1, "cache"), (2, "encoded"), (3, "cache")}
    assert all(r.source == "encoded" for r in compress.driver(strips, stored, 5).collect())  # another quality


def test_kernel_failures_cost_one_image(spark, monkeypatch):
    good = np.random.default_rng(3).integers(0, 256, (4, 4, 4))
    rows = compress.packed_images(frame(spark, good, 0).unionByName(frame(spark, good, 1)))
    together = {r.image_id: r.blocks for r in compress.compress_images(rows).collect()}
    refused = compress.compress_images(rows, "BC7", lambda t: None).collect()
    assert {r.image_id: r.blocks for r in refused} == together and all(r.reason == "second encoder" for r in refused)


def test_hidden_texels_weigh_less():
    rng = np.random.default_rng(5)
    x = np.zeros((200, 16, 4), np.uint8)
    x[..., :3] = 100 + rng.integers(0, 12, (200, 16, 1))
    x[..., 3] = 255
    x[:, ::3, :3] = rng.integers(0, 256, (200, 6, 3))
    x[:, ::3, 3] = 0  # hidden, of any colour
    out = bc7.decode(bc7.encode(x)[0]).astype(int)
    shown = x[..., 3] > 0
    assert np.abs(out[shown][:, :3] - x[shown][:, :3].astype(int)).mean() < 4


def test_settings_reach_the_plans(spark):
    from oracle import SF

    from tilewright import catalog

    spark.conf.set("spark.tilewright.disabled", "true")
    spark.conf.set("spark.tilewright.budget_mb", "300")
    try:
        assert catalog.queries()["format_routing"](spark, SF).count() == 0
        assert catalog.queries()["effective_budget"](spark, SF).filter("budget_mb = 300").count() > 0
    finally:
        spark.conf.unset("spark.tilewright.disabled")
        spark.conf.unset("spark.tilewright.budget_mb")


def test_settling_with_pending_work(spark):
    from tilewright.streaming import animation

    rows = [(1, 10, 10, None), (1, 100, 700, 50), (1, 950, 950, None), (2, 5, 5, None), (3, 1, 1, 400), (4, 7000, 7000, 7000)]
    df = spark.createDataFrame(rows, "atlas long, tick long, until long, seen long")
    assert {r.atlas: r.settled_at for r in animation.settled(df).collect()} == {1: 900, 2: 6000, 3: 400, 4: 6000}


def test_lookup_rejects_unsound_entries(spark):
    cols = "key string, format string, width int, height int, quality int, size long, declared long, last_access long"
    e = spark.createDataFrame([("a", "bc7", 4, 4, 4, 40, 16, 1), ("b", "bc7", 0, 4, 4, 40, 16, 1), ("c", "tmp", 4, 4, 4, 40, 16, 1), ("d", "bc7", 4, 4, 4, 24, 0, 1), ("e", "bc7", 4, 4, 4, 39, 16, 1)], cols)
    asked = e.select("key", "format", "width", "height", "quality").union(spark.createDataFrame([("a", "bc7", 4, 4, 5)], "key string, format string, width int, height int, quality int"))
    assert sorted((r.key, r.quality, r.hit) for r in cache.lookup(asked, e).collect()) == [("a", 4, True), ("a", 5, False), ("b", 4, False), ("c", 4, False), ("d", 4, False), ("e", 4, False)]


def test_psnr_infinite_and_hidden(spark):
    a = np.zeros((4, 4, 4), int)
    a[..., 3] = 255
    same = image.psnr(frame(spark, a), frame(spark, a), ["image_id"]).first()
    assert same.psnr == float("inf")
    hidden = a.copy()
    hidden[0, 0] = 9, 9, 9, 0
    assert image.psnr(frame(spark, hidden), frame(spark, a), ["image_id"]).first().texels == 15


def test_config_ranges(spark):
    assert Config().needs_reload(Config(quality=5)) and not Config().needs_reload(Config(budget_mb=300))
    with pytest.raises(ValueError):
        Config(quality=8)
    spark.conf.set("spark.tilewright.quality", "2")
    assert Config.of(spark).quality == 2
    spark.conf.unset("spark.tilewright.quality")


def test_pushdown_reads_only_needed_columns(spark):
    from oracle import SF

    from tilewright.sources import fixtures

    plan = fixtures.ledger_events(spark, SF).filter("atlas = 3").select("atlas", F.col("bytes"))._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan


def test_packed_compression_and_fallback(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 256, (6, 10, 4))
    a[..., 3] = np.where(a[..., 3] < 120, 0, 255)
    df = frame(spark, a)
    rows = compress.packed_images(df)
    for target, size in (("BC1", 8), ("BC7", 16)):
        own = compress.compress_images(rows, target).first()
        assert len(own.blocks) == 6 * size and own.reason is None

        def refuses(_):
            raise RuntimeError("no")

        second = compress.compress_images(rows, target, refuses).first()
        assert second.blocks == own.blocks and second.reason == "second encoder"
        assert compress.compress_images(rows, target, lambda t: b"x").first().blocks == b"x"
    by_expression = bc1.encode(image.blocks(image.bleed(df).withColumn("w", F.lit(10)).withColumn("h", F.lit(6)))).orderBy("by", "bx")
    want = b"".join((r.block % 2**64).to_bytes(8, "little") for r in by_expression.collect())
    assert compress.compress_images(rows, "BC1").first().blocks == want
    bad = rows.withColumn("w", F.lit(11)).first(), rows.withColumn("w", F.lit(0)).first()
    got = compress.compress_images(spark.createDataFrame([*bad, (3, None, 1, None)], "image_id long, w int, h int, rgba binary")).collect()
    assert [(r.blocks, r.reason) for r in got] == [(None, "invalid image")] * 3


def test_content_hash_by_hand():
    from tilewright.functions import content

    def plain(data, w, h, target):
        out = content.SEED ^ (w << 32 | h << 1 | target)
        words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data) // 8 * 8, 8)] + list(data[len(data) // 8 * 8 :])
        for word in words:
            out ^= word
            for shift, factor in ((30, content.FACTORS[0]), (27, content.FACTORS[1])):
                out = (out ^ out >> shift) * factor % 2**64
            out ^= out >> 31
        return out

    rng = np.random.default_rng(1)
    for w, h in ((1, 1), (2, 3), (3, 3), (8, 8)):
        x = rng.integers(0, 256, (5, w * h * 4)).astype(np.uint8)
        assert content.hashes(x, w, h, 1).tolist() == [plain(r.tobytes(), w, h, 1) for r in x]


def snake(n, seed=1):
    """(id, tinted, fp) with ids in no order: each number is within 6 bits of those beside it only."""
    rng = random.Random(seed)
    ids, fp, last, rows = rng.sample(range(n), n), 0, [], []
    for i in ids:
        rows.append((i, False, fp))
        flip = rng.sample([b for b in range(62) if b not in last], 6)
        fp ^= sum(1 << b for b in flip)
        last = (last + flip)[-42:]
    return rows


def test_families_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    from tilewright.operators import components

    made, settled = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df: made.append(settled(df)) or made[-1])
    got = fingerprint.families(spark.createDataFrame(snake(300), "id long, tinted boolean, fp long"), 6).collect()
    assert len(got) == 300 and {r.family_id for r in got} == {0}
    assert len(made) <= 20


def test_settled_tables_do_not_grow_in_the_plan(spark):
    from tilewright.plans.settle import settle

    t = spark.range(20)
    for _ in range(8):
        t = settle(t.join(t.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert t.count() == 20 and t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64


def test_keys_of_near_pairs_are_not_broadcast(spark):
    rows = snake(300)
    prints = spark.createDataFrame(rows, "id long, tinted boolean, fp long").groupBy("tinted", "fp").agg(F.min("id").alias("id"))
    pairs = fingerprint.near_pairs(prints, 6)
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and (p[2] ^ q[2]).bit_count() <= 6}
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_families_do_not_broadcast_keys(spark, monkeypatch):
    edges, connected = [], fingerprint.connected
    monkeypatch.setattr(fingerprint, "connected", lambda e: edges.append(e) or connected(e))
    rows = [*snake(40), *[(i, i % 2 == 1, -1) for i in range(40, 60)]]
    got = fingerprint.families(spark.createDataFrame(rows, "id long, tinted boolean, fp long"), 6).collect()
    assert {r.sprite_id: r.family_id for r in got} == {i: 0 if i < 40 else 40 + i % 2 for i in range(60)}
    edges[0].collect()
    plan = edges[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

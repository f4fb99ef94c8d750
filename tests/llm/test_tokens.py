import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF

from tilewright.llm import bpe, packing, queries, token_store, vocab

WORD, BYTE = vocab.path("word_bpe_49k.json"), vocab.path("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(1)
    space = [chr(c) for c in (9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF)]
    pieces = ["ab", "Cd's", "é", "'", "S", ",", ".", "!", "<|", "|>", "###", "12", "ñ", " ", " ", "\n", "中", "İ", "x", "don't", "\u0301", "ΑΣ", "<|endoftext|>", *space]
    out = ["", " ", "\n", " lead", "trail ", "a  b\n\nc", "a" * 3000, "ab" * 1500 + "!" * 2000, "a\0b"]
    return out + ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(1500)]


@pytest.mark.parametrize("kind,file", [(vocab.WordEncoder, WORD), (vocab.ByteEncoder, BYTE)])
def test_piecewise_encoding_equals_the_library(kind, file):
    texts, lib = odd_texts(), vocab._load(file)
    want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert list(kind(file).encode_all(pa.array(texts))) == want
    assert list(kind(file, remember=9000).encode_all(pa.array(texts))) == want


def test_backtracking_equals_the_library():
    mine, lib = bpe.WordBpe(WORD), vocab._load(WORD)
    for t in odd_texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert mine.encode(t) == packed
        assert mine.decode(packed) == lib.decode(ids, skip_special_tokens=False).encode()


def test_a_long_word_takes_little_memory():
    import tracemalloc

    coder = bpe.word_bpe(WORD).merger
    word = "".join(random.Random(3).choices("abcdehinorst", k=60_000))
    coder.encode(word)  # the table of pairs is bounded by itself
    tracemalloc.start()
    ids = coder.encode(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(coder.strings[i] for i in ids) == word + bpe.END and peak < 40 * len(word)


def test_workers_drop_what_other_tasks_remember():
    from tilewright.llm.common import trimmed

    vocab.byte_encoder(BYTE), bpe.word_bpe(WORD)
    list(trimmed(iter, "byte_encoder")([]))
    assert vocab.byte_encoder.cache_info().currsize == 1 and bpe.word_bpe.cache_info().currsize == 0
    encoder = vocab.ByteEncoder(BYTE, remember=10_000)
    for _ in encoder.encode_all(pa.array([" ".join(f"w{k}" for k in range(at, at + 30)) for at in range(0, 900, 30)])):
        assert encoder.held <= 10_000


@pytest.mark.parametrize("kind,file", [(vocab.WordEncoder, WORD), (vocab.ByteEncoder, BYTE)])
def test_words_that_come_back_stay_when_the_room_is_full(kind, file):
    """Words of every text are encoded once, however many others pass; all were forgotten when the room was full."""
    rng = random.Random(5)
    encoder, lib, asked = kind(file, remember=40_000), vocab._load(file), []
    fresh = encoder._fresh
    encoder._fresh = lambda pieces: asked.extend(pieces) or fresh(pieces)
    for _ in range(80):
        text = " ".join(["often", "again", "there", *["".join(rng.choices("abcdefgh", k=9)) for _ in range(30)]])
        assert encoder.encode(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.held <= 20_000
    assert asked.count("again") == asked.count("there") == 1 and len(asked) > 2000


def test_backtracking_equals_merging():
    rng = random.Random(2)
    coder = bpe.word_bpe(WORD).merger
    for _ in range(300):
        w = "".join(rng.choices("abcdehinorst", k=rng.randint(1, 25)))
        assert [coder.strings[i] for i in coder.encode(w)] == coder.merged(w + bpe.END)


@pytest.mark.parametrize("width", [1, 3, 5, 7, 8])
def test_codes_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        packed = token_store.Packed(token_store.pack(ids, width))
        assert len(packed) == n and (packed.read(0, n) == ids).all()
        for i in rng.integers(0, n, 40) if n else []:
            assert packed[int(i)] == ids[i]
            j = int(rng.integers(i, n + 1))
            assert (packed.read(int(i), j) == ids[i:j]).all()
    with pytest.raises(IndexError):
        packed[3000]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def check_store(spark, df, rows, tmp_path, **how):
    got = token_store.read_tokens(spark, token_store.write_tokens(df, str(tmp_path / "tokens"), **how)).collect()
    lib, start, want = vocab._load(WORD), 0, []
    for i, t in ordered(rows):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_store_reads_back(spark, edges, empty, tmp_path):
    from edge_rows import EDGES

    check_store(spark, edges, EDGES, tmp_path)
    check_store(spark, edges, EDGES, tmp_path, shard_tokens=10, width=5)
    assert token_store.read_tokens(spark, token_store.write_tokens(empty)).count() == 0


def test_store_query(spark):
    got = queries.op7_token_store(spark, SF).orderBy("doc_id").collect()
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()


def check_packed(got, rows, capacity=1024):
    lib = vocab._load(BYTE)
    want = []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want.append((str(i), k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= capacity
    return len(bins)


def test_packing(edges, empty, stored):
    from edge_rows import EDGES

    check_packed(packing.pack_documents(edges).collect(), EDGES)
    check_packed(packing.pack_documents(edges, capacity=16, open_bins=2, packer_rows=4).collect(), EDGES, 16)
    assert packing.pack_documents(empty).count() == 0
    rng = random.Random(4)
    rows = [(k, "word " * rng.randint(0, 1500)) for k in range(600)]
    got = packing.pack_documents(stored(rows)).collect()
    assert check_packed(got, rows) <= 1.02 * sum(r.length for r in got) / 1024 + 8


def test_the_bound_on_open_bins_binds(stored):
    rng = random.Random(8)
    lengths = [min(1023, 1 + int(rng.lognormvariate(6, 0.7))) for _ in range(30_000)]
    fit, closed, most = packing.BestFit(), 0, 0
    for at in range(0, len(lengths), packing.WINDOW):
        for n in sorted(lengths[at : at + packing.WINDOW], reverse=True):
            closed += fit.open == fit.limit and not fit.bits >> n
            fit.place(n)
            most = max(most, fit.open)
    assert most == packing.OPEN_BINS < packing.WINDOW < packing.PACKER_ROWS and closed > 100
    assert fit.made <= 1.01 * sum(lengths) / 1024


@pytest.mark.parametrize("window,open_bins", [(1, 8), (16, 4), (4096, 1)])
def test_packing_in_windows(stored, window, open_bins):
    rng = random.Random(4)
    rows = [(k, "word " * rng.randint(0, 1500)) for k in range(300)]
    got = packing.pack_documents(stored(rows), window=window, open_bins=open_bins).collect()
    assert check_packed(got, rows) <= 1.5 * sum(r.length for r in got) / 1024 + 8


def test_best_fit_by_hand():
    fit = packing.BestFit(capacity=10, open_bins=2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(capacity=10, open_bins=1)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0)]  # the fullest closed
    with pytest.raises(ValueError):
        fit.place(11)


def test_bpe_query_and_edges(spark, edges, empty):
    from edge_rows import EDGES

    lib = vocab._load(WORD)
    want = []
    for i, t in EDGES:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.encode_decode(edges).collect()) == sorted(want)
    assert bpe.encode_decode(empty).count() == 0


def test_token_queries_equal_the_library(spark):
    from tilewright.llm.common import table

    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    lib, want = vocab._load(WORD), []
    start, stores = 0, []
    for i, t in sorted(rows):
        ids = lib.encode(t, add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        stores.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes())))
        start += len(ids) + 1
    assert sorted(map(tuple, queries.op9_bpe(spark, SF).collect())) == want
    assert sorted(map(tuple, queries.op7_token_store(spark, SF).collect())) == stores
    check_packed(queries.op8_best_fit_packing(spark, SF).collect(), rows)


def test_whole_texts_reach_the_library_in_small_parts(monkeypatch):
    import pyarrow as pa

    from tilewright.llm import vocab

    encoder = vocab.ByteEncoder(vocab.path("byte_bpe_50k.json"))
    texts = ["a  b\t" * 60_000, "plain words", None, "c\r\n" * 200_000, "d  e " * 90_000, ""]
    sizes, each = [], encoder._each
    monkeypatch.setattr(encoder, "_each", lambda some: sizes.append(sum(map(len, some))) or each(some))
    got = list(encoder.encode_all(pa.array([t or "" for t in texts])))
    assert got == each([t or "" for t in texts]) and max(sizes) <= 1 << 20

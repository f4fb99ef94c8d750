"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

One Aho-Corasick pass finds the longest token that starts at each place of a word. The
encoder takes it, checks it against its left neighbour in the table of compatible pairs
(two tokens may stand side by side when merging their joined text gives just the two), and
falls back to the next shorter one, which a table names for each token, or to the token
before. A place that has failed is never tried again, so the work is linear in the word,
and so is the memory: some ten bytes a letter. The result equals merging by rank.

Decoding joins the tokens' strings, which lie in one buffer with an offset each.

All work is local to a text; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, text_of, trimmed
from .vocab import REMEMBER, WordEncoder, path

#: Stands for the end of a word in the automaton; never part of a byte-level string.
END = "￿"
#: Compatible pairs that a worker remembers.
PAIRS = 500_000


class Backtracker:
    """Encodes byte-level strings with a vocabulary and its ranked merges."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str | None = None):
        import ahocorasick

        self.suffix = suffix or ""
        end = lambda s: s[: -len(suffix)] + END if suffix and s.endswith(suffix) else s
        self.ids = {end(s): i for s, i in vocab.items()}
        self.strings = {i: s for s, i in self.ids.items()}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        self.ranks = {(end(a), end(b)): k for k, (a, b) in enumerate(pairs)}
        reached = {end(a + b) for a, b in pairs} | {s for s in self.ids if len(s.replace(END, "")) == 1}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if s in reached:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        #: by token: its length, and the longest other token that it starts with (-1: none)
        self.size, self.shorter = (array("i", [-1]) * (max(self.ids.values()) + 1) for _ in range(2))
        for s, i in self.ids.items():
            self.size[i] = len(s)
            self.shorter[i] = next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in reached and s[:n] in self.ids), -1)
        self.table: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by rank, leftmost first; for the pair table and for tests."""
        parts = list(text[:-1])
        if text.endswith(END) and parts:
            parts[-1] += END
        else:
            parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        found = self.table.get((a, b))
        if found is None:
            if len(self.table) >= PAIRS:
                self.table.clear()
            found = self.table[a, b] = self.merged(self.strings[a] + self.strings[b]) == [self.strings[a], self.strings[b]]
        return found

    def encode(self, word: str) -> array:
        """Ids of one pre-token, given as a byte-level string."""
        text = word + END if self.suffix else word
        size, shorter, longest = self.size, self.shorter, array("i", [-1]) * (len(text) + 1)
        for stop, i in self.automaton.iter(text):  # by their ends, so the longest of a place comes last
            longest[stop - size[i] + 1] = i
        out = array("I")
        places, tries = array("q", [0]), array("i", [longest[0]])
        dead = bytearray(len(text) + 1)
        while places[-1] < len(text):
            at, i = places[-1], tries[-1]
            while i >= 0:
                stop = at + size[i]
                if not dead[stop] and (not out or self.compatible(out[-1], i)):
                    break
                i = shorter[i]
            if i < 0:
                dead[at] = 1
                places.pop()
                tries.pop()
                if not places:
                    raise ValueError(f"the vocabulary has no encoding of {word!r}")
                out.pop()
                continue
            tries[-1] = shorter[i]
            out.append(i)
            places.append(stop)
            tries.append(longest[stop])
        return out


class OffsetTable:
    """Token strings in one buffer. decode() joins them, with a gap between any two."""

    def __init__(self, strings: list[str], gap: bytes = b" "):
        coded = [s.encode() + gap for s in strings]
        self.gap = len(gap)
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)
        self.offsets = np.cumsum([0, *map(len, coded)]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        if not ids.size:
            return b""
        first = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - first
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(first - stops + sizes, sizes)
        return self.bytes[at[: at.size - self.gap]].tobytes()


class WordBpe(WordEncoder):
    """The whole tokenizer of a vocabulary with word ends: texts -> packed ids, ids -> text.

    Normalisation and the cut into pre-tokens are the library's; merging and decoding are
    this module's. White space is dropped by the pre-tokenizer, so a text is the sum of its
    words; a worker merges each distinct word once.
    """

    def __init__(self, file: str, remember: int = REMEMBER):
        super().__init__(file, remember)
        with open(file) as f:
            spec = json.load(f)
        self.normalize, self.cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.merger = Backtracker(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        names = {i: s for s, i in (spec["model"]["vocab"] | self.special).items()}
        self.table = OffsetTable([names.get(i, "") for i in range(max(names) + 1)])

    def words(self, pieces: list[str]) -> list[bytes] | None:
        cut = self.cut(self.normalize(" ".join(pieces)))
        if len(cut) != len(pieces):  # a letter that does not stay one pre-token
            return None
        return [self.merger.encode(p).tobytes() for p, _ in cut]

    def _each(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            ids = array("I")
            for k, part in enumerate(self.split_special(text)):
                if k % 2:
                    ids.append(self.special[part])
                elif part:
                    for piece, _ in self.cut(self.normalize(part)):
                        ids += self.merger.encode(piece)
            out.append(ids.tobytes())
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.table.decode(np.frombuffer(ids, "<u4"))


@remembered
def word_bpe(file: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(file)


def _round_trip(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(file)
        for batch in batches:
            sizes, digests, decoded = [], [], []
            for ids in bpe.encode_all(batch.column(1)):
                sizes.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of nothing. Null ids are kept,
    repeated rows answered once each; further columns are not read. An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(trimmed(_round_trip(tokenizer or path("word_bpe_49k.json")), "word_bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

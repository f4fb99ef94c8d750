"""Where tokenizer files are, and whole-text encoding with the tokenizers library.

Natural text repeats its words, and the pre-tokenizers of both supported files never let
a token cross certain white space. A batch of texts is therefore cut at that white space
by Arrow kernels, its distinct pieces are found there, and only pieces that the worker has
not met before go to the library, many in one call. The ids of the texts are gathered from
the pieces' ids. Texts for which a cut might change the result go to the library whole.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import portions, remembered

#: About as many bytes of pieces and their ids a worker remembers: half of them the latest, half those before.
REMEMBER = 64 << 20
#: What a remembered piece takes beside its letters and ids.
ENTRY = 170
#: Longer pieces are encoded but not remembered.
LONGEST = 64
#: Texts that are encoded together, and the bytes after which fewer are.
TOGETHER, TOGETHER_BYTES = 1024, 4 << 20
#: Bytes of whole texts that the library gets in one call: what it makes of a token takes a hundred bytes or more.
WHOLE_BYTES = 1 << 20
#: Pieces that the library gets as one string.
JOINED = 2000
_MARKS = string.punctuation
_MARK_CLASS = r"!-/:-@\[-`{-~"
#: A letter and marks at the end. Letters are those that all versions of Unicode agree on, but for one whose lower case ends in a mark.
_MARKED = rf"[A-Za-z\x{{c0}}-\x{{d6}}\x{{d8}}-\x{{f6}}\x{{f8}}-\x{{12f}}\x{{131}}-\x{{24f}}\x{{3b1}}-\x{{3c9}}\x{{410}}-\x{{44f}}][{_MARK_CLASS}]+\z"
#: White space of Unicode that is not ASCII, and what str.isspace adds to it.
_RARE_SPACE = r"\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def path(name: str) -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


class PieceEncoder:
    """Texts -> packed little-endian unsigned 32-bit ids, equal to the library's on whole texts."""

    #: Texts that match must stay whole.
    whole_pattern = ""

    def __init__(self, file: str, remember: int = REMEMBER):
        self.tokenizer, self.remember, self.held = _load(file), remember, 0
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.flags = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.flags[i] = self.flag(token)

    def flag(self, token: str) -> bool:
        """Whether a token opens or ends a word; see words()."""
        raise NotImplementedError

    def split(self, texts: pa.Array) -> pa.Array:
        """Lists of pieces whose encodings add up to those of the texts."""
        raise NotImplementedError

    def raw(self, piece: str) -> str:
        """The text that a piece stands for."""
        return piece

    def bare(self, text: str) -> str:
        """The piece that stands for just this text."""
        return text

    def words(self, pieces: list[str]) -> list[bytes] | None:
        """Ids of pieces that are one pre-token each, from one call; None if they are not."""
        raise NotImplementedError

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> dict[str, bytes]:
        plain, out = [], {}
        for p in pieces:
            letters = p.lstrip("\0")
            (plain if letters.isalpha() and (letters.isascii() or max(letters) < "Ԁ") else out.setdefault("", [])).append(p)
        rest = out.pop("", [])
        for kind in (lambda p: p[0] == "\0", lambda p: p[0] != "\0"):
            some = [p for p in plain if kind(p)]
            for at in range(0, len(some), JOINED):
                part = some[at : at + JOINED]
                ids = self.words(part)
                if ids is None:
                    rest += part
                else:
                    out.update(zip(part, ids, strict=True))
        out.update(zip(rest, self._each([self.raw(p) for p in rest]), strict=True))
        return out

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces. When the latest take half of the room, they become those before, and what is met again goes on."""
        got = list(map(self.known.get, pieces))
        met, new = {}, []
        for p, ids in zip(pieces, got, strict=True):
            if ids is None:
                ids = self.before.get(p)
                if ids is not None:
                    met[p] = ids
                elif p:
                    new.append(p)
        if not met and not new:
            return [ids or b"" for ids in got]
        found = self._fresh(new) if new else {}
        short = {p: ids for p, ids in found.items() if len(p) <= LONGEST}
        short.update(met)
        size = sum(ENTRY + len(p) + len(ids) for p, ids in short.items())
        if self.held + size > self.remember // 2:
            self.known, self.before, self.held = {}, self.known, 0
        if size <= self.remember // 2:
            self.known.update(short)
            self.held += size
        found.update(met)
        return [found.get(p, b"") if ids is None else ids for p, ids in zip(pieces, got, strict=True)]

    def _parted(self, pieces: pa.Array) -> tuple[list[str], np.ndarray]:
        """Pieces that repeat more often, and which two of them make up each piece.

        ASCII marks that end a piece stand alone: a letter and a mark are never in one
        pre-token, and a contraction needs a letter after its apostrophe.
        """
        ends = pc.match_substring_regex(pieces, _MARKED)
        cores = pc.if_else(ends, pc.utf8_rtrim(pieces, characters=_MARKS), pieces).dictionary_encode()
        tails = pc.struct_field(pc.extract_regex(pieces.filter(ends), rf"(?P<t>[{_MARK_CLASS}]+)\z"), "t").dictionary_encode()
        names = [*cores.dictionary.to_pylist(), *[self.bare(t) for t in tails.dictionary.to_pylist()], ""]
        both = np.full((len(pieces), 2), len(names) - 1, np.int64)
        both[:, 0] = cores.indices.to_numpy()
        both[ends.to_numpy(zero_copy_only=False).astype(bool), 1] = len(cores.dictionary) + tails.indices.to_numpy()
        return names, both

    def encode_all(self, texts: pa.Array):
        """Packed ids of each text, one after the other."""
        for part in portions(texts.cast(pa.string()), TOGETHER, TOGETHER_BYTES):
            yield from self._encode_slice(part)
            pa.default_memory_pool().release_unused()

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        whole = pc.match_substring_regex(texts, self.whole_pattern).to_numpy(zero_copy_only=False).astype(bool)
        at_whole = np.flatnonzero(whole)
        encoded = [ids for some in portions(texts.take(pa.array(at_whole, pa.int64())), TOGETHER, WHOLE_BYTES) for ids in self._each(some.to_pylist())]
        as_whole = dict(zip(at_whole.tolist(), encoded, strict=True))
        lists = self.split(pc.if_else(pa.array(whole), "", texts))
        coded = lists.flatten().dictionary_encode()
        names, both = self._parted(coded.dictionary)
        ids = self._lookup(names)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        pieces = both[coded.indices.to_numpy()].ravel()
        piece_sizes = sizes[pieces]
        stops = np.concatenate([[0], np.cumsum(piece_sizes)])
        at = np.repeat(starts[pieces] - stops[:-1], piece_sizes) + np.arange(stops[-1])
        out = np.frombuffer(b"".join(ids), "<u4")[at]
        counts = 2 * pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = stops[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [as_whole[i] if i in as_whole else out[a:b].tobytes() for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]

    def encode(self, text: str) -> bytes:
        return next(iter(self.encode_all(pa.array([text], pa.string()))))


class WordEncoder(PieceEncoder):
    """For vocabularies with word ends, whose pre-tokenizer drops white space and case."""

    whole_pattern = rf"<\||[\x00{_RARE_SPACE}]"

    def flag(self, token: str) -> bool:
        return token.endswith("</w>")

    def split(self, texts: pa.Array) -> pa.Array:
        return pc.ascii_split_whitespace(pc.ascii_lower(texts))

    def words(self, pieces: list[str]) -> list[bytes] | None:
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        stops = np.flatnonzero(self.flags[ids]) + 1
        if stops.size != len(pieces):  # a letter that does not stay one pre-token
            return None
        return [ids[a:b].tobytes() for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


class ByteEncoder(PieceEncoder):
    """For byte-level vocabularies: a single space opens a piece, a single line feed is one.

    A piece is kept as the text after its space; a piece without one starts with \\0.
    """

    #: only where all white space is single spaces and line feeds between words
    whole_pattern = rf"<\||[\x00\t\x0b\x0c\r{_RARE_SPACE}]|[ \n][ \n]|^[ \n]|[ \n]\z"

    def flag(self, token: str) -> bool:
        return token.startswith("Ġ")

    def split(self, texts: pa.Array) -> pa.Array:
        marked = pc.replace_substring(texts, "\n", " \n \0")
        return pc.split_pattern(pc.binary_join_element_wise("", marked, "\0"), " ")

    def bare(self, text: str) -> str:
        return "\0" + text

    def raw(self, piece: str) -> str:
        return piece[1:] if piece[0] == "\0" else piece if piece == "\n" else " " + piece

    def words(self, pieces: list[str]) -> list[bytes] | None:
        if pieces[0][0] == "\0":  # words without a space, a line feed after each
            text = "\n".join([p[1:] for p in pieces]) + "\n"
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(ids == ids[-1])
            starts = [0, *(stops[:-1] + 1).tolist()]
        else:
            ids = np.array(self.tokenizer.encode(" " + " ".join(pieces), add_special_tokens=False).ids, "<u4")
            starts = np.flatnonzero(self.flags[ids])
            stops = np.append(starts[1:], ids.size)
            starts = starts.tolist()
        if len(stops) != len(pieces):
            return None
        return [ids[a:b].tobytes() for a, b in zip(starts, stops.tolist(), strict=True)]


@remembered
def word_encoder(file: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(file)


@remembered
def byte_encoder(file: str) -> ByteEncoder:
    """One for each Python worker."""
    return ByteEncoder(file)

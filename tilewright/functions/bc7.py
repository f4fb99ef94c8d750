"""BC7 blocks, modes 4, 5 and 6, for many blocks at once in NumPy.

A block is 16 texels of 4 channels. Mode 6 fits one line through all four channels, in which
a hidden texel has the weight of its colour's error, a sixteenth; where alpha varies, modes 5 and 4 fit colour and alpha apart. The mode with the least weighted
error wins, the earlier of equals in the order 6, 5, 4.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: interpolation weights by index bits.
WEIGHTS = {
    2: np.array([0, 21, 43, 64]),
    3: np.array([0, 9, 18, 27, 37, 46, 55, 64]),
    4: np.array([0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64]),
}
#: What an error in a colour channel counts in a visible and in a hidden texel; alpha counts as visible.
VISIBLE, HIDDEN = 16, 1


def _axis(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the principal line through weighted points: x (n, 16, c), w (n, 16)."""
    w = w.astype(np.float32)[..., None]
    mean = (x * w).sum(1) / w.sum(1)
    d = x - mean[:, None]
    cov = np.einsum("nic,nid->ncd", d * w, d)
    axis = x.max(1) - x.min(1) + 1
    for _ in range(4):
        new = np.einsum("ncd,nd->nc", cov, axis)
        size = np.linalg.norm(new, axis=1, keepdims=True)
        axis = np.where(size < 1e-6, axis, new / np.maximum(size, 1e-6))
    axis = axis / np.maximum(np.linalg.norm(axis, axis=1, keepdims=True), 1e-6)
    t = np.einsum("nic,nc->ni", d, axis)
    seen = w[..., 0] > 0
    lo, hi = np.where(seen, t, np.inf).min(1), np.where(seen, t, -np.inf).max(1)
    ends = [np.clip(mean + axis * s[:, None], 0, 255) for s in (lo, hi)]
    return ends[0], ends[1]


def _expand(q: np.ndarray, bits: int) -> np.ndarray:
    return q if bits == 8 else (q << (8 - bits)) | (q >> (2 * bits - 8))


def _nearest(e: np.ndarray, bits: int) -> np.ndarray:
    """The code of a few bits whose expansion is nearest, the lower of equals."""
    top = (1 << bits) - 1
    base = np.floor(e * top / 255).astype(np.int64)
    tries = np.stack([np.clip(base + k, 0, top) for k in (-1, 0, 1, 2)])
    return np.take_along_axis(tries, np.abs(_expand(tries, bits) - e).argmin(0)[None], 0)[0]


def _with_parity(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of 7 bits and one lowest bit for all channels of an end."""
    codes, errors = [], []
    for p in (0, 1):
        q = np.clip(np.floor((e - p) / 2 + 0.5), 0, 127).astype(np.int64)
        codes.append(q)
        errors.append(((2 * q + p - e) ** 2).sum(1))
    p = (errors[1] < errors[0]).astype(np.int64)
    return np.where(p[:, None] == 1, codes[1], codes[0]), p


class _Line:
    """Quantised ends and indices of a line through some channels, and their error."""

    def __init__(self, x, w, ends, index_bits: int, bits):
        """w: (n, 16, c) error weights; bits: of each channel's code, or None for 7 and a shared lowest bit."""
        self.parity = bits is None
        if self.parity:
            (q0, p0), (q1, p1) = _with_parity(ends[0]), _with_parity(ends[1])
            self.codes, self.p = (q0, q1), (p0, p1)
            v0, v1 = 2 * q0 + p0[:, None], 2 * q1 + p1[:, None]
        else:
            self.codes = tuple(np.stack([_nearest(e[:, c], b) for c, b in enumerate(bits)], 1) for e in ends)
            v0, v1 = (np.stack([_expand(q[:, c], b) for c, b in enumerate(bits)], 1) for q in self.codes)
        t = WEIGHTS[index_bits]
        palette = ((64 - t)[None, :, None] * v0[:, None] + t[None, :, None] * v1[:, None] + 32) >> 6
        d = x[:, :, None].astype(np.int64) - palette[:, None]
        cost = (d * d * w[:, :, None]).sum(-1)
        self.index = cost.argmin(2)
        self.error = np.take_along_axis(cost, self.index[..., None], 2)[..., 0].sum(1)

    def better(self, other: _Line) -> None:
        """Take over the blocks in which other has less error."""
        won = other.error < self.error
        for mine, theirs in zip(self.codes, other.codes, strict=True):
            mine[won] = theirs[won]
        if self.parity:
            for mine, theirs in zip(self.p, other.p, strict=True):
                mine[won] = theirs[won]
        self.index[won], self.error[won] = other.index[won], other.error[won]


def _refined(x: np.ndarray, w: np.ndarray, index: np.ndarray, index_bits: int, ends):
    """Least-squares ends for given indices; the old ones where they are not determined."""
    t = WEIGHTS[index_bits][index] / 64.0
    w = w.astype(np.float64)
    aa, ab, bb = (((1 - t) ** 2 * w).sum(1), ((1 - t) * t * w).sum(1), (t * t * w).sum(1))
    ax, bx = np.einsum("ni,nic->nc", (1 - t) * w, x), np.einsum("ni,nic->nc", t * w, x)
    det = aa * bb - ab * ab
    ok = np.abs(det) >= 1e-9
    safe = np.where(ok, det, 1)[:, None]
    new = ((bb[:, None] * ax - ab[:, None] * bx) / safe, (aa[:, None] * bx - ab[:, None] * ax) / safe)
    return [np.where(ok[:, None], np.clip(n, 0, 255), e) for n, e in zip(new, ends, strict=True)]


def _fit(x, fit_weight, error_weight, index_bits, bits) -> _Line:
    ends = _axis(x.astype(np.float32), fit_weight)
    line = _Line(x, error_weight, ends, index_bits, bits)
    line.better(_Line(x, error_weight, _refined(x.astype(np.float64), fit_weight, line.index, index_bits, ends), index_bits, bits))
    return line


class _Bits:
    """128 bits of each block, filled from the lowest."""

    def __init__(self, n: int):
        self.words, self.at = np.zeros((n, 2), np.uint64), 0

    def put(self, value, bits: int) -> None:
        value = np.broadcast_to(np.asarray(value, np.int64), self.words.shape[:1]).astype(np.uint64)
        word, shift = divmod(self.at, 64)
        self.words[:, word] |= value << np.uint64(shift)
        if shift + bits > 64:
            self.words[:, word + 1] |= value >> np.uint64(64 - shift)
        self.at += bits

    def put_indices(self, index: np.ndarray, bits: int) -> None:
        for i in range(16):
            self.put(index[:, i], bits - (i == 0))


def _anchored(line: _Line, bits: int) -> None:
    """Swap the ends where the first index has its top bit, which is not written."""
    flip = line.index[:, 0] >= 1 << (bits - 1)
    q0, q1 = line.codes
    q0[flip], q1[flip] = q1[flip].copy(), q0[flip].copy()
    if line.parity:
        p0, p1 = line.p
        p0[flip], p1[flip] = p1[flip].copy(), p0[flip].copy()
    line.index[flip] = (1 << bits) - 1 - line.index[flip]


def encode(texels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16, 4) bytes -> (n, 2) 64-bit words and the modes."""
    x = np.asarray(texels, np.int64)
    n = len(x)
    hidden = x[..., 3] == 0
    colour = np.where(hidden, HIDDEN, VISIBLE)
    w4 = np.stack([colour] * 3 + [np.full_like(colour, VISIBLE)], -1)
    best = _fit(x, np.where(hidden, HIDDEN / VISIBLE, 1.0), w4, 4, None)
    mode, error = np.full(n, 6), best.error.copy()
    _anchored(best, 4)
    out = _Bits(n)
    out.put(1 << 6, 7)
    for c in range(4):
        out.put(best.codes[0][:, c], 7)
        out.put(best.codes[1][:, c], 7)
    out.put(best.p[0], 1)
    out.put(best.p[1], 1)
    out.put_indices(best.index, 4)
    words = out.words

    varies = np.flatnonzero((x[..., 3] != x[:, :1, 3]).any(1))
    if varies.size:
        y, h = x[varies], hidden[varies]
        seen = np.where(h.all(1)[:, None], 1, ~h)
        w = w4[varies]
        for number, head, colour_bits, alpha_bits, colour_index, alpha_index in ((5, 6, (7, 7, 7), (8,), 2, 2), (4, 5, (5, 5, 5), (6,), 3, 2)):
            c = _fit(y[..., :3], seen, w[..., :3], colour_index, colour_bits)
            a = _fit(y[..., 3:], np.ones(h.shape), w[..., 3:], alpha_index, alpha_bits)
            total = c.error + a.error
            _anchored(c, colour_index)
            _anchored(a, alpha_index)
            bits = _Bits(varies.size)
            bits.put(1 << number, head)
            bits.put(0, 2)  # no rotation
            if number == 4:
                bits.put(1, 1)  # colour has the longer indices
            for k in range(3):
                bits.put(c.codes[0][:, k], colour_bits[k])
                bits.put(c.codes[1][:, k], colour_bits[k])
            bits.put(a.codes[0][:, 0], alpha_bits[0])
            bits.put(a.codes[1][:, 0], alpha_bits[0])
            sections = ((a.index, alpha_index), (c.index, colour_index)) if number == 4 else ((c.index, colour_index), (a.index, alpha_index))
            for index, b in sections:
                bits.put_indices(index, b)
            won = total < error[varies]
            words[varies[won]], mode[varies[won]], error[varies[won]] = bits.words[won], number, total[won]
    return words, mode


def decode(words: np.ndarray) -> np.ndarray:
    """(n, 2) 64-bit words of modes 4, 5 and 6 without rotation -> (n, 16, 4) bytes."""
    words = np.asarray(words, np.uint64)
    bits = ((words[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64).reshape(len(words), 128)
    mode = bits.argmax(1)
    out = np.zeros((len(words), 16, 4), np.int64)
    for number in (4, 5, 6):
        rows = np.flatnonzero(mode == number)
        if not rows.size:
            continue
        b, at = bits[rows], number + 1

        def take(n, b=b):
            nonlocal at
            at += n
            return (b[:, at - n : at] << np.arange(n)).sum(1)

        def indices(n):
            return np.stack([take(n - (i == 0)) for i in range(16)], 1)

        line = lambda e0, e1, i, n: ((64 - WEIGHTS[n][i]) * e0[:, None] + WEIGHTS[n][i] * e1[:, None] + 32) >> 6
        if number == 6:
            ends = [(take(7), take(7)) for _ in range(4)]
            p = take(1), take(1)
            index = indices(4)
            for c, (a, z) in enumerate(ends):
                out[rows, :, c] = line(2 * a + p[0], 2 * z + p[1], index, 4)
            continue
        take(2)
        swap = take(1) if number == 4 else np.zeros(rows.size, np.int64)
        nc, na = (5, 6) if number == 4 else (7, 8)
        ends = [tuple(_expand(take(nc), nc) for _ in range(2)) for _ in range(3)]
        alpha = tuple(_expand(take(na), na) for _ in range(2))
        first = indices(2)
        second = indices(3 if number == 4 else 2)
        if number == 4 and (swap != 1).any():
            raise ValueError("mode 4 is read with the longer indices on colour only")
        ci, ai, cb = (second, first, 3) if number == 4 else (first, second, 2)
        for c, (a, z) in enumerate(ends):
            out[rows, :, c] = line(a, z, ci, cb)
        out[rows, :, 3] = line(*alpha, ai, 2)
    if not np.isin(mode, (4, 5, 6)).all():
        raise ValueError("only modes 4, 5 and 6 are read")
    return out.astype(np.uint8)

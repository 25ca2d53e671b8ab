"""Words and word shingles of many texts at once, as 64-bit hashes over numpy buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


#: Bytes of text that are hashed at a time; a longer text is one piece by itself.
PIECE = 2 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse; kept for pieces of the usual size."""
    global _POWERS, _INVERSE
    if len(_POWERS) >= n:
        return _POWERS, _INVERSE
    n = max(n, PIECE + 1)
    back = np.uint64(pow(int(_STEP), -1, 1 << 64))
    powers, inverse = (np.full(n, x) for x in (_STEP, back))
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    if n == PIECE + 1:
        _POWERS, _INVERSE = powers, inverse
    return powers, inverse


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets into them; a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z as a-z), and the n + 1 offsets of the texts in them."""
    raw, offsets = buffer(texts)
    if len(raw) > PIECE and len(offsets) > 2:
        cuts = [0, *(np.flatnonzero(np.diff((offsets[1:] - 1) // PIECE)) + 1).tolist(), len(offsets) - 1]
        parts = [_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
        before = np.cumsum([0, *[len(h) for h, _ in parts]])
        return np.concatenate([h for h, _ in parts]), np.concatenate([[0], *[e[1:] + n for (_, e), n in zip(parts, before[:-1], strict=True)]])
    return _hashes(raw, offsets)


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(raw)]
    begins[at] = inside[at]
    starts = np.flatnonzero(begins)
    ends = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), ends
    before = np.cumsum(inside) - inside
    where = before[starts]
    size = np.diff(np.append(where, before[-1] + inside[-1])).astype(np.uint64)
    power, back = _powers(int(size.sum()) + 1)
    values = _TABLE[raw[inside]] * power[: int(size.sum())]
    return mix64(np.add.reduceat(values, where) * back[where] + size), ends


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Of each text its sorted distinct shingles of `width` words; a shorter text's whole sequence is one; without words, none."""
    words, ends = word_hashes(texts)
    odd = [np.uint64(pow(int(_STEP), k + 1, 1 << 64)) for k in range(width)]
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k : k + len(full)] * odd[k]
    full = mix64(full)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            own = words[a:b] * np.array(odd[: b - a], dtype=np.uint64)
            out.append(mix64(own.sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Word shingle hashes of many texts at once, in numpy over their bytes.

Words are runs of bytes other than space and U+0009 to U+000D, with A-Z
lower-cased. A word's hash is a polynomial in its bytes modulo 2**64, read off
one running sum; a shingle's hash mixes the hashes of its words. Texts are
taken in slices of about ``SLICE`` bytes, so memory is bounded by the longest
text, and no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[str, np.ndarray] = {}


def _table(base: np.uint64, n: int) -> np.ndarray:
    key = hex(int(base))
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, SLICE * 2), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good high and low bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(texts: Iterable[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    Fewer words make one shingle of all of them; no words make none.
    """
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= SLICE:
            yield from _slice(held, width)
            held, size = [], 0
    if held:
        yield from _slice(held, width)


def _slice(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edges[0::2], edges[1::2]
    if not len(start):
        for _ in texts:
            yield np.empty(0, np.uint64)
        return
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw].astype(np.uint64) * _table(_BASE, len(raw)), out=sums[1:])
    words = (sums[stop] - sums[start]) * _table(_BASE_INV, len(raw))[start]
    words = mix(words + (stop - start).astype(np.uint64) * _STEP)
    border = np.searchsorted(start, ends)  # words before each text's end
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full = full * _STEP + words[k : len(words) - width + 1 + k] if len(full) else full
    full = mix(full) if len(full) else full
    at = 0
    for to in border.tolist():
        n = to - at
        if n >= width:
            yield np.unique(full[at : to - width + 1])
        elif n:
            short = np.uint64(n)
            for w in words[at:to]:
                short = np.uint64((int(short) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at = to

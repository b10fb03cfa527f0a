"""Token hashes of many texts at once, in numpy over their bytes.

A token is a maximal run of bytes of a class, A-Z lower-cased; a token's 64-bit hash is a polynomial
in its bytes, read off one running sum, so a text costs time in proportion to its length. Texts are taken in
slices of about ``SLICE`` bytes (a longer text is a slice of its own, whole).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from ._shingle import _BASE, _BASE_INV, _IN_WORD, _LOWER, _STEP, SLICE, _table, mix

#: Bytes of words: all but space and U+0009 to U+000D.
IN_WORD = _IN_WORD
#: Bytes of search terms: digits, ASCII letters, and all of characters from U+0080.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_hashes(texts: list[bytes], inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of ``texts``, one after the other, and each text's number of them."""
    parts = [_hashes([t for (t,) in some], inside) for some in slices(((t,) for t in texts), 0)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _hashes(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    flags = inside[raw]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    start, stop = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw].astype(np.uint64) * _table(_BASE, len(raw)), out=sums[1:])
    found = (sums[stop] - sums[start]) * _table(_BASE_INV, len(raw))[start]
    found = mix(found + (stop - start).astype(np.uint64) * _STEP)
    return found, np.diff(np.searchsorted(start, ends), prepend=0)


def slices(rows: Iterable[tuple], text: int, limit: int = SLICE) -> Iterator[list[tuple]]:
    """Lists of rows whose texts (bytes, at ``text``) have about ``limit`` bytes together."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 1
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held

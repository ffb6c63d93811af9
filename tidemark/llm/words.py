"""Word and shingle hashing of many texts at once, in numpy.

A word is a maximal run of ASCII letters or digits and of bytes from 128 on
(so letters of any script) in the lower-cased UTF-8 text. Hashes are 64-bit:
a polynomial of the word's bytes, mixed. They depend on the text alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)
#: Bytes hashed at once; longer texts go in several pieces.
PIECE = 1 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    WORD_BYTE[_c] = True
LETTER_BYTE = WORD_BYTE.copy()
LETTER_BYTE[48:58] = False
#: Bytes that are neither of a word nor white space.
MARK_BYTE = ~WORD_BYTE
MARK_BYTE[[9, 10, 11, 12, 13, 32, 0]] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, U), np.full(size, _INV, U)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes (in a new array)."""
    h = h ^ (h >> U(32))
    h *= _STEP
    h ^= h >> U(32)
    h *= _STEP
    h ^= h >> U(32)
    return h


def encode(text: str | None) -> bytes:
    """Lower-cased UTF-8; lone surrogates become '?'."""
    return (text or "").lower().encode("utf-8", "replace")


def pieces(texts: list[bytes]):
    """Yields (buffer, ends): joined texts with a line end after each, about PIECE bytes; ends: where each text's bytes end.

    A text longer than PIECE is given whole, alone.
    """
    part: list[bytes] = []
    size = 0
    for t in texts:
        if part and size + len(t) > PIECE:
            yield _joined(part)
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield _joined(part)


def _joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"\n".join(part) + b"\n", np.uint8), np.cumsum([len(t) + 1 for t in part])


def spans(buffer: np.ndarray, kind: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes of a kind."""
    inside = kind[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edges = np.concatenate(([0], edges))
    if edges.size % 2:
        edges = np.concatenate((edges, [inside.size]))
    return edges[::2], edges[1::2]


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    out = np.empty(starts.size, U)
    at = 0
    while at < starts.size:  # by blocks, so that memory stays bounded
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE * 2, "right")))
        high = int(ends[to - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, U)
        np.cumsum((buffer[low:high].astype(U) + U(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s])
        at = to
    return out


def word_hashes(texts: list[str | None]):
    """Yields, for runs of consecutive texts, (word hashes, counts of words by text)."""
    for buffer, ends in pieces([encode(t) for t in texts]):
        s, e = spans(buffer)
        yield span_hashes(buffer, s, e), np.diff(np.searchsorted(s, np.concatenate(([0], ends))))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each text, and their counts.

    A text of 1 to n-1 words has one shingle, all its words; an empty one none.
    """
    starts = np.concatenate(([0], np.cumsum(counts)))
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    doc = np.repeat(np.arange(counts.size), each)
    first = np.arange(doc.size) - np.repeat(np.cumsum(each) - each, each) + starts[doc]
    h = np.zeros(doc.size, U)
    length = np.minimum(counts[doc], n)
    for k in range(n):
        use = k < length
        w = words[np.where(use, first + k, 0)] if words.size else h
        h = np.where(use, (h ^ w) * _BASE + U(k + 1), h)
    return mix(h), each

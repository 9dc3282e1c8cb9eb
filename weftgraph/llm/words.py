"""Words, word hashes and hashes of word runs over whole texts.

A word is a maximal run of bytes other than space and 0x09-0x0D; in UTF-8 these
never occur inside another character, so bytes and code points agree.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = 4096
#: Bytes of text that are hashed at once; bounds the memory of a very long text.
PIECE = 1 << 17
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (one to one)."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(0x9E3779B97F4A7C15)) * U(0x9E3779B97F4A7C15))


_COEF = stream(_TABLE, 1) | U(1)


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of data."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space, prepend=True, append=True)
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    if not len(start):
        return np.empty(0, U), start, end
    size = end - start
    pos = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw)))) if start[0] == 0 else None
    if pos is None:
        pos = np.zeros(len(raw), np.int64)
        pos[start[0] :] = np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    coef = _COEF[pos & (_TABLE - 1)]
    if size.max() >= _TABLE:
        coef = coef * ((pos >> 12).astype(U) * U(2) + U(1))
    prod = (raw.astype(U) + U(1)) * coef
    prod[space] = 0
    return mix(np.add.reduceat(prod, start) + size.astype(U) * U(0xD6E8FEB86659FD93)), start, end


def _cut(text: bytes) -> list[bytes]:
    """Pieces of about PIECE bytes that end at a space."""
    if len(text) <= PIECE:
        return [text]
    raw, out, at = np.frombuffer(text, np.uint8), [], 0
    spaces = np.flatnonzero(_SPACE[raw])
    while len(text) - at > PIECE:
        k = np.searchsorted(spaces, at + PIECE)
        if k == len(spaces):
            break
        out.append(text[at : spaces[k] + 1])
        at = int(spaces[k]) + 1
    return [*out, text[at:]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and how many words each text has."""
    pieces, owner = [], []
    for i, t in enumerate(texts):
        for p in _cut(t or b""):
            pieces.append(p)
            owner.append(i)
    out, n = [], np.zeros(len(texts), np.int64)
    k = 0
    while k < len(pieces):
        group, took = [], 0
        first = k
        while k < len(pieces) and (not group or took + len(pieces[k]) <= PIECE):
            group.append(pieces[k])
            took += len(pieces[k]) + 1
            k += 1
        h, start, _ = _hash_piece(b" ".join(group))
        out.append(h)
        ends = np.cumsum([len(p) + 1 for p in group])
        per = np.diff(np.searchsorted(start, ends), prepend=0)
        np.add.at(n, owner[first:k], per)
    return (np.concatenate(out) if out else np.empty(0, U)), n


def runs(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """64-bit hash of the k values that start at each place; k - 1 fewer than h (none if h is shorter)."""
    if len(h) < k:
        return np.empty(0, U)
    coef, n = stream(k, seed) | U(1), len(h) - k + 1
    out = h[:n] * coef[0]
    for j in range(1, k):
        out += h[j : n + j] * coef[j]
    return mix(out)


def inside(counts: np.ndarray, k: int) -> np.ndarray:
    """Which of the places of runs() lie within one text."""
    total = int(counts.sum())
    if total < k:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc[: total - k + 1] == doc[k - 1 :]


def owners(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)

"""Distinct word shingles of whole texts, by numpy over a batch's bytes."""

from __future__ import annotations

import numpy as np

from .flat import U64, Rolling, byte_table, mix64

WORDS = 5
_BYTES = byte_table(5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted by both. A text with fewer words has one shingle, without words none."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = ~_GAP[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = Rolling(_BYTES[_LOWER[data]]).of(s, e)
    doc = np.searchsorted(offs, s, side="right") - 1
    count = np.bincount(doc, minlength=n)
    start = np.zeros(n, np.int64)
    start[1:] = np.cumsum(count)[:-1]
    acc = h.copy()
    for k in range(1, WORDS):
        acc[:-k] = mix64(acc[:-k] * _STEP + h[k:] + U64(k))
    whole = doc[: len(doc) - WORDS + 1] == doc[WORDS - 1 :] if len(doc) >= WORDS else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    d, x = doc[at], acc[at]
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):  # one for the whole sequence, apart from all others by its length
        own = np.zeros(len(few), U64)
        for i, f in enumerate(few):
            v = 0
            for w in h[start[f] : start[f] + count[f]].tolist():
                v = (v * 0x9E3779B97F4A7C15 + w + 1) & 0xFFFFFFFFFFFFFFFF
            own[i] = v ^ (0x5851F42D4C957F2D * int(count[f]) & 0xFFFFFFFFFFFFFFFF)
        d, x = np.append(d, few), np.append(x, mix64(own))
    order = np.argsort(x)
    d, x = d[order], x[order]
    order = np.argsort(d.astype(np.uint16) if n < 65536 else d, kind="stable")
    d, x = d[order], x[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[new], x[new]

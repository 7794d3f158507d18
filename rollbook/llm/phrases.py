"""Phrases of a text by rolling-hash triggers, and hashes of their contexts; plain numpy.

A window is ``WIDTH`` bytes. Its trigger is the place in it whose next ``GRAM`` bytes have the least rolling hash, the first of
equals: that depends on nothing but the window's bytes, so equal windows have their triggers at equal places. The windows of
one trigger are consecutive. They form a phrase: its bytes run from its first window's first to its last window's last,
and phrases of equal bytes and trigger place are the same entry of the dictionary.
"""

from __future__ import annotations

import numpy as np

WIDTH, GRAM = 100, 24
#: Windows treated at once; a phrase that crosses such a border is read as two.
CHUNK = 1 << 20

_BYTES = np.random.default_rng(20240611).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PLACE = np.uint64((1 << 22) - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    row = np.full(n, base)
    row[0] = 1
    return np.cumprod(row)


_UP, _DOWN = (_powers(b, CHUNK + WIDTH + 1) for b in (_BASE, _INVERSE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sums(part: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * _UP[:len(part)])])


def _chunks(raw: np.ndarray):
    """(first window, bytes of the windows) of each chunk."""
    for at in range(0, len(raw) - WIDTH + 1, CHUNK):
        yield at, raw[at:at + CHUNK + WIDTH - 1]


def phrases(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash of the trigger, hash of the phrase, first window, number of windows; of every phrase of a text in order."""
    out = []
    for at, part in _chunks(raw):
        total, n = _sums(part), len(part) - WIDTH + 1
        grams = len(part) - GRAM + 1
        gram = _mix((total[GRAM:] - total[:-GRAM]) * _DOWN[:grams])
        least = (gram & ~_PLACE) | np.arange(grams, dtype=np.uint64)
        span, width = 1, WIDTH - GRAM + 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[:n], least[width - span:width - span + n])
        place = (least & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        many = np.diff(np.concatenate([first, [n]]))
        last = first + many + WIDTH - 1
        trigger = place[first]
        body = _mix((total[last] - total[first]) * _DOWN[first] + ((trigger - first) * 512 + many).astype(np.uint64) * _BASE)
        out.append((gram[trigger].view(np.int64), body.view(np.int64), first + at, many))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def window_hashes(raw: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of the windows of the given phrases, and the number of the phrase that each belongs to."""
    owner = np.repeat(np.arange(len(first)), many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    out = np.zeros(len(start), np.uint64)
    for at, part in _chunks(raw):
        own = np.flatnonzero((start >= at) & (start < at + CHUNK))
        if len(own):
            s, total = start[own] - at, _sums(part)
            out[own] = _mix((total[s + WIDTH] - total[s]) * _DOWN[s])
    return start, out.view(np.int64), owner

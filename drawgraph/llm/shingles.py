"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed odd multipliers of the hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def slices(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    out, size = [], 0
    for t in texts:
        t = t or b""
        out.append(t)
        size += len(t)
        if size >= SLICE_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased, cut at ASCII blanks) and the first word of each text (with an end)."""
    raw = b" ".join([b"", *texts, b""]).lower()
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * STEP)
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(starts, at)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``size`` words of each text.

    A text of fewer words has the whole sequence as one; one without words has none.
    """
    words, first = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * np.uint64(pow(int(STEP), k + 1, 1 << 64))
    rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), first.tolist()[1:], strict=False):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        elif b > a:
            x = np.uint64(b - a)
            for k, w in enumerate(words[a:b]):
                x = x + w * np.uint64(pow(int(STEP), k + 1, 1 << 64))
            out.append(mix(np.array([x])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Word shingles of whole texts as 64-bit hashes, computed over bytes without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PART = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(21).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & 0xFFFFFFFFFFFFFFFF
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _PART * 2), _powers(_INVERSE, _PART * 2)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(data: bytes) -> Iterator[bytes]:
    """Parts of about _PART bytes, cut at white space; a longer word stays whole."""
    at = 0
    while len(data) - at > _PART:
        end = max(data.rfind(c, at, at + _PART) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if end <= at:
            after = [p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := data.find(c, at + _PART)) >= 0]
            end = min(after, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str) -> np.ndarray:
    """One hash for each maximal run of characters that are no ASCII white space, in order."""
    out = []
    for part in _parts(text.encode("utf-8", "surrogatepass")):
        raw = np.frombuffer(part, np.uint8)
        n = len(raw)
        if not n:
            continue
        up, down = (_UP, _DOWN) if n < len(_UP) else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
        edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[raw] * up[:n], out=total[1:])
        out.append(mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(text: str) -> np.ndarray:
    """A hash for each run of five words, repeats included; of fewer words, one for all of them; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = out * _STEP[k] + words[k : k + n]
    return mixed(out + np.uint64(min(WORDS, len(words))))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and how often each occurs."""
    return np.unique(shingle_hashes(text), return_counts=True)

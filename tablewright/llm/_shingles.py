"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RANDOM.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(step: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(step))
    if got is None or len(got) < n:
        factors = np.full(max(n, 1 << 16), step, dtype=np.uint64)
        factors[0] = 1
        got = _powers[int(step)] = np.cumprod(factors)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word: a polynomial of its bytes, from running sums."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = ~_SEPARATOR[a]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * _power(_STEP, len(a)), out=total[1:])
    return starts, mix((total[ends] - total[starts]) * _power(_BACK, len(a) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], words: int, batch_bytes: int = 1 << 18) -> Iterator[np.ndarray]:
    """For each text its set of shingles of so many words, sorted, as signed
    64-bit numbers; a text with fewer words has its whole sequence as one, a text
    without words, or null, the empty set."""
    encoded = [(t or "").encode("utf-8", "replace") for t in texts]
    at = 0
    while at < len(encoded):
        end, size = at, 0
        while end < len(encoded) and (end == at or size + len(encoded[end]) <= batch_bytes):
            size += len(encoded[end]) + 1
            end += 1
        part = encoded[at:end]
        first = np.cumsum([0, *(len(t) + 1 for t in part)])
        starts, h = _words(b" ".join(part))
        of = np.searchsorted(starts, first)
        whole = np.zeros(max(len(h) - words + 1, 0), dtype=np.uint64)
        for k in range(words):
            whole += h[k:k + len(whole)] * _PLACE[k]
        whole = mix(whole)
        for a, b in zip(of, of[1:], strict=False):
            n = b - a
            if n >= words:
                yield np.unique(whole[a:b - words + 1].view(np.int64))
            elif n:
                yield mix((h[a:b] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)
        at = end

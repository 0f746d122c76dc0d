"""64-bit hashes of the words of many texts at once, and of runs of words, with numpy.

A word is a run of bytes that are not separators. Its hash is a polynomial over
random 64-bit values of its bytes, mixed; equal words have equal hashes, and two
given words share one with a chance of about 2**-60.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 20
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: All bytes below 128 but letters and digits.
NON_ALPHANUMERIC = bytes(b for b in range(128) if not chr(b).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=8)
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def byte_hashes(lower: bool) -> tuple[int, np.ndarray]:
    """The base of the polynomial, and what stands for each byte in it; 0 for white space."""
    values = _byte_values(lower).copy()
    values[list(WHITE_SPACE)] = 0
    return _BASE, values


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def forget_powers() -> None:
    """16 MB and more that are made again in no time."""
    _powers.cache_clear()


@dataclass
class Words:
    """Words of many texts in order: hash, first and end byte in ``data``; text i has words firsts[i]:firsts[i + 1]."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))


def words_of(texts: list[str], separators: bytes = WHITE_SPACE, lower: bool = False) -> Words:
    encoded = [text.encode("utf-8") for text in texts]
    data = b"\n".join([*encoded, b""])
    raw = np.frombuffer(data, np.uint8)
    inside = np.ones(256, np.bool_)
    inside[np.frombuffer(separators, np.uint8)] = False
    if inside[10]:
        raise ValueError("a line feed has to separate words")
    is_word = np.empty(len(raw) + 2, np.bool_)
    is_word[0] = is_word[-1] = False
    np.take(inside, raw, out=is_word[1:-1])
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    values = _byte_values(lower)
    at = 0
    while at < len(starts):  # blocks that end between words keep memory in proportion to a block
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        first, end = int(starts[at]), int(ends[to - 1])
        size = 1 << max(20, (end - first).bit_length())
        sums = np.zeros(end - first + 1, np.uint64)
        np.cumsum(values[raw[first:end]] * _powers(_BASE, size)[: end - first], out=sums[1:])
        lo, hi = starts[at:to] - first, ends[at:to] - first
        hashes[at:to] = (sums[hi] - sums[lo]) * _powers(pow(_BASE, -1, 1 << 64), size)[lo]
        at = to
    bounds = np.cumsum([0, *(len(text) + 1 for text in encoded)])
    return Words(data, mix(hashes), starts, ends, np.searchsorted(starts, bounds))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, by doubling; run i starts at word i, also across texts."""
    runs, have, out, done = hashes, 1, None, 0
    while width:
        if width & 1:
            out = runs if out is None else out[: len(runs) - done] * np.uint64(pow(_BASE, have, 1 << 64)) + runs[done:] if len(runs) > done else runs[:0]
            done += have
        width >>= 1
        if width:
            n = max(0, len(runs) - have)
            runs = mix(runs[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + runs[have : have + n])
            have *= 2
    return mix(out)

"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 1 << 24:
            return out
        _powers[base] = out
    return _powers[base][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit hash."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and where each text's words begin (one more entry at the end)."""
    data = b"\n".join(texts).lower()
    if not data:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[raw]
    turn = np.diff(inside)
    starts, ends = np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]
    hashes = hashed(data, starts, ends - starts)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def hashed(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, each of at least one byte.

    Blocks of eight bytes are mixed with their number before they are added up. A sum of powers over the bytes would be
    cheaper, but modulo 2^64 it is alike for words that follow the Thue-Morse sequence.
    """
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    last = starts + ((sizes - 1) & ~7)
    left = (sizes - 1 & 7) + 1
    tail = eight[last] << ((8 - left) * 8).astype(np.uint64)  # only the bytes of the word, the rest shifted out
    out = mix(tail + sizes.astype(np.uint64) * np.uint64(BASE), 11)
    more = np.nonzero(sizes > 8)[0]
    if len(more):
        blocks = (sizes[more] - 1) >> 3
        first = np.cumsum(blocks) - blocks
        k = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        parts = mix(mix(eight[np.repeat(starts[more], blocks) + 8 * k], 12) + k.astype(np.uint64), 13)
        out[more] = mix(out[more] + np.add.reduceat(parts, first), 14)
    return out


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct hashes, ascending, of each text's runs of so many words; of all its words where it has fewer; none without words."""
    hashes, at = words(texts)
    n = len(hashes)
    run = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        run[: max(0, n - k)] += hashes[k:] * np.uint64((BASE * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
    run = mix(run, 1)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            short = sum(int(h) * BASE * (2 * k + 1) for k, h in enumerate(hashes[a:b])) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([short], dtype=np.uint64), 1 + b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

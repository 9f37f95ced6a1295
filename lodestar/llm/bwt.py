"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement."""

from __future__ import annotations

import numpy as np


def shard(strings: list[np.ndarray], first: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of one shard by prefix doubling: string and position of each suffix, and the symbol before it.

    Symbols are 1 to ``symbols``; 0 stands for the end of any string. Ends differ by string and come first, in order.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(begins[-1], dtype=np.int64)
    for s, b in zip(strings, begins, strict=False):
        flat[b : b + len(s)] = s
    which = np.repeat(np.arange(len(strings)), sizes)
    rank = np.where(flat == 0, which, flat + len(strings))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(len(rank), dtype=np.int64)
        same = np.nonzero(which[: len(rank) - step] == which[step:])[0] if step < len(rank) else np.zeros(0, np.int64)
        after[same] = rank[same + step] + 1
        key = rank * (len(rank) + 2) + after
        values, new = np.unique(key, return_inverse=True)
        rank = new.astype(np.int64)
        if len(values) == len(rank):
            break
        step *= 2
    order = np.argsort(rank)
    before = np.where(order == begins[which[order]], 0, flat[np.maximum(order - 1, 0)])
    return which[order] + first, order - begins[which[order]], before


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """The order of numbers below 2^32, equal ones as they stand: numpy sorts 16 bits by counting, which two passes use."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and symbols.max() > 0xFFFF:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges transforms until suffixes are told apart by their first ``depth`` symbols, without sorting suffixes again.

    The interleave says which shard each suffix of the merged order comes from. Each round deals it anew by the symbols
    before the suffixes, keeping order, and so orders all suffixes by one more symbol. Where neighbours first differ gives
    their longest common prefix. Returns string and position of the suffixes in merged order, and the common prefix of each
    with the one before it (``depth`` where that is at least so much).
    """
    source = np.repeat(np.arange(len(shards)), [len(s[0]) for s in shards])
    ends = np.concatenate([s[2] for s in shards]) if shards else np.zeros(0, np.int64)
    strings = int(np.count_nonzero(ends == 0))
    place = np.zeros(len(source), dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum([len(s[0]) for s in shards])])
    top = np.repeat(np.arange(len(shards)), [int(np.count_nonzero(s[2] == 0)) for s in shards])
    common = np.full(len(source), depth, dtype=np.int64)
    block = np.zeros(len(source), dtype=np.int64)
    for h in range(1, depth + 1):
        symbols = np.empty(len(source), dtype=np.int64)
        for k, s in enumerate(shards):
            symbols[source == k] = s[2]
        order = stable_order(symbols)
        sorted_symbols, was = symbols[order], block[order]
        source = source[order]
        source[:strings] = top
        new = np.ones(len(source), dtype=bool)
        new[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (was[1:] != was[:-1])
        new[:strings] = True
        common[new & (common == depth)] = h - 1
        block = np.cumsum(new) - 1
    for k in range(len(shards)):
        own = source == k
        place[own] = offset[k] + np.arange(int(own.sum()))
    which, at = np.concatenate([s[0] for s in shards])[place], np.concatenate([s[1] for s in shards])[place]
    return which, at, common

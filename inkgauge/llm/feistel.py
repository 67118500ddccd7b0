"""Keyed permutations of 0 .. n-1, computed number by number."""

from __future__ import annotations

import numpy as np

from inkgauge.llm.lattice import scramble

ROUNDS = 6


def permute(values: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each of ``values`` (below n) goes: a Feistel network on the next even number of bits.

    A result of n or more goes through the network again until it falls below n, which keeps this a permutation;
    the network covers less than 4 n numbers, so that takes fewer than four turns on average.
    """
    if n <= 1:
        return np.zeros_like(np.asarray(values, np.int64))
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = scramble(np.arange(ROUNDS, dtype=np.uint64) + scramble(np.array([key % 2**64], np.uint64)))
    out = np.asarray(values, np.int64).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (scramble(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)

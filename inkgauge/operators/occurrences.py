"""Which of many passages of a text stand in it exactly once, answered for all of them together."""

from __future__ import annotations

import numpy as np

_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse among the 64-bit numbers
_BACK = pow(_STEP, -1, 2**64)
#: Fewer characters than this are searched directly.
_SMALL = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _found_again(text: str, passage: str, at: int) -> bool:
    return text.find(passage, at + len(passage)) >= 0


def occur_once(text: str, passages: list[str]) -> list[bool]:
    """For each passage whether it is found, and not found again behind its first place; never for an empty one.

    A few passages are searched one by one. Many are looked up in an index of the text: for every length among the
    passages the hashes of all stretches of that length come from one running sum, so a page costs its length times
    the number of different lengths, not times the number of passages. Hits are compared as text.
    """
    if len(text) * len(passages) <= _SMALL:
        first = [text.find(p) if p else -1 for p in passages]
        return [at >= 0 and not _found_again(text, p, at) for p, at in zip(passages, first)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_STEP, n), dtype=np.uint64)])
    back = _powers(_BACK, n + 1)
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(passages):
        if p and len(p) <= n:
            by_length.setdefault(len(p), []).append(i)
    out = [False] * len(passages)
    for size, those in by_length.items():
        hashes = (sums[size:] - sums[: n - size + 1]) * back[: n - size + 1]
        # A passage of the text is found through the places that share its hash.
        wanted: dict[int, list[int]] = {}
        for i in those:
            own = np.frombuffer(passages[i].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            wanted.setdefault(int((own * _powers(_STEP, size)).sum(dtype=np.uint64)), []).append(i)
        sieve = np.zeros(1 << 16, bool)
        sieve[np.array([h & 0xFFFF for h in wanted], np.int64)] = True
        places: dict[int, list[int]] = {}
        for at in np.flatnonzero(sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
            h = int(hashes[at])
            if h in wanted:
                known = places.setdefault(h, [])
                # The first place, and the first one behind it.
                if not known or (len(known) == 1 and at >= known[0] + size):
                    known.append(at)
        for h, own in wanted.items():
            for i in own:
                real = [at for at in places.get(h, []) if text.startswith(passages[i], at)]
                out[i] = len(real) == 1
    return out

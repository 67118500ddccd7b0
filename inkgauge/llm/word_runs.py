"""Runs of words: stretches in which a passage repeats back to back.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``LEAST`` words and 2 q long, and
no longer when a neighbour is added. Seen from the right, every word of it equals the word q before: a diagonal of lag
q in the table of a text against itself.

The words of a text are read once, from left to right, by a sparse dynamic programme over diagonals. The state is the
match length of each active lag; a word's earlier occurrences lengthen the lags they lie at and start new ones, and a
lag at which the words differ ends: if its length makes a run, the run is given out at once. Of lags that end together
and began together the smallest is the period, the others are its multiples.

To keep it sparse, an earlier occurrence starts a lag only if that can become a run: the words from there on must equal
those one lag before for max(lag, LEAST - lag) words. That is looked up in names of blocks: block lengths double,
equal blocks have equal names, blocks that occur once have none, and at each length only aligned blocks ask for their
earlier occurrences within reach. So a text in which no six words in a row recur never starts a lag, and any text of n
words takes O(n log n), one word repeated a million times included.

Defined cases: words are what stands between white space, whole texts; a null, empty or blank text has none and no
runs. Rows are independent, so repeated rows give repeated results. Empty tables give empty results. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkgauge.llm.common import whole_text

LEAST = 12
#: Different words a task remembers, pairs of equal blocks looked at together, words hashed together.
WORDS_HELD, PAIRS, CHUNK = 300_000, 1 << 20, 1 << 16
_SLICE = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordNumbers(dict):
    """Numbers of words in order of appearance, and the words by number."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def of(self, data: bytes) -> np.ndarray:
        """Word numbers of a text, a megabyte at a time."""
        out, begin = [], 0
        while begin < len(data):
            end = min(begin + _SLICE, len(data))
            while end < len(data) and data[end] not in _BLANK:
                end += 1
            words = data[begin:end].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
            begin = end
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int64)


def stuttered(ids: np.ndarray, doc_id: object) -> np.ndarray:
    """Places of the words that are read: for one document in ten a passage comes again and again to the end of the text."""
    n, at = len(ids), np.arange(len(ids))
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(at < a, at, a + (at - a) % p)


def _named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names from 1 on for pairs that occur more than once; 0 where a half has no name or the pair occurs once."""
    out = np.zeros(len(left), np.int64)
    alive = np.flatnonzero((left > 0) & (right > 0))
    if len(alive):
        key = left[alive] * (int(right.max()) + 1) + right[alive]
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        often = n > 1
        out[alive] = np.where(often, np.cumsum(often), 0)[inverse]
    return out


def block_names(ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(block length, name of the block at each place) for lengths 1, 3, 6, 12, ... while any block recurs."""
    n = len(ids)
    one = ids + 1
    if n < LEAST:
        return []
    names = [(1, one), (3, _named(_named(one[: n - 1], one[1:])[: n - 2], one[2:]))]
    while names[-1][1].any() and 2 * names[-1][0] <= n // 2:
        size, last = names[-1]
        names.append((2 * size, _named(last[: len(last) - size], last[size:])))
    return names


def _recurs(ids: np.ndarray) -> bool:
    """Whether six words in a row may occur twice (never false if they do)."""
    if len(ids) < LEAST:
        return False
    words = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    words ^= words >> np.uint64(29)
    rolled = words[: len(words) - 5].copy()
    for k in range(1, 6):
        rolled = rolled * _MIX + words[k : len(words) - 5 + k]
    rolled.sort()
    return bool((rolled[1:] == rolled[:-1]).any())


def _same(names: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether the block at each place has the name of the block one lag before; not where there is none."""
    inside = (at - lag >= 0) & (at < len(names))
    here = names[np.where(inside, at, 0)]
    return inside & (here > 0) & (here == names[np.where(inside, at - lag, 0)])


def _pairs(names: np.ndarray, size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Aligned blocks and the lags, from low to below high, at which they occurred before."""
    there = np.flatnonzero(names)
    if not len(there):
        return
    # Places in order of (name, place): the earlier occurrences within reach are neighbours.
    span = len(names) + 1
    key = np.sort(names[there] * span + there)
    anchors = there[there % size == 0]
    base = names[anchors] * span
    first = np.searchsorted(key, base + np.maximum(anchors - high + 1, 0))
    last = np.searchsorted(key, base + np.maximum(anchors - low + 1, 0))
    n = np.maximum(last - first, 0)
    begin = 0
    total = np.cumsum(n)
    while begin < len(anchors):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS)))
        own = n[begin:end]
        if own.any():
            at = np.repeat(anchors[begin:end], own)
            rank = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own - first[begin:end], own)
            yield at, at - key[rank] % span
        begin = end


def starts(ids: np.ndarray) -> list[tuple[int, int]]:
    """(place, lag), in order: where an earlier occurrence starts a lag that lasts long enough for a run."""
    levels, found, n = block_names(ids), [], len(ids)
    for k in range(1, len(levels)):
        size, names = levels[k]
        low, high = (1, LEAST) if k == 1 else (2 * size, 4 * size)
        if low > n // 2:
            break
        for at, lag in _pairs(names, size, low, high):
            # A lag is looked at where it meets its first aligned block, and followed back to its first word.
            new = ~_same(names, at - size, lag)
            at, lag = at[new], lag[new]
            back = at.copy()
            for shorter, those in [*reversed(levels[1:k]), levels[0], levels[0]]:
                back = np.where(_same(those, back - shorter, lag), back - shorter, back)
            need = np.maximum(lag, LEAST - lag)
            good = back + need <= n
            back, lag, need = back[good], lag[good], need[good]
            for step in range(4):
                same = _same(names, back + np.minimum(step * size, need - size), lag)
                back, lag, need = back[same], lag[same], need[same]
            found.append(np.stack([back, lag], axis=1))
    if not found:
        return []
    return sorted(map(tuple, np.concatenate(found).tolist()))


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if not _recurs(ids):
        return []
    waiting = starts(ids)
    if not waiting:
        return []
    words, n = ids.tolist(), len(ids)
    active: dict[int, int] = {}  # lag -> match length
    out, due, i = [], 0, 0
    while due < len(waiting) or active:
        if not active:
            i = waiting[due][0]
        ended = [lag for lag in active if i == n or words[i] != words[i - lag]]
        if ended:
            least: dict[int, int] = {}
            for lag in sorted(ended):
                length = active.pop(lag) + lag
                if length >= max(LEAST, 2 * lag):
                    least.setdefault(i - length, lag)
            out += [(start, i - start, lag) for start, lag in least.items()]
        for lag in active:
            active[lag] += 1
        while due < len(waiting) and waiting[due][0] == i:
            lag = waiting[due][1]
            due += 1
            # Within a run, multiples of its period say the same as the period.
            if not any(lag % q == 0 and i - m - q + 1 <= i - lag for q, m in active.items()):
                active[lag] = 1
        i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def word_runs(docs: DataFrame, stutter: bool = False) -> DataFrame:
    """Per row: doc_id, n_runs; start, length, period and exponent_milli of the longest run; digests of all runs and of
    the text without repetitions. ``stutter`` makes one text in ten repeat itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                if len(numbers) > WORDS_HELD:
                    numbers = WordNumbers()
                ids = numbers.of(text.as_py())
                if stutter:
                    ids = ids[stuttered(ids, doc_id.as_py())]
                found = runs(ids)
                kept = ids[~dropped(len(ids), found)] if found else ids
                listed, collapsed = hashlib.sha256(), hashlib.sha256()
                for r in found:
                    listed.update(b"%d,%d,%d\n" % r)
                for a in range(0, len(kept), CHUNK):
                    collapsed.update((b" " if a else b"") + b" ".join(map(numbers.words.__getitem__, kept[a : a + CHUNK].tolist())))
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                rows.append((len(found), *best, None if not found else 1000 * best[1] // best[2], listed.hexdigest(), collapsed.hexdigest()))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    )

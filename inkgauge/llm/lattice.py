"""All segmentations of words into the pieces of a given vocabulary, many words at once.

A unit is one or more spaces and the characters up to the next space; no piece crosses units, so a text is a row of
units and each different unit needs to be looked at once. The arrays here hold, for a list of units, every piece that
fits somewhere (an edge), and recursions over them run for all units together, one start position at a time.

A character that is no piece itself stands for its UTF-8 bytes, as byte pieces.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 19
#: Longer units are looked up all starts at once and summed one position after the other.
WIDE = 48
SPACE_MARK = "▁"
UNITS = re.compile(" *[^ ]+| +")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces by hash of their characters; every prefix of a piece is in the table too, with -1."""

    texts: list[str]
    scores: np.ndarray
    bytes_at: int
    keys: np.ndarray
    values: np.ndarray
    longest: int

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """From a sentencepiece model file; control pieces take no part."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
        n = model.get_piece_size()
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(n)]
        texts = [model.id_to_piece(i).replace(SPACE_MARK, " ") if plain[i] else "" for i in range(n)]
        first_byte = next(i for i in range(n) if model.is_byte(i))
        return cls.build(texts, np.array([model.get_score(i) for i in range(n)]), first_byte)

    @classmethod
    def build(cls, texts: list[str], scores: np.ndarray, bytes_at: int) -> Vocabulary:
        known: dict[int, int] = {}
        for i, text in enumerate(texts):
            h = 0
            for depth, c in enumerate(text):
                h = (h * int(_STEP) + ord(c) + 1) % 2**64
                if depth + 1 == len(text):
                    known[h] = i
                else:
                    known.setdefault(h, -1)
        keys, values = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, -1, np.int32)
        for h, i in known.items():
            slot = (h * int(_SPREAD) % 2**64) >> (64 - _BITS)
            while keys[slot]:
                slot = (slot + 1) % (1 << _BITS)
            keys[slot], values[slot] = h, i
        return cls(texts, scores, bytes_at, keys, values, max(map(len, texts)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix of a piece, and the piece it is, or -1."""
        slot = ((hashes * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)
        key = self.keys[slot]
        hit = key == hashes
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % (1 << _BITS)
            key = self.keys[slot[open_]]
            hit[open_] = key == hashes[open_]
            open_ = open_[~hit[open_] & (key != 0)]
        return hit, np.where(hit, self.values[slot], -1)

    def prior(self, shift: float = 10.0) -> np.ndarray:
        """Natural log probabilities from the scores the vocabulary brings.

        Scores of a merge vocabulary are minus ranks: they are read as Zipf's law over ranks. Scores that are log
        probabilities already are kept. Byte pieces share one rank beyond the last.
        """
        live = np.array([bool(t) for t in self.texts])
        ranks = np.where(live, -self.scores, 0)
        if ranks.max() > 100:
            usual = ranks[live & (ranks < 1e8)]
            top = usual.max() if len(usual) else 1.0
            logs = -np.log(np.where(ranks < 1e8, ranks, top) + shift)
        else:
            logs = self.scores.astype(float)
        logs[self.bytes_at : self.bytes_at + 256] = logs[live].min() if live.any() else 0.0
        live[self.bytes_at : self.bytes_at + 256] = True
        logs[~live] = -np.inf
        return logs - np.logaddexp.reduce(logs[live])


def bytes_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of code points: (n, 4) byte values and the number of them that count."""
    c = codes.astype(np.int64)
    n = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    out = np.zeros((len(c), 4), np.int64)
    for length, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        own = n == length
        for k in range(length):
            part = c[own] >> (6 * (length - 1 - k))
            out[own, k] = part | mark if k == 0 else (part & 0x3F) | 0x80
    return out, n


@dataclass
class Edges:
    """Edges of some units; ``groups`` lists, per start position, (rows, end, piece, weight) with no row twice."""

    units: np.ndarray
    lengths: np.ndarray
    groups: list[list[tuple[np.ndarray, int, np.ndarray]]]


def edges(vocabulary: Vocabulary, units: list[str]) -> list[Edges]:
    """Edges of all units, in blocks of like length. A piece of -1 - c stands for the bytes of character c."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(lengths, kind="stable")
    out, begin = [], 0
    bounds = [b for b in (6, 10, 16, 28, WIDE)]
    for i, bound in enumerate(bounds):
        end = int(np.searchsorted(lengths[order], bound, side="right"))
        if end > begin:
            out.append(_block(vocabulary, units, order[begin:end], lengths[order[begin:end]]))
        begin = end
    return out


def long_units(units: list[str]) -> list[int]:
    return [k for k, unit in enumerate(units) if len(unit) > WIDE]


def long_edges(vocabulary: Vocabulary, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of every edge of one unit, ordered by end."""
    codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, hashes, found = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
    for length in range(1, vocabulary.longest + 1):
        keep = starts + length <= len(codes)
        starts, hashes = starts[keep], hashes[keep]
        hashes = hashes * _STEP + codes[starts + length - 1].astype(np.uint64) + np.uint64(1)
        hit, piece = vocabulary.find(hashes)
        if length == 1 and (piece < 0).any():
            lacking = starts[piece < 0]
            found.append((lacking, lacking + 1, -1 - codes[lacking].astype(np.int64)))
        real = piece >= 0
        found.append((starts[real], starts[real] + length, piece[real].astype(np.int64)))
        starts, hashes = starts[hit], hashes[hit]
        if not len(starts):
            break
    start, end, piece = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((start, end))
    return start[order], end[order], piece[order]


def chain(start: np.ndarray, end: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The forward recursion over one unit's edges, ordered by end."""
    alpha = [0.0] + [-math.inf] * n
    for i, j, w in zip(start.tolist(), end.tolist(), weight.tolist()):
        x, y = alpha[j], alpha[i] + w
        if x < y:
            x, y = y, x
        alpha[j] = x + math.log1p(math.exp(y - x)) if y > -math.inf else x
    return np.array(alpha)


def _block(vocabulary: Vocabulary, units: list[str], own: np.ndarray, lengths: np.ndarray) -> Edges:
    width = int(lengths.max())
    codes = np.zeros((width + 1, len(own)), np.uint32)
    flat = np.frombuffer("".join([units[k] for k in own]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(own)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[at, row] = flat
    groups = []
    for i in range(width):
        rows = np.flatnonzero(lengths > i)
        first, hashes, found = rows, np.zeros(len(rows), np.uint64), []
        for end in range(i + 1, min(i + vocabulary.longest, width) + 1):
            hashes = hashes * _STEP + codes[end - 1, rows].astype(np.uint64) + np.uint64(1)
            hit, piece = vocabulary.find(hashes)
            real = np.flatnonzero(piece >= 0)
            if end == i + 1:
                lacking = np.flatnonzero(piece < 0)
                if len(lacking):
                    found.append((first[lacking], end, -1 - codes[i, first[lacking]].astype(np.int64)))
            if len(real):
                found.append((rows[real], end, piece[real].astype(np.int64)))
            alive = np.flatnonzero(hit & (lengths[rows] > end))
            if not len(alive):
                break
            rows, hashes = rows[alive], hashes[alive]
        groups.append(found)
    return Edges(own, lengths, groups)


def weights(vocabulary: Vocabulary, logs: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Log probability of edges; a character without a piece weighs what its bytes weigh."""
    if (piece >= 0).all():
        return logs[piece]
    out = logs[np.maximum(piece, 0)].astype(float)
    lacking = np.flatnonzero(piece < 0)
    values, n = bytes_of(-1 - piece[lacking])
    each = logs[vocabulary.bytes_at + values]
    out[lacking] = np.where(np.arange(4) < n[:, None], each, 0.0).sum(axis=1)
    return out


def forward(vocabulary: Vocabulary, logs: np.ndarray, block: Edges) -> np.ndarray:
    """alpha[i, row]: log of the summed probability of all segmentations of the first i characters."""
    alpha = np.full((int(block.lengths.max()) + 1, len(block.units)), -np.inf)
    alpha[0] = 0.0
    for i, found in enumerate(block.groups):
        for rows, end, piece in found:
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[i, rows] + weights(vocabulary, logs, piece))
    return alpha


def marginals(vocabulary: Vocabulary, logs: np.ndarray, units: list[str]) -> np.ndarray:
    """Natural log of each unit's probability over all its segmentations."""
    out = np.zeros(len(units))
    for block in edges(vocabulary, units):
        alpha = forward(vocabulary, logs, block)
        out[block.units] = alpha[block.lengths, np.arange(len(block.units))]
    for k in long_units(units):
        start, end, piece = long_edges(vocabulary, units[k])
        out[k] = chain(start, end, weights(vocabulary, logs, piece), len(units[k]))[-1]
    return out


def expected_counts(vocabulary: Vocabulary, logs: np.ndarray, units: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in ``times`` occurrences of the units, over all segmentations."""
    total = np.zeros(len(logs))

    def add(piece: np.ndarray, share: np.ndarray) -> None:
        nonlocal total
        real = piece >= 0
        total += np.bincount(piece[real], share[real], len(logs))
        if not real.all():
            values, k = bytes_of(-1 - piece[~real])
            there = np.arange(4) < k[:, None]
            total += np.bincount(vocabulary.bytes_at + values[there], np.repeat(share[~real], k), len(logs))

    for k in long_units(units):
        start, end, piece = long_edges(vocabulary, units[k])
        weight, n = weights(vocabulary, logs, piece), len(units[k])
        alpha = chain(start, end, weight, n)
        back = np.lexsort((-end, -start))
        beta = chain((n - end)[back], (n - start)[back], weight[back], n)[::-1]
        add(piece, times[k] * np.exp(alpha[start] + weight + beta[end] - alpha[-1]))
    for block in edges(vocabulary, units):
        alpha = forward(vocabulary, logs, block)
        width, everyone = alpha.shape[0], np.arange(len(block.units))
        beta = np.full_like(alpha, -np.inf)
        beta[block.lengths, everyone] = 0.0
        whole, n = alpha[block.lengths, everyone], times[block.units]
        for i in range(width - 2, -1, -1):
            for rows, end, piece in block.groups[i]:
                weight = weights(vocabulary, logs, piece)
                beta[i, rows] = np.logaddexp(beta[i, rows], weight + beta[end, rows])
                share = n[rows] * np.exp(alpha[i, rows] + weight + beta[end, rows] - whole[rows])
                add(piece, share)
    return total


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def scramble(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each number: the same for the same number, whatever stands around it."""
    x = (x + _STEP).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

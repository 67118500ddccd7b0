"""Sampled segmentations of texts into the pieces of a given vocabulary, and back.

Forward filtering: over the lattice of a unit (see ``lattice``), alpha(i) sums all segmentations of its first i
characters. Backward sampling: from the end, a piece that ends here is drawn with probability
alpha(start) p(piece) / alpha(end), until the start is reached; so a whole segmentation is drawn with its posterior
probability. The draws of a row come from its key, the place of the unit in the text and the step alone, so that a
row has the same segmentation in every run, on any partitioning, next to any other rows.

One space is put before the text, as these vocabularies expect, and taken off again; a literal space mark stands for
its bytes. Decoding gives every text back exactly.

Defined cases: a null text gives null ids and decodes to null; an empty text gives no ids. Rows with the same key and
text have the same segmentation; a null key is the key 0. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import lattice
from inkgauge.llm.lattice import Vocabulary

#: Units that are worked on at a time: bounds the memory of a task, not the texts.
UNITS_AT_A_TIME = 300_000
SEED = 2024
#: Probabilities are rounded to parts of this.
GRID = 2.0**24


def split_units(text: str) -> list[str]:
    """The units of a text without their first space; a mark within is set apart so that it becomes bytes."""
    if "  " not in text and not text.endswith(" "):
        return text.split(" ") if not text.startswith(" ") else [m[1:] for m in lattice.UNITS.findall(" " + text)]
    return [m[1:] for m in lattice.UNITS.findall(" " + text)]


class Sampler:
    """Draws segmentations of rows of units."""

    def __init__(self, vocabulary: Vocabulary, logs: np.ndarray, seed: int):
        self.vocabulary, self.logs = vocabulary, logs
        self.seed = lattice.scramble(np.array([seed], np.uint64))[0]

    def _states(self, units: list[str]):
        """Edges of all units by the state they end in: offset of each unit's states, start, piece, cumulative key."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        offset = np.cumsum(lengths + 1) - (lengths + 1)
        into, start, piece, share = [], [], [], []
        for block in lattice.edges(self.vocabulary, units):
            alpha = lattice.forward(self.vocabulary, self.logs, block)
            base = offset[block.units]
            for i, found in enumerate(block.groups):
                for rows, end, pieces in found:
                    into.append(base[rows] + end)
                    start.append(np.full(len(rows), i))
                    piece.append(pieces)
                    share.append(np.exp(alpha[i, rows] + lattice.weights(self.vocabulary, self.logs, pieces) - alpha[end, rows]))
        for k in lattice.long_units(units):
            begin, end, pieces = lattice.long_edges(self.vocabulary, units[k])
            weight = lattice.weights(self.vocabulary, self.logs, pieces)
            alpha = lattice.chain(begin, end, weight, len(units[k]))
            into.append(offset[k] + end)
            start.append(begin)
            piece.append(pieces)
            share.append(np.exp(alpha[begin] + weight - alpha[end]))
        into, start, piece, share = (np.concatenate(x) for x in (into, start, piece, share))
        order = np.argsort(into * 32 + start % 32)
        into, start, piece, share = into[order], start[order], piece[order], share[order]
        n_states = int(lengths.sum()) + len(units)
        first = np.searchsorted(into, np.arange(n_states + 1))
        # Sums within a state alone, on a grid of 2^-24: the draws of a unit do not depend on its neighbours.
        many = np.diff(first)
        for k in range(1, int(many.max())):
            further = first[:-1][many > k] + k
            share[further] += share[further - 1]
        last = first[1:][many > 0] - 1
        share = np.rint(share / np.repeat(share[last], many[many > 0]) * GRID) / GRID
        return offset, lengths, first, start, piece, into + share

    def draw(self, units: list[str], unit_of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all tokens one after the other, and how many each token has.

        ``unit_of`` is the unit of each token and ``keys`` a mixed 64-bit number of its row and place.
        """
        offset, lengths, first, start, piece, cumulative = self._states(units)
        token = np.argsort(unit_of, kind="stable")  # neighbours look up the same states
        base, at = offset[unit_of[token]], lengths[unit_of[token]]
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        mixed = keys[token]
        while len(token):
            mixed = lattice.scramble(mixed)
            state = base + at
            u = ((mixed >> np.uint64(40)).astype(np.float64) + 0.5) / GRID
            edge = np.searchsorted(cumulative, state + u)
            edge = np.clip(edge, first[state], first[state + 1] - 1)
            drawn.append((token, piece[edge]))
            at = start[edge]
            on = np.flatnonzero(at > 0)
            token, base, at, mixed = token[on], base[on], at[on], mixed[on]
        steps = np.zeros(len(unit_of), np.int64)
        for t, _ in drawn:
            steps[t] += 1
        end = np.cumsum(steps)
        out = np.empty(int(end[-1]) if len(end) else 0, np.int64)
        for k, (t, p) in enumerate(drawn):
            out[end[t] - 1 - k] = p
        if (out >= 0).all():
            return out, steps
        values, n = lattice.bytes_of(-1 - np.minimum(out, -1))
        n = np.where(out < 0, n, 1)
        wide = np.repeat(out, n)
        place = np.arange(len(wide)) - np.repeat(np.cumsum(n) - n, n)
        low = wide < 0
        wide[low] = self.vocabulary.bytes_at + np.repeat(values, n, axis=0)[low, place[low]]
        per_token = np.add.reduceat(n, end - steps) if len(end) else steps
        return wide, per_token

    def rows(self, texts: list[str | None], keys: list[int | None]) -> pa.Array:
        """One list of piece ids for each text."""
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        numbers, unit_of, row_of, place = lattice.Numbering(), [], [], []

        def flush() -> None:
            nonlocal numbers, unit_of, row_of, place
            if not unit_of:
                return
            own, rows_, where = np.concatenate(unit_of), np.concatenate(row_of), np.concatenate(place)
            mixed = lattice.scramble(np.array([(keys[r] or 0) & (2**64 - 1) for r in rows_.tolist()], np.uint64) ^ self.seed)
            mixed = lattice.scramble(mixed + where.astype(np.uint64))
            ids, per_token = self.draw([" " + u for u in numbers], own, mixed)
            parts.append(ids)
            sizes[: len(texts)] += np.bincount(rows_, per_token, len(texts)).astype(np.int64)
            numbers, unit_of, row_of, place = lattice.Numbering(), [], [], []

        held = 0
        for r, text in enumerate(texts):
            if not text:
                continue
            units = split_units(text)
            for k in range(0, len(units), UNITS_AT_A_TIME):
                some = units[k : k + UNITS_AT_A_TIME]
                unit_of.append(np.fromiter(map(numbers.__getitem__, some), np.int64, len(some)))
                row_of.append(np.full(len(some), r))
                place.append(np.arange(k, k + len(some)))
                held += len(some)
                if held >= UNITS_AT_A_TIME:
                    flush()
                    held = 0
        flush()
        values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        missing = np.array([t is None for t in texts], bool)
        return pa.LargeListArray.from_arrays(
            pa.array(offsets, pa.int64()), pa.array(values), mask=pa.array(missing) if len(missing) else None
        ).cast(pa.list_(pa.int32()))


def decode_table(vocabulary: Vocabulary) -> list[bytes]:
    table = [t.encode() for t in vocabulary.texts]
    for b in range(256):
        table[vocabulary.bytes_at + b] = bytes([b])
    return table


def decode_rows(table: list[bytes], ids: pa.Array) -> list[str | None]:
    """The texts that lists of ids stand for."""
    offsets = ids.offsets.to_pylist()
    values = ids.values.to_numpy(zero_copy_only=False)
    out: list[str | None] = []
    for valid, a, b in zip(ids.is_valid().to_pylist(), offsets, offsets[1:]):
        out.append(b"".join(map(table.__getitem__, values[a:b].tolist())).decode()[1:] if valid else None)
    return out


def encode(docs: DataFrame, vocabulary: str | None = None, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """key, ids (sampled segmentation of the whole text), n_ids and lossless (decoding gave the text back)."""
    spark = docs.sparkSession
    loaded = Vocabulary.load(vocabulary)
    shared = spark.sparkContext.broadcast((loaded, loaded.prior()))  # one entry per piece, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_, logs = shared.value
        sampler, table = Sampler(vocabulary_, logs, seed), decode_table(vocabulary_)
        for batch in batches:
            texts, begin = batch.column("text").to_pylist(), 0
            keys = batch.column("seed").to_pylist()
            while begin < len(texts):
                # Rows go on in groups of bounded length, so output batches are bounded too.
                end, size = begin, 0
                while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= 3_000_000):
                    size += len(texts[end] or "") + 1
                    end += 1
                ids = sampler.rows(texts[begin:end], keys[begin:end])
                same = [a == b for a, b in zip(decode_rows(table, ids), texts[begin:end])]
                counts = pa.compute.list_value_length(ids).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(begin, end - begin), ids, counts, pa.array(same, pa.bool_())],
                    names=["key", "ids", "n_ids", "lossless"],
                )
                begin = end

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("long").alias("seed"), F.col("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, n_ids bigint, lossless boolean").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """key and text of every row of ``encode``."""
    loaded = Vocabulary.load(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast(loaded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(shared.value)
        for batch in batches:
            ids = batch.column("ids").cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(decode_rows(table, ids), pa.string())], names=["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

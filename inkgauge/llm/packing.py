"""Best-fit packing of tokenised documents into sequences of one length.

A document is its tokens and one end token. What is longer than a sequence is cut from the back into whole sequences,
so only its first piece may be shorter. Pieces are packed best-fit decreasing: the longest first, each into the open
sequence with the least room that still takes it, or into a new one.

Only lengths matter for that, and there are as many as a sequence has places. So the packing is planned on the count
of each length: a segment tree over the remaining capacities finds the tightest open sequences of a piece in
logarithmic time, and pieces of one length that meet sequences of one capacity are placed together. The result is the
same as document by document, whatever the size of the corpus. The plan is at most about a hundred thousand moves
(a length splits at most two ranges of sequences and opens two, and each visit of a range at least halves its room),
so it is broadcast; pieces are numbered by one sort on length and find their move by that number.

Defined cases: a null or empty text is the end token alone; pieces of one length are ordered by doc_id (null last),
so the packing does not depend on how files are split; repeated rows are packed again; an empty table gives an empty
result. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import stage, whole_text

LENGTH, END = 2048, 0
#: Different units and their tokens that a task remembers; characters that are looked at together.
UNITS_HELD, TOKENS_HELD, SLICE = 1_000_000, 8_000_000, 1 << 20
#: A unit is white space and what follows it: no token of a byte-level vocabulary goes on from other characters into white space.
_AS_IS = "\0"
_UNIT, _DOUBLE = re.compile(r"\s*\S+|\s+"), re.compile(r"\s\s")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Numbered(dict):
    """Units by number, in order of appearance."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class UnitTokenizer:
    """Token ids of whole texts; each different unit is tokenised once and then remembered."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        self.model = Tokenizer.from_str(definition)
        # Bytes that a token stands for: one character of its name each.
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, i in vocabulary.items():
            self.widths[i] = len(name)
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbered()
        self.places, self.flat = np.zeros((0, 2), np.int64), np.zeros(0, np.uint32)  # of each unit: first token, number

    def _learn(self) -> None:
        """Tokenise the units that are new: one by one what cannot follow another unit, the others in texts of many units,
        where the width of each token in bytes tells whose it is."""
        new = list(islice(self.numbers, len(self.places), None))
        if not new:
            return
        spaced = np.array([u[0] != _AS_IS for u in new])
        inner = new if spaced.all() else [u for u, s in zip(new, spaced) if s]
        texts = [" " + " ".join(inner[k : k + 128]) for k in range(0, len(inner), 128)]
        encoded = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(encoded), np.uint32, sum(map(len, encoded)))
        unit_ends = np.cumsum(np.fromiter(map(len, map(str.encode, inner)), np.int64, len(inner)) + 1)
        ends = np.searchsorted(np.cumsum(self.widths[ids]), unit_ends, side="right")
        alone = [e.ids for e in self.model.encode_batch([u[1:] for u, s in zip(new, spaced) if not s], add_special_tokens=False)]
        n, first = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        n[spaced] = np.diff(ends, prepend=0)
        n[~spaced] = list(map(len, alone))
        first[spaced] = ends - n[spaced]
        first[~spaced] = len(ids) + np.cumsum(n[~spaced]) - n[~spaced]
        self.places = np.concatenate([self.places, np.stack([first + len(self.flat), n], axis=1)])
        self.flat = np.concatenate([self.flat, ids, np.fromiter(chain.from_iterable(alone), np.uint32, int(n[~spaced].sum()))])

    def _of_slices(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > UNITS_HELD or len(self.flat) > TOKENS_HELD:
            self._forget()
        number = self.numbers.__getitem__
        numbered = [np.fromiter(map(number, u), np.int64, len(u)) for u in map(_units, texts)]
        self._learn()
        out = []
        for own in numbered:
            at, n = self.places[own].T
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + n, n)])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; together the texts should have about ``SLICE`` characters, but one may be longer."""
        if max(map(len, texts), default=0) <= SLICE:
            return self._of_slices(texts)
        return [np.concatenate([self._of_slices([part])[0] for part in _slices(text)]) if len(text) > SLICE else self._of_slices([text])[0] for text in texts]


def _units(text: str) -> list[str]:
    """A unit that begins with a single space is named without it, any other with a mark in front."""
    if not text:
        return []
    if _DOUBLE.search(text) or _AS_IS in text or text[0].isspace() or text[-1].isspace():
        return [
            u[1:] if u[0] == " " and len(u) > 1 and not u[1].isspace() and u[1] != _AS_IS else _AS_IS + u for u in _UNIT.findall(text)
        ]
    # Every space stands alone between other characters.
    units = text.split(" ")
    units[0] = _AS_IS + units[0]
    return units


def _slices(text: str) -> Iterator[str]:
    held, size = [], 0
    for unit in _UNIT.finditer(text):
        held.append(unit[0])
        size += len(unit[0])
        if size >= SLICE:
            yield "".join(held)
            held, size = [], 0
    if held:
        yield "".join(held)


def _batched(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer_file: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    with open(tokenizer_file or default_tokenizer(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, about 1.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = UnitTokenizer(shared.value)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for k, own in enumerate(chain.from_iterable(map(model.encode, _batched(texts)))):
                ids = np.append(own, np.uint32(end)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    piece.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


class OpenSequences:
    """Ranges of sequence numbers by remaining capacity, and a segment tree over the capacities that have any."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.any = np.zeros(2 * self.width, bool)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` with an open sequence."""
        tree, node = self.any, least + self.width
        if tree[node]:
            return least
        # Up to the first right neighbour that has some, then down to its leftmost leaf.
        while node > 1:
            if node % 2 == 0 and tree[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.width:
            node = 2 * node + (not tree[2 * node])
        return node - self.width

    def _mark(self, capacity: int) -> None:
        node = capacity + self.width
        self.any[node] = bool(self.ranges[capacity])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def put(self, capacity: int, first: int, n: int) -> None:
        if capacity and n:
            self.ranges[capacity].append((first, n))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        got = self.ranges[capacity].pop()
        self._mark(capacity)
        return got


def plan(counts: dict[int, int], length: int = LENGTH) -> np.ndarray:
    """Best-fit decreasing for ``counts[n]`` pieces of n tokens. Columns of a move, by number of the first piece in
    descending order of length: that number, first sequence, pieces per sequence, offset of the first, length."""
    open_, moves, number, fresh = OpenSequences(length), [], 0, 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            capacity = open_.tightest(size)
            if capacity is None:
                # New sequences; the plan needs as many as the pieces left do.
                capacity, per = length, length // size
                first, n = fresh, -(-left // per)
                fresh += n
            else:
                per = capacity // size
                first, n = open_.take(capacity)
            # A sequence that took one piece is tighter than before: it takes pieces until no more fit.
            full = min(n, left // per)
            if full:
                moves.append((number, first, per, length - capacity, size))
                number, left = number + full * per, left - full * per
                open_.put(capacity - per * size, first, full)
            rest = n - full
            if rest and left:
                moves.append((number, first + full, left, length - capacity, size))
                open_.put(capacity - left * size, first + full, 1)
                number, left, rest, full = number + left, 0, rest - 1, full + 1
            open_.put(capacity, first + full, rest)
    return np.array(moves, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_file: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, tokenizer_file, length, end).withColumn("place", F.monotonically_increasing_id()), "pieces")
    # At most one row per length.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.desc("length"), F.asc_nulls_last("doc_id"), "piece", "start", "ids_crc32", "place"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64())],
                names=[*batch.schema.names, "part", "at"],
            )
            at += n

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    listed = stage(
        cut.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).mapInArrow(number, f"{fields}, part int, at bigint"), "numbered-pieces"
    )
    # One row per writing task: where its numbers begin.
    parts = sorted((r["part"], r["n"]) for r in listed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    begins = np.zeros(max([p for p, _ in parts], default=0) + 1, np.int64)
    for (part, _), before in zip(parts, np.cumsum([0] + [n for _, n in parts]).tolist()):
        begins[part] = before
    shared = spark.sparkContext.broadcast((begins, plan(counts, length)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, moves = shared.value
        for batch in batches:
            number = begins[batch.column("part").to_numpy()] + batch.column("at").to_numpy()
            move = moves[np.searchsorted(moves[:, 0], number, side="right") - 1]
            k = number - move[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(move[:, 1] + k // move[:, 2], pa.int64()), pa.array(move[:, 3] + k % move[:, 2] * move[:, 4], pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    return listed.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")

"""Product codes of vectors, with distances read from dictionaries of values.

Components become integers, floor(``SCALE`` * x), and vectors are cut into ``PARTS`` equal parts. Each part position has
a codebook: it starts as that part of the vectors with the smallest ids, and each of ``ROUNDS`` rounds assigns every
part to its nearest entry and moves each entry to the floor of its parts' mean.

Integers repeat. So each dimension of a block of vectors gets a dictionary of its different integers, the squared
difference of every one of them to the dimension's value in all entries is tabulated once, and the distances of a part
are sums of table rows picked by dictionary code: gathers and adds, no multiplication per vector. A table has one row
per different integer of a block, so its size is bounded by the block.

A round moves sums only: each task adds up its parts by entry, the sums of all tasks are added before they come to the
driver, and what comes is one number per codebook cell. All arithmetic is on integers: any grouping gives one result.

Defined cases: rows without a vector, or with a null or non-finite component, are left out. All others are returned;
a vector whose length is not that of the first one (by id) with a multiple of PARTS components has no code and no
error. Seeds with equal ids are ordered by their components, a null id comes last; fewer rows than ``ENTRIES`` give
as many entries. Integers beyond +-``MOST`` count as +-MOST, which keeps every sum in 64 bits. A null label is a label
of its own. Repeated rows are rows of their own. An empty table gives an empty result. Columns other than vec_id,
embedding and label are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import stage

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
MOST, BLOCK = 1 << 24, 8192


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and vector (array of integers) of the rows with whole finite vectors."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return vectors.where(F.col("embedding").isNotNull() & sound).select("vec_id", "label", whole.alias("vector"))


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different integers in order, and the place of each component among them."""
    low = int(column.min())
    span = int(column.max()) - low + 1
    if span > 4 * len(column):
        return np.unique(column, return_inverse=True)
    there = np.zeros(span, bool)
    there[column - low] = True
    return np.flatnonzero(there) + low, (np.cumsum(there) - 1)[column - low]


def nearest(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (row, part) and squared distance summed over parts; ``codebooks``: (part, entry, place within the part)."""
    parts, entries, size = codebooks.shape
    codes, error = np.empty((len(block), parts), np.int64), np.zeros(len(block), np.int64)
    for p in range(parts):
        tables = []
        for k in range(size):
            values, code = dictionary(block[:, p * size + k])
            tables.append(((values[:, None] - codebooks[p, :, k]) ** 2, code))
        narrow = sum(int(t.max()) for t, _ in tables) < 2**31
        total = None
        for table, code in tables:
            picked = (table.astype(np.int32) if narrow else table)[code]
            total = picked if total is None else np.add(total, picked, out=total)
        # The first of equal distances is the lower entry.
        codes[:, p] = total.argmin(axis=1)
        error += total[np.arange(len(block)), codes[:, p]]
    return codes, error


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches, which of their rows have the width, and those rows' vectors."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            own = batch.slice(begin, BLOCK)
            fits = np.asarray(own.column("fits"))
            rows = own.column("vector").filter(own.column("fits"))
            yield own, fits, rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def moved(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries that no part chose stay."""
    parts, entries, size = codebooks.shape
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums = np.zeros((parts, entries, size + 1), np.int64)
        for _, _, block in _blocks(batches, parts * size):
            if len(block):
                codes, _ = nearest(block, books)
                for p in range(parts):
                    np.add.at(sums[p, :, size], codes[:, p], 1)
                    for k in range(size):
                        np.add.at(sums[p, :, k], codes[:, p], block[:, p * size + k])
        real = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(real, pa.int32()), pa.array(sums.ravel()[real], pa.int64())], names=["cell", "total"])

    added = vectors.select("vector", "fits").mapInArrow(run, "cell int, total bigint").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros(parts * entries * (size + 1), np.int64)
    sums[added.column("cell").to_numpy()] = added.column("total").to_numpy()
    sums = sums.reshape(parts, entries, size + 1)
    n = sums[:, :, size:]
    return np.where(n > 0, sums[:, :, :size] // np.maximum(n, 1), codebooks)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label, code (two hex digits a part) and error of every kept row; and the codebooks."""
    kept = stage(integers(vectors, scale), "integers")
    order = [F.asc_nulls_last("vec_id"), "vector"]
    whole = (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    first = kept.where(whole).orderBy(*order).select(F.size("vector").alias("n")).first()
    if first is None:
        none = F.lit(None)
        return kept.select("vec_id", "label", none.cast("string").alias("code"), none.cast("bigint").alias("error")), None
    width = first["n"]
    fitting = kept.withColumn("fits", F.size("vector") == width)
    # At most ``entries`` rows.
    seeds = np.array([r["vector"] for r in fitting.where("fits").orderBy(*order).limit(entries).select("vector").collect()], np.int64)
    codebooks = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        codebooks = moved(fitting, codebooks)
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, fits, block in _blocks(batches, width):
            code, error = np.full(own.num_rows, None, object), np.zeros(own.num_rows, np.int64)
            if len(block):
                codes, error[fits] = nearest(block, shared.value)
                text = codes.astype(np.uint8).tobytes().hex()
                code[fits] = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays(
                [own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=~fits)],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return fitting.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), codebooks


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    rows, codebooks = compress(vectors, **options)
    rows = stage(rows, "codes")
    numbers = "" if codebooks is None else ",".join(map(str, codebooks.ravel().tolist()))
    # Sums are made before the exchange; the join has one on both sides, so that a frequent label can be split.
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256")
    )

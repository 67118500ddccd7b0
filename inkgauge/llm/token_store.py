"""Training order on disk: token sequences of one length, permuted as a whole, in files of one stride.

Texts are tokenised with a given vocabulary (each different unit once per task at a time), an end token is put behind
each text, and a task's tokens are cut into sequences of ``LENGTH``; the last one of a task is filled with end tokens.
Sequences are numbered through all tasks, and a keyed Feistel permutation with cycle-walking gives each number its
slot: every slot from 0 to n - 1 once, computed from the key alone, without sorting. Shard s holds the slots from
s * PER_SHARD on, one after the other, 16 bits a token: slot t starts at byte (t - first) * stride. A reader goes on at
any slot by seeking there.

Tokens move twice, compressed both times: into the numbered table, and to the shard that writes them. A shard is a
bounded piece of work; a retried task writes the same bytes and puts them in place by renaming.

Defined cases: a null or empty text is one end token; repeated rows are stored again; no rows, no shards. Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgauge.llm import lattice
from inkgauge.llm.common import shuffle_partitions, stage, whole_text
from inkgauge.llm.feistel import permute
from inkgauge.llm.piece_sampling import split_units
from inkgauge.session import fresh_path

LENGTH, PER_SHARD, KEY = 2048, 4096, 11
#: Tokens of a block of the numbered table, and different units that a task remembers.
BLOCK, HELD = 1 << 21, 300_000


class Tokeniser:
    """Ids of whole texts from a sentencepiece model, unit by unit."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.end = self.model.eos_id()
        self.space = self.model.piece_to_id(lattice.SPACE_MARK)
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.lengths, self.flat, self.known = lattice.Numbering(), np.zeros(0, np.int64), np.zeros(0, np.uint16), 0

    def encode(self, texts: list[str]) -> np.ndarray:
        """Tokens of the texts, each followed by the end token."""
        if self.known > HELD:
            self._forget()
        units = [split_units(t) if t else [] for t in texts]
        number = self.numbers.__getitem__
        own = [np.fromiter(map(number, u), np.int64, len(u)) for u in units]
        if len(self.numbers) > self.known:
            new = list(self.numbers)[self.known :]
            # The model puts a space before each unit, but not before nothing: that unit is one space.
            fresh = [f if u else [self.space] for u, f in zip(new, self.model.encode(new, num_threads=1))]
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            ids = np.fromiter((i for f in fresh for i in f), np.uint16, int(sizes.sum()))
            self.lengths, self.flat = np.concatenate([self.lengths, sizes]), np.concatenate([self.flat, ids])
            self.known = len(self.numbers)
        starts = np.cumsum(self.lengths) - self.lengths
        out = []
        for u in own:
            n = self.lengths[u]
            total = int(n.sum())
            at = np.arange(total) - np.repeat(np.cumsum(n) - n - starts[u], n)
            out += [self.flat[at], np.array([self.end], np.uint16)]
        return np.concatenate(out) if out else np.zeros(0, np.uint16)


def numbered_sequences(docs: DataFrame, model_file: str | None = None, length: int = LENGTH) -> DataFrame:
    """part, first, n, tokens: blocks of sequences numbered within each part (a task of the reading)."""
    with open(model_file or lattice.default_vocabulary(), "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser, pack = Tokeniser(model.value), zstandard.ZstdCompressor(3)
        part, first, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, held, size
            tokens = np.concatenate(held) if held else np.zeros(0, np.uint16)
            whole = len(tokens) // length * length
            if last and whole < len(tokens):
                tokens = np.concatenate([tokens, np.full(whole + length - len(tokens), tokeniser.end, np.uint16)])
                whole = len(tokens)
            for a in range(0, whole, BLOCK // length * length):
                block = tokens[a : min(a + BLOCK // length * length, whole)]
                n = len(block) // length
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                     pa.array([pack.compress(block.tobytes())], pa.binary())],
                    names=["part", "first", "n", "tokens"],
                )
                first += n
            held, size = [tokens[whole:]], len(tokens) - whole

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 200):
                held.append(tokeniser.encode(texts[k : k + 200]))
                size += len(held[-1])
                if size >= BLOCK:
                    yield from out(False)
        yield from out(True)

    return stage(docs.select(whole_text().alias("text")).mapInArrow(run, "part int, first bigint, n bigint, tokens binary"), "sequences")


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, folder: str, model_file: str | None = None, length: int = LENGTH,
                 per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards and returns one row for each: shard, path, first_slot, n_sequences, stride, n_bytes, sha256.

    ``folder`` must be one that all executors share.
    """
    spark = docs.sparkSession
    blocks = numbered_sequences(docs, model_file, length)
    # One row per reading task: where its numbers begin.
    parts = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, total = {}, 0
    for part, n in parts:
        base[part] = total
        total += n
    shared = spark.sparkContext.broadcast(base)
    row_bytes = 2 * length

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(unpack.decompress(row["tokens"]), np.uint8).reshape(row["n"], row_bytes)
                slot = permute(shared.value[row["part"]] + row["first"] + np.arange(row["n"]), total, key)
                order = np.argsort(slot)
                slot = slot[order]
                shard, begin = np.unique(slot // per_shard, return_index=True)
                ends = [*begin[1:].tolist(), len(slot)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int64()),
                     pa.array([(slot[a:b] % per_shard).astype(np.uint32).tobytes() for a, b in zip(begin, ends)], pa.binary()),
                     pa.array([pack.compress(tokens[order[a:b]].tobytes()) for a, b in zip(begin, ends)], pa.binary())],
                    names=["shard", "places", "tokens"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        unpack, attempt = zstandard.ZstdDecompressor(), TaskContext.get().taskAttemptId()

        def close(shard: int, content: np.ndarray) -> pa.RecordBatch:
            name, data = f"{root}/shard-{shard:08d}.bin", content.tobytes()
            with files.open_output_stream(f"{name}.{attempt}") as out:
                out.write(data)
            files.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": f"{folder}/shard-{shard:08d}.bin", "first_slot": shard * per_shard, "n_sequences": len(content),
                  "stride": row_bytes, "n_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}],
                schema=schema,
            )

        schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()),
                            ("stride", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
        current, content = None, None
        for batch in batches:
            for shard, places, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    if current is not None:
                        yield close(current, content)
                    current = shard
                    content = np.zeros((min(per_shard, total - shard * per_shard), row_bytes), np.uint8)
                at = np.frombuffer(places, np.uint32)
                content[at] = np.frombuffer(unpack.decompress(tokens), np.uint8).reshape(len(at), row_bytes)
        if current is not None:
            yield close(current, content)

    n_tasks = max(1, min(-(-total // per_shard), 4 * shuffle_partitions(spark)))
    dealt = blocks.mapInArrow(deal, "shard bigint, places binary, tokens binary")
    return dealt.repartition(n_tasks, "shard").sortWithinPartitions("shard").mapInArrow(
        write, "shard bigint, path string, first_slot bigint, n_sequences bigint, stride bigint, n_bytes bigint, sha256 string"
    )


def read_sequences(manifest: list, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences from slot ``start`` on, in training order; ``manifest``: rows of ``write_shards``, or some of them."""
    left = count if count is not None else 2**62
    for row in sorted(manifest, key=lambda r: r["first_slot"]):
        begin = max(start - row["first_slot"], 0)
        if left <= 0 or begin >= row["n_sequences"]:
            continue
        files, path = _files(row["path"])
        with files.open_input_file(path) as f:
            f.seek(begin * row["stride"])
            for _ in range(min(left, row["n_sequences"] - begin)):
                yield np.frombuffer(f.read(row["stride"]), np.uint16)
                left -= 1


def materialise(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Shards of a table in a new folder below the shared one."""
    return stage(write_shards(docs, fresh_path(spark, "shards")), "manifest")

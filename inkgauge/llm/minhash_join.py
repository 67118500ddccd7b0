"""Near duplicates by an inverted join on the coordinates of MinHash signatures.

Every document has its set of five-word shingles (64-bit hashes) and a signature of ``COORDINATES`` minima; it is
posted under (coordinate, value). Two sets of a similarity of 0.85 agree in 54 of 64 coordinates on average; a pair
is looked at only if it agrees in ``MATCHES``, which a pair at the limit misses less than once in ten thousand times.

Before that, documents that cannot reach MATCHES with anybody go: cut into COORDINATES - MATCHES + 1 runs, two
signatures with that many agreements agree in all of at least one run, so whoever shares no whole run is left alone.

Prefix: pairs that agree in MATCHES of COORDINATES meet in at least one of the COORDINATES - MATCHES + 1 rarest
coordinate-value pairs of each, under any one order of rareness, so only those are posted. Rareness is counted in a
table of fixed size (``BUCKETS``). Skip: the long lists that are left out are never merged; the collisions in them are
counted afterwards, by comparing the two signatures.

A list is never multiplied out. In each of ``ROUNDS`` rounds a list's members meet one of them, its pivot: first the one
that stands in most lists, as what others were copied from does, then the first by a hash. Both orders are the same in
all lists, so lists with the same members agree, and a group of thousands of near copies costs about a pair a member and
round. What proves alike becomes one component; rounds end as soon as no list has members of several components. What
then still stands in such lists is joined exactly, without the pairs tested before, by the rarest shingles of the full
sets: sets of
sizes n and m with the wanted overlap o share one of the rarest n - o + 1 and m - o + 1, and the places at which they
share it bound the overlap, as does a sketch of each set (parities of its shingles in ``PARITIES`` cells: two sets differ
in as many shingles at least as their sketches differ in cells). Near copies that differ by more than the limit do so by shingles of their own, which
stand first, so they don't meet. No pair that the coordinates find is given up.

Links are confirmed on full shingle sets. Documents with equal sets are one class from the start.

Defined cases: words are what stands between white space, A-Z in lower case; fewer than five words are one shingle;
a null, empty or blank text has no shingles and links with nothing. Repeated rows get equal results. A null doc_id
counts as larger than any other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import stage, whole_text, with_row_id
from inkgauge.llm.components import components
from inkgauge.llm.lattice import scramble
from inkgauge.llm.text_slices import lower_words

SHINGLE = 5
COORDINATES, MATCHES = 64, 43
BUCKETS = 1 << 18
TOKEN_BUCKETS = 1 << 20
ROUNDS = 2
PARITIES = 256
SIMILAR = 85
_P = np.uint64(0x9E3779B97F4A7C15)
_MUL = scramble(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = scramble(np.arange(1001, COORDINATES + 1001, dtype=np.uint64))
_WORDS_HELD = 300_000
#: Two classes and the components they are in so far.
_PAIR = ["a", "b", "own_a", "own_b"]
_SKETCH = [f"sketch{k}" for k in range(PARITIES // 64)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(data: bytes, hashes: WordHashes) -> np.ndarray:
    """The different shingles of a text, as sorted 64-bit hashes."""
    parts = [np.fromiter(map(hashes.__getitem__, some), np.uint64, len(some)) for some in lower_words(data)]
    if len(hashes) > _WORDS_HELD:
        hashes.clear()
    words = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(words):
        return words
    n = min(SHINGLE, len(words))
    rolled = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        rolled = rolled * _P + scramble(words[k : len(words) - n + 1 + k])
    return np.unique(scramble(rolled + np.uint64(n)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set (none of them empty): the low 32 bits of each coordinate's least hash."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], starts) & np.uint64(0xFFFFFFFF)
    return out


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(7), text).alias("key2")]


def _sketched(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Per row: the columns to keep, doc_id, key1, key2, n_shingles, digest of the shingle set, signature (null without shingles)."""
    rows = docs.select(*keep, "doc_id", whole_text().alias("text")).select(*keep, "doc_id", *_text_key(F.col("text")), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts, begin = batch.column("text"), 0
            while begin < batch.num_rows:
                sets, held = [], 0
                while begin + len(sets) < batch.num_rows and held < 200_000:
                    sets.append(shingles(texts[begin + len(sets)].as_py(), hashes))
                    held += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = signatures([sets[i] for i in full]) if full else None
                found: list[bytes | None] = [None] * len(sets)
                for row, i in enumerate(full):
                    found[i] = signed[row].tobytes()
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                own = batch.slice(begin, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(c) for c in keep], own.column("doc_id"), own.column("key1"), own.column("key2"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digests, pa.binary()), pa.array(found, pa.binary())],
                    names=[*keep, "doc_id", "key1", "key2", "n_shingles", "digest", "signature"],
                )
                begin += len(sets)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep) + f"doc_id {kind}, key1 bigint, key2 bigint, n_shingles bigint, digest binary, signature binary"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _elements(signed: np.ndarray) -> np.ndarray:
    return (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) | signed.astype(np.uint64)


def _runs(classes: DataFrame, matches: int) -> DataFrame:
    """run (hash of the values of one run of coordinates) and id: COORDINATES - matches + 1 rows per class."""
    bounds = [part[0] for part in np.array_split(np.arange(COORDINATES), COORDINATES - matches + 1)] + [COORDINATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            elements, keys = _elements(_matrix(batch.column("signature"))), []
            for low, high in zip(bounds, bounds[1:]):
                key = scramble(elements[:, low])
                for k in range(low + 1, high):
                    key = scramble(key ^ elements[:, k])
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).astype(np.int64), pa.int64()), pa.array(np.tile(batch.column("id").to_numpy(), len(keys)), pa.int64())],
                names=["run", "id"],
            )

    return classes.select("id", "signature").mapInArrow(run, "run bigint, id bigint")


def _in_company(classes: DataFrame, matches: int) -> DataFrame:
    """The classes that share a whole run of coordinates with another one."""
    runs = stage(_runs(classes, matches), "runs")
    shared = runs.groupBy("run").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("run")
    return classes.join(stage(runs.join(shared, "run").select("id").distinct(), "company"), "id")


def _rareness(classes: DataFrame) -> np.ndarray:
    """How many classes are posted in each bucket: BUCKETS numbers, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((scramble(_elements(_matrix(batch.column(0)))).ravel() % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        real = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(real, pa.int32()), pa.array(total[real], pa.int64())], names=["bucket", "n"])

    sums = classes.select("signature").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS, np.int64)
    total[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return total


def _postings(classes: DataFrame, prefix: int) -> DataFrame:
    """element, id, n_shingles: every class under the rarest ``prefix`` of its coordinate-value pairs."""
    shared = classes.sparkSession.sparkContext.broadcast(_rareness(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rareness = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 4000):
                own = batch.slice(begin, 4000)
                elements = _elements(_matrix(own.column("signature")))
                mixed = scramble(elements)
                order = (np.minimum(rareness[(mixed % np.uint64(BUCKETS)).astype(np.int64)], 2**30).astype(np.uint64) << np.uint64(32)) | (mixed >> np.uint64(32))
                rarest = np.argpartition(order, prefix - 1, axis=1)[:, :prefix]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.take_along_axis(elements, rarest, 1).ravel().astype(np.int64), pa.int64()),
                     pa.array(np.repeat(own.column("id").to_numpy(), prefix), pa.int64()),
                     pa.array(np.repeat(own.column("n_shingles").to_numpy(), prefix), pa.int64())],
                    names=["element", "id", "n"],
                )

    return classes.select("id", "n_shingles", "signature").mapInArrow(run, "element bigint, id bigint, n bigint")


def _enough_matches(pairs: DataFrame, signed: DataFrame, matches: int) -> DataFrame:
    """Those of the pairs (a, b, own_a, own_b) whose signatures agree in enough coordinates, counted over all of them."""
    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(
        signed.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).sum(axis=1) >= matches
                yield batch.select(_PAIR).filter(pa.array(same))

    return both.select(*_PAIR, "sa", "sb").mapInArrow(run, ", ".join(f"{c} bigint" for c in _PAIR))


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and shingles (bytes of sorted hashes) of the wanted classes, from the whole text of one row of each."""
    text = whole_text()
    rows = docs.select(F.col("doc_id"), *_text_key(text), text.cast("binary").alias("text"))
    no_id = F.lit(-(2**63))
    rows = rows.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), no_id)).drop("doc_id")
    keys = wanted.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), no_id)).select("id", "place", "key1", "key2")
    found = rows.join(keys, ["place", "key1", "key2"]).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                own = batch.slice(begin, 500)
                sets = [shingles(t.as_py(), hashes).tobytes() for t in own.column("text")]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    # Repeated rows come more than once, with the same set.
    return found.mapInArrow(run, "id bigint, shingles binary").dropDuplicates(["id"])


def _rare_shingles(sets: DataFrame, similar: int) -> DataFrame:
    """token, id, n, place, role: the rarest shingles of each set, as many as a partner of like size calls for.

    Role 0 is looked up by sets as large or larger, role 1 looks up those as small or smaller.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOKEN_BUCKETS, np.int64)
        for batch in batches:
            for data in batch.column(0):
                tokens = np.frombuffer(data.as_py(), np.uint64)
                np.add.at(total, (tokens % np.uint64(TOKEN_BUCKETS)).astype(np.int64), 1)
        real = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(real, pa.int32()), pa.array(total[real], pa.int64())], names=["bucket", "n"])

    sums = sets.select("shingles").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(TOKEN_BUCKETS, np.int64)
    total[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(total)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rareness = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                tokens = np.frombuffer(batch.column("shingles")[k].as_py(), np.uint64)
                n = len(tokens)
                order = np.lexsort((tokens, rareness[(tokens % np.uint64(TOKEN_BUCKETS)).astype(np.int64)]))
                parts = []
                for role, least in ((0, -(-2 * similar * n // (100 + similar))), (1, -(-similar * n // 100))):
                    parts.append((order[: n - least + 1], role))
                chosen = np.concatenate([o for o, _ in parts])
                places = np.concatenate([np.arange(len(o)) for o, _ in parts])
                roles = np.concatenate([np.full(len(o), r) for o, r in parts])
                size = len(chosen)
                cells = np.bincount((tokens >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
                sketch = np.packbits(cells.astype(np.uint8)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[chosen].astype(np.int64), pa.int64()), pa.array(np.full(size, batch.column("id")[k].as_py()), pa.int64()),
                     pa.array(np.full(size, n), pa.int64()), pa.array(places, pa.int32()), pa.array(roles, pa.int32()), *[pa.array(np.full(size, x), pa.int64()) for x in sketch]],
                    names=["token", "id", "n", "place", "role", *_SKETCH],
                )

    return sets.select("id", "shingles").mapInArrow(post, "token bigint, id bigint, n bigint, place int, role int" + "".join(f", {c} bigint" for c in _SKETCH))


def _exact_pairs(sets: DataFrame, own: DataFrame, similar: int) -> DataFrame:
    """Pairs of different components that full sets leave possible; ``own``: id and component."""
    posted = stage(_rare_shingles(sets, similar).join(own, "id"), "rare-shingles")
    small = posted.where("role = 0").select("token", F.col("id").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"), F.col("own").alias("other"), *[F.col(c).alias(f"{c}_b") for c in _SKETCH])
    large = posted.where("role = 1").select("token", F.col("id").alias("a"), "n", F.col("place").alias("i"), "own", *_SKETCH)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH), F.lit(0))
    overlap = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    possible = (
        (F.col("own") != F.col("other")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") > F.col("b"))))
        & (F.col("m") * 100 >= F.col("n") * similar) & (overlap * (100 + similar) >= (F.col("n") + F.col("m")) * similar)
        & (differ * (100 + similar) <= (F.col("n") + F.col("m")) * (100 - similar))
    )
    return large.join(small, "token").where(possible).select("a", "b", F.col("own").alias("own_a"), F.col("other").alias("own_b")).distinct().select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "own_a", "own_b"
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similar * (len(x) + len(y) - common))
            yield batch.select(_PAIR).filter(pa.array(keep, pa.bool_()))

    return both.select(*_PAIR, "sa", "sb").mapInArrow(run, ", ".join(f"{c} bigint" for c in _PAIR))


def _pivot(step: int) -> Column:
    """A member as pivot, by rank: even steps take the member of the most lists, odd ones any, both the same in all lists."""
    order = -F.col("lists") if step % 2 == 0 else F.lit(0).cast("bigint")
    return F.struct(order.alias("first"), F.xxhash64("id", F.lit(step)).alias("second"), "id", "n", "own")


def _pivoted(member: DataFrame, mixed: DataFrame, tested: DataFrame | None, similar: int) -> DataFrame:
    """a, b, own_a, own_b: the members of each list with its pivot, every pair once and none that was tested before."""
    # Sizes alone rule out many pairs.
    like = (F.col("n") * 100 >= F.col("pivot.n") * similar) & (F.col("pivot.n") * 100 >= F.col("n") * similar)
    pairs = member.join(mixed, "element").where((F.col("own") != F.col("pivot.own")) & like).select(
        F.least("id", "pivot.id").alias("a"), F.greatest("id", "pivot.id").alias("b"), F.col("own").alias("own_a"), F.col("pivot.own").alias("own_b")
    ).dropDuplicates(["a", "b"])
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def near_duplicate_classes(docs: DataFrame, similar: int = SIMILAR, matches: int = MATCHES, rounds: int = ROUNDS,
                           keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per row: ``keep``, doc_id, n_shingles, digest; per class: digest, component, component_id."""
    sketched = stage(_sketched(docs, keep or []), "sketched")
    classes = stage(
        sketched.where("n_shingles > 0").groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.first(F.struct("doc_id", "key1", "key2", "n_shingles", "signature")).alias("one"))
        .select(F.monotonically_increasing_id().alias("id"), "digest", "least", "one.*"),
        "classes",
    )
    near = stage(_in_company(classes, matches), "near")
    signed = near.select("id", "signature")
    posted = stage(_postings(near, COORDINATES - matches + 1), "postings")
    # Only lists with company.
    live = stage(posted.join(posted.groupBy("element").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("element"), "element"), "lists")
    # In how many of them a class stands: what others were copied from stands in more than its copies do.
    live = stage(live.join(live.groupBy("id").agg(F.count(F.lit(1)).alias("lists")), "id"), "ranked-lists")
    # Full sets of all that meet anybody, from one pass over the texts.
    sets = stage(_full_sets(docs, near.join(live.select("id").distinct(), "id")), "sets")
    own = near.select("id", F.col("id").alias("own"))
    tested = None
    for step in range(rounds + 1):
        member = stage(live.join(own, "id").select("element", "id", "n", "lists", "own"), "members")
        # The pivot depends on members alone, so lists with the same members agree on it.
        mixed = stage(member.groupBy("element").agg(
            F.min("own").alias("low"), F.max("own").alias("high"), F.min(_pivot(step)).alias("pivot"),
        ).where("low < high").select("element", "pivot"), "mixed")
        if mixed.isEmpty():
            break
        if step < rounds:
            met = stage(_pivoted(member, mixed, tested, similar), "met")
            pairs = stage(_enough_matches(met, signed, matches), "pairs")
        else:
            left = stage(member.join(mixed.select("element"), "element", "left_semi").select("id", "own").distinct(), "left")
            pairs = _exact_pairs(sets.join(left.select("id"), "id"), left, similar)
            met = pairs = stage(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        tested = met.select("a", "b") if tested is None else tested.unionByName(met.select("a", "b"))
        links = stage(_confirmed(pairs, sets, similar), "confirmed")
        if links.isEmpty():
            continue
        merged = components(links.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")))
        own = stage(
            own.join(merged.withColumnRenamed("node", "own"), "own", "left").select("id", F.coalesce("component", "own").alias("own")), "own"
        )
    found = stage(
        classes.select("id", "digest", "least").join(own, "id", "left").select("digest", "least", F.coalesce("own", "id").alias("component")), "found"
    )
    leasts = stage(found.groupBy("component").agg(F.min("least").alias("component_id")), "leasts")
    return sketched, stage(found.join(leasts, "component").select("digest", "component", "component_id"), "members")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    sketched, members = near_duplicate_classes(docs, **options)
    alone = sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = sketched.where("n_shingles > 0").join(members, "digest").select("doc_id", "n_shingles", "component_id")
    return alone.unionByName(grouped).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, and all without words; columns of ``docs``."""
    rows = with_row_id(docs)
    sketched, members = near_duplicate_classes(rows, keep=["__row"], **options)
    grouped = sketched.where("n_shingles > 0").join(members, "digest").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Repeated rows, or texts that differ in white space alone, may share the smallest id.
    kept = grouped.groupBy("component").agg(F.min("__row").alias("__row")).select("__row").union(
        sketched.where("n_shingles = 0").select("__row")
    )
    return rows.join(stage(kept, "kept"), "__row", "left_semi").select(*docs.columns)

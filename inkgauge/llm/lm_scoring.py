"""Probability of texts under a unigram model over subword pieces, summed over all segmentations.

The vocabulary and its scores are given; scores become prior probabilities, and expectation-maximisation over the
training documents fits them to the corpus (``ROUNDS`` passes over the table of different words, each word weighed by
its count). A text is its words in lower case, each with a space before it, and one end. Its probability is the
probability of the end times that of each word, and a word's is the sum over all its segmentations, by the forward
recursion in log space. As no piece crosses words, this is the marginal over all segmentations of the text.

Beside it stands a base: smoothed relative frequencies of whole words. Counts of words grow with the corpus and are
never broadcast whole. Words that make up a ``1 / HOT`` part of the training tokens or more, of which there cannot be
more than ``HOT``, are looked up in tasks; all others are joined by a shuffle, counted per document before.

Training documents: those whose crc32 of the id as text is not divisible by 10 (a null id: crc32 of the empty text,
which is 0, so it is held out). Defined cases: a null text is empty and has one token, the end; repeated rows count
each time; with no training documents the base is uniform over nothing (N = V = 0) and the pieces keep their prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import lattice
from inkgauge.llm.common import stage, whole_text
from inkgauge.llm.lattice import Vocabulary
from inkgauge.llm.text_slices import lower_words

HOT, HOT_BYTES = 100_000, 64
ROUNDS = 2
PRIOR_WEIGHT = 1000.0
#: Different words that a task holds before it hands its counts on.
HELD = 400_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and n over all texts of a binary column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for data in batch.column("text"):
                for some in lower_words(data.as_py()):
                    seen.update(some)
                    if len(seen) > HELD:
                        yield out()
                        seen.clear()
        yield out()

    return texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces, and of the end; what comes to the driver is one number per piece."""
    context = counts.sparkSession.sparkContext
    prior = np.exp(vocabulary.prior())
    logs = vocabulary.prior()
    log_end = float(np.log(0.5))
    for _ in range(rounds):
        shared = context.broadcast((vocabulary, logs))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary_, logs_ = shared.value
            total = np.zeros(len(logs_))
            for batch in batches:
                for k in range(0, batch.num_rows, 50_000):
                    some = batch.slice(k, 50_000)
                    units = [" " + w.decode() for w in some.column("word").to_pylist()]
                    total += lattice.expected_counts(vocabulary_, logs_, units, some.column("n").to_numpy().astype(float))
            real = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(real, pa.int32()), pa.array(total[real], pa.float64())], names=["piece", "n"])

        sums = counts.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.zeros(len(logs))
        for row in sums:
            n[row.piece] = row.n
        smooth = n + PRIOR_WEIGHT * prior
        whole = smooth.sum() + ends + 1.0
        with np.errstate(divide="ignore"):
            logs = np.log(smooth) - np.log(whole)
        log_end = float(np.log(ends + 1.0) - np.log(whole))
    return logs, log_end


def score(docs: DataFrame, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    train = rows.where(~F.col("held_out"))
    counts = stage(word_counts(train.select("text")), "word-counts")
    ends = train.count()
    facts = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_train, n_words = facts["n"] + ends, facts["v"] + (1 if ends else 0)
    loaded = Vocabulary.load(vocabulary)
    logs, log_end = fit(counts, ends, loaded, rounds)
    divisor = n_train + 0.1 * (n_words + 1)
    least = max(n_train / HOT, 1)
    # No more than HOT words of at most HOT_BYTES bytes each.
    hot = {
        bytes(r.word): r.n
        for r in counts.where((F.col("n") >= least) & (F.length("word") <= HOT_BYTES)).collect()
    }
    shared = context.broadcast((loaded, logs, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_, logs_, hot_ = shared.value
        known: dict[bytes, float] = {}
        base_of = {w: float(np.log10((c + 0.1) / divisor)) for w, c in hot_.items()}
        for batch in batches:
            texts = batch.column("text")
            for begin in range(0, batch.num_rows, 500):
                part, docs_words, fresh = texts.slice(begin, 500), [], {}
                for data in part:
                    tally: Counter = Counter()
                    for some in lower_words(data.as_py()):
                        tally.update(some)
                    docs_words.append(tally)
                    fresh.update(dict.fromkeys(w for w in tally if w not in known))
                fresh = list(fresh)
                for k in range(0, len(fresh), 50_000):
                    some = fresh[k : k + 50_000]
                    known.update(zip(some, lattice.marginals(vocabulary_, logs_, [" " + w.decode() for w in some]).tolist()))
                out = {name: [] for name in ("n_tokens", "n_hot", "base_hot", "score", "rare")}
                for tally in docs_words:
                    n_hot, base, total, rare = 0, 0.0, log_end, []
                    for w, n in tally.items():
                        total += n * known[w]
                        b = base_of.get(w)
                        if b is None:
                            rare.append((w, n))
                        else:
                            n_hot += n
                            base += n * b
                    out["n_tokens"].append(sum(tally.values()) + 1)
                    out["n_hot"].append(n_hot)
                    out["base_hot"].append(base)
                    out["score"].append(total / np.log(10))
                    out["rare"].append(rare)
                if len(known) > HELD:  # bounded; what is met again is summed again
                    known = {w: known[w] for w in base_of if w in known}
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in out["rare"]])])
                pairs = pa.StructArray.from_arrays(
                    [pa.array([w for r in out["rare"] for w, _ in r], pa.binary()), pa.array([n for r in out["rare"] for _, n in r], pa.int64())],
                    names=["word", "times"],
                )
                some = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row_id"), some.column("doc_id"), some.column("held_out"), pa.array(out["n_tokens"], pa.int64()),
                        pa.array(out["n_hot"], pa.int64()), pa.array(out["base_hot"], pa.float64()), pa.array(out["score"], pa.float64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    ],
                    names=["row_id", "doc_id", "held_out", "n_tokens", "n_hot", "base_hot", "score", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stage(
        rows.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(
            run,
            f"row_id bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_hot bigint, base_hot double, score double, "
            "rare array<struct<word:binary,times:bigint>>",
        ),
        "scored",
    )
    rest = (
        scored.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.times")
        .join(counts, "word", "left")
        .groupBy("row_id").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_rare"),
            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / divisor)).alias("base_rare"),
        )
    )
    base_end = float(np.log10((ends + 0.1) / divisor))
    return scored.drop("rare").join(rest, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base_rare", F.lit(0.0)) + base_end).alias("base_score"), "score",
    )

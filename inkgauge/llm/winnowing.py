"""Document fingerprints by winnowing.

Tokens are runs of up to ``CUT`` characters other than white space, in lower case; a character of a script written
without spaces is a token of its own. Every run of ``k`` tokens is hashed, and of every ``w`` neighbouring hashes the
smallest is kept with its position, the rightmost on a tie. Two texts that share ``k + w - 1`` tokens in a row share
a fingerprint. A text of fewer than ``k`` tokens has one hash over all of them, one without tokens has none.

Likeness is the share of common hashes among all of two fingerprints; two empty fingerprints are alike (1.0).
Defined cases: a null text is empty; equal texts have equal fingerprints; order of documents is descending doc_id,
null last, repeated ids in the order of their texts' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import whole_text

K, W, CUT = 5, 4, 24
TOKEN = f"[\\u2E80-\\uD7FF\\uF900-\\uFAFF]|[^\\x20\\x09-\\x0D\\u2E80-\\uD7FF\\uF900-\\uFAFF]{{1,{CUT}}}"
ROWS_PER_RUN = 2000
MOST_RUNS = 100_000


def _at(values: Column, index: Column, step: int) -> Column:
    return F.get(values, index + step) if step else F.get(values, index)


def with_grams(df: DataFrame, text: str, into: str, k: int = K) -> DataFrame:
    """Adds the hashes of all runs of ``k`` tokens of a text column."""
    tokens = f"__{into}_tokens"
    df = df.withColumn(tokens, F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), 0))
    t = F.col(tokens)
    places = F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0)))
    grams = F.transform(places, lambda i: F.xxhash64(*[_at(t, i, s) for s in range(k)]))
    return df.withColumn(into, F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(grams)).drop(tokens)


def with_fingerprint(df: DataFrame, text: str, into: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``into``: array of (hash, pos), and ``into``_set: its different hashes."""
    grams, picks = f"__{into}_grams", f"__{into}_picks"
    df = with_grams(df, text, grams, k)
    h = F.col(grams)

    def rightmost_least(i: Column) -> Column:
        # Beyond the end there is null, which least() passes over and a comparison does not choose.
        choice = None
        for s in range(w - 1, 0, -1):
            best = _at(h, i, s) <= F.least(*[_at(h, i, r) for r in range(s)]) if s > 1 else _at(h, i, 1) <= _at(h, i, 0)
            choice = F.when(best, i + s) if choice is None else choice.when(best, i + s)
        return choice.otherwise(i)

    windows = F.sequence(F.lit(0), F.greatest(F.size(h) - w, F.lit(0)))
    df = df.withColumn(picks, F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(F.transform(windows, rightmost_least)))
    p = F.col(picks)
    fresh = F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1)))
    df = df.withColumn(into, F.transform(fresh, lambda x: F.struct(F.get(h, x).alias("hash"), x.alias("pos"))))
    return df.withColumn(f"{into}_set", F.array_distinct(F.col(f"{into}.hash"))).drop(grams, picks)


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id and fingerprint, an array of (hash, pos), of every row."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    return with_fingerprint(rows, "text", "fingerprint", k, w).select("doc_id", "fingerprint")


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.concat_ws(":", F.lower(F.hex(x["hash"])), x["pos"])), ",")


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the next document's text, in the order of descending doc_id, the last followed by the first.

    Rows are dealt into runs of neighbouring ids (cut at quantiles of the id, looked up by bisection); the first row of
    a run visits the run before it, so one exchange of the texts is all that moves.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(order.alias("id"))
    count = ids.count()
    n_runs = max(1, min(MOST_RUNS, -(-count // ROWS_PER_RUN)))
    steps = max(1, n_runs.bit_length())
    cuts: list[int] = []
    if n_runs > 1:
        shares = F.expr("array(" + ",".join(f"{i / n_runs!r}D" for i in range(1, n_runs)) + ")")
        cuts = sorted(set(ids.agg(F.percentile_approx("id", shares, max(10_000, 20 * n_runs)).alias("q")).first()["q"]))
    if cuts:
        held = F.expr("array(" + ",".join(f"bigint('{x}')" for x in cuts) + ")")
        run_of = F.aggregate(
            F.array(*[F.lit(1 << s) for s in range(steps, -1, -1)]), F.lit(0),
            lambda at, step: F.when((at + step <= len(cuts)) & (F.get(held, at + step - 1) < F.col("id")), at + step).otherwise(at),
        )
    else:
        run_of = F.lit(0)
    tied = F.xxhash64(whole_text())
    rows = docs.select("doc_id", order.alias("id"), whole_text().alias("text")).withColumn("run", run_of).withColumn("tie", tied)
    # At most one row per run; the row each run begins with, and the run that it follows.
    heads = rows.groupBy("run").agg(F.max(F.struct("id", "tie")).alias("head"))
    before = Window.orderBy("run")
    heads = heads.select(
        F.coalesce(F.lead("run").over(before), F.min("run").over(Window.partitionBy())).alias("visits"), "head"
    )
    visitors = (
        rows.join(F.broadcast(heads.select(F.col("head.id").alias("id"), F.col("head.tie").alias("tie"), "visits")), ["id", "tie"])
        .dropDuplicates(["visits"])
        .select("doc_id", "id", "text", F.col("visits").alias("run"), "tie", F.lit(True).alias("guest"))
    )
    both = rows.select("doc_id", "id", "text", "run", "tie", F.lit(False).alias("guest")).unionByName(visitors)
    within = Window.partitionBy("run").orderBy(F.asc("guest"), F.desc("id"), F.desc("tie"))
    return both.withColumn("next_text", F.lead("text").over(within)), within


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text, and of the text whose last third is replaced by the start of the next document."""
    rows, within = with_next(docs)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited",
        F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.coalesce(F.substring(F.col("next_text"), F.lit(1), third), F.lit(""))),
    ).drop("next_text")
    rows = with_fingerprint(rows, "text", "own", k, w).drop("text")
    rows = rows.withColumn("next_set", F.lead("own_set").over(within)).where(~F.col("guest"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    rows = with_fingerprint(rows, "edited", "new", k, w).drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("new").alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("new_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )

"""Mixing sources to target weights by a splitting tree over exact block quotas.

Sizes are words. Sources, in code point order with null last, weigh 5, 2, 1 and so on in turn; together they get
``SHARE`` of all words, none more than ``MOST`` times its own size, and what is cut off is shared out by weight again
(the level is found by repeated sums over the table of sources).

A source's documents lie in a keyed random order on a line of words; its quota is cut into blocks of ``BLOCK`` words,
the last one shorter, and where the quota exceeds the line it goes round a second time. Output shards are the leaves
of a tree: each node splits the block counts of all sources between its halves by a multivariate hypergeometric draw,
so every shard gets a random sample of the whole mix and the quotas come out exactly. Which blocks a shard gets is
read off a keyed permutation of the source's blocks: shards get disjoint runs of it. Within a shard, pieces of
documents stand in a keyed random order.

Nothing follows the number of documents of a source but sums: a source's line is cut into buckets by the order's
leading bits, sums of buckets are added up in two levels, and documents are placed within their bucket. The tree handles
sources in groups of a thousand: at each node the groups' totals are split, then each group by itself. Blocks are doubled
while there would be a thousand million of them.

Defined cases: a null text has no words and is never taken; a null source is a source, the last; repeated rows are
rows of their own; a source without words gets nothing; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.llm.common import SPACE, WORD, stage, whole_text, with_row_id, word_count
from inkgauge.llm.feistel import permute

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK, BLOCKS_PER_SHARD = 32_768, 64
SEED = 5
GROUP, ROWS_PER_BUCKET = 1000, 500
#: Levels of the tree that one task splits at a time, and the number of blocks up to which draws are exact.
LEVELS, MOST_BLOCKS = 8, 10**9


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size and rank (from 0 in code point order, null last), without one task for all of them."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    runs = stage(sums.repartitionByRange(F.asc_nulls_last("source")).withColumn("run", F.spark_partition_id()), "source-runs")
    # One number per task: how many sources stand before it.
    counts = sorted((r.run, r.n) for r in runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in counts]).tolist()
    offsets = sized.sparkSession.createDataFrame([(run, b) for (run, _), b in zip(counts, before)], "run int, before bigint")
    at = F.row_number().over(Window.partitionBy("run").orderBy(F.asc_nulls_last("source"))) - 1
    return runs.withColumn("at", at).join(F.broadcast(offsets), "run").select("source", "source_size", (F.col("before") + F.col("at")).alias("rank"))


def water_level(sources: DataFrame, total: float, most: float = MOST) -> float:
    """The level L at which the sum of min(most * source_size, weight * L) is ``total``."""
    level = 0.0
    while True:
        cap = F.col("source_size") * most
        full = F.col("weight") * level >= cap
        sums = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not sums["open"]:
            return level
        higher = (total - sums["full"]) / sums["open"]
        if higher <= level * (1 + 1e-12):
            return level
        level = higher


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, rank, target and quota (the target in whole words)."""
    ranked = stage(ranked_sources(sized), "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = ranked.withColumn("weight", weight)
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level = water_level(sources, share * words, most)
    target = F.least(F.col("source_size") * most, F.col("weight") * level)
    return stage(sources.select("source", "source_size", "rank", target.alias("target"), F.round(target).cast("long").alias("quota")), "targets")


def _halved(have: np.ndarray, draws: int, seed: list[int]) -> np.ndarray:
    """How many of each colour are among ``draws`` drawn without putting back."""
    return np.random.default_rng(seed).multivariate_hypergeometric(have, draws, method="marginals")


def split_tree(quotas: np.ndarray, room: np.ndarray, seed: list[int]) -> np.ndarray:
    """counts[i, s]: how many of quotas[i] go to shard s, whose room adds up to the quotas' sum; for few shards."""
    out = np.zeros((len(quotas), len(room)), np.int64)
    todo = [(0, len(room), quotas.astype(np.int64))] if len(room) else []
    while todo:
        low, high, have = todo.pop()
        if high - low == 1:
            out[:, low] = have
        elif have.any():
            middle = (low + high) // 2
            left = _halved(have, int(room[low:middle].sum()), [*seed, low, high])
            todo += [(low, middle, left), (middle, high, have - left)]
    return out


NODE = "group bigint, low bigint, high bigint, totals array<bigint>, ranks array<bigint>, blocks array<bigint>, start array<bigint>, have array<bigint>"


def _subtree(node: dict, own: int, levels: int, room, seed: int) -> Iterator[dict]:
    """The nodes ``levels`` below a node of the tree, or its leaves.

    ``totals``: blocks of each group of sources in the node's shards; ``have``: of each source of the node's own group,
    ``start`` of them in shards before. Draws depend on seed, group and range alone, so every group finds the same totals.
    """
    todo = [(node["low"], node["high"], levels, *(np.array(node[c], np.int64) for c in ("totals", "start", "have")))]
    while todo:
        low, high, depth, totals, start, have = todo.pop()
        if not have.any():
            continue
        if high - low == 1 or not depth:
            yield {**node, "low": low, "high": high, "totals": totals, "start": start, "have": have}
            continue
        middle = (low + high) // 2
        left_totals = _halved(totals, room(low, middle), [seed, 0, low, high])
        left = _halved(have, int(left_totals[own]), [seed, 1, node["group"], low, high])
        todo += [(low, middle, depth - 1, left_totals, start, left), (middle, high, depth - 1, totals - left_totals, start + left, have - left)]


def block_plan(sources: DataFrame, block: int = BLOCK, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """rank, block, shard: every block of every quota, each in one shard.

    The tree is split ``LEVELS`` levels at a time, each node by a task of its own; what a node holds is the counts of one
    group of sources, whatever the number of shards. A leaf is a run of a source's permuted blocks.
    """
    spark = sources.sparkSession
    counted = sources.where("quota > 0").select(
        "rank", F.ceil(F.col("quota") / block).cast("long").alias("blocks"), F.floor(F.col("rank") / GROUP).cast("long").alias("group")
    )
    # One number per thousand sources.
    groups = sorted((r["group"], r["n"]) for r in counted.groupBy("group").agg(F.sum("blocks").alias("n")).collect())
    place, totals = {g: i for i, (g, _) in enumerate(groups)}, [n for _, n in groups]
    total = sum(totals)
    shards = -(-total // per_shard)
    each, more = divmod(total, max(shards, 1))

    def room(low: int, high: int) -> int:
        return (high - low) * each + min(max(more - low, 0), high - low)

    member = F.array_sort(F.collect_list(F.struct("rank", "blocks")))
    nodes = counted.groupBy("group").agg(member.alias("m")).select(
        "group", F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.array(*[F.lit(n).cast("long") for n in totals]).cast("array<bigint>").alias("totals"),
        F.col("m.rank").alias("ranks"), F.col("m.blocks").alias("blocks"), F.transform("m", lambda x: F.lit(0).cast("long")).alias("start"), F.col("m.blocks").alias("have"),
    )

    def descend(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for node in table.to_dict("records"):
                made = list(_subtree(node, place[node["group"]], LEVELS, room, seed))
                for k in range(0, len(made), 64):
                    yield pd.DataFrame(made[k : k + 64])

    for _ in range(max(1, -(-max(shards - 1, 1).bit_length() // LEVELS))):
        nodes = stage(nodes.repartition("group", "low").mapInPandas(descend, NODE), "mix-nodes")
    runs = nodes.select(F.col("low").alias("shard"), F.explode(F.arrays_zip("ranks", "blocks", "start", "have")).alias("r")).where("r.have > 0")

    def permuted(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            for rank, n, start, have, shard in table.itertuples(index=False):
                order = permute(np.arange(start, start + have), int(n), seed * 1_000_003 + int(rank))
                yield pd.DataFrame({"rank": rank, "block": order, "shard": shard})

    return runs.select("r.ranks", "r.blocks", "r.start", "r.have", "shard").mapInPandas(permuted, "rank bigint, block bigint, shard bigint")


def fitting_block(sources: DataFrame, block: int = BLOCK) -> int:
    """``block``, doubled while all quotas together would be ``MOST_BLOCKS`` blocks or more: draws are exact below that."""
    words = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    while words["n"] // block + words["k"] >= MOST_BLOCKS and block < words["n"]:
        block *= 2
    return block


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    text = whole_text()
    return docs.select(
        *more, "doc_id", "source", word_count(text).alias("size"), F.xxhash64(F.lit(SEED), F.col("doc_id")).alias("mixed"),
        F.xxhash64(text).alias("tie"),
    )


def _bucket_offsets(sums: DataFrame, span: int) -> DataFrame:
    """rank, bucket and the words before each bucket of its source: within spans of buckets, and before each span."""
    sums = sums.withColumn("span", F.floor(F.col("bucket") / span))
    spans = sums.groupBy("rank", "span").agg(F.sum("n").alias("m"))
    spans = spans.select("rank", "span", (F.sum("m").over(Window.partitionBy("rank").orderBy("span")) - F.col("m")).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("rank", "span").orderBy("bucket")) - F.col("n")
    return sums.withColumn("inside", inside).join(spans, ["rank", "span"]).select("rank", "bucket", (F.col("earlier") + F.col("inside")).alias("before"))


def segments(rows: DataFrame, sources: DataFrame, block: int = BLOCK, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """The mix: shard, position, row_id, doc_id, rank, pass, block, from_word, to_word (of the document).

    ``rows``: row_id, doc_id, source, size, mixed, tie.
    """
    block = fitting_block(sources, block)
    buckets = max(64, 1 << (rows.count() // ROWS_PER_BUCKET).bit_length())
    bits = buckets.bit_length() - 1
    placed = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).where("size > 0").select(
        "row_id", "doc_id", "rank", "size", "mixed", "tie", "source_size", "quota", F.shiftrightunsigned("mixed", 64 - bits).alias("bucket")
    )
    placed = stage(placed, "mix-rows")
    offsets = stage(_bucket_offsets(placed.groupBy("rank", "bucket").agg(F.sum("size").alias("n")), 1 << (bits // 2)), "mix-buckets")
    inside = Window.partitionBy("rank", "bucket").orderBy("mixed", "tie", "row_id")
    line = placed.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(
        offsets, ["rank", "bucket"]
    ).withColumn("at", F.col("before") + F.col("inside"))
    rounds = line.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("low", F.col("at") + F.col("pass") * F.col("source_size"))
    taken = rounds.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("quota"))).where("high > low")
    first, last = F.floor(F.col("low") / block).cast("long"), F.floor((F.col("high") - 1) / block).cast("long")
    parts = taken.withColumn("block", F.explode(F.sequence(first, last))).select(
        "row_id", "doc_id", "rank", "pass", "block",
        (F.greatest("low", F.col("block") * block) - F.col("low")).alias("from_word"),
        (F.least("high", (F.col("block") + 1) * block) - F.col("low")).alias("to_word"),
    )
    plan = stage(block_plan(sources, block, per_shard, seed), "mix-plan")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "row_id", "pass", "block"), "row_id", "pass", "block")
    return parts.join(plan, ["rank", "block"]).withColumn("position", F.row_number().over(order) - 1)


def mix(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with sizes, the sources with targets, and the segments that the mix takes."""
    rows = stage(_sized(docs).withColumn("row_id", F.monotonically_increasing_id()), "mix-sized")
    sources = targets(rows)
    return rows, sources, segments(rows, sources, **options)


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    rows, sources, parts = mix(docs)
    taken = parts.groupBy("row_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("row_id", "doc_id", "size", "source_size", "target").join(
        taken, "row_id", "left"
    ).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _words_between(text: Column, low: Column, high: Column) -> Column:
    """Words ``low`` to ``high`` (exclusive) with the white space between them."""
    word = f"(?:{SPACE}*+{WORD}++)"
    pattern = F.concat(F.lit(f"^{word}{{"), low, F.lit(f"}}+{SPACE}*+({WORD}++{word}{{"), high - low - 1, F.lit("}+)"))
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Rows with the columns of ``docs``: each pass of a document through the mix is a row with the words it takes.

    A whole pass keeps the text as it is; at the end of a quota the text is cut after a word, and n_chars follows.
    """
    kept = with_row_id(docs, "__mix_row")
    rows = stage(_sized(kept, "__mix_row").withColumnRenamed("__mix_row", "row_id"), "mix-sized")
    sources = targets(rows)
    parts = segments(rows, sources).groupBy("row_id", "pass").agg(F.min("from_word").alias("low"), F.max("to_word").alias("high"))
    parts = parts.join(rows.select("row_id", "size"), "row_id").select(
        F.col("row_id").alias("__mix_row"), F.col("low").alias("__mix_low"), F.col("high").alias("__mix_high"), F.col("size").alias("__mix_size")
    )
    part = (F.col("__mix_low") > 0) | (F.col("__mix_high") < F.col("__mix_size"))
    text = F.when(part, _words_between(F.col("text"), F.col("__mix_low"), F.col("__mix_high"))).otherwise(F.col("text"))
    out = kept.join(stage(parts, "mix-taken"), "__mix_row").withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(part, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

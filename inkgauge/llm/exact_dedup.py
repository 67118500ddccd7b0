"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own characters say so (a pattern, within a least and a greatest length), so a chunk does not
depend on what stands far before it. Chunks are grouped by their characters, which moves each different chunk once
per task, and every chunk gets a short identifier; an identifier that two different chunks share is found there, so
identifiers are verified and not merely likely. From then on a document is the ordered list of its identifiers: lists
are grouped, joined and compared, and no document text moves.

Defined cases: a null text counts as empty; all empty texts are equal. Of equal texts the row with the largest doc_id
stays (a null doc_id is the smallest); among repeated rows of that doc_id exactly one stays. An empty table gives an
empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm.common import stage, whole_text, with_row_id

LEAST, MOST = 512, 8192
#: Where a chunk ends. Latin text: after these characters, about one place in two hundred. Other scripts: where a word ends
#: with a letter from evenly spread ranges, and, as some scripts have no spaces, behind characters from such ranges.
#: Such places must be rare beside LEAST: only then do two texts that are shifted meet again at the next one.
_LATIN = "[aehiortuyäéíñ1-5][aeginrstóü6-9.,;][.,;]?[ \\n]"


def _ranges(low: int, high: int, size: int, step: int) -> str:
    return "".join(f"\\x{{{at:X}}}-\\x{{{at + size - 1:X}}}" for at in range(low, high, step))


_SPACED, _UNSPACED = _ranges(0x250, 0x1400, 4, 32), _ranges(0x0E00, 0x1800, 4, 64) + _ranges(0x3040, 0x30000, 16, 1024) + _ranges(0x4E00, 0xD800, 8, 512)
_OTHER = f"(?=[^\\x00-\\x{{24F}}])(?:[{_SPACED}]\\p{{P}}?[ \\n]|[{_UNSPACED}])"
CUT = f"(?:{_LATIN}|{_OTHER})"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The text as an array of chunks, in order; together they are the whole text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most - 4}}}?{CUT}|.{{1,{most}}}"), 0)


def chunk_id(chunk: Column) -> Column:
    """160 bits of hash and length; only the check of contents makes it an identity."""
    return F.struct(
        F.xxhash64(chunk).alias("h"), F.xxhash64(F.lit(7), chunk).alias("g"), F.length(chunk).alias("n")
    )


def shared_ids(parts: DataFrame) -> DataFrame:
    """Identifiers that belong to more than one chunk text (in practice none); ``parts`` has a column chunk."""
    different = parts.groupBy("chunk").agg(F.lit(1).alias("one"))
    return (
        different.select(chunk_id(F.col("chunk")).alias("id"))
        .groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("id")
    )


def recipes(docs: DataFrame, row_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Per row: row_id (numbers given here, if none are), doc_id, text_sha256 and recipe, the ordered chunk identifiers; and the shared identifiers."""
    number = F.monotonically_increasing_id() if row_id is None else row_id
    texts = docs.select(number.alias("row_id"), F.col("doc_id"), whole_text().alias("text"))
    listed = stage(
        texts.withColumn("parts", chunks(F.col("text"))).select(
            "row_id", "doc_id",
            F.sha2(F.col("text"), 256).alias("text_sha256"),
            F.transform("parts", chunk_id).alias("recipe"),
        ),
        "recipes",
    )
    parts = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    return listed, shared_ids(parts)


def duplicate_groups(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept, text_sha256."""
    listed, shared = recipes(docs, row_id)
    # A list with a shared identifier cannot stand for its text alone: there the digest of the whole text joins it.
    unsure = (
        listed.select("row_id", F.explode("recipe").alias("id")).join(shared, "id", "left_semi")
        .select("row_id", F.lit(True).alias("unsure")).distinct()
    )
    keyed = stage(
        listed.join(unsure, "row_id", "left")
        .select(
            "row_id", "doc_id", "text_sha256", "recipe",
            F.when(F.col("unsure"), F.col("text_sha256")).otherwise("").alias("extra"),
        ),
        "keyed",
    )
    groups = stage(
        keyed.groupBy("recipe", "extra").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("top")
        ),
        "groups",
    )
    return keyed.join(groups, ["recipe", "extra"]).select(
        "row_id", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("top.row_id")).alias("kept"), "text_sha256",
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return duplicate_groups(docs).drop("row_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    rows = with_row_id(docs)
    kept = duplicate_groups(rows, F.col("__row")).where("kept").select(F.col("row_id").alias("__row"))
    return rows.join(stage(kept, "kept"), "__row", "left_semi").select(*docs.columns)

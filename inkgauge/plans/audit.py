"""The whole audit of a corpus as one narrow job per post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators import findings as fnd, jsonld, judge, posts as post_ops, scoring, structure, style, trust
from inkgauge.operators.shred import shred

# Emission order of the checks: it decides ties in every "first k" of the reports.
TECHNICAL = [
    structure.STRUCTURE,
    jsonld.VALIDITY,
    jsonld.BLOCK_PRESENCE,
    jsonld.ARTICLE_PRESENCE,
    jsonld.ENTITIES,
    jsonld.MISSING_IDS,
    jsonld.ID_RESOLUTION,
    jsonld.INLINE_OVER_REFERENCE,
    structure.META,
    structure.CANONICAL,
    jsonld.FAQ_PARITY,
    structure.TLDR,
    structure.H2_QUESTIONS,
    structure.DENSITY,
    structure.SECTION_SIZE,
    structure.H2_EXTRACTABLE,
    structure.LAST_UPDATED,
    structure.TOC,
    structure.WORD_BAND,
    jsonld.REQUIRED_TYPE,
]
TRUST = [
    jsonld.AUTHOR,
    trust.BYLINE,
    trust.FIRST_PARTY,
    trust.ORIGINAL_VISUAL,
    trust.CITATIONS,
    trust.BUNDLE,
]
STYLE = [style.TEXT_SIGNALS]
FAMILIES = TECHNICAL + TRUST + STYLE

OPTIONAL = {
    "brand": "string", "brand_website": "string", "slug": "string", "format": "string", "topic": "string",
    "primary_keyword": "string", "word_count": "int", "schemas_json": "string", "meta": "map<string,string>",
    "audited_at": "timestamp",
}


def prepare(posts: DataFrame, keep_html: bool = False, elements: bool = False) -> DataFrame:
    """Posts with visible text, shredded arrays and post type. The only step that reads the source.

    ``elements`` also keeps the arrays of all elements and text runs, for checks of one's own.
    """
    df = posts.withColumns(
        {n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in posts.columns}
    )
    df = df.withColumn("text", X.visible_text(F.col("html")))
    if "article_body_html" in df.columns:
        body = F.col("article_body_html")
        own = F.when(F.coalesce(body, F.lit("")).isin("") | (body == F.col("html")), F.lit(None)).otherwise(body)
        df = df.withColumn("body_only", F.when(own.isNotNull(), X.visible_text(own)))
    else:
        df = df.withColumn("body_only", F.lit(None).cast("string"))
    df = shred(df, keep_html=keep_html, elements=elements or keep_html)
    # Only JSON-LD supplied with the post takes part in guessing its type.
    supplied = F.when(
        F.coalesce("schemas_json", F.lit("")) != "", F.flatten(F.transform("ld_entities", lambda e: e["types"]))
    ).otherwise(F.array().cast("array<string>"))
    return df.withColumns(
        {
            "body_text": F.coalesce("body_only", "text"),
            "post_type": post_ops.infer_post_type(F.col("format"), F.col("topic"), F.col("word_count"), supplied),
        }
    ).drop("body_only")


def detect(prepared: DataFrame, families: list[fnd.Family] = FAMILIES, key: str = "doc_id", keep: list[str] = ()) -> DataFrame:
    """One row per post with its ordered ``found`` array."""
    df = prepared
    for family in families:
        df = family.measures(df)
    return df.select(key, *keep, fnd.all_found(families).alias("found"))


def score(found: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores from the findings array; judge scores enter when their columns are present."""
    col = F.col("found")
    h_judge = F.col("human_judge_score") if "human_judge_score" in found.columns else F.lit(None).cast("int")
    q_judge = F.col("quality_judge_score") if "quality_judge_score" in found.columns else F.lit(None).cast("int")
    signals = F.filter(col, lambda f: ~f["check_id"].startswith("H_judge_"))
    df = found.withColumns(
        {
            "technical": scoring.array_score(col, ["technical", "eeat"], dims.PAGE_PENALTY),
            "humanization": scoring.blend(
                scoring.array_score(signals, ["humanization"], dims.STYLE_PENALTY), h_judge
            ),
            "quality": F.coalesce(q_judge, F.lit(dims.UNJUDGED_QUALITY)),
            "criticals": F.transform(
                F.filter(col, lambda f: f["severity"] == "critical"), lambda f: f["check_id"]
            ),
        }
    )
    return df.withColumn(
        "overall", scoring.overall(F.col("technical"), F.col("humanization"), F.col("quality"), weights)
    ).withColumn("critical_count", F.size("criticals"))


def judged(posts: DataFrame, judgements: DataFrame, key: str = "doc_id") -> DataFrame:
    """Attach judge findings and scores; ``judgements`` holds (doc_id, judge, answer), one per judge."""
    parsed = judge.parse_answers(judgements)

    def side(name: str, prefix: str) -> DataFrame:
        return parsed.filter(F.col("judge") == name).select(
            key, judge.axis_findings(name).alias(f"{prefix}_found"), judge.axis_score().alias(f"{prefix}_judge_score")
        )

    return posts.join(side("humanization", "human"), key, "left").join(side("quality", "quality"), key, "left")


def _or_empty(column: str) -> Column:
    return F.coalesce(column, fnd.no_findings())


def audit(
    posts: DataFrame,
    judgements: DataFrame | None = None,
    preflight: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    target: int = dims.TARGET_SCORE,
    key: str = "doc_id",
    families: list[fnd.Family] | None = None,
) -> DataFrame:
    """One report row per post: findings array, scores and verdict. ``families`` adds or leaves out checks.

    Without side tables there is no shuffle at all. Side tables join on ``key`` after the page source
    has been reduced to findings, so only small rows move.
    """
    df = detect(prepare(posts, elements=families is not None), FAMILIES if families is None else families, key, keep=["brand", "slug", "post_type"])
    if judgements is not None:
        df = judged(df, judgements, key).withColumn(
            "found", F.concat("found", _or_empty("human_found"), _or_empty("quality_found"))
        )
    return verdicts(df, preflight, weights, target, key)


def verdicts(
    df: DataFrame, preflight: DataFrame | None = None, weights: dict[str, float] | None = None, target: int = dims.TARGET_SCORE, key: str = "doc_id",
) -> DataFrame:
    """Scores and verdict of posts that have their findings."""
    df = score(df, weights)
    if preflight is not None:
        # Outside findings never change scores; their criticals block. Only a count and three ids per
        # post are carried over, so a post with very many outside findings stays a small row.
        outside = preflight if "ord" in preflight.columns else preflight.withColumn("ord", F.xxhash64("check_id", "evidence"))
        df = (
            df.join(scoring.count_critical(outside, [key]).withColumnRenamed("critical_count", "more"), key, "left")
            .join(scoring.first_criticals(outside, [key]), key, "left")
            .withColumns(
                {
                    "critical_count": F.col("critical_count") + F.coalesce("more", F.lit(0)),
                    "criticals": F.concat("criticals", F.coalesce("shown", F.array().cast("array<string>"))),
                }
            )
            .drop("more", "shown")
        )
    return df.withColumns(
        {
            "verdict": scoring.verdict(F.col("critical_count"), F.col("overall"), target),
            "verdict_reason": scoring.verdict_reason(
                F.col("critical_count"), F.slice("criticals", 1, 3), F.col("overall"), target
            ),
        }
    ).drop("criticals", "human_found", "quality_found", "human_judge_score", "quality_judge_score")


def findings_table(reports: DataFrame, preflight: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """The findings of all posts as the long table, with rule citations; outside findings come last."""
    rows = fnd.explode_findings(reports, key)
    if preflight is not None:
        shown = preflight.select(
            key, F.lit(None).cast("int").alias("ord"),
            F.inline(
                F.array(
                    fnd.finding(F.col("check_id"), "preflight", F.col("severity"), "static", F.col("evidence"))
                )
            ),
        )
        rows = rows.unionByName(shown)
    return scoring.citations_for_check(rows)

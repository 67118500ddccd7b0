"""Scores, verdicts and rollups over a long findings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X


def penalty(severity: Column, table: dict[str, int]) -> Column:
    (first, points), *rest = table.items()
    out = F.when(severity == first, points)
    for name, points in rest:
        out = out.when(severity == name, points)
    return out.otherwise(0)


def rank(severity: Column) -> Column:
    """4 for critical down to 1 for info."""
    return penalty(severity, dims.SEVERITY_RANK)


def score_by_key(findings: DataFrame, posts: DataFrame, keys: list[str], layers: list[str], table: dict[str, int], name: str) -> DataFrame:
    """100 minus penalties, floored at 0. Sums are combined before the shuffle; clean posts keep 100.

    Rows, not documents, carry the penalties, so a post that holds a third of all findings still
    costs one partial sum per task.
    """
    lost = findings.filter(F.col("layer").isin(*layers)).groupBy(*keys).agg(
        F.sum(penalty(F.col("severity"), table)).alias("lost")
    )
    return posts.join(lost, keys, "left").select(
        *keys, F.greatest(F.lit(0), 100 - F.coalesce("lost", F.lit(0))).cast("int").alias(name)
    )


def score_technical(findings: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    return score_by_key(findings, posts, keys, ["technical", "eeat"], dims.PAGE_PENALTY, "technical")


def score_humanization_signals(findings: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    return score_by_key(findings, posts, keys, ["humanization"], dims.STYLE_PENALTY, "humanization")


def score_posts(findings: DataFrame, posts: DataFrame, keys: list[str]) -> DataFrame:
    """technical, humanization and critical_count of every post from one grouping of the findings."""
    severity, layer = F.col("severity"), F.col("layer")
    page = F.when(layer.isin("technical", "eeat"), penalty(severity, dims.PAGE_PENALTY))
    style = F.when(layer == "humanization", penalty(severity, dims.STYLE_PENALTY))
    sums = findings.groupBy(*keys).agg(
        F.sum(page).alias("page_lost"), F.sum(style).alias("style_lost"), F.count_if(severity == "critical").cast("int").alias("critical_count")
    )

    def left(lost: str) -> Column:
        return F.greatest(F.lit(0), 100 - F.coalesce(lost, F.lit(0))).cast("int")

    return posts.join(sums, keys, "left").select(
        *posts.columns, left("page_lost").alias("technical"), left("style_lost").alias("humanization"), F.coalesce("critical_count", F.lit(0)).alias("critical_count")
    )


def array_score(found: Column, layers: list[str], table: dict[str, int]) -> Column:
    """The same score from the findings array of one row."""
    lost = F.aggregate(
        F.filter(found, lambda f: f["layer"].isin(*layers)), F.lit(0),
        lambda acc, f: acc + penalty(f["severity"], table),
    )
    return F.greatest(F.lit(0), 100 - lost).cast("int")


def blend(signal: Column, judge: Column) -> Column:
    return F.coalesce(X.round_half_up(signal * 0.45 + judge * 0.55), signal).cast("int")


def normalized_weights(weights: dict[str, float] | None) -> dict[str, float]:
    if weights is None or sum(weights.values()) <= 0:
        return dims.SCORE_WEIGHTS
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()}


def overall(technical: Column, humanization: Column, quality: Column, weights: dict[str, float] | None = None) -> Column:
    w = normalized_weights(weights)
    mixed = technical * w["technical"] + humanization * w["humanization"] + quality * w["quality"]
    # Ten decimals first: 0.35 and the like are not exact in binary, halves must stay halves.
    return X.round_half_up(F.round(mixed, 10)).cast("int")


def weighted_overall(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Overall score under every row of a small weights table (w_technical, w_humanization, w_quality)."""
    total = F.col("w_technical") + F.col("w_humanization") + F.col("w_quality")
    usable = weights.select(
        "weights_id",
        *[
            F.when(total > 0, F.col(f"w_{k}") / total).otherwise(F.lit(v)).alias(f"w_{k}")
            for k, v in dims.SCORE_WEIGHTS.items()
        ],
    )
    mixed = sum(F.col(k) * F.col(f"w_{k}") for k in dims.SCORE_WEIGHTS)
    return df.join(usable, "weights_id").withColumn(
        "overall", X.round_half_up(F.round(mixed, 10)).cast("int")
    )


def count_critical(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count_if(F.col("severity") == "critical").cast("int").alias("critical_count"))


def verdict(critical_count: Column, overall_score: Column, target: int = dims.TARGET_SCORE) -> Column:
    return (
        F.when(critical_count > 0, "block").when(overall_score >= target, "ship").otherwise("edit")
    )


def verdict_reason(critical_count: Column, shown: Column, overall_score: Column, target: int = dims.TARGET_SCORE) -> Column:
    more = F.when(critical_count > 3, "...").otherwise("")
    return (
        F.when(
            critical_count > 0,
            F.concat(critical_count.cast("string"), F.lit(" critical finding(s) — cannot ship: "), F.array_join(shown, ", "), more),
        )
        .when(overall_score >= target, F.format_string(f"Overall %d ≥ target {target}", overall_score))
        .otherwise(F.format_string(f"Overall %d < target {target}; no criticals but needs editing", overall_score))
    )


def first_criticals(findings: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Ids of the first ``k`` critical findings per key, in order.

    A ranked filter before the grouping keeps at most k rows per key; Spark prunes them per task
    before the shuffle (group limit), so a hot key is never collected whole.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("ord")
    top = (
        findings.filter(F.col("severity") == "critical")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= k)
    )
    return top.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "check_id"))), lambda s: s["check_id"]).alias("shown")
    )


def derive_verdict(findings: DataFrame, scores: DataFrame, keys: list[str], target: int = dims.TARGET_SCORE) -> DataFrame:
    if "critical_count" not in scores.columns:
        scores = scores.join(count_critical(findings, keys), keys, "left")
    df = scores.join(first_criticals(findings, keys), keys, "left")
    n = F.coalesce("critical_count", F.lit(0))
    return df.select(
        *keys, "overall", n.alias("critical_count"),
        verdict(n, F.col("overall"), target).alias("verdict"),
        verdict_reason(n, F.col("shown"), F.col("overall"), target).alias("verdict_reason"),
    )


def usage_cost(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of all calls per key; a model without a price costs nothing. ``prices`` is a short list."""
    cost = (
        F.col("input_tokens") / 1e6 * F.coalesce("in_per_m", F.lit(0.0))
        + F.col("output_tokens") / 1e6 * F.coalesce("out_per_m", F.lit(0.0))
    )
    return usage.join(prices, "model", "left").groupBy(*keys).agg(F.sum(cost).alias("cost"))


def corpus_rollup(reports: DataFrame) -> DataFrame:
    """Audits, mean score and verdict counts by brand and post type, with subtotals."""
    return reports.rollup("brand", "post_type").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("audits"),
        F.round(F.avg("final_score"), 6).alias("mean_score"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("ship", "edit", "block")],
    )


def check_prevalence(findings: DataFrame, key: str, documents: int | Column) -> DataFrame:
    """Share of documents with each (check, severity).

    Documents are made distinct per check first, so the count itself is a plain combinable sum even
    for a check that holds most of the table.
    """
    hit = findings.select("check_id", "severity", key).distinct()
    total = F.lit(documents) if isinstance(documents, int) else documents
    return hit.groupBy("check_id", "severity").agg(F.count("*").alias("docs")).withColumn(
        "share", F.round(F.col("docs") / total, 6)
    )


def citations_for_check(findings: DataFrame) -> DataFrame:
    """Rule and anti-pattern ids of each finding's check; empty when the check cites nothing."""
    cites = F.broadcast(dims.dim_citation(findings.sparkSession))
    none = F.array().cast("array<int>")
    return findings.join(cites, "check_id", "left").withColumns(
        {"rule_ids": F.coalesce("rule_ids", none), "anti_pattern_ids": F.coalesce("anti_pattern_ids", none)}
    )


def rubric_join(findings: DataFrame) -> DataFrame:
    """Critical findings with target, weight and hint of their rubric entry."""
    return findings.filter(F.col("severity") == "critical").join(
        F.broadcast(dims.dim_rubric(findings.sparkSession)), "check_id", "left"
    )


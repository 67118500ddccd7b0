"""Audit, patch and audit again: a bounded number of rounds over the posts that are still open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.operators import findings as fnd, lineage as li, remedy, scoring
from inkgauge.plans import audit as au
from inkgauge.session import ensure_checkpoint_dir, small_batches

KEPT = ["doc_id", "brand", "slug", "post_type"]


def plan(df: DataFrame) -> DataFrame:
    """Planned patches of one round: ``word_patches``, ``span_patches``, ``meta_patches``, ``schema_patches``."""
    df = remedy.page_context(df)
    suggested = F.array_compact(F.transform("found", lambda f: f["patch"]))
    return df.withColumns(
        {
            "word_patches": remedy.word_patches(),
            "span_patches": remedy.dedupe_spans(suggested),
            "meta_patches": remedy.meta_patches(df),
            "schema_patches": remedy.schema_patches(df),
        }
    )


def apply(df: DataFrame) -> DataFrame:
    """Apply the planned patches in order; ``applied`` counts the accepted ones.

    A source without a body element is no whole page: every patch of it is rejected, with that reason in ``patch_log``.
    """
    shown = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", "")
    kinds = ("word_patches", "span_patches", "meta_patches", "schema_patches")
    df = df.withColumn("whole", F.coalesce(shown.rlike(r"(?i)<body[\s>]"), F.lit(False)))
    refused = F.flatten(F.array(*[remedy.rejected(F.col(k), "page without a body element") for k in kinds]))
    df = df.withColumn("refused", F.when(F.col("whole"), F.array().cast(f"array<{remedy.OUTCOME}>")).otherwise(refused))
    df = df.withColumns({k: F.when(F.col("whole"), F.col(k)).otherwise(remedy.no_patches()) for k in kinds})
    df = df.withColumn("w", remedy.apply_rewrites(
        F.col("word_patches"), F.col("rewrites"), F.col("html"), F.coalesce("article_body_html", F.lit(""))
    ))
    df = df.withColumn("s", remedy.apply_spans(F.col("span_patches"), F.col("w.html"), F.col("w.body")))
    df = df.withColumn("m", remedy.apply_meta(F.col("meta_patches"), F.col("s.html")))
    df = df.withColumn("html", F.col("m.html")).withColumn(
        "article_body_html", F.when(F.col("article_body_html").isNotNull(), F.col("s.body"))
    )
    df = remedy.apply_schema_inserts(df)
    log = F.concat("refused", "w.log", "s.log", "m.log", "schema_log")
    changed_head = F.exists(F.concat("m.log", "schema_log"), lambda e: e["ok"])
    return df.withColumns(
        {
            "applied": F.size(F.filter(log, lambda e: e["ok"])),
            "patch_log": log,
            # After a head edit the JSON-LD of the page counts, no longer the one supplied with the post.
            "schemas_json": F.when(~changed_head, F.col("schemas_json")),
        }
    ).drop("w", "s", "m", "schema_log", "refused", "whole")


def audit_rounds(
    posts: DataFrame,
    rewrites: DataFrame | None = None,
    judgements: DataFrame | None = None,
    costs: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    target: int = dims.TARGET_SCORE,
    max_rounds: int = dims.MAX_ROUNDS,
    today: str | None = None,
    preflight: DataFrame | None = None,
    families: list | None = None,
) -> DataFrame:
    """Iterations of every post, the last one with its stop reason, status and verdict.

    ``rewrites``: (doc_id, kind, before, after) with kind title, description or sentence.
    ``judgements``: (doc_id, round, judge, answer). ``costs``: (doc_id, round, cost).
    ``preflight``: findings from outside (doc_id, severity, …); nothing here can patch them, so a critical one
    escalates its post. ``families``: the checks to run, all by default.
    Each round is written to the checkpoint folder, so neither the plan nor the work grows with the
    number of rounds, and a lost executor does not repeat earlier rounds.
    """
    spark = posts.sparkSession
    ensure_checkpoint_dir(spark)
    day = F.date_format(F.current_date(), "yyyy-MM-dd") if today is None else F.lit(today)
    df = posts.withColumns(
        {n: F.lit(None).cast(t) for n, t in {**au.OPTIONAL, "article_body_html": "string"}.items() if n not in posts.columns}
    )
    if rewrites is not None:
        # A post has one title, one description and a rewording per flagged sentence.
        wording = rewrites.groupBy("doc_id").agg(
            F.max(F.when(F.col("kind") == "title", F.col("after"))).alias("new_title"),
            F.max(F.when(F.col("kind") == "description", F.col("after"))).alias("new_description"),
            F.collect_set(F.when(F.col("kind") == "sentence", F.struct("before", "after"))).alias("rewrites"),
        )
        df = df.join(wording, "doc_id", "left")
    else:
        df = df.withColumns({"new_title": F.lit(None).cast("string"), "new_description": F.lit(None).cast("string")})
    none = F.array().cast("array<struct<before:string,after:string>>")
    if preflight is not None:
        outside = preflight.groupBy("doc_id").agg(F.count_if(F.col("severity") == "critical").cast("int").alias("outside_critical"))
        df = df.join(outside, "doc_id", "left").withColumn("outside_critical", F.coalesce("outside_critical", F.lit(0)))
    else:
        df = df.withColumn("outside_critical", F.lit(0))
    families = au.FAMILIES if families is None else families
    df = df.withColumn("rewrites", F.coalesce("rewrites", none) if "rewrites" in df.columns else none)
    carried = df.columns
    df = df.withColumns(
        {
            "last_overall": F.lit(None).cast("int"), "last_delta": F.lit(None).cast("int"),
            "running_cost": F.lit(0.0), "today": day,
        }
    )
    closed = []
    for i in range(max_rounds + 1):
        ready = au.prepare(df, keep_html=True)
        for family in families:
            ready = family.measures(ready)
        ready = ready.withColumn("found", fnd.all_found(families))
        if judgements is not None:
            ready = au.judged(ready, judgements.filter(F.col("round") == i)).withColumn(
                "found", F.concat("found", au._or_empty("human_found"), au._or_empty("quality_found"))
            )
        ready = au.score(ready, weights)
        if costs is not None:
            now = costs.filter(F.col("round") == i).groupBy("doc_id").agg(F.sum("cost").alias("spent"))
            ready = ready.join(now, "doc_id", "left")
        else:
            ready = ready.withColumn("spent", F.lit(0.0))
        delta = F.coalesce(F.col("overall") - F.col("last_overall"), F.lit(0))
        ready = ready.withColumns(
            {
                "iteration": F.lit(i),
                "running_cost": F.col("running_cost") + F.coalesce("spent", F.lit(0.0)),
                "delta": delta,
                "stalled": (F.lit(i) >= 2) & (delta < 2) & (F.coalesce("last_delta", F.lit(0)) < 2),
                "unfixable": F.size(
                    F.filter("found", lambda f: (f["severity"] == "critical") & f["patch"].isNull())
                ) + F.col("outside_critical"),
                "critical_count": F.col("critical_count") + F.col("outside_critical"),
            }
        )
        ready = plan(ready).withColumn(
            "planned", F.size("word_patches") + F.size("span_patches") + F.size("meta_patches") + F.size("schema_patches")
        )
        ready = ready.select(
            *[c for c in carried if c in ready.columns], *[c for c in ("article_body_html", "post_type") if c in ready.columns and c not in carried],
            "found", "technical", "humanization", "quality", "overall", "critical_count", "iteration", "delta", "stalled",
            "unfixable", "planned", "running_cost", "today", "word_patches", "span_patches", "meta_patches", "schema_patches",
        )
        c = F.col
        done = apply(ready).withColumn(
            "stop_reason",
            li.stop_rule(
                c("overall"), c("unfixable"), c("iteration"), c("running_cost"), c("stalled"), c("planned"), c("applied"),
                target, max_rounds,
            ),
        )
        # The source is kept only where another round follows.
        on = c("stop_reason").isNull()
        done = done.withColumns({n: F.when(on, c(n)) for n in ("html", "article_body_html")})
        with small_batches(spark):
            done = done.checkpoint()
        closed.append(
            done.select(
                *KEPT, "iteration", "technical", "humanization", "quality", "overall", "delta", "critical_count", "planned",
                "applied", "running_cost", "stop_reason", "found", "patch_log",
                li.status_of(c("stop_reason")).alias("status"), scoring.verdict(c("critical_count"), c("overall"), target).alias("verdict"),
            )
        )
        still = done.filter(F.col("stop_reason").isNull())
        if i == max_rounds or still.isEmpty():
            break
        df = still.select(
            *carried, c("overall").alias("last_overall"), c("delta").alias("last_delta"), "running_cost", "today"
        )
    return reduce(DataFrame.unionByName, closed)

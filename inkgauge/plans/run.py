"""A whole run over a corpus: audit, diff to the run before, versions, instructions, and the tables to keep.

The page sources are read once and never move: what the later steps need of a post (its findings, instructions and
paragraphs) is written to the checkpoint folder, and all joins with earlier runs and outside findings are made on that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.operators import findings as fnd, lineage as li, remedy, style
from inkgauge.operators.scoring import citations_for_check
from inkgauge.plans import audit as au
from inkgauge.session import ensure_checkpoint_dir
from inkgauge.sources.runs import write_run_table

NO_COUNTS = {"fixed": 0, "unresolved": 0, "regressed": 0}


@dataclass(frozen=True)
class Run:
    """``reports``: a row per post with scores, verdict, version and prior counts. ``findings``: the long table with
    citations, outside findings last. ``prior_issues``: every finding of the run before and what became of it.
    ``adjudication``: outside findings that own checks can confirm or reject, if there were any. ``paragraphs``: measures of each paragraph. ``instructions``: the repair record of each post as JSON. ``index``:
    newest-first index rows. ``final``: the consolidated record of every post that has reached its last version."""

    reports: DataFrame
    findings: DataFrame
    prior_issues: DataFrame
    adjudication: DataFrame | None
    paragraphs: DataFrame
    instructions: DataFrame
    index: DataFrame
    final: DataFrame

    def write(self, root: str, batch: str) -> None:
        """Findings, scores, reports and paragraphs below ``root``; writing a batch again replaces it."""
        at = self.reports.select("doc_id", "brand", F.substring("started_at", 1, 7).alias("run_date"))
        write_run_table(self.findings.join(at, "doc_id"), f"{root}/findings", batch)
        scores = self.reports.select("doc_id", "technical", "humanization", "quality", "overall", "iterations", "total_cost")
        write_run_table(scores.join(at, "doc_id"), f"{root}/scores", batch)
        write_run_table(self.reports.drop("found", "instructions", "paragraphs", "brand").join(at, "doc_id"), f"{root}/reports", batch)
        write_run_table(self.paragraphs.join(at, "doc_id"), f"{root}/paragraphs", batch)


def audited(posts: DataFrame, judgements: DataFrame | None, families: list[fnd.Family] | None) -> DataFrame:
    """found, instructions and paragraphs of every post; the page sources end here."""
    df = au.prepare(posts, keep_html=True)
    chosen = au.FAMILIES if families is None else families
    for family in chosen:
        df = family.measures(df)
    df = df.withColumn("found", fnd.all_found(chosen))
    if judgements is not None:
        df = au.judged(df, judgements).withColumn("found", F.concat("found", au._or_empty("human_found"), au._or_empty("quality_found")))
    kept = ["doc_id", "brand", "slug", "post_type", "found", "paragraphs", *[c for c in df.columns if c.endswith("_judge_score")]]
    return df.select(*kept, remedy.instructions().alias("instructions"))


def full_run(
    posts: DataFrame,
    started_at: str,
    prior_runs: DataFrame | None = None,
    prior_findings: DataFrame | None = None,
    preflight: DataFrame | None = None,
    judgements: DataFrame | None = None,
    iterations: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    target: int = dims.TARGET_SCORE,
    families: list[fnd.Family] | None = None,
) -> Run:
    """``prior_runs``: (doc_id, started_at) of earlier runs. ``prior_findings``: (doc_id, ord, check_id, severity) of the
    last one. ``iterations``: (doc_id, iteration, cost) where rounds of patching went before; without it a run is one
    iteration at no cost. ``started_at``: ISO time of this run."""
    spark = posts.sparkSession
    ensure_checkpoint_dir(spark)
    checked = audited(posts, judgements, families).checkpoint()
    current = fnd.explode_findings(checked)
    reports = au.verdicts(checked, preflight, weights, target).withColumn("started_at", F.lit(started_at)).withColumn("final_score", F.col("overall"))
    earlier = prior_runs if prior_runs is not None else spark.createDataFrame([], "doc_id bigint, started_at string")
    if prior_findings is None:
        prior_findings = spark.createDataFrame([], "doc_id bigint, ord int, check_id string, severity string")
    issues = li.prior_diff(prior_findings, current, ["doc_id"])
    rounds = iterations if iterations is not None else reports.select("doc_id", F.lit(0).alias("iteration"), F.lit(0.0).alias("cost"))
    reports = (
        reports.join(earlier.groupBy("doc_id").agg(F.count("*").alias("before")), "doc_id", "left")
        .join(li.status_counts(issues, ["doc_id"]), "doc_id", "left")
        .join(rounds.groupBy("doc_id").agg((F.max("iteration") + 1).cast("int").alias("iterations"), F.sum("cost").alias("total_cost")), "doc_id", "left")
        .fillna({**NO_COUNTS, "iterations": 1, "total_cost": 0.0})
        .withColumn("version", (F.coalesce("before", F.lit(0)) + 1).cast("int")).drop("before")
        .withColumn("is_final", F.col("version") >= dims.FINAL_VERSION)
    )
    reports = reports.checkpoint()
    paragraphs = style.paragraph_metrics(style.paragraph_rows(checked))
    regressed = issues.filter("status = 'regressed'").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "check_id", "status", "severity", "previous_severity"))).alias("regressions")
    )
    none = F.array().cast("array<struct<ord:int,check_id:string,status:string,severity:string,previous_severity:string>>")
    asked = reports.join(regressed, "doc_id", "left").withColumn("regressions", F.coalesce("regressions", none))
    findings, adjudication = citations_for_check(current), None
    if preflight is not None:
        findings = au.findings_table(checked, preflight)
        adjudication = li.reconcile_preflight(current, preflight, ["doc_id"])["adjudication"]
        # The record of a post holds all it is asked to do, so what was reported of it from outside is gathered here.
        told = preflight.groupBy("doc_id").agg(F.array_sort(F.collect_list(remedy.outside_instruction())).alias("told"))
        nothing = F.array().cast(f"array<{remedy.INSTRUCTION}>")
        asked = asked.join(told, "doc_id", "left").withColumn("instructions", remedy.by_severity(F.concat("instructions", F.coalesce("told", nothing))))
    versions = earlier.select("doc_id", "started_at").unionByName(reports.select("doc_id", "started_at"))
    return Run(
        reports, findings, issues, adjudication, paragraphs, remedy.instruction_payload(asked).select("doc_id", "payload"), li.run_index(reports),
        li.final_summary(reports, versions, paragraphs),
    )

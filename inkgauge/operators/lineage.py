"""Runs over time: versions, diffs against the run before, outside witnesses, stop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators.scoring import rank


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt out by key into so many parts; left to the engine without a number.

    The engine makes as many parts as its settings say. A number that grows with the table keeps the share of a task,
    and with it the memory of its sorts and groupings, the same.
    """
    return df if parts is None else df.repartition(parts, *keys)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """Row number of each row in its group, exact even when one group holds much of the table.

    ``bucket`` must grow with ``order``. Rows are numbered inside (group, bucket), and the sizes of the
    earlier buckets are added, so a hot group is spread over as many tasks as it has buckets. The sizes
    are combined before their shuffle, and rows move once: the join and the window share a partitioning, one of
    ``parts`` parts if given.
    """
    rows = dealt(df.withColumn("_b", bucket), parts, *keys, "_b")
    sizes = dealt(rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n")), parts, *keys)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        rows.join(offsets, [*keys, "_b"])
        .withColumn(name, (F.col("_off") + F.row_number().over(w)).cast("int"))
        .drop("_b", "_off")
    )


def time_bucket(time: str) -> Column:
    return F.date_trunc("day", F.col(time))


def version_lineage(reports: DataFrame, keys: list[str], time: str, run: str) -> DataFrame:
    """``version`` counts the runs of a post in time order; ``is_final`` from version 3 on.

    The times of earlier versions are the rows of the same post with a smaller version: kept as rows,
    since a list in every run would grow with the square of the number of runs.
    """
    made = numbered(reports, keys, time_bucket(time), [time, run], "version")
    return made.withColumn("is_final", F.col("version") >= dims.FINAL_VERSION)


def next_runs(runs: DataFrame, post: list[str], time: str, run: str) -> DataFrame:
    """(run, next_run) of the same post; a post with very many runs is split by day."""
    rows = runs.select(*post, time, run).withColumn("_b", time_bucket(time))
    firsts = rows.groupBy(*post, "_b").agg(F.min_by(run, F.struct(time, run)).alias("_first"))
    onward = firsts.select(*post, "_b", F.lead("_first").over(Window.partitionBy(*post).orderBy("_b")).alias("_next_first"))
    w = Window.partitionBy(*post, "_b").orderBy(time, run)
    return rows.join(onward, [*post, "_b"]).select(
        run, F.coalesce(F.lead(run).over(w), F.col("_next_first")).alias("next_run")
    ).filter("next_run is not null")


def last_by_check(findings: DataFrame, keys: list[str]) -> DataFrame:
    """For each check of a run the severity raised last.

    ``max_by`` combines before the shuffle; over ranks, which have a fixed width, it also hashes.
    """
    last = findings.groupBy(*keys, "check_id").agg(F.max_by(rank(F.col("severity")), "ord").alias("r"))
    names = F.array(*[F.lit(s) for s, _ in sorted(dims.SEVERITY_RANK.items(), key=lambda kv: kv[1])])
    return last.select(*keys, "check_id", F.get(names, F.col("r") - 1).alias("current_severity"))


def prior_diff(previous: DataFrame, current: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Every finding of the previous run, against the current one: fixed, regressed or still present.

    Both inputs carry ``keys`` naming the current run. Repeated checks of the previous run repeat here.
    ``parts``: into how many parts both are dealt.
    """
    now = last_by_check(dealt(current, parts, *keys, "check_id"), keys)
    status = (
        F.when(F.col("current_severity").isNull(), "fixed")
        .when(rank(F.col("current_severity")) > rank(F.col("severity")), "regressed")
        .otherwise("still_present")
    )
    return dealt(previous, parts, *keys, "check_id").join(now, [*keys, "check_id"], "left").select(
        *keys, "ord", "check_id",
        F.coalesce("current_severity", "severity").alias("severity"),
        status.alias("status"),
        F.col("severity").alias("previous_severity"),
    )


def previous_findings(findings: DataFrame, runs: DataFrame, post: list[str], time: str, run: str) -> DataFrame:
    """Findings of each run's predecessor, under the id of the run that follows."""
    chain = next_runs(runs, post, time, run)
    return findings.join(chain, run).withColumn(run, F.col("next_run")).drop("next_run")


def diff_consecutive(findings: DataFrame, runs: DataFrame, post: list[str], time: str, run: str, parts: int | None = None) -> DataFrame:
    """``prior_diff`` of every run against the run before it of the same post."""
    return prior_diff(previous_findings(findings, runs, post, time, run), findings, [run], parts)


def new_issues(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Checks of the current run that the previous one did not raise."""
    return current.select(*keys, "check_id").distinct().join(
        previous.select(*keys, "check_id").distinct(), [*keys, "check_id"], "left_anti"
    )


def status_counts(diff: DataFrame, keys: list[str]) -> DataFrame:
    return diff.groupBy(*keys).agg(
        *[
            F.count_if(F.col("status") == status).alias(name)
            for status, name in (("fixed", "fixed"), ("still_present", "unresolved"), ("regressed", "regressed"))
        ]
    )


def final_iteration_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of each run's last iteration. The last number is a combinable max, not a sort of the run."""
    last = findings.groupBy(*keys).agg(F.max("iteration").alias("iteration"))
    return findings.join(last, [*keys, "iteration"])


def reconcile_preflight(
    findings: DataFrame, preflight: DataFrame, keys: list[str], source: str = "writer",
) -> dict[str, DataFrame]:
    """Two-witness check of findings reported from outside.

    Codes are read as "source:code"; only those of ``source`` have equivalents, all others pass through.
    ``adjudication`` holds the mapped ones: confirmed when any own equivalent was raised, else rejected
    with the reason. ``findings`` turns every outside finding into a ``preflight`` row.
    """
    witness = dims.dim_witness(findings.sparkSession)
    named = F.startswith("check_id", F.lit(source + ":"))
    mapped = preflight.withColumn("code", F.when(named, F.substring("check_id", len(source) + 2, 1000)))
    own_names = witness.groupBy("code").agg(F.sort_array(F.collect_list("own_check")).alias("own_checks"))
    # Only findings that can witness something are kept, one per key and check.
    seen = (
        findings.select(*keys, F.col("check_id").alias("own_check"))
        .join(F.broadcast(witness), "own_check")
        .select(*keys, "code")
        .distinct()
        .withColumn("seen", F.lit(True))
    )
    judged = (
        mapped.join(F.broadcast(own_names), "code")
        .join(seen, [*keys, "code"], "left")
        .select(
            *keys, "check_id", F.coalesce("seen", F.lit(False)).alias("confirmed"),
            F.when(
                F.col("seen").isNull(),
                F.concat(
                    F.lit("own checks ["), F.array_join("own_checks", ", "),
                    F.lit("] saw nothing; scope or limits may differ"),
                ),
            ).alias("reason"),
        )
    )
    as_findings = preflight.select(
        *keys, "check_id", F.lit("preflight").alias("layer"), "severity", "evidence",
        F.lit("static").alias("truth_badge"),
    )
    return {"adjudication": judged, "findings": as_findings}


# --- iterations of one run --------------------------------------------------------------------


def iteration_measures(iterations: DataFrame, keys: list[str]) -> DataFrame:
    """Delta to the iteration before, stall flag and running cost of each iteration."""
    w = Window.partitionBy(*keys).orderBy("iteration")
    df = iterations.withColumns(
        {
            "delta": F.coalesce(F.col("overall") - F.lag("overall").over(w), F.lit(0)),
            "running_cost": F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "nth": F.row_number().over(w),
        }
    )
    stalled = (F.col("nth") >= 3) & (F.col("delta") < 2) & (F.lag("delta").over(w) < 2)
    return df.withColumn("stalled", F.coalesce(stalled, F.lit(False)))


def stop_rule(
    overall: Column, unfixable: Column, iteration: Column, running_cost: Column, stalled: Column,
    planned: Column, applied: Column, target: int = dims.TARGET_SCORE, max_rounds: int = dims.MAX_ROUNDS,
    cost_cap: float = dims.COST_CAP,
) -> Column:
    """Why a post stops at this iteration; NULL when it goes on. The order of the rules matters."""
    return (
        F.when(overall >= target, "target_reached")
        .when(unfixable > 0, "unfixable_critical")
        .when(iteration >= max_rounds, "max_iterations")
        .when(running_cost > cost_cap, "cost_cap")
        .when(stalled, "stalled")
        .when(planned == 0, "no_patches")
        .when(applied == 0, "all_rejected")
    )


#: What a stop reason means for the post.
STATUS = {
    "target_reached": "shipped",
    "unfixable_critical": "escalated",
    "max_iterations": "escalated",
    "cost_cap": "budget_exceeded",
    "stalled": "stalled",
    "no_patches": "stalled",
    "all_rejected": "stalled",
}


def status_of(stop_reason: Column) -> Column:
    """shipped, escalated, budget_exceeded or stalled; open while there is no reason to stop."""
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(names[stop_reason], F.lit("open"))


# --- ordering and top-k -----------------------------------------------------------------------


def top_actions(findings: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` findings by severity, ties in the order raised."""
    w = Window.partitionBy(*keys).orderBy(rank(F.col("severity")).desc(), F.col("ord"))
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def fix_order(findings: DataFrame, keys: list[str], span: int = 100_000, parts: int | None = None) -> DataFrame:
    """Place of every finding in its run's repair list; a very long list is split by severity and position."""
    r = rank(F.col("severity"))
    bucket = F.struct((-r).alias("r"), F.floor(F.col("ord") / span).alias("o"))
    return numbered(findings, keys, bucket, ["ord"], "place", parts)


def flagged_paragraphs(paragraphs: DataFrame, keys: list[str], fallback: int = 10) -> DataFrame:
    """Paragraphs with an issue flag; for a post that has none, its first ten.

    The window holds the paragraphs of one post, never more than the one page they came from.
    """
    flagged = F.size("issue_flags") > 0
    rows = paragraphs.withColumn("any_flag", F.max(flagged).over(Window.partitionBy(*keys)))
    return rows.filter(flagged | (~F.col("any_flag") & (F.col("index") < fallback))).drop("any_flag")


# --- keys, index, summary ---------------------------------------------------------------------


def run_key(brand: Column, slug: Column, started_at: Column) -> Column:
    """brand/slug/time, fit for a path. ``started_at`` is ISO text."""
    return F.concat_ws("/", X.path_key(brand), X.path_key(slug), F.translate(started_at, ":.", "--"))


def run_index(reports: DataFrame) -> DataFrame:
    """Newest-first index rows of all runs."""
    c = F.col
    diff = F.when(
        c("fixed") + c("unresolved") + c("regressed") > 0,
        F.format_string("%d fixed / %d open / %d regressed", c("fixed"), c("unresolved"), c("regressed")),
    ).otherwise("—")
    return reports.select(
        F.concat(F.substring("started_at", 1, 19), F.lit("Z")).alias("date"), "brand", "slug", "post_type",
        F.concat(F.lit("v"), c("version").cast("string"), F.when(c("is_final"), " · FINAL").otherwise("")).alias("version_label"),
        F.upper("verdict").alias("verdict_label"),
        F.concat(
            c("final_score").cast("string"),
            F.when(c("critical_count") > 0, F.concat(F.lit(" · "), c("critical_count").cast("string"), F.lit(" critical"))).otherwise(""),
        ).alias("score_label"),
        diff.alias("prior_label"), "iterations", "total_cost",
        run_key(c("brand"), c("slug"), c("started_at")).alias("run_key"),
    ).orderBy(F.desc("date"), "run_key")


def final_summary(reports: DataFrame, versions: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """One consolidated record per run that is final.

    ``versions``: (doc_id, started_at) of all runs of the posts, this one included. ``paragraphs``: their measures. Both
    are gathered only for final posts; a post has few versions, and its paragraphs come from one page.
    """
    shown = ["brand", "slug", "post_type", "version", "verdict", "verdict_reason", "final_score", "critical_count", "started_at"]
    final = reports.filter("is_final")
    ids = final.select("doc_id") if versions is not None or paragraphs is not None else None
    if versions is not None:
        times = versions.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list("started_at")).alias("version_history"))
        final, shown = final.join(times, "doc_id", "left"), [*shown, "version_history"]
    if paragraphs is not None:
        fields = [c for c in paragraphs.columns if c not in ("doc_id", "index")]
        rows = paragraphs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("index", *fields))).alias("paragraph_metrics")
        )
        empty = F.array().cast(rows.schema["paragraph_metrics"].dataType)
        final = final.join(rows, "doc_id", "left").withColumn("paragraph_metrics", F.coalesce("paragraph_metrics", empty))
        shown = [*shown, "paragraph_metrics"]
    return final.select("brand", "slug", "version", F.to_json(F.struct(*shown)).alias("summary"))


def version_history(reports: DataFrame) -> DataFrame:
    """Times of all versions of the posts that have reached a final one, one row each."""
    final = reports.filter(F.col("version") == dims.FINAL_VERSION).select("brand", "slug")
    return reports.join(final, ["brand", "slug"], "left_semi").select("brand", "slug", "version", "started_at")

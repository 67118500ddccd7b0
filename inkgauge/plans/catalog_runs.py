"""Registered queries over runs and findings: scores, verdicts, lineage, ordering, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.operators import judge, lineage as li, scoring as sc, style
from inkgauge.plans import duck as D
from inkgauge.plans.catalog_text import SIGNALS_CTE, _AXES, _SIGNAL_HITS, texts
from inkgauge.plans.fixtures import fixture, put_files, run_parts, table, with_fixtures
from inkgauge.session import fresh_path
from inkgauge.sources import posts as src_posts, runs as src_runs

QUERIES: dict = {}
RUN = ["run_id"]


def findings(spark, sf) -> DataFrame:
    return fixture(spark, sf, "synth_findings")


def runs(spark, sf) -> DataFrame:
    return fixture(spark, sf, "synth_runs")


def keys(spark, sf) -> DataFrame:
    return runs(spark, sf).select("run_id")


def case(column: str, values: dict, default="0") -> str:
    return f"case {column} " + " ".join(f"when {D.q(k)} then {v}" for k, v in values.items()) + f" else {default} end"


RANK = case("severity", dims.SEVERITY_RANK)
TECH = f"tech AS (SELECT r.run_id, cast(greatest(0, 100 - coalesce(sum(case when layer in ('technical', 'eeat') then {case('severity', dims.PAGE_PENALTY)} end), 0)) as int) AS technical FROM synth_runs r LEFT JOIN synth_findings f ON f.run_id = r.run_id GROUP BY r.run_id)"
HUMAN = f"human AS (SELECT r.run_id, cast(greatest(0, 100 - coalesce(sum(case when layer = 'humanization' then {case('severity', dims.STYLE_PENALTY)} end), 0)) as int) AS humanization FROM synth_runs r LEFT JOIN synth_findings f ON f.run_id = r.run_id GROUP BY r.run_id)"


def over(select: str, names: str = "synth_findings synth_runs") -> str:
    return with_fixtures(names, select)


# --- scores -----------------------------------------------------------------------------------

QUERIES["score_technical"] = (
    lambda spark, sf: sc.score_technical(findings(spark, sf), keys(spark, sf), RUN),
    over(f"WITH {TECH} SELECT run_id, technical FROM tech"),
)
QUERIES["score_humanization_signals"] = (
    lambda spark, sf: sc.score_humanization_signals(findings(spark, sf), keys(spark, sf), RUN),
    over(f"WITH {HUMAN} SELECT run_id, humanization FROM human"),
)


def blended(spark, sf) -> DataFrame:
    found = style.TEXT_SIGNALS.measures(texts(spark, sf)).select("doc_id", style.TEXT_SIGNALS.findings().alias("found"))
    signal = found.select("doc_id", sc.array_score(F.col("found"), ["humanization"], dims.STYLE_PENALTY).alias("signal"))
    judged = judge.parse_answers(fixture(spark, sf, "synth_judge")).select("doc_id", judge.axis_score().alias("judge"))
    return signal.join(judged, "doc_id", "left").select("doc_id", "signal", sc.blend(F.col("signal"), F.col("judge")).alias("humanization"))


QUERIES["blend_humanization"] = (
    blended,
    with_fixtures(
        "synth_text synth_judge",
        f"WITH {SIGNALS_CTE}, hits AS ({D.hits(_SIGNAL_HITS, 'n')}), sig AS (SELECT t.doc_id, cast(greatest(0, 100 - coalesce(sum({case('severity', dims.STYLE_PENALTY)}), 0)) as int) AS signal FROM t LEFT JOIN hits h ON h.doc_id = t.doc_id GROUP BY t.doc_id), "
        f"{_AXES}, jd AS (SELECT s.doc_id, case when avg(score) is null then 70 else greatest(0, least(100, floor(avg(score) * 10 + 0.5))) end AS j FROM synth_judge s LEFT JOIN axes a ON a.doc_id = s.doc_id GROUP BY s.doc_id) "
        "SELECT sig.doc_id, signal, cast(coalesce(floor(round(signal * 0.45 + j * 0.55, 10) + 0.5), signal) as int) AS humanization FROM sig LEFT JOIN jd ON jd.doc_id = sig.doc_id",
    ),
)


def three_scores(spark, sf) -> DataFrame:
    f, k = findings(spark, sf), keys(spark, sf)
    both = sc.score_technical(f, k, RUN).join(sc.score_humanization_signals(f, k, RUN), "run_id")
    return both.withColumn("quality", (F.lit(40) + F.col("run_id") % 61).cast("int"))


THREE = f"{TECH}, {HUMAN}, three AS (SELECT run_id, technical, humanization, cast(40 + run_id % 61 as int) AS quality FROM tech JOIN human USING (run_id))"


def composed(spark, sf) -> DataFrame:
    weights = spark.createDataFrame(
        [(0, 0.35, 0.4, 0.25), (1, 1.0, 1.0, 2.0), (2, 0.0, 0.0, 0.0)],
        "weights_id int, w_technical double, w_humanization double, w_quality double",
    )
    df = three_scores(spark, sf).withColumn("weights_id", (F.col("run_id") % 3).cast("int"))
    return sc.weighted_overall(df, weights).select("run_id", "technical", "humanization", "quality", "overall")


_MIX = ("case run_id % 3 when 1 then technical * 0.25 + humanization * 0.25 + quality * 0.5 else technical * 0.35 + humanization * 0.4 + quality * 0.25 end")
QUERIES["compose_overall"] = (
    composed,
    over(f"WITH {THREE} SELECT run_id, technical, humanization, quality, cast(floor(round({_MIX}, 10) + 0.5) as int) AS overall FROM three"),
)
QUERIES["count_critical"] = (
    lambda spark, sf: sc.count_critical(findings(spark, sf), RUN),
    over("SELECT run_id, cast(count(*) FILTER (WHERE severity = 'critical') as int) AS critical_count FROM synth_findings GROUP BY run_id"),
)


def overall_scores(spark, sf) -> DataFrame:
    df = sc.score_posts(findings(spark, sf), keys(spark, sf), RUN).withColumn("quality", (F.lit(40) + F.col("run_id") % 61).cast("int"))
    return df.select("run_id", sc.overall(F.col("technical"), F.col("humanization"), F.col("quality")).alias("overall"), "critical_count")


def verdicts(spark, sf) -> DataFrame:
    return sc.derive_verdict(findings(spark, sf), overall_scores(spark, sf), RUN, target=80)


OVERALL = "ov AS (SELECT run_id, cast(floor(round(technical * 0.35 + humanization * 0.4 + quality * 0.25, 10) + 0.5) as int) AS overall FROM three)"
QUERIES["derive_verdict"] = (
    verdicts,
    over(f"""WITH {THREE}, {OVERALL}, cr AS (SELECT run_id, count(*) AS n, list(check_id order by ord)[1:3] AS ids FROM synth_findings WHERE severity = 'critical' GROUP BY run_id)
      SELECT ov.run_id, overall, cast(coalesce(n, 0) as int) AS critical_count, case when n > 0 then 'block' when overall >= 80 then 'ship' else 'edit' end AS verdict,
      case when n > 0 then n || ' critical finding(s) — cannot ship: ' || array_to_string(ids, ', ') || case when n > 3 then '...' else '' end
        when overall >= 80 then 'Overall ' || overall || ' ≥ target 80' else 'Overall ' || overall || ' < target 80; no criticals but needs editing' end AS verdict_reason
      FROM ov LEFT JOIN cr ON cr.run_id = ov.run_id"""),
)


def usage(spark, sf) -> DataFrame:
    prices = spark.createDataFrame([("large", 15.0, 75.0), ("small", 0.8, 4.0)], "model string, in_per_m double, out_per_m double")
    cost = sc.usage_cost(fixture(spark, sf, "synth_usage"), prices, ["doc_id"])
    return cost.select("doc_id", F.round("cost", 6).alias("cost"))


QUERIES["usage_cost"] = (
    usage,
    with_fixtures(
        "synth_usage",
        "SELECT doc_id, round(sum(input_tokens / 1e6 * coalesce(i, 0) + output_tokens / 1e6 * coalesce(o, 0)), 6) AS cost FROM synth_usage "
        "LEFT JOIN (VALUES ('large', 15.0, 75.0), ('small', 0.8, 4.0)) p(model, i, o) USING (model) GROUP BY doc_id",
    ),
)


def reports(spark, sf) -> DataFrame:
    """One row per run with score, verdict, version and diff counts."""
    v = overall_scores(spark, sf).withColumn("verdict", sc.verdict(F.col("critical_count"), F.col("overall"), 80)).withColumnRenamed("overall", "final_score")
    versioned = li.version_lineage(runs(spark, sf), ["brand", "slug"], "started", "run_id")
    counts = li.status_counts(diffs(spark, sf), RUN)
    return versioned.join(v, "run_id").join(counts, "run_id", "left").fillna(0, ["fixed", "unresolved", "regressed"])


def diffs(spark, sf) -> DataFrame:
    return li.diff_consecutive(findings(spark, sf), runs(spark, sf).select("slug_id", "run_id", "started"), ["slug_id"], "started", "run_id", run_parts(spark, sf))


CHAIN = "chain AS (SELECT run_id, lead(run_id) over (partition by slug_id order by started, run_id) AS next_run FROM synth_runs)"
DIFF = f"""{CHAIN}, prev AS (SELECT c.next_run AS run_id, f.ord, f.check_id, f.severity FROM synth_findings f JOIN chain c ON c.run_id = f.run_id WHERE next_run IS NOT NULL),
cur AS (SELECT run_id, check_id, arg_max(severity, ord) AS now FROM synth_findings GROUP BY run_id, check_id),
diff AS (SELECT p.run_id, p.ord, p.check_id, coalesce(now, severity) AS severity, case when now is null then 'fixed' when {RANK.replace('case severity', 'case now')} > {RANK} then 'regressed' else 'still_present' end AS status, severity AS previous_severity
  FROM prev p LEFT JOIN cur USING (run_id, check_id)),
counts AS (SELECT run_id, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'still_present') AS unresolved, count(*) FILTER (WHERE status = 'regressed') AS regressed FROM diff GROUP BY run_id)"""
QUERIES["prior_diff"] = (
    diffs, over(f"WITH {DIFF} SELECT run_id, ord, check_id, severity, status, previous_severity FROM diff"),
)
QUERIES["prior_status_counts"] = (
    lambda spark, sf: li.status_counts(diffs(spark, sf), RUN), over(f"WITH {DIFF} SELECT * FROM counts"),
)


def fresh(spark, sf) -> DataFrame:
    f, r = findings(spark, sf), runs(spark, sf)
    return li.new_issues(li.previous_findings(f, r, ["slug_id"], "started", "run_id"), f, RUN)


QUERIES["new_issues"] = (
    fresh, over(f"WITH {DIFF} SELECT run_id, check_id FROM cur c WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.run_id = c.run_id AND p.check_id = c.check_id)"),
)
REPORTS = f"""{THREE}, {OVERALL}, {DIFF}, cr AS (SELECT run_id, count(*) AS n FROM synth_findings WHERE severity = 'critical' GROUP BY run_id),
rep AS (SELECT r.*, row_number() over (partition by brand, slug order by started, r.run_id) AS version, overall AS final_score, coalesce(n, 0) AS critical_count,
  case when n > 0 then 'block' when overall >= 80 then 'ship' else 'edit' end AS verdict, coalesce(fixed, 0) AS fixed, coalesce(unresolved, 0) AS unresolved, coalesce(regressed, 0) AS regressed
  FROM synth_runs r JOIN ov ON ov.run_id = r.run_id LEFT JOIN cr ON cr.run_id = r.run_id LEFT JOIN counts ON counts.run_id = r.run_id)"""
QUERIES["corpus_rollup"] = (
    lambda spark, sf: sc.corpus_rollup(reports(spark, sf)),
    over(f"WITH {REPORTS} SELECT brand, post_type, cast(grouping(brand) * 2 + grouping(post_type) as int) AS level, count(*) AS audits, round(avg(final_score), 6) AS mean_score, "
         "count(*) FILTER (WHERE verdict = 'ship') AS ship, count(*) FILTER (WHERE verdict = 'edit') AS edit, count(*) FILTER (WHERE verdict = 'block') AS block FROM rep GROUP BY ROLLUP (brand, post_type)"),
)


def prevalence(spark, sf) -> DataFrame:
    total = keys(spark, sf).agg(F.count("*").alias("total"))
    counted = sc.check_prevalence(findings(spark, sf), "run_id", 1).drop("share")
    # One row on the right: its size is fixed by the aggregate.
    return counted.join(F.broadcast(total)).select("check_id", "severity", "docs", F.round(F.col("docs") / F.col("total"), 6).alias("share"))


QUERIES["check_prevalence"] = (
    prevalence,
    over("SELECT check_id, severity, count(distinct run_id) AS docs, round(count(distinct run_id) / (SELECT count(*) FROM synth_runs), 6) AS share FROM synth_findings GROUP BY check_id, severity"),
)

# --- lineage ----------------------------------------------------------------------------------

QUERIES["version_lineage"] = (
    lambda spark, sf: li.version_lineage(runs(spark, sf), ["brand", "slug"], "started", "run_id").select("run_id", "version", "is_final"),
    over("SELECT run_id, row_number() over w AS version, row_number() over w >= 3 AS is_final FROM synth_runs WINDOW w AS (partition by brand, slug order by started, run_id)", "synth_runs"),
)
ITER = """im AS (SELECT *, coalesce(overall - lag(overall) over w, 0) AS delta, sum(cost) over (w rows between unbounded preceding and current row) AS running_cost, row_number() over w AS nth FROM synth_iterations WINDOW w AS (partition by doc_id order by iteration)),
ir AS (SELECT *, coalesce(nth >= 3 and delta < 2 and lag(delta) over (partition by doc_id order by iteration) < 2, false) AS stalled FROM im)"""


def iterations(spark, sf) -> DataFrame:
    return li.iteration_measures(fixture(spark, sf, "synth_iterations"), ["doc_id"])


def registered_iterations():
    for query, name in (("iteration_delta", "delta"), ("stall_detection", "stalled"), ("running_cost", "running_cost")):
        sql = f"round({name}, 6)" if name == "running_cost" else name

        def run(spark, sf, name=name) -> DataFrame:
            shown = F.round(name, 6).alias(name) if name == "running_cost" else F.col(name)
            return iterations(spark, sf).select("doc_id", "iteration", shown)

        QUERIES[query] = (run, with_fixtures("synth_iterations", f"WITH {ITER} SELECT doc_id, iteration, {sql} AS {name} FROM ir"))


registered_iterations()


def stops(spark, sf) -> DataFrame:
    c = F.col
    df = iterations(spark, sf)
    rule = li.stop_rule(c("overall"), c("unfixable"), c("iteration"), F.round("running_cost", 6), c("stalled"), c("planned"), c("applied"))
    return df.select("doc_id", "iteration", rule.alias("stop_reason"))


QUERIES["stop_reason"] = (
    stops,
    with_fixtures(
        "synth_iterations",
        f"WITH {ITER} SELECT doc_id, iteration, case when overall >= 90 then 'target_reached' when unfixable > 0 then 'unfixable_critical' when iteration >= 5 then 'max_iterations' "
        "when round(running_cost, 6) > 0.75 then 'cost_cap' when stalled then 'stalled' when planned = 0 then 'no_patches' when applied = 0 then 'all_rejected' end AS stop_reason FROM ir",
    ),
)
QUERIES["final_iteration_findings"] = (
    lambda spark, sf: li.final_iteration_findings(findings(spark, sf), RUN).select("run_id", "iteration", "ord", "check_id"),
    over("SELECT run_id, iteration, ord, check_id FROM (SELECT *, max(iteration) over (partition by run_id) AS m FROM synth_findings) WHERE iteration = m", "synth_findings"),
)

# --- ordering ---------------------------------------------------------------------------------

_PLACE = f"SELECT run_id, row_number() over (partition by run_id order by {RANK} desc, ord) AS place, ord, check_id, severity FROM synth_findings"
QUERIES["top_actions"] = (
    lambda spark, sf: li.top_actions(findings(spark, sf), RUN, 5).select("run_id", "place", "ord", "check_id", "severity"),
    over(f"SELECT * FROM ({_PLACE}) WHERE place <= 5", "synth_findings"),
)
QUERIES["fix_order"] = (
    lambda spark, sf: li.fix_order(findings(spark, sf), RUN, 10**12, run_parts(spark, sf)).select("run_id", "place", "ord", "check_id", "severity"), over(_PLACE, "synth_findings"),
)

# --- joins with rules and witnesses -----------------------------------------------------------


# --- keys, index, summary, sinks --------------------------------------------------------------

_CLEAN = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_PATH = "case when length({c}) <= 80 then {c} else substr({c}, 1, 80) || '-' || substr(sha256({0}), 1, 16) end"
_BRAND, _SLUG = (_PATH.format(v, c=_CLEAN.format(v)) for v in ("brand", "slug"))
_KEY = f"{_BRAND} || '/' || {_SLUG} || '/' || replace(replace(started_at, ':', '-'), '.', '-')"
QUERIES["run_key"] = (
    lambda spark, sf: runs(spark, sf).select("run_id", li.run_key(F.col("brand"), F.col("slug"), F.col("started_at")).alias("run_key")),
    over(f"SELECT run_id, {_KEY} AS run_key FROM synth_runs", "synth_runs"),
)


QUERIES["version_history"] = (
    lambda spark, sf: li.version_history(li.version_lineage(runs(spark, sf), ["brand", "slug"], "started", "run_id")),
    over("WITH v AS (SELECT brand, slug, row_number() over (partition by brand, slug order by started, run_id) AS version, count(*) over (partition by brand, slug) AS n, started_at FROM synth_runs) "
         "SELECT brand, slug, version, started_at FROM v WHERE n >= 3", "synth_runs"),
)


# --- sources ----------------------------------------------------------------------------------

_FILES = [
    ("metadata.json", "page_id % 10 <> 9", "'{\"brand\": {\"name\": ' || case when page_id % 3 = 0 then 'null' else '\"Acme\"' end || '}, \"post\": {\"topic\": \"How to test\"' || case when page_id % 2 = 0 then ', \"slug\": \"s' || cast(page_id as string) || '\"' else '' end || '}, \"quality\": {\"word_count\": ' || cast(page_id * 10 as string) || '}}'"),
    ("full-page.html", "page_id % 13 <> 5", "html"),
    ("article-body.html", "page_id % 4 = 0", "'<p>body</p>'"),
    ("meta-tags.json", "page_id % 5 = 0", "'{\"title\": \"T\", \"og\": {\"title\": \"O\"}}'"),
    ("notes.txt", "page_id % 2 = 0", "'ignored'"),
]


def post_files(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    parts = [
        pages.filter(F.expr(cond)).select(F.expr(f"'post-' || cast(page_id as string) || '/{name}'").alias("path"), F.expr(content).alias("content"))
        for name, cond, content in _FILES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def post_dirs(spark, sf) -> DataFrame:
    """Folders of files in the shared folder, read by the loader."""
    root = fresh_path(spark, "posts")
    put_files(post_files(spark, sf), root)
    return src_posts.load_post_dirs(spark, root).select(
        F.regexp_extract("source_dir", "[^/]*$", 0).alias("folder"), "slug", "brand", "topic", "word_count", F.sha2("html", 256).alias("page"),
        F.length("article_body_html").alias("n_body"), F.coalesce(F.size("meta"), F.lit(0)).alias("n_meta"),
    )


QUERIES["load_post_dirs"] = (
    post_dirs,
    "SELECT 'post-' || page_id AS folder, case when page_id % 2 = 0 then 's' || page_id else 'post-' || page_id end AS slug, case when page_id % 3 = 0 then 'unknown' else 'Acme' end AS brand, "
    "'How to test' AS topic, cast(page_id * 10 as int) AS word_count, sha256(html) AS page, case when page_id % 4 = 0 then 11 else length(html) end AS n_body, case when page_id % 5 = 0 then 2 else 0 end AS n_meta "
    "FROM pages WHERE page_id % 10 <> 9 AND page_id % 13 <> 5",
)


def record_lines(spark, sf) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("slug"),
                F.struct(F.lit("Acme").alias("name"), F.col("url").alias("website")).alias("brand"), "html",
                F.when(F.col("page_id") % 2 == 0, F.lit("<p>b</p>")).alias("articleBodyHtml"),
                F.when(F.col("page_id") % 3 == 0, F.lit("guide")).alias("format"), F.col("page_id").cast("int").alias("wordCount"),
            )
        ).alias("value")
    )


def post_records(spark, sf) -> DataFrame:
    """Records written as JSON lines and read by the loader."""
    path = fresh_path(spark, "records")
    record_lines(spark, sf).write.text(path)
    return src_posts.load_post_records(spark, path).select(
        "doc_id", "slug", "brand", "brand_website", "format", "word_count", F.length("html").alias("n_html"), F.length("article_body_html").alias("n_body")
    )


QUERIES["load_post_records"] = (
    post_records,
    "SELECT 'Acme/s' || page_id AS doc_id, 's' || page_id AS slug, 'Acme' AS brand, url AS brand_website, case when page_id % 3 = 0 then 'guide' end AS format, cast(page_id as int) AS word_count, "
    "length(html) AS n_html, case when page_id % 2 = 0 then 8 else length(html) end AS n_body FROM pages",
)


def defaults(spark, sf) -> DataFrame:
    from inkgauge.operators.posts import post_defaults

    df = table(spark, sf, "pages").select(
        "page_id", "html", F.expr("case when page_id % 2 = 0 then 'own' end").alias("slug"), F.expr("case when page_id % 3 = 0 then 'Acme' end").alias("brand"),
        F.expr("case when page_id % 5 = 0 then 'b' end").alias("article_body_html"), F.expr("'/x/dir-' || cast(page_id as string) || '/'").alias("source_dir"),
    )
    return post_defaults(df).select("page_id", "slug", "brand", F.length("article_body_html").alias("n_body"))


QUERIES["post_defaults"] = (
    defaults,
    "SELECT page_id, case when page_id % 2 = 0 then 'own' else 'dir-' || page_id end AS slug, case when page_id % 3 = 0 then 'Acme' else 'unknown' end AS brand, case when page_id % 5 = 0 then 1 else length(html) end AS n_body FROM pages",
)
_TS = "case when run_id % 19 = 0 then 'draft' else replace(replace(started_at, ':', '-'), '.', '-') end"
_REPORT = "'{\"version\": ' || cast(run_id % 5 + 1 as string) || ', \"iterations\": [{\"iteration\": 0, \"findings\": []}, {\"iteration\": 1, \"findings\": [{\"checkId\": \"C1\", \"severity\": \"warn\"}]}]' || case when run_id % 17 = 0 then '' else '}' end"


def history(spark, sf) -> DataFrame:
    """Reports written as partitioned lines and read by the loader; every other brand is left to the partition filter."""
    root, r = fresh_path(spark, "audits"), runs(spark, sf)
    lines = r.select(
        F.expr(_REPORT).alias("value"), F.expr("'brand-' || cast(slug_id % 7 as string)").alias("brand_key"), F.expr("'post-' || cast(slug_id % 10 as string)").alias("slug_key"), F.expr(_TS).alias("run_time"),
    )
    lines.repartition("brand_key", "slug_key", F.substring("run_time", 1, 4)).withColumn("run_time", F.substring("run_time", 1, 10)).withColumn(
        "run_time", F.when(F.col("run_time") != "draft", F.concat(F.substring("run_time", 1, 7), F.lit("-01T00"))).otherwise("draft")
    ).write.partitionBy("brand_key", "slug_key", "run_time").text(root)
    out = src_runs.load_run_history(spark, root, brand="Brand 3").unionByName(src_runs.load_run_history(spark, root, brand="brand-5", slug="post-1"))
    return out.groupBy("brand_key", "slug_key", "run_time", "version", F.get("findings", F.lit(0))["checkId"].alias("check_id")).agg(F.count("*").alias("n"))


QUERIES["load_run_history"] = (
    history,
    over("SELECT 'brand-' || slug_id % 7 AS brand_key, 'post-' || slug_id % 10 AS slug_key, substr(started_at, 1, 7) || '-01T00' AS run_time, cast(run_id % 5 + 1 as int) AS version, 'C1' AS check_id, count(*) AS n "
         "FROM synth_runs WHERE run_id % 19 <> 0 AND run_id % 17 <> 0 AND (slug_id % 7 = 3 OR slug_id % 7 = 5 AND slug_id % 10 = 1) GROUP BY 1, 2, 3, 4", "synth_runs"),
)

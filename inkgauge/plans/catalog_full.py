"""Registered queries over a whole run of the derived pages: every check family, outside findings, earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.operators import findings as fnd, lineage as li, scoring as sc, structure as st
from inkgauge.plans import duck as D
from inkgauge.plans.audit import audit
from inkgauge.plans.catalog_audit import ALL, SCORED, _points, posts
from inkgauge.plans.catalog_pages import BARE, QUERIES as PAGES, over
from inkgauge.plans.catalog_repair import BLOCKS, _offending_sql
from inkgauge.plans.catalog_runs import RANK, _CLEAN, _PATH
from inkgauge.plans.fixtures import ADA, SOUND_PAGES, SYNTH_PAGES, fixture, sound_jsonld, with_fixtures
from inkgauge.plans.rounds import audit_rounds
from inkgauge.plans.run import Run, full_run
from inkgauge.session import fresh_path
from inkgauge.sources import runs as src_runs

QUERIES: dict = {}
STARTED = "2026-04-30T10:00:00.000Z"


def pages_run(spark, sf) -> Run:
    return full_run(
        posts(spark, sf), STARTED, prior_runs=fixture(spark, sf, "synth_history"), prior_findings=fixture(spark, sf, "synth_prior"),
        preflight=fixture(spark, sf, "synth_preflight"), iterations=fixture(spark, sf, "synth_iterations").select("doc_id", "iteration", "cost"),
    )


# --- comparison -------------------------------------------------------------------------------

_TRI = _offending_sql(D.TRICOLON).replace("off AS", "off2 AS").replace("top AS", "top2 AS").replace("FROM off ", "FROM off2 ")
#: How many paragraphs a style finding is spread over.
_FAN = over(f"""WITH {BARE}, {BLOCKS}, {_offending_sql(D.PASSIVE)}, {_TRI}
  SELECT doc_id, 'H_em_dash_overuse' AS check_id, 'apply_patch' AS how, count(*) AS n FROM uniq WHERE once AND contains(b, '—') GROUP BY doc_id
  UNION ALL SELECT doc_id, 'H_passive_overuse', 'attempt_rewrite', count(*) FROM top WHERE rn <= 5 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'H_tricolon_density', 'attempt_rewrite', count(*) FROM top2 WHERE rn <= 5 GROUP BY doc_id""")
_PRE = with_fixtures("synth_preflight", "SELECT doc_id, check_id, 'preflight' AS layer, severity FROM synth_preflight")
INSTRUCTIONS = f"""SELECT f.doc_id, f.check_id, f.severity, f.layer,
  coalesce(how, case when f.severity = 'critical' then 'human_fix_required' when starts_with(f.check_id, 'D_') or starts_with(f.check_id, 'S_missing_') then 'insert_missing'
    when starts_with(f.check_id, 'M_') then 'edit_schema' else 'attempt_rewrite' end) AS action, coalesce(n, 1) AS n, coalesce(n, 0) AS targeted
  FROM ({ALL} UNION ALL SELECT * FROM ({_PRE})) f LEFT JOIN ({_FAN}) fan ON fan.doc_id = f.doc_id AND fan.check_id = f.check_id"""
_PRIOR = f"""prior AS ({with_fixtures("synth_prior", "SELECT * FROM synth_prior")}), now AS (SELECT DISTINCT doc_id, check_id, severity FROM ({ALL})),
  diff AS (SELECT p.doc_id, case when n.severity is null then 'fixed' when {RANK.replace('case severity', 'case n.severity')} > {RANK.replace('case severity', 'case p.severity')} then 'regressed' else 'still_present' end AS status
    FROM prior p LEFT JOIN now n ON n.doc_id = p.doc_id AND n.check_id = p.check_id),
  dc AS (SELECT doc_id, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'still_present') AS unresolved, count(*) FILTER (WHERE status = 'regressed') AS regressed FROM diff GROUP BY doc_id)"""
_OUT = "case when v.doc_id % 25 = 0 then 1 else 0 end"
REPORTS = f"""{SCORED}, {_PRIOR}, it AS ({with_fixtures("synth_iterations", "SELECT doc_id, max(iteration) + 1 AS iterations, sum(cost) AS cost FROM synth_iterations GROUP BY doc_id")}),
  rep AS (SELECT v.doc_id, 'Brand ' || (v.doc_id % 7) AS brand, 'Post No. ' || v.doc_id AS slug, v.overall, v.critical_count + {_OUT} AS critical_count, case when v.doc_id % 25 = 0 then 'block' else v.verdict end AS verdict,
    cast(v.doc_id % 4 + 1 as int) AS version, coalesce(fixed, 0) AS fixed, coalesce(unresolved, 0) AS unresolved, coalesce(regressed, 0) AS regressed,
    cast(coalesce(iterations, 1) as int) AS iterations, round(coalesce(cost, 0), 6) AS total_cost
    FROM v LEFT JOIN dc ON dc.doc_id = v.doc_id LEFT JOIN it ON it.doc_id = v.doc_id)"""


# --- queries ----------------------------------------------------------------------------------


def instructed(spark, sf) -> DataFrame:
    read = F.from_json("payload", "instructions array<struct<check_id:string,severity:string,layer:string,action:string,evidence:string>>")
    rows = fnd.rows_of(pages_run(spark, sf).instructions.select("doc_id", read["instructions"].alias("x")), ["doc_id"], "x", "nth", "x")
    return rows.groupBy("doc_id", "x.check_id", "x.severity", "x.layer", "x.action").agg(
        F.count("*").alias("n"), F.count_if(F.col("x.evidence").rlike("; paragraph [0-9]+ of [0-9]+$")).alias("targeted"), F.count_if(F.col("x.evidence") != "").alias("explained")
    )


QUERIES["instructions"] = (
    instructed,
    f"SELECT doc_id, check_id, severity, layer, action, cast(sum(n) as bigint) AS n, cast(sum(targeted) as bigint) AS targeted, cast(sum(n) as bigint) AS explained FROM ({INSTRUCTIONS}) GROUP BY 1, 2, 3, 4, 5",
)


def payloads(spark, sf) -> DataFrame:
    made = pages_run(spark, sf).instructions
    shape = (
        "meta struct<version:int,next_version:int,is_final:boolean,is_final_pending:boolean,verdict:string,final_score:int,critical_count:int>, fix_order array<string>, "
        "instructions array<struct<severity:string>>, regressions array<struct<check_id:string>>"
    )
    return made.select("doc_id", F.from_json("payload", shape).alias("p")).select(
        "doc_id", "p.meta.*", F.size("p.fix_order").alias("n_order"), F.get("p.instructions", F.lit(0))["severity"].alias("first_severity"),
        F.size("p.regressions").alias("n_regressions"),
    )


QUERIES["instruction_payload"] = (
    payloads,
    f"""{REPORTS}, i AS ({INSTRUCTIONS}), g AS (SELECT doc_id, cast(sum(n) as int) AS n_order, max({RANK}) AS r FROM i GROUP BY doc_id)
      SELECT rep.doc_id, version, version + 1 AS next_version, version >= 3 AS is_final, version = 2 AS is_final_pending, verdict, overall AS final_score, cast(critical_count as int) AS critical_count, n_order,
      case r when 4 then 'critical' when 3 then 'fail' when 2 then 'warn' when 1 then 'info' end AS first_severity, cast(regressed as int) AS n_regressions FROM rep LEFT JOIN g ON g.doc_id = rep.doc_id""",
)


def rubric(spark, sf) -> DataFrame:
    rows = sc.rubric_join(pages_run(spark, sf).findings).groupBy("doc_id", "check_id", "category", "weight", "auto_fixable")
    return rows.agg(F.count("*").alias("n"))


_RUBRIC = ", ".join(f"({D.q(k)}, {D.q(v[0])}, {v[3]}, {str(v[4]).lower()})" for k, v in dims.RUBRIC.items())
QUERIES["rubric_join"] = (
    rubric,
    f"SELECT doc_id, check_id, category, weight, auto_fixable, count(*) AS n FROM ({ALL} UNION ALL SELECT * FROM ({_PRE})) LEFT JOIN (VALUES {_RUBRIC}) r(check_id, category, weight, auto_fixable) USING (check_id) WHERE severity = 'critical' GROUP BY 1, 2, 3, 4, 5",
)
QUERIES["reconcile_preflight"] = (
    lambda spark, sf: pages_run(spark, sf).adjudication.select("doc_id", "check_id", "confirmed"),
    with_fixtures(
        "synth_preflight",
        f"WITH own AS ({ALL}) SELECT doc_id, check_id, exists(SELECT 1 FROM own o WHERE o.doc_id = p.doc_id AND o.check_id = w.own) AS confirmed FROM synth_preflight p "
        "JOIN (VALUES ('B2', 'S_h2_question_ratio_low'), ('F7', 'S_visible_last_updated_missing'), ('F2', 'E_no_first_party_data')) w(code, own) ON p.check_id = 'writer:' || w.code",
    ),
)


def loaded_preflight(spark, sf) -> DataFrame:
    """Outside findings written as JSON lines and read by the loader, then adjudicated beside the page checks."""
    path = fresh_path(spark, "preflight")
    fixture(spark, sf, "synth_preflight").withColumn("doc_id", F.col("doc_id").cast("string")).write.json(path)
    outside = src_runs.load_preflight(spark, path, "json").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return li.reconcile_preflight(pages_run(spark, sf).findings, outside, ["doc_id"])["findings"]


QUERIES["load_preflight"] = (
    loaded_preflight,
    with_fixtures("synth_preflight", "SELECT doc_id, check_id, 'preflight' AS layer, severity, evidence, 'static' AS truth_badge FROM synth_preflight"),
)

_BRAND, _SLUG = (_PATH.format(v, c=_CLEAN.format(v)) for v in ("brand", "slug"))
QUERIES["run_index"] = (
    lambda spark, sf: pages_run(spark, sf).index.drop("post_type").withColumn("total_cost", F.round("total_cost", 6)),
    f"""{REPORTS} SELECT '{STARTED[:19]}Z' AS date, brand, slug, 'v' || version || case when version >= 3 then ' · FINAL' else '' end AS version_label,
      upper(verdict) AS verdict_label, overall || case when critical_count > 0 then ' · ' || critical_count || ' critical' else '' end AS score_label,
      case when fixed + unresolved + regressed > 0 then fixed || ' fixed / ' || unresolved || ' open / ' || regressed || ' regressed' else '—' end AS prior_label,
      iterations, total_cost, {_BRAND} || '/' || {_SLUG} || '/' || '{STARTED.replace(":", "-").replace(".", "-")}' AS run_key FROM rep""",
)


def finals(spark, sf) -> DataFrame:
    shape = "verdict string, final_score int, version_history array<string>, paragraph_metrics array<struct<index:int,word_count:int,issue_flags:array<string>>>"
    read = pages_run(spark, sf).final.select("brand", "slug", "version", F.from_json("summary", shape).alias("s"))
    return read.select(
        "brand", "slug", "version", "s.verdict", "s.final_score", F.array_join("s.version_history", ",").alias("times"), F.size("s.paragraph_metrics").alias("n_paragraphs"),
        F.aggregate("s.paragraph_metrics", F.lit(0), lambda a, m: a + m["word_count"]).alias("n_words"),
    )


_TIMES = " || ".join(f"case when doc_id % 4 >= {k} then '2026-0{k}-01T00:00:00.000Z,' else '' end" for k in (1, 2, 3))
QUERIES["final_summary"] = (
    finals,
    f"""{REPORTS}, pm AS (SELECT doc_id, cast(count(*) as int) AS n, cast(sum({D.word_count(D.collapse('paragraph'))}) as int) AS w FROM ({PAGES['paragraph_blocks'][1]}) GROUP BY doc_id)
      SELECT brand, slug, version, verdict, overall AS final_score, {_TIMES.replace('doc_id', 'rep.doc_id')} || '{STARTED}' AS times, coalesce(n, 0) AS n_paragraphs, coalesce(w, 0) AS n_words
      FROM rep LEFT JOIN pm ON pm.doc_id = rep.doc_id WHERE version >= 3""",
)


def written(spark, sf) -> DataFrame:
    """The run tables, written twice under one batch and read back."""
    path, run = fresh_path(spark, "run-tables"), pages_run(spark, sf)
    run.write(path, "b1")
    run.write(path, "b1")
    parts = []
    for name in ("findings", "scores", "reports", "paragraphs"):
        rows = spark.read.parquet(f"{path}/{name}").filter("batch = 'b1'").groupBy("brand", "run_date")
        parts.append(rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).withColumn("name", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("name", "brand", "run_date", "n", "docs")


QUERIES["write_run_tables"] = (
    written,
    f"""WITH t AS (SELECT 'findings' AS name, doc_id FROM ({ALL} UNION ALL SELECT * FROM ({_PRE})) UNION ALL SELECT 'scores', page_id FROM pages UNION ALL SELECT 'reports', page_id FROM pages
      UNION ALL SELECT 'paragraphs', doc_id FROM ({PAGES['paragraph_blocks'][1]}))
      SELECT name, 'Brand ' || (doc_id % 7) AS brand, '2026-04' AS run_date, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1, 2, 3""",
)


def own_checks(spark, sf) -> DataFrame:
    """An audit with two families of the library and one of one's own, which reads the elements of the page."""
    long_lists = fnd.Family(
        "long_lists",
        lambda df: df.withColumn("list_items", F.size(F.filter("elements", lambda e: e["tag"] == "li"))),
        lambda: fnd.collect(fnd.finding("X_long_lists", "technical", "info", "static", F.format_string("%d list items", F.col("list_items")), F.col("list_items") > 3)),
    )
    reports = audit(posts(spark, sf), families=[st.STRUCTURE, st.META, long_lists])
    return reports.select("doc_id", "technical", F.size("found").alias("n"), F.exists("found", lambda f: f["check_id"] == "X_long_lists").alias("long_lists"))


_OWN = f"""SELECT doc_id, check_id, severity FROM ({PAGES['detect_structure'][1]}) UNION ALL SELECT doc_id, check_id, severity FROM ({PAGES['detect_meta'][1]})
  UNION ALL SELECT doc_id, 'X_long_lists', 'info' FROM ({over(f"WITH {BARE} SELECT doc_id FROM p WHERE len(regexp_extract_all(bare, '<li[ >]')) > 3")})"""
QUERIES["detector_registration"] = (
    own_checks,
    f"""SELECT page_id AS doc_id, cast(greatest(0, 100 - coalesce(sum({_points(dims.PAGE_PENALTY)}), 0)) as int) AS technical, cast(count(check_id) as int) AS n,
      coalesce(bool_or(check_id = 'X_long_lists'), false) AS long_lists FROM pages LEFT JOIN ({_OWN}) f ON f.doc_id = page_id GROUP BY page_id""",
)


# --- rounds -----------------------------------------------------------------------------------


def rounds(spark, sf) -> DataFrame:
    pages = fixture(spark, sf, "sound_pages")
    sentence = pages.select("doc_id", F.lit("sentence").alias("kind"), F.lit("The robust plan held.").alias("before"), F.lit("The sturdy plan held.").alias("after"))
    out = audit_rounds(pages, rewrites=sentence, today="2026-04-30")
    return out.select("doc_id", "iteration", "overall", "delta", "critical_count", "planned", "applied", "stop_reason")


def _rounds_sql() -> str:
    """Two rounds by hand: the pages as they are, and the pages with every planned patch made."""
    required, google, advised = dims.ENTITY_FIELDS["BlogPosting"]
    # Members that can be set, and where they are missing.
    known = {
        "author": ("page_id % 2 <> 0", f"""', "author": {ADA}'"""), "image": ("true", """', "image": "/own.png"'"""),
        "dateModified": ("true", """', "dateModified": "2026-04-30"'"""), "description": ("true", """', "description": "D"'"""),
        "mainEntityOfPage": ("true", """', "mainEntityOfPage": "https://site.example.com/p"'"""), "inLanguage": ("true", """', "inLanguage": "en-US"'"""),
    }
    asked = [known[f] for f in [x for x in google if x in ("author", "image")] + [x for x in advised if x in ("dateModified", "description", "mainEntityOfPage", "inLanguage")]]
    members = " || ".join(f"case when {when} then {text} else '' end" for when, text in asked)
    titles = """'<meta property="og:title" content="T"><meta property="og:type" content="article">' || case when page_id % 4 <> 0 then '<meta property="og:description" content="D">' else '' end"""
    columns = "brand, cast(null as varchar) AS brand_website, slug, cast(null as varchar) AS format, cast(null as varchar) AS topic, cast(null as varchar) AS primary_keyword, cast(null as int) AS word_count"
    base = f"(SELECT doc_id AS page_id, brand, slug, html FROM ({SOUND_PAGES.strip()}))"
    before = f"SELECT page_id AS doc_id, {columns}, html, {sound_jsonld()} AS jsonld FROM {base}"
    after = f"""SELECT page_id AS doc_id, {columns}, replace(replace(html, '</head>', {titles} || '</head>'), 'The robust plan held.', 'The sturdy plan held.') AS html,
      {sound_jsonld(members)} AS jsonld FROM {base}"""
    scored = [SCORED.replace(SYNTH_PAGES.strip(), pages) + " SELECT doc_id, overall, critical_count FROM v" for pages in (before, after)]
    planned = "case when doc_id % 5 = 0 then 1 else 0 end + 2 + case when doc_id % 4 <> 0 then 1 else 0 end + " + " + ".join(
        f"case when {when.replace('page_id', 'doc_id')} then 1 else 0 end" for when, _ in asked
    )
    return f"""WITH r0 AS ({scored[0]}), r1 AS ({scored[1]})
      SELECT doc_id, 0 AS iteration, overall, 0 AS delta, critical_count, cast({planned} as int) AS planned, cast({planned} as int) AS applied, cast(null as varchar) AS stop_reason FROM r0
      UNION ALL SELECT r1.doc_id, 1, r1.overall, r1.overall - r0.overall, r1.critical_count, 0, 0, 'no_patches' FROM r1 JOIN r0 ON r0.doc_id = r1.doc_id"""


QUERIES["audit_rounds"] = (rounds, _rounds_sql())

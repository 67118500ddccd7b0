"""Registered queries over the whole audit, compared with the union of the single checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.operators import findings as fnd
from inkgauge.plans import catalog_jsonld as cj, duck as D
from inkgauge.plans.audit import audit, detect, findings_table, prepare
from inkgauge.plans.catalog_pages import LD, QUERIES as PAGES, over
from inkgauge.plans.catalog_text import SIGNALS_CTE, TEXTS, _SIGNAL_HITS
from inkgauge.plans.fixtures import SYNTH_JSONLD, SYNTH_PAGES, fixture
from inkgauge.session import ensure_checkpoint_dir

QUERIES: dict = {}

# --- the comparison: every check of every page ------------------------------------------------

_NUMBERED = LD.replace("ents AS (", "ents0 AS (").replace(
    "etypes AS (SELECT doc_id, n,", "ents AS (SELECT *, row_number() over () AS nth FROM ents0),\netypes AS (SELECT doc_id, nth, n,"
)


def _on_pages(name: str) -> str:
    """A JSON-LD comparison moved from the customer texts to the blocks of the pages."""
    sql = cj.QUERIES[name][1]
    sql = sql.replace(f"synth_jsonld AS ({SYNTH_JSONLD.strip()})", f"synth_pages AS ({SYNTH_PAGES.strip()})")
    return f"SELECT doc_id, check_id, severity FROM ({sql.replace(cj.LD, _NUMBERED)})"


_TEXT_OF_PAGES = f"t AS (SELECT doc_id, {D.visible('html')} AS body_text, {D.paragraphs()} AS paragraphs FROM synth_pages)"
_NO_BLOCK = over(f"WITH {LD} SELECT doc_id, 'D_no_schema_blocks' AS check_id, 'critical' AS severity FROM synth_pages WHERE doc_id NOT IN (SELECT doc_id FROM ld)")
_NO_ARTICLE = over(
    f"WITH {LD} SELECT doc_id, 'D_no_article_entity' AS check_id, 'critical' AS severity FROM ld WHERE doc_id NOT IN (SELECT doc_id FROM etypes WHERE type IN ('Article', 'BlogPosting', 'NewsArticle'))"
)
_STYLE = over(f"WITH {SIGNALS_CTE.replace(TEXTS, _TEXT_OF_PAGES)} " + D.hits(_SIGNAL_HITS, "n"))

_PAGE_CHECKS = [
    "detect_structure", "schema_validity", "detect_meta", "detect_canonical", "faq_parity", "detect_tldr", "detect_h2_questions",
    "detect_density", "detect_section_size", "detect_h2_extractable", "detect_last_updated", "detect_toc", "detect_word_band",
    "required_type_for_post",
]
_TRUST_CHECKS = ["detect_author", "detect_byline", "detect_first_party", "detect_original_visual", "detect_citations", "human_signal_bundle"]
_LD_CHECKS = ["field_completeness", "faq_main_entity_check", "breadcrumb_sequence", "iso_date_checks", "missing_ids", "id_resolution", "inline_over_reference"]


def _layer(layer: str, parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, check_id, '{layer}' AS layer, severity FROM ({p})" for p in parts)


ALL = " UNION ALL ".join(
    [
        _layer("technical", [PAGES[n][1] for n in _PAGE_CHECKS] + [_on_pages(n) for n in _LD_CHECKS] + [_NO_BLOCK, _NO_ARTICLE]),
        _layer("eeat", [PAGES[n][1] for n in _TRUST_CHECKS]),
        _layer("humanization", [_STYLE]),
    ]
)


def _points(table: dict) -> str:
    return "case severity " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " end"


SCORED = f"""WITH f AS ({ALL}), s AS (SELECT page_id AS doc_id,
  cast(greatest(0, 100 - coalesce(sum(case when layer in ('technical', 'eeat') then {_points(dims.PAGE_PENALTY)} end), 0)) as int) AS technical,
  cast(greatest(0, 100 - coalesce(sum(case when layer = 'humanization' then {_points(dims.STYLE_PENALTY)} end), 0)) as int) AS humanization,
  cast(count(*) FILTER (WHERE severity = 'critical') as int) AS critical_count FROM pages LEFT JOIN f ON f.doc_id = page_id GROUP BY page_id),
  o AS (SELECT *, 70 AS quality, cast(floor(round(technical * 0.35 + humanization * 0.4 + 70 * 0.25, 10) + 0.5) as int) AS overall FROM s),
  v AS (SELECT *, case when critical_count > 0 then 'block' when overall >= 90 then 'ship' else 'edit' end AS verdict FROM o)"""

# --- queries ----------------------------------------------------------------------------------


def posts(spark, sf) -> DataFrame:
    return fixture(spark, sf, "synth_pages").drop("jsonld")


def all_findings(spark, sf) -> DataFrame:
    rows = fnd.explode_findings(detect(prepare(posts(spark, sf))))
    return rows.groupBy("doc_id", "check_id", "layer", "severity").agg(F.count("*").alias("n"))


def full_audit(spark, sf) -> DataFrame:
    return audit(posts(spark, sf)).select(
        "doc_id", "technical", "humanization", "quality", "overall", "critical_count", "verdict"
    )


def preflight_audit(spark, sf) -> DataFrame:
    """The audit with outside findings: they add criticals and rows, never points."""
    outside = fixture(spark, sf, "synth_preflight")
    ensure_checkpoint_dir(spark)
    # Written once: scores and rows are both made of it, and the pages are audited a single time.
    reports = audit(posts(spark, sf), preflight=outside).checkpoint()
    rows = findings_table(reports, outside).filter("severity = 'critical'").groupBy("doc_id").agg(F.count("*").cast("int").alias("critical_rows"))
    return reports.select("doc_id", "overall", "critical_count", "verdict").join(rows, "doc_id", "left").fillna(0, ["critical_rows"])


QUERIES["all_findings"] = (
    all_findings, f"SELECT doc_id, check_id, layer, severity, count(*) AS n FROM ({ALL}) GROUP BY doc_id, check_id, layer, severity",
)
QUERIES["audit"] = (
    full_audit, f"{SCORED} SELECT doc_id, technical, humanization, quality, overall, critical_count, verdict FROM v",
)
QUERIES["audit_with_preflight"] = (
    preflight_audit,
    f"{SCORED} SELECT doc_id, overall, critical_count + case when doc_id % 25 = 0 then 1 else 0 end AS critical_count, case when doc_id % 25 = 0 then 'block' else verdict end AS verdict, "
    "critical_count + case when doc_id % 25 = 0 then 1 else 0 end AS critical_rows FROM v",
)
STREAM_SQL = f"{SCORED} SELECT doc_id, overall, critical_count, verdict FROM v"

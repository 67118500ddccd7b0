"""Registered queries over pages: the shredded tables and the page checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators import findings as fnd, jsonld, selectors, shred as sh, structure as st, style, trust
from inkgauge.plans import duck as D
from inkgauge.plans.audit import prepare
from inkgauge.plans.catalog_text import duck_normal_url
from inkgauge.plans.fixtures import fixture, table, with_fixtures

QUERIES: dict = {}


def shredded(spark, sf, *extra: str) -> DataFrame:
    return sh.shred(fixture(spark, sf, "synth_pages").select("doc_id", "html", *extra))


def with_text(spark, sf, *extra: str) -> DataFrame:
    posts = fixture(spark, sf, "synth_pages").select("doc_id", "html", *extra)
    return sh.shred(posts.withColumn("text", X.visible_text(F.col("html"))))


def typed(spark, sf) -> DataFrame:
    return prepare(fixture(spark, sf, "synth_pages"))


def rows(df: DataFrame, family: fnd.Family) -> DataFrame:
    return fnd.run_family(df, family).select("doc_id", "check_id", "severity")


def over(select: str) -> str:
    return with_fixtures("synth_pages", select)


# CTE p: pages without scripts, with the numbers most checks need.
BARE = f"p AS (SELECT *, {D.BARE} AS bare, {D.visible('html')} AS text FROM synth_pages)"
WORDS = "coalesce(word_count, " + D.word_count("text") + ")"


def tags(pattern: str) -> str:
    return f"len(regexp_extract_all(bare, {D.q(pattern)}))"


# --- elements ---------------------------------------------------------------------------------

_TAGS = f"""regexp_extract_all(bare || repeat('<style>', {D.found('html', '<style')}) || repeat('<script>', {D.found('html', '<script')}), '<[a-z][a-z0-9]*[^>]*>')"""
_ATTRS = ("href", "alt", "class", "content")
QUERIES["shred_elements"] = (
    lambda spark, sf: sh.elements_table(shredded(spark, sf)).groupBy("doc_id", "tag").agg(
        F.count("*").alias("n"), *[F.count(F.try_element_at("attrs", F.lit(a))).alias(f"n_{a}") for a in _ATTRS],
        *[F.max(F.try_element_at("attrs", F.lit(a))).alias(f"last_{a}") for a in _ATTRS],
        # In document order every element ends at or behind its place, inside its parent, one level deeper.
        F.bool_and((F.col("end_pos") >= F.col("pos")) & (F.col("parent_pos") < F.col("pos"))).alias("nested"),
    ),
    over(f"WITH {BARE} SELECT doc_id, tag, count(*) AS n, "
         + ", ".join(f"""count(*) FILTER (WHERE contains(t, ' {a}="')) AS n_{a}, max(case when contains(t, ' {a}="') then {D.decode(f"regexp_extract(t, ' {a}=" + '"([^"]*)"' + "', 1)")} end) AS last_{a}""" for a in _ATTRS)
         + f", true AS nested FROM (SELECT doc_id, t, regexp_extract(t, '<([a-z][a-z0-9]*)', 1) AS tag FROM (SELECT doc_id, unnest({_TAGS}) AS t FROM p)) GROUP BY doc_id, tag"),
)


#: name -> selector, comparison pattern (its group is the text of the element; no group: elements without text).
_SELECTED = {
    "nav links": ("nav li a[href^='/']", None),
    "canonical": ('link[rel="canonical"]', '<link rel="canonical"'),
    "open graph": ("meta[property^=og:]", '<meta property="og:'),
    "no alt": ("img[alt='']", '<img [^>]*alt=""'),
    "headings": ("h1, h2,h3", "<h[1-3]>([^<]*)"),
    "captions": ("figure figcaption", "<figcaption>([^<]*)"),
    "marked": ("p[data-tldr]", "<p data-tldr>([^<]*)"),
    "references": ('a[href*="REF.example.ORG" i]', '<a href="https://ref.example.org[^>]*>([^<]*)'),
    "byline": (".byline", '<div class="meta byline">([^<]*)'),
    "gifs": ("article img[src$=.gif], #none", '<img src="[^"]*\\.gif"'),
}


def selected(spark, sf) -> DataFrame:
    found = selectors.select_elements(fixture(spark, sf, "synth_pages"), {name: selector for name, (selector, _) in _SELECTED.items()})
    return found.groupBy("doc_id", "name").agg(
        F.count("*").alias("n"), F.min_by(X.collapse(F.col("text")), "nth").alias("first_text"), F.max(F.col("attrs")["href"]).alias("last_href")
    )


def _selected_sql() -> str:
    links = """SELECT doc_id, 'nav links' AS name, len(l) AS n, regexp_extract(l[1], '>([^<]*)</a>', 1) AS first_text, list_max(list_transform(l, lambda x: regexp_extract(x, 'href="([^"]*)"', 1))) AS last_href FROM n WHERE len(l) > 0"""
    parts = [links]
    for name, (_, pattern) in _SELECTED.items():
        if pattern:
            text = f"{D.decode(D.collapse(f'regexp_extract(bare, {D.q(pattern)}, 1)'))}" if "(" in pattern else "''"
            href = {"canonical": "regexp_extract(bare, '<link rel=\"canonical\" href=\"([^\"]*)\"', 1)", "references": "'https://ref.example.org/paper'"}.get(name, "null")
            parts.append(f"SELECT doc_id, '{name}', {tags(pattern)}, {text}, {href} FROM p WHERE {tags(pattern)} > 0")
    return (
        f"""WITH {BARE}, n AS (SELECT doc_id, regexp_extract_all(regexp_extract(bare, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="/[^"]*">[^<]*</a></li>') AS l FROM p) """
        + " UNION ALL ".join(parts)
    )


QUERIES["select_elements"] = (selected, over(_selected_sql()))


def containment(spark, sf) -> DataFrame:
    return selectors.containment(fixture(spark, sf, "synth_pages"), ["article", "nav", "figure", "ul", "ol"], ["li", "h2", "figcaption", "img"])


_NEST = " UNION ALL ".join(
    f"SELECT doc_id, '{o}' AS outer_tag, '{i}' AS inner_tag, list_sum(list_transform(regexp_extract_all(bare, '(?s)<{o}[ >].*?</{o}>'), lambda b: len(regexp_extract_all(b, '<{i}[ >]')))) AS n FROM p"
    for o in ("article", "nav", "figure", "ul", "ol") for i in ("li", "h2", "figcaption", "img")
)
QUERIES["interval_containment"] = (
    containment, over(f"WITH {BARE} SELECT doc_id, outer_tag, inner_tag, cast(n as bigint) AS n FROM ({_NEST}) WHERE n > 0"),
)


def meta_rows(df: DataFrame) -> DataFrame:
    return fnd.rows_of(st.head_meta(df), ["doc_id"], F.map_entries("head_meta"), "nth", "m").select("doc_id", "m.*")


_TITLE = D.decode("trim(regexp_extract(html, '<title>([^<]*)</title>', 1))")
HEAD_META = f"""hm AS (
  SELECT doc_id, 'title' AS key, {_TITLE} AS value FROM synth_pages
  UNION ALL SELECT doc_id, regexp_extract(t, '(?:name|property)="([^"]*)"', 1), regexp_extract(t, 'content="([^"]*)"', 1) FROM
    (SELECT doc_id, unnest(regexp_extract_all(html, '<meta (?:name|property)="[^"]*" content="[^"]+">')) AS t FROM synth_pages))"""
QUERIES["head_meta"] = (
    lambda spark, sf: meta_rows(shredded(spark, sf)), over(f"WITH {HEAD_META} SELECT doc_id, key, value FROM hm"),
)
CANON = """c AS (SELECT *, nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), '') AS canonical,
  nullif(regexp_extract(html, '<meta property="og:url" content="([^"]*)"', 1), '') AS og_url FROM synth_pages)"""
QUERIES["head_attr"] = (
    lambda spark, sf: st.CANONICAL.measures(shredded(spark, sf)).select("doc_id", "canonical", "og_url"),
    over(f"WITH {CANON} SELECT doc_id, canonical, og_url FROM c"),
)


def outline_rows(spark, sf) -> DataFrame:
    df = st.outline(shredded(spark, sf))
    return fnd.rows_of(df, ["doc_id"], "headings", "nth", "h").select("doc_id", "nth", "h.level", "h.prev_level", "h.text")


LEVELS = f"l AS (SELECT doc_id, list_transform(regexp_extract_all(bare, '<h([1-6])[ >]', 1), lambda x: cast(x as int)) AS lv, regexp_extract_all(bare, '<h[1-6]>([^<]*)', 1) AS tx FROM p)"
QUERIES["heading_outline"] = (
    outline_rows,
    over(f"WITH {BARE}, {LEVELS} SELECT doc_id, i - 1 AS nth, lv[i] AS level, case when i > 1 then lv[i - 1] end AS prev_level, {D.decode(D.collapse('tx[i]'))} AS text FROM (SELECT *, unnest(range(1, len(lv) + 1)) AS i FROM l)"),
)


def gaps(spark, sf) -> DataFrame:
    return st.STRUCTURE.measures(shredded(spark, sf)).filter("heading_gap is not null").select(
        "doc_id", F.col("heading_gap.prev_level").alias("from_level"), F.col("heading_gap.level").alias("to_level")
    )


QUERIES["heading_gap"] = (
    gaps,
    over(f"WITH {BARE}, {LEVELS}, g AS (SELECT doc_id, lv, list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1) AS gap_at FROM l) "
         "SELECT doc_id, lv[gap_at[1] - 1] AS from_level, lv[gap_at[1]] AS to_level FROM g WHERE len(gap_at) > 0"),
)

# --- sections ---------------------------------------------------------------------------------

SECTIONS = f"""s0 AS (SELECT doc_id, string_split(bare, '<h2>') AS parts FROM p),
s1 AS (SELECT doc_id, i - 2 AS nth, parts[i] AS part FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM s0)),
s AS (SELECT doc_id, nth, regexp_extract(part, '^([^<]*)</h2>', 1) AS heading, regexp_replace(part, '^[^<]*</h2>', '') AS rest FROM s1),
sec AS (SELECT doc_id, nth, heading, {D.collapse(D.sub('rest', '<[^>]*>', ' '))} AS body, len(regexp_extract_all(rest, '<h3')) AS h3_count FROM s),
lead AS (SELECT doc_id, nth, heading, case when starts_with(rest, '<p') then
  coalesce(nullif(regexp_extract(pt, '^[^.!?]+[.!?]'), ''), pt) end AS lead FROM (SELECT *, {D.collapse("regexp_extract(rest, '(?s)^<p>([^<]*)', 1)")} AS pt FROM s))"""


def section_rows(spark, sf) -> DataFrame:
    df = st.sections(shredded(spark, sf))
    return fnd.rows_of(df, ["doc_id"], "section_texts", "nth", "s").select(
        "doc_id", "nth", "s.heading", X.word_count(F.col("s.text")).alias("words"), F.col("s.text").alias("body"), F.col("s.h3_count").alias("h3_count")
    )


QUERIES["section_text"] = (
    section_rows,
    over(f"WITH {BARE}, {SECTIONS} SELECT doc_id, nth, heading, {D.word_count('body')} AS words, {D.decode('body')} AS body, h3_count FROM sec"),
)


def bounds(spark, sf) -> DataFrame:
    """Text-run bounds of each H2 section: its own end and the start of the next H2."""
    df = st.outline(shredded(spark, sf)).withColumn("h2s", F.filter("headings", lambda h: h["level"] == 2))
    ranges = F.transform(
        "h2s", lambda h, i: F.struct(h["text"].alias("heading"), F.get("h2s", i + 1)["text"].alias("next_heading"))
    )
    return fnd.rows_of(df, ["doc_id"], ranges, "nth", "s").select("doc_id", "nth", "s.*")


QUERIES["section_bounds"] = (
    bounds,
    over(f"WITH {BARE}, {SECTIONS} SELECT doc_id, nth, heading, lead(heading) over (partition by doc_id order by nth) AS next_heading FROM sec"),
)


def lead_rows(spark, sf) -> DataFrame:
    df = st.section_leads(shredded(spark, sf))
    return fnd.rows_of(df, ["doc_id"], "leads", "nth", "s").select("doc_id", "nth", "s.heading", "s.lead")


QUERIES["section_lead_sentence"] = (
    lead_rows, over(f"WITH {BARE}, {SECTIONS} SELECT doc_id, nth, heading, lead FROM lead"),
)

_TRIMMED = f"list_transform({D.paragraphs('bare')}, lambda t: {D.sub('t', '^' + D.SPACES + '+|' + D.SPACES + '+$', '')})"
QUERIES["paragraph_blocks"] = (
    lambda spark, sf: style.paragraph_rows(shredded(spark, sf)),
    over(f"""WITH {BARE}, k AS (SELECT doc_id, list_filter({_TRIMMED}, lambda t: {D.word_count(D.collapse('t'))} >= 8) AS k FROM p),
      u AS (SELECT doc_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS u FROM k)
      SELECT doc_id, i - 1 AS index, u[i] AS paragraph FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM u)"""),
)

_OPEN = ", ".join(D.q(w) for w in dims.QUESTION_OPENERS)
FAQ_SEEN = f"""fq AS (SELECT doc_id, len(list_filter(list_transform(regexp_extract_all(bare, '<(?:h2|h3|h4|strong|summary|dt)>([^<]*)<', 1), lambda x: {D.collapse('x')}),
  lambda x: x <> '' AND (ends_with(x, '?') OR regexp_replace(lower(string_split(x, ' ')[1]), '[^A-Za-z0-9_]', '', 'g') IN ({_OPEN})))) AS visible_questions FROM p)"""
QUERIES["faq_visible_count"] = (
    lambda spark, sf: st.faq_visible(shredded(spark, sf)).select("doc_id", "visible_questions"),
    over(f"WITH {BARE}, {FAQ_SEEN} SELECT doc_id, visible_questions FROM fq"),
)


_SPA = "case " + " ".join(
    f"when {' or '.join(f'contains(lower(html), {D.q(m)})' for m in marks)} then {D.q(name)}" for name, marks in dims.SPA_MARKERS
) + " end"
_BODY = D.collapse(D.sub("regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)", "<[^>]+>", " "))
QUERIES["spa_shell_detection"] = (
    lambda spark, sf: fixture(spark, sf, "synth_pages").select("doc_id", *st.spa_shell(F.col("html"))), over(f"SELECT doc_id, {_SPA} AS framework, ({_SPA}) is not null and length({_BODY}) < 400 AS shell FROM synth_pages"),
)
QUERIES["hreflang_links"] = (
    lambda spark, sf: st.hreflang(shredded(spark, sf)).select(
        "doc_id", F.size("hreflang").alias("n"), F.array_join("hreflang", ",").alias("langs")
    ),
    over("""SELECT doc_id, len(h) AS n, array_to_string(h, ',') AS langs FROM
      (SELECT doc_id, regexp_extract_all(html, '<link rel="alternate" hreflang="([^"]+)"', 1) AS h FROM synth_pages)"""),
)

# --- page checks ------------------------------------------------------------------------------

STRUCT = f"""{BARE}, {LEVELS}, d AS (SELECT p.doc_id, len(list_filter(lv, lambda x: x = 1)) AS h1,
  len(list_filter(range(2, len(lv) + 1), lambda i: lv[i] > lv[i - 1] + 1)) AS gaps,
  {tags('<img')} AS imgs, {tags('<img [^>]*alt=""')} AS no_alt, {tags('<link rel="canonical" href="[^"]')} AS canon,
  {tags('<meta name="viewport" content="[^"]')} AS vp, lower(regexp_extract(bare, '<meta name="robots" content="([^"]*)"', 1)) AS robots,
  {tags('<a href="[/#]')} AS internal FROM p JOIN l ON p.doc_id = l.doc_id)"""
QUERIES["detect_structure"] = (
    lambda spark, sf: rows(shredded(spark, sf), st.STRUCTURE),
    over(f"WITH {STRUCT} " + D.hits([
        ("T_h1_missing", "fail", "h1 = 0"), ("T_h1_multiple", "warn", "h1 > 1"), ("T_heading_hierarchy_gap", "warn", "gaps > 0"),
        ("T_img_alt_missing", "warn", "no_alt > 0"), ("A4_canonical_tag", "critical", "canon = 0"),
        ("A9_viewport_meta", "fail", "vp = 0"), ("A5_robots_meta_indexing", "critical", "contains(robots, 'noindex')"),
        ("T_internal_links_sparse", "warn", "internal < 2"),
    ], "d")),
)
_ABS = "regexp_matches({}, '^(?i:https?)://[^/?#\\s]+')"
QUERIES["detect_canonical"] = (
    lambda spark, sf: rows(shredded(spark, sf), st.CANONICAL),
    over(f"""WITH {CANON}, k AS (SELECT doc_id, case when canonical is null then null
        when not {_ABS.format('canonical')} then 'A4b_canonical_not_absolute' when og_url is null then 'A4c_canonical_no_og_url'
        when not {_ABS.format('og_url')} then 'A4d_og_url_not_absolute'
        when {duck_normal_url('canonical')} <> {duck_normal_url('og_url')} then 'A4e_canonical_og_mismatch' end AS check_id FROM c)
      SELECT doc_id, check_id, case when check_id = 'A4c_canonical_no_og_url' then 'warn' else 'fail' end AS severity FROM k WHERE check_id is not null"""),
)
META_CTE = f"""{HEAD_META}, mm AS (SELECT doc_id, coalesce(max(case when key = 'title' then value end), max(case when key = 'og:title' then value end), '') AS title,
  coalesce(max(case when key = 'description' then value end), max(case when key = 'og:description' then value end), '') AS descr,
  count(*) filter (where key in ('og:title', 'og:description', 'og:type', 'og:url')) AS og, count(*) filter (where key = 'twitter:card') AS tw FROM hm GROUP BY doc_id)"""
QUERIES["detect_meta"] = (
    lambda spark, sf: rows(shredded(spark, sf), st.META),
    over(f"WITH {META_CTE} " + D.hits([
        ("M_title_missing", "fail", "title = ''"), ("M_title_length", "warn", "title <> '' and not length(title) between 30 and 65"),
        ("M_description_missing", "fail", "descr = ''"), ("M_description_length", "warn", "descr <> '' and not length(descr) between 110 and 170"),
        ("M_og_incomplete", "warn", "og < 4"), ("M_twitter_card_missing", "info", "tw = 0"),
    ], "mm")),
)
TLDR_CTE = f"""t0 AS (SELECT doc_id, primary_keyword, {tags('<p data-tldr>')} > 0 AS marked, regexp_extract(bare, '<p data-tldr>([^<]*)', 1) AS a,
  regexp_extract(bare, '<(?:p|div)(?: [^>]*)?>\\s*((?i:tl;?dr|summary)[:\\s][^<]*)', 1) AS b FROM p),
t1 AS (SELECT doc_id, primary_keyword, marked, marked or b <> '' AS present, {D.collapse(D.sub("case when marked then a else b end", "^(?i:tl;?dr)[:\\s]+", ""))} AS txt FROM t0),
t2 AS (SELECT *, {D.word_count('txt')} AS n, lower(array_to_string(string_split(txt, ' ')[1:8], ' ')) AS lead, array_to_string(string_split(lower(primary_keyword), ' ')[1:3], ' ') AS core FROM t1)"""
QUERIES["detect_tldr"] = (
    lambda spark, sf: rows(shredded(spark, sf, "primary_keyword"), st.TLDR),
    over(f"WITH {BARE}, {TLDR_CTE} " + D.hits([
        ("S_tldr_missing", "fail", "not present"), ("S_tldr_word_count", "warn", "present and not n between 40 and 58"),
        ("S_tldr_keyword_position", "warn", "present and primary_keyword is not null and not contains(lead, core)"),
        ("S_tldr_attribute_missing", "info", "present and not marked"),
    ], "t2")),
)
QUERIES["detect_h2_questions"] = (
    lambda spark, sf: rows(shredded(spark, sf), st.H2_QUESTIONS),
    over(f"WITH {BARE}, {SECTIONS} SELECT doc_id, 'S_h2_question_ratio_low' AS check_id, 'warn' AS severity FROM sec GROUP BY doc_id "
         "HAVING count(*) >= 3 AND count(*) FILTER (WHERE ends_with(heading, '?')) / count(*) < 0.4"),
)
DENSITY = f"""dn AS (SELECT doc_id, {WORDS} AS words, {tags('<table')} + {tags('<ol')} +
  len(list_filter(regexp_extract_all(bare, '(?s)<ul>.*?</ul>'), lambda u: len(regexp_extract_all(u, '<li')) > 3)) AS structural FROM p)"""
QUERIES["detect_density"] = (
    lambda spark, sf: rows(with_text(spark, sf, "word_count"), st.DENSITY),
    over(f"WITH {BARE}, {DENSITY} SELECT doc_id, 'S_structural_density_low' AS check_id, 'warn' AS severity FROM dn WHERE words >= 500 AND structural < floor(words / 500)"),
)
QUERIES["detect_section_size"] = (
    lambda spark, sf: rows(shredded(spark, sf), st.SECTION_SIZE),
    over(f"WITH {BARE}, {SECTIONS} SELECT doc_id, 'S_section_too_large' AS check_id, 'warn' AS severity FROM sec GROUP BY doc_id "
         f"HAVING count(*) >= 2 AND count(*) FILTER (WHERE h3_count = 0 AND {D.word_count('body')} > 500) > 0"),
)
QUERIES["detect_h2_extractable"] = (
    lambda spark, sf: rows(shredded(spark, sf), st.H2_EXTRACTABLE),
    over(f"WITH {BARE}, {SECTIONS} SELECT doc_id, 'S_h2_referential_phrases' AS check_id, 'fail' AS severity FROM lead WHERE regexp_matches(lead, {D.q(D.REFERENTIAL)}) GROUP BY doc_id"),
)
_DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* +\d{1,2},? +20\d{2}"
QUERIES["detect_last_updated"] = (
    lambda spark, sf: rows(with_text(spark, sf), st.LAST_UPDATED),
    over(f"WITH {BARE} SELECT doc_id, 'S_visible_last_updated_missing' AS check_id, 'warn' AS severity FROM p WHERE NOT (regexp_matches(lower(text), {D.q(st.UPDATED)}) "
         f"OR regexp_matches(lower(text), {D.q(st.REVIEWED)}) OR regexp_matches(text, {D.q(_DATE)}))"),
)


LD = """ld AS (SELECT doc_id, json(jsonld) AS j FROM synth_pages WHERE jsonld <> '' AND json_valid(jsonld)),
roots AS (SELECT doc_id, j AS n, 0 AS o FROM ld WHERE json_type(j) = 'OBJECT' UNION ALL SELECT doc_id, unnest(cast(j as json[])), 0 FROM ld WHERE json_type(j) = 'ARRAY'),
kids AS (SELECT doc_id, unnest(cast(n->'@graph' as json[])) AS n FROM roots WHERE json_type(n->'@graph') = 'ARRAY'),
ents AS (SELECT doc_id, n FROM roots WHERE json_type(n) = 'OBJECT' AND (n->'@type') IS NOT NULL UNION ALL SELECT doc_id, n FROM kids WHERE json_type(n) = 'OBJECT' AND (n->'@type') IS NOT NULL),
etypes AS (SELECT doc_id, n, unnest(case when json_type(n->'@type') = 'ARRAY' then cast(n->'@type' as varchar[]) when (n->>'@type') <> '' then [n->>'@type'] else []::varchar[] end) AS type FROM ents)"""


def post_type_sql(types: str = "[]") -> str:
    fmt = " ".join(f"when {D.q(k)} then {D.q(v)}" for k, v in dims.FORMAT_SYNONYMS.items())
    return (
        f"coalesce(case replace(lower(format), ' ', '_') {fmt} end, case when list_contains({types}, 'HowTo') then 'procedural' "
        f"when list_has_any({types}, ['DefinedTerm', 'DefinedTermSet']) then 'definitional' when list_contains({types}, 'Dataset') then 'research' "
        f"when list_contains({types}, 'ItemList') and contains(lower(format), 'best') then 'listicle' "
        "when regexp_matches(lower(topic), '^(?:what is|what are)\\b') then 'definitional' when regexp_matches(lower(topic), '^how to\\b') then 'procedural' "
        "when regexp_matches(lower(topic), '\\bvs\\b|\\balternatives?\\b') then 'comparison' "
        "when regexp_matches(lower(topic), '\\bbest\\b.*\\b(?:tools?|apps?|platforms?)\\b') then 'listicle' when word_count >= 1900 then 'pillar' else 'general' end)"
    )


BANDS = "bands(post_type, min_words, target_words, max_words, required_types, wants_toc) AS (VALUES " + ", ".join(
    f"({D.q(k)}, {v[0]}, {v[1]}, {v[2]}, {('[' + ', '.join(D.q(t) for t in v[3]) + ']') if v[3] else '[]::varchar[]'}, {str(v[4]).lower()})" for k, v in dims.BANDS.items()
) + ")"
TYPED = f"ty AS (SELECT *, {WORDS} AS words, {post_type_sql('[]::varchar[]')} AS post_type FROM p), b AS (SELECT * FROM ty JOIN bands USING (post_type))"


def type_rows(spark, sf) -> DataFrame:
    """Post type guessed with JSON-LD types as an input: those of the page's own blocks, two of them renamed so that every rule is met."""
    from inkgauge.operators.posts import infer_post_type, literal_map

    df = sh.shred(fixture(spark, sf, "synth_pages").select("doc_id", "html", "format", "topic", "word_count"))
    named = literal_map(_RENAMED)
    types = F.transform(F.flatten(F.transform("ld_entities", lambda e: e["types"])), lambda t: F.coalesce(F.try_element_at(named, t), t))
    # Half of the posts come without a format of their own.
    own = F.when(F.col("doc_id") % 2 == 0, F.col("format"))
    return df.select("doc_id", infer_post_type(own, F.col("topic"), F.col("word_count"), types).alias("post_type"))


_RENAMED = {"BreadcrumbList": "HowTo", "Organization": "Dataset", "FAQPage": "DefinedTerm", "WebPage": "ItemList"}
_RENAMED_SQL = "case type " + " ".join(f"when '{a}' then '{b}'" for a, b in _RENAMED.items()) + " else type end"
QUERIES["infer_post_type"] = (
    type_rows,
    over(f"""WITH {LD}, ts AS (SELECT doc_id, list({_RENAMED_SQL}) AS types FROM etypes GROUP BY doc_id),
      q AS (SELECT p.doc_id, case when p.doc_id % 2 = 0 then format end AS format, topic, word_count, coalesce(types, []::varchar[]) AS types FROM synth_pages p LEFT JOIN ts ON ts.doc_id = p.doc_id)
      SELECT doc_id, {post_type_sql("types")} AS post_type FROM q"""),
)
QUERIES["band_join"] = (
    lambda spark, sf: st.WORD_BAND.measures(typed(spark, sf)).select("doc_id", "post_type", "min_words", "target_words", "max_words", "wants_toc"),
    over(f"WITH {BARE}, {BANDS}, {TYPED} SELECT doc_id, post_type, min_words, target_words, max_words, wants_toc FROM b"),
)
QUERIES["detect_toc"] = (
    lambda spark, sf: rows(typed(spark, sf), st.TOC),
    over(f"WITH {BARE}, {BANDS}, {TYPED} SELECT doc_id, 'S_toc_missing' AS check_id, 'warn' AS severity FROM b WHERE wants_toc AND words >= 1500 AND NOT contains(bare, 'aria-label=\"Table of Contents\"')"),
)
QUERIES["detect_word_band"] = (
    lambda spark, sf: rows(typed(spark, sf), st.WORD_BAND),
    over(f"WITH {BARE}, {BANDS}, {TYPED} " + D.hits([
        ("S_word_count_below_band", "fail", "words < min_words"), ("S_word_count_above_band", "warn", "words > max_words"),
    ], "b")),
)

# --- trust ------------------------------------------------------------------------------------

QUERIES["detect_byline"] = (
    lambda spark, sf: rows(with_text(spark, sf), trust.BYLINE),
    over(f"WITH {BARE} SELECT doc_id, 'E_visible_byline_missing' AS check_id, 'fail' AS severity FROM p WHERE NOT (contains(bare, 'class=\"meta byline\"') OR regexp_matches(text, {D.q(D.BYLINE)}))"),
)
TRUST_CTE = f"""tr AS (SELECT *, {D.found('text', D.FIRST_PARTY)} AS first_party,
  contains(bare, '/pic/shot.png') OR contains(bare, '<figcaption>') AS visual,
  len(list_filter(regexp_extract_all(bare, '<a href="(https?://[^"]*)"', 1), lambda h: brand_website is null or not contains(lower(h), regexp_extract(brand_website, 'www[.]([^/]*)', 1)))) AS cites FROM p)"""
QUERIES["detect_first_party"] = (
    lambda spark, sf: rows(with_text(spark, sf).withColumnRenamed("text", "body_text"), trust.FIRST_PARTY),
    over(f"WITH {BARE}, {TRUST_CTE} SELECT doc_id, 'E_no_first_party_data' AS check_id, 'fail' AS severity FROM tr WHERE first_party = 0"),
)
QUERIES["detect_original_visual"] = (
    lambda spark, sf: rows(shredded(spark, sf), trust.ORIGINAL_VISUAL),
    over(f"WITH {BARE}, {TRUST_CTE} SELECT doc_id, 'E_no_original_visual' AS check_id, 'warn' AS severity FROM tr WHERE NOT visual"),
)
QUERIES["detect_citations"] = (
    lambda spark, sf: rows(shredded(spark, sf, "brand_website"), trust.CITATIONS),
    over(f"WITH {BARE}, {TRUST_CTE} SELECT doc_id, 'E_insufficient_outbound_citations' AS check_id, 'fail' AS severity FROM tr WHERE cites < 3"),
)

# --- JSON-LD of pages -------------------------------------------------------------------------

AUTHOR = f"""{LD}, persons AS (SELECT doc_id, n FROM etypes WHERE type = 'Person'),
inline AS (SELECT doc_id, n->'author' AS n FROM etypes WHERE type = 'Article' AND json_type(n->'author') = 'OBJECT'),
auth AS (SELECT p.doc_id, coalesce((SELECT any_value(n) FROM persons x WHERE x.doc_id = p.doc_id), (SELECT any_value(n) FROM inline x WHERE x.doc_id = p.doc_id)) AS n FROM synth_pages p),
au AS (SELECT doc_id, n is not null AS has, coalesce(n->>'name', '') <> '' AS named,
  case json_type(n->'sameAs') when 'ARRAY' then cast(n->'sameAs' as varchar[]) when 'VARCHAR' then [n->>'sameAs'] else []::varchar[] end AS urls,
  coalesce(n->>'jobTitle', '') <> '' AS credited FROM auth),
av AS (SELECT *, len(list_filter(urls, lambda u: contains(u, 'linkedin.com'))) > 0 AS linkedin FROM au)"""
QUERIES["detect_author"] = (
    lambda spark, sf: rows(shredded(spark, sf), jsonld.AUTHOR),
    over(f"WITH {AUTHOR} " + D.hits([
        ("E_author_person_missing", "critical", "not has"), ("E_author_name_missing", "critical", "has and not named"),
        ("E_author_sameas_missing", "critical", "has and len(urls) = 0"), ("E_author_linkedin_missing", "fail", "len(urls) > 0 and not linkedin"),
        ("E_author_sameas_thin", "warn", "len(urls) = 1"), ("E_author_credentials_missing", "warn", "has and not credited"),
    ], "av")),
)
_SIGNALS = "cast(named as int) + cast(linkedin as int) + cast(first_party >= 1 as int) + cast(visual as int) + cast(cites >= 3 as int)"
QUERIES["human_signal_bundle"] = (
    lambda spark, sf: rows(with_text(spark, sf, "brand_website").withColumnRenamed("text", "body_text"), trust.BUNDLE),
    over(f"WITH {BARE}, {TRUST_CTE}, {AUTHOR} SELECT doc_id, 'E_human_signals_bundle_incomplete' AS check_id, 'critical' AS severity FROM av JOIN tr USING (doc_id) WHERE {_SIGNALS} < 4"),
)
QUERIES["faq_parity"] = (
    lambda spark, sf: rows(shredded(spark, sf), jsonld.FAQ_PARITY),
    over(f"WITH {BARE}, {FAQ_SEEN}, {LD} SELECT e.doc_id, 'P_faq_count_mismatch' AS check_id, 'fail' AS severity FROM etypes e JOIN fq ON fq.doc_id = e.doc_id "
         "WHERE type = 'FAQPage' AND json_array_length(n->'mainEntity') > 0 AND abs(cast(json_array_length(n->'mainEntity') as int) - visible_questions) > 1"),
)
QUERIES["required_type_for_post"] = (
    lambda spark, sf: rows(typed(spark, sf), jsonld.REQUIRED_TYPE),
    over(f"WITH {BARE}, {BANDS}, {TYPED}, {LD} SELECT doc_id, 'S_missing_' || t || '_schema' AS check_id, 'fail' AS severity FROM (SELECT doc_id, unnest(required_types) AS t FROM b) r "
         "WHERE NOT EXISTS (SELECT 1 FROM etypes e WHERE e.doc_id = r.doc_id AND e.type = r.t)"),
)
SCRIPTS = f"""sc AS (SELECT doc_id, i - 1 AS block, trim(s[i]) AS raw FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM
  (SELECT doc_id, regexp_extract_all(html, '(?s)<script type="application/ld[+]json">(.*?)</script>', 1) AS s FROM synth_pages)))"""
QUERIES["jsonld_blocks"] = (
    lambda spark, sf: fnd.rows_of(shredded(spark, sf), ["doc_id"], "ld_scripts", "nth", "s").select("doc_id", "s.block", "s.status", "s.raw"),
    over(f"WITH {SCRIPTS} SELECT doc_id, block, case when raw = '' then 'empty' when json_valid(raw) then 'ok' else 'invalid' end AS status, raw FROM sc"),
)
VALIDITY = f"""{SCRIPTS}, okb AS (SELECT doc_id, block, json(raw) AS j FROM sc WHERE raw <> '' AND json_valid(raw)),
tree AS (SELECT doc_id, block, t.key, t.value, t.type, t.fullkey, t.id, t.parent FROM okb, json_tree(j) t),
up AS (SELECT c.*, p.key AS pkey, p.type AS ptype, g.type AS gtype FROM tree c LEFT JOIN tree p ON p.doc_id = c.doc_id AND p.block = c.block AND p.id = c.parent
  LEFT JOIN tree g ON g.doc_id = p.doc_id AND g.block = p.block AND g.id = p.parent),
objs AS (SELECT * FROM up WHERE type = 'OBJECT' AND NOT (key = '@graph' AND coalesce(ptype, '') = 'OBJECT')),
vf AS (SELECT doc_id, 'V_schema_empty_block' AS check_id, 'fail' AS severity FROM sc WHERE raw = ''
 UNION ALL SELECT doc_id, 'V_schema_invalid_json', 'critical' FROM sc WHERE raw <> '' AND NOT json_valid(raw)
 UNION ALL SELECT doc_id, 'V_schema_invalid_root', 'fail' FROM up WHERE parent IS NOT NULL AND pkey IS NULL AND ptype = 'ARRAY' AND gtype IS NULL AND type <> 'OBJECT'
 UNION ALL SELECT doc_id, 'V_schema_graph_not_array', 'fail' FROM up WHERE key = '@graph' AND type <> 'ARRAY'
 UNION ALL SELECT doc_id, 'V_schema_graph_non_object_item', 'fail' FROM up WHERE pkey = '@graph' AND ptype = 'ARRAY' AND type <> 'OBJECT'
 UNION ALL SELECT doc_id, 'V_schema_entity_no_type', 'warn' FROM objs WHERE (value->'@type') IS NULL AND (value->'@graph') IS NULL AND NOT ((value->'@id') IS NOT NULL AND len(json_keys(value)) = 1)
   AND fullkey NOT LIKE '%@graph".%' AND fullkey NOT LIKE '%@graph.%'
 UNION ALL SELECT doc_id, 'V_schema_invalid_type_value', 'fail' FROM objs WHERE (value->'@type') IS NOT NULL AND (value->>'@type') = '')"""
QUERIES["schema_validity"] = (
    lambda spark, sf: rows(shredded(spark, sf), jsonld.VALIDITY),
    over(f"WITH {VALIDITY} SELECT doc_id, check_id, severity FROM vf"),
)

# --- a first look -----------------------------------------------------------------------------


def quick_slice(spark, sf) -> DataFrame:
    """Title, h1, links and head tags by pattern only: a first verdict without shredding."""
    html = F.col("html")
    bare = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)", "")
    df = table(spark, sf, "pages").withColumn("bare", bare)
    title = F.length(F.trim(F.regexp_extract("bare", "(?i)<title>([^<]*)", 1)))
    df = df.withColumns(
        {
            "h1": X.count(F.col("bare"), "(?i)<h1[ >]"), "title": title,
            "links": X.count(F.col("bare"), r'(?i)<a\s[^>]*href="[/#]'),
            "canon": X.count(F.col("bare"), r'(?i)<link\s[^>]*rel="canonical"'),
            "view": X.count(F.col("bare"), r'(?i)<meta\s[^>]*name="viewport"'),
        }
    )
    lost = (
        F.when(F.col("h1") == 0, 14).when(F.col("h1") > 1, 5).otherwise(0)
        + F.when(F.col("title") == 0, 14).when(~F.col("title").between(30, 65), 5).otherwise(0)
        + F.when(F.col("links") < 2, 5).otherwise(0)
        + F.when(F.col("canon") == 0, 30).otherwise(0) + F.when(F.col("view") == 0, 14).otherwise(0)
    )
    criticals = F.when(F.col("canon") == 0, 1).otherwise(0)
    score = F.greatest(F.lit(0), 100 - lost)
    from inkgauge.operators.scoring import verdict

    return df.select("page_id", score.alias("score"), criticals.alias("criticals"), verdict(criticals, score).alias("verdict"))


QUERIES["page_slice"] = (
    quick_slice,
    f"""WITH b AS (SELECT page_id, {D.BARE} AS bare FROM pages), m AS (SELECT page_id, {tags('(?i)<h1[ >]')} AS h1,
      length(trim(regexp_extract(bare, '(?i)<title>([^<]*)', 1))) AS title, {tags('(?i)<a[ ][^>]*href="[/#]')} AS links,
      {tags('(?i)<link[ ][^>]*rel="canonical"')} AS canon, {tags('(?i)<meta[ ][^>]*name="viewport"')} AS view FROM b),
    s AS (SELECT page_id, greatest(0, 100 - (case when h1 = 0 then 14 when h1 > 1 then 5 else 0 end + case when title = 0 then 14 when not title between 30 and 65 then 5 else 0 end
      + case when links < 2 then 5 else 0 end + case when canon = 0 then 30 else 0 end + case when view = 0 then 14 else 0 end)) AS score, case when canon = 0 then 1 else 0 end AS criticals FROM m)
    SELECT page_id, score, criticals, case when criticals > 0 then 'block' when score >= 90 then 'ship' else 'edit' end AS verdict FROM s""",
)

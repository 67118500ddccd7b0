"""Registered queries over patches, instructions and rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators import findings as fnd, jsonld, remedy as rm, shred as sh, structure as st, style
from inkgauge.plans import duck as D
from inkgauge.plans.catalog_pages import BARE, CANON, HEAD_META, LD, META_CTE, over
from inkgauge.plans.catalog_text import QUERIES as TEXTS_Q, texts
from inkgauge.plans.fixtures import fixture, with_fixtures

QUERIES: dict = {}


def sourced(spark, sf, *families: fnd.Family) -> DataFrame:
    """Shredded pages with source, text, page context and the findings of the named families."""
    posts = fixture(spark, sf, "synth_pages").select("doc_id", "brand", "slug", "topic", "primary_keyword", "html")
    df = sh.shred(posts.withColumn("text", X.visible_text(F.col("html"))), keep_html=True)
    for family in families:
        df = family.measures(df)
    found = F.concat(*[f.findings() for f in families]) if families else fnd.no_findings()
    return rm.page_context(df.withColumn("found", found))


# --- words ------------------------------------------------------------------------------------


def words(spark, sf) -> DataFrame:
    df = style.TEXT_SIGNALS.measures(texts(spark, sf)).select("doc_id", style.TEXT_SIGNALS.findings().alias("found"))
    return rm.patch_rows(df.withColumn("patches", rm.word_patches()), "patches").select("doc_id", "type", "target", "before")


QUERIES["plan_word_patches"] = (
    words,
    f"SELECT doc_id, 'regex_replace' AS type, '\\b' || term || '\\b' AS target, term AS before FROM ({TEXTS_Q['lexicon_hits'][1]}) WHERE list = 'banned_word'",
)

# --- page context and meta --------------------------------------------------------------------

_H = {k: f"max(case when key = {D.q(k)} then value end)" for k in ("title", "description", "og:title", "og:description", "og:type", "og:url", "og:image")}
CTX = f"""{BARE}, {HEAD_META}, {CANON}, hx AS (SELECT doc_id, {_H['title']} AS title, {_H['og:title']} AS og_title, {_H['description']} AS d, {_H['og:description']} AS od, {_H['og:type']} AS ot, {_H['og:image']} AS oi FROM hm GROUP BY doc_id),
cx AS (SELECT p.doc_id, p.brand, nullif(hx.title, '') AS title, hx.og_title, hx.d, hx.od, hx.ot, coalesce(nullif(hx.title, ''), {D.decode("trim(regexp_extract(bare, '<h1>([^<]*)', 1))")}) AS headline, coalesce(hx.d, hx.od, substr(text, 1, 160)) AS description,
  coalesce(hx.oi, nullif(regexp_extract(bare, '<img src="([^"]*)"', 1), '')) AS image, coalesce(c.canonical, c.og_url) AS url FROM p JOIN hx ON hx.doc_id = p.doc_id JOIN c ON c.doc_id = p.doc_id)"""
QUERIES["page_context"] = (
    lambda spark, sf: sourced(spark, sf).select(
        "doc_id", F.col("ctx_headline").alias("headline"), F.col("ctx_description").alias("description"), F.col("ctx_image").alias("image"), F.col("ctx_url").alias("url")
    ),
    over(f"WITH {CTX} SELECT doc_id, headline, description, image, url FROM cx"),
)


def meta_plan(spark, sf) -> DataFrame:
    """Half of the posts come with supplied wording."""
    df = sourced(spark, sf, st.META).withColumns(
        {
            "new_title": F.expr("case when doc_id % 2 = 0 then 'A new title of about fifty characters in length' end"),
            "new_description": F.expr("case when doc_id % 3 = 0 then 'New words' end"),
        }
    )
    return rm.patch_rows(df.withColumn("patches", rm.meta_patches(df)), "patches").select("doc_id", "target", "before", "after")


QUERIES["plan_meta_patches"] = (
    meta_plan,
    over(f"""WITH {CTX}, {META_CTE.split(', mm AS', 1)[1].join(['mm AS', ''])}, pl AS (SELECT cx.*, case when doc_id % 2 = 0 and not length(coalesce(m_title, '')) between 30 and 65 then 'A new title of about fifty characters in length' end AS nt,
      case when doc_id % 3 = 0 and not length(coalesce(m_descr, '')) between 110 and 170 then 'New words' end AS nd, og FROM cx JOIN (SELECT doc_id, title AS m_title, descr AS m_descr, og FROM mm) USING (doc_id))
      SELECT doc_id, 'title' AS target, coalesce(title, '') AS before, nt AS after FROM pl WHERE nt is not null
      UNION ALL SELECT doc_id, 'description', coalesce(d, ''), nd FROM pl WHERE nd is not null
      UNION ALL SELECT doc_id, 'og:title', '', coalesce(nt, title, og_title) FROM pl WHERE og < 4 AND og_title is null AND coalesce(nt, title) is not null
      UNION ALL SELECT doc_id, 'og:description', '', coalesce(nd, d, od) FROM pl WHERE og < 4 AND od is null AND coalesce(nd, d) is not null
      UNION ALL SELECT doc_id, 'og:type', '', 'article' FROM pl WHERE og < 4 AND ot is null"""),
)

# --- JSON-LD ----------------------------------------------------------------------------------


def schema_plan(spark, sf) -> DataFrame:
    df = sourced(spark, sf, jsonld.ARTICLE_PRESENCE, jsonld.FIELD_COMPLETENESS).withColumn("today", F.lit("2026-04-30"))
    rows = rm.patch_rows(df.withColumn("patches", rm.schema_patches(df)), "patches")
    # The value is compared as parsed text, so that spacing inside nested JSON does not matter.
    plain = F.coalesce(F.try_variant_get(F.try_parse_json("after"), "$.headline", "string"), F.try_variant_get(F.try_parse_json("after"), "$.name", "string"), F.try_variant_get(F.try_parse_json("after"), "$.url", "string"), F.try_variant_get(F.try_parse_json("after"), "$", "string"))
    return rows.select("doc_id", "target", plain.alias("value"))


_SPEC_ROWS = ", ".join(
    f"({D.q(t)}, {D.q(tier)}, {D.q(f)})" for t, tiers in dims.ENTITY_FIELDS.items() if t in ("Article", "BlogPosting", "NewsArticle", "WebPage", "Organization") for tier, fs in zip(dims.FIELD_TIERS, tiers) for f in fs
)
_ART = "('BlogPosting', 'Article', 'NewsArticle')"
QUERIES["plan_schema_patches"] = (
    schema_plan,
    over(f"""WITH {CTX}, {LD}, spec(type, tier, field) AS (VALUES {_SPEC_ROWS}),
      miss AS (SELECT e.doc_id, e.type, s.tier, s.field FROM etypes e JOIN spec s USING (type) WHERE NOT list_contains(json_keys(e.n), s.field)),
      pers AS (SELECT doc_id, any_value(n->>'name') AS pname FROM etypes WHERE type = 'Person' GROUP BY doc_id),
      val AS (SELECT m.doc_id, m.type || '.' || m.field AS target, case
        when tier = 'google_required' and type in {_ART} and field = 'author' then coalesce(pname, brand)
        when tier = 'google_required' and type in {_ART} and field = 'image' then image
        when tier = 'recommended' and type in ('BlogPosting', 'Article', 'NewsArticle', 'WebPage') then case field when 'dateModified' then '2026-04-30' when 'description' then description
          when 'mainEntityOfPage' then url when 'inLanguage' then 'en-US' when 'primaryImageOfPage' then image end
        when type = 'WebPage' and tier = 'required' and field = 'name' then headline
        when type = 'Organization' and tier = 'recommended' and field = 'description' then brand || ' — content and insights' end AS value
        FROM miss m JOIN cx USING (doc_id) LEFT JOIN pers USING (doc_id))
      SELECT doc_id, target, value FROM val WHERE value is not null
      UNION ALL SELECT cx.doc_id, 'add:BlogPosting', headline FROM cx WHERE doc_id IN (SELECT doc_id FROM ld) AND doc_id NOT IN (SELECT doc_id FROM etypes WHERE type IN {_ART})"""),
)

# --- style ------------------------------------------------------------------------------------

_PSRC = f"""src AS (SELECT doc_id, html, {D.sub(D.sub('html', '(?is)<!--.*?-->', ''), D.BLOCK_EDGE, chr(1) + chr(92) + '1')} AS marked FROM synth_pages)"""
# Sources of paragraphs inside the article; the inner HTML runs to the edge that ends the paragraph.
BLOCKS = f"""{_PSRC}, art AS (SELECT doc_id, html, regexp_extract(marked, '(?s)<article>(.*)</article>', 1) AS a FROM src),
inn AS (SELECT doc_id, html, list_distinct_ordered AS l FROM (SELECT doc_id, html, list_filter(pl, lambda x, i: list_position(pl, x) = i) AS list_distinct_ordered FROM
  (SELECT doc_id, html, regexp_extract_all(a, '<p(?: [^>]*)?>([^{chr(1)}]*)', 1) AS pl FROM art))),
blk AS (SELECT doc_id, html, i AS nth, l[i] AS b, {D.collapse(D.decode(D.sub('l[i]', '<[^>]*>', '')))} AS text FROM (SELECT doc_id, html, l, unnest(range(1, len(l) + 1)) AS i FROM inn)),
uniq AS (SELECT *, (length(html) - length(replace(html, b, ''))) / length(b) = 1 AS once FROM blk WHERE b <> '')"""


def style_blocks(spark, sf) -> DataFrame:
    return sourced(spark, sf)


QUERIES["plan_emdash_patches"] = (
    lambda spark, sf: rm.patch_rows(style_blocks(spark, sf).withColumn("patches", rm.emdash_patches()), "patches").select("doc_id", "before", "after"),
    over(f"WITH {BLOCKS} SELECT doc_id, b AS before, replace(regexp_replace(b, '\\s—\\s', ', ', 'g'), '—', ', ') AS after FROM uniq WHERE once AND contains(b, '—')"),
)


def _offending_sql(pattern: str) -> str:
    return (f"off AS (SELECT doc_id, b, nth, list_filter({D.sentence_list('text')}, lambda s: regexp_matches(s, {D.q(pattern)}))[1] AS sentence FROM uniq WHERE once), "
            "top AS (SELECT *, row_number() over (partition by doc_id order by nth) AS rn FROM off WHERE sentence is not null)")


QUERIES["top_offending_paragraphs"] = (
    lambda spark, sf: fnd.rows_of(style_blocks(spark, sf), ["doc_id"], rm.offending(X.PASSIVE), "nth", "h").select("doc_id", "nth", "h.sentence"),
    over(f"WITH {BLOCKS}, {_offending_sql(D.PASSIVE)} SELECT doc_id, rn - 1 AS nth, sentence FROM top WHERE rn <= 5"),
)
QUERIES["plan_rewrite_targets"] = (
    lambda spark, sf: rm.patch_rows(
        style_blocks(spark, sf).withColumn("patches", F.concat(rm.tricolon_targets(), rm.passive_targets())), "patches"
    ).select("doc_id", "target", "before"),
    over(f"WITH {BLOCKS}, {_offending_sql(D.PASSIVE)}, {_offending_sql(D.TRICOLON).replace('off AS', 'off2 AS').replace('top AS', 'top2 AS').replace('FROM off ', 'FROM off2 ')} "
         "SELECT doc_id, 'passive-to-active' AS target, b AS before FROM top WHERE rn <= 5 UNION ALL SELECT doc_id, 'tricolon-reduction', b FROM top2 WHERE rn <= 5"),
)

# --- spans ------------------------------------------------------------------------------------

# Spans taken from the text itself: a common pair of letters, a longer piece, an absent piece, one repeated.
_SPANS = "array(substr(body_text, 40, 2), substr(body_text, 40, 12), substr(body_text, 200, 30), 'no such words', substr(body_text, 200, 30))"
_SPANS_DUCK = "[substr(body_text, 40, 2), substr(body_text, 40, 12), substr(body_text, 200, 30), 'no such words', substr(body_text, 200, 30)]"


def fragments(spark, sf) -> DataFrame:
    df = texts(spark, sf)
    wide = rm.unique_fragment(F.substring("body_text", 40, 8), F.col("body_text"))
    return df.select("doc_id", wide.alias("w")).select("doc_id", F.col("w.before").alias("before"), F.length("w.prefix").alias("n_prefix"))


def _wide(k: int) -> str:
    at = "strpos(body_text, f)"
    start = f"greatest({at} - {20 * k}, 1)"
    return f"substr(body_text, {start}, {at} - {start}) || f || substr(body_text, {at} + length(f), {20 * k})"


_TEXTS_CTE = f"t AS (SELECT doc_id, {D.collapse('text')} AS body_text FROM synth_text)"
QUERIES["unique_fragment"] = (
    fragments,
    with_fixtures(
        "synth_text",
        f"WITH {_TEXTS_CTE}, f0 AS (SELECT doc_id, body_text, nullif(substr(body_text, 40, 8), '') AS f FROM t), "
        f"f1 AS (SELECT *, list_filter([f, {', '.join(_wide(k) for k in range(1, 6))}], lambda w: (length(body_text) - length(replace(body_text, w, ''))) / length(w) = 1)[1] AS w FROM f0) "
        "SELECT doc_id, w AS before, case when w is not null then strpos(w, f) - 1 end AS n_prefix FROM f1",
    ),
)


def span_patches(spark, sf) -> DataFrame:
    made = F.transform(F.col("spans"), lambda s: rm.patch("replace_span", s, s, F.concat(F.lit("<"), s, F.lit(">")), "test"))
    return texts(spark, sf).withColumn("spans", F.expr(_SPANS)).withColumn("patches", made)


QUERIES["dedupe_spans"] = (
    lambda spark, sf: rm.patch_rows(span_patches(spark, sf).withColumn("patches", rm.dedupe_spans(F.col("patches"))), "patches").select("doc_id", "target"),
    with_fixtures(
        "synth_text",
        f"WITH {_TEXTS_CTE}, s AS (SELECT doc_id, {_SPANS_DUCK} AS l FROM t) SELECT doc_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)) AS target FROM s",
    ),
)


def spans_applied(spark, sf) -> DataFrame:
    df = span_patches(spark, sf).withColumn("r", rm.apply_spans(F.col("patches"), F.col("body_text"), F.col("body_text")))
    return df.select("doc_id", F.col("r.html").alias("html"), F.array_join(F.transform("r.log", lambda e: e["ok"].cast("int").cast("string")), "").alias("accepted"))


def _apply_sql() -> str:
    """Five ordered steps, each a replacement when the span occurs exactly once in the text so far."""
    steps = []
    previous, text = "s", "body_text"
    for i in range(1, 6):
        before = f"l[{i}]"
        ok = f"(length({before}) > 0 and (length(h) - length(replace(h, {before}, ''))) / greatest(length({before}), 1) = 1)"
        steps.append(
            f"a{i} AS (SELECT doc_id, l, case when {ok} then replace(h, {before}, '<' || {before} || '>') else h end AS h, acc || case when {ok} then '1' else '0' end AS acc FROM {previous})"
        )
        previous = f"a{i}"
    return f"WITH {_TEXTS_CTE}, s AS (SELECT doc_id, {_SPANS_DUCK} AS l, body_text AS h, '' AS acc FROM t), {', '.join(steps)} SELECT doc_id, h AS html, acc AS accepted FROM a5"


QUERIES["apply_span_patches"] = (spans_applied, with_fixtures("synth_text", _apply_sql()))

_EDITS = [("title", "New & shiny"), ("description", 'Said "so"'), ("og:type", "website")]


def meta_applied(spark, sf) -> DataFrame:
    patches = F.array(*[rm.patch("meta_tag_edit", target, "", after, "test") for target, after in _EDITS])
    df = fixture(spark, sf, "synth_pages").select("doc_id", "html").withColumn("r", rm.apply_meta(patches, F.col("html")))
    return df.select("doc_id", F.col("r.html").alias("html"), F.size(F.filter("r.log", lambda e: e["ok"])).alias("accepted"))


def _set_meta(html: str, kind: str, name: str, safe: str) -> str:
    tag = f'<meta {kind}="{name}" content="{safe}">'
    old = f"<meta {kind}=\"{name}\" content=\"[^\"]*\">"
    return (f"(case when regexp_matches({html}, {D.q(old)}) then regexp_replace({html}, {D.q(old)}, {D.q(tag)}) "
            f"else regexp_replace({html}, '</head>', {D.q(chr(10) + '  ' + tag + '</head>')}) end)")


_M1 = f"regexp_replace(html, '<title>[^<]*</title>', {D.q('<title>New &amp; shiny</title>')})"
QUERIES["apply_meta_edits"] = (
    meta_applied,
    over(f"WITH m1 AS (SELECT doc_id, {_M1} AS html FROM synth_pages), m2 AS (SELECT doc_id, {_set_meta('html', 'name', 'description', 'Said &quot;so&quot;')} AS html FROM m1) "
         f"SELECT doc_id, {_set_meta('html', 'property', 'og:type', 'website')} AS html, 3 AS accepted FROM m2"),
)


def schema_applied(spark, sf) -> DataFrame:
    patches = F.array(
        rm.patch("insert_schema", "BlogPosting.image", "undefined", '"/i.png"', "test"),
        rm.patch("insert_schema", "Person.worksFor.name", "undefined", "Acme", "test"),
        rm.patch("insert_schema", "add:WebPage", "", '{"name": "Home"}', "test"),
    )
    df = fixture(spark, sf, "synth_pages").select("doc_id", "html").withColumn("schema_patches", patches)
    done = sh.shred(rm.apply_schema_inserts(df).drop("schema_patches"))
    accepted = F.array_join(F.transform("schema_log", lambda e: e["ok"].cast("int").cast("string")), "")
    types = F.array_join(F.array_sort(F.flatten(F.transform("ld_entities", lambda e: e["types"]))), ",")
    return done.select("doc_id", accepted.alias("accepted"), types.alias("types"))


QUERIES["apply_schema_inserts"] = (
    schema_applied,
    over(f"""WITH {LD}, shape AS (SELECT p.doc_id, (SELECT count(*) FROM etypes e WHERE e.doc_id = p.doc_id AND type = 'BlogPosting') > 0 AS b, (SELECT count(*) FROM etypes e WHERE e.doc_id = p.doc_id AND type = 'Person') > 0 AS pe,
      (SELECT any_value(json_type(j) = 'ARRAY' or json_type(j->'@graph') = 'ARRAY') FROM ld WHERE ld.doc_id = p.doc_id) AS home FROM synth_pages p),
      tl AS (SELECT doc_id, type FROM etypes UNION ALL SELECT doc_id, 'WebPage' FROM shape WHERE home)
      SELECT s.doc_id, cast(cast(b as int) as varchar) || cast(cast(pe as int) as varchar) || cast(cast(coalesce(home, false) as int) as varchar) AS accepted,
      coalesce(string_agg(type, ',' order by type), '') AS types FROM shape s LEFT JOIN tl ON tl.doc_id = s.doc_id GROUP BY ALL"""),
)

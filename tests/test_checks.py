"""Hand-written pages at the edges of the checks."""

import pytest
from pyspark.sql import functions as F

from inkgauge.functions import text as X, urls as U
from inkgauge.operators import findings as fnd, jsonld, shred as sh, structure as st, style, trust
from inkgauge.plans.audit import FAMILIES, audit, prepare


def checks(spark, html, family, **extra):
    df = spark.createDataFrame([(1, html)], "doc_id int, html string").withColumns({k: F.lit(v) for k, v in extra.items()})
    return {r["check_id"] for r in fnd.run_family(prepare(df), family).collect()}


def page(head="", body=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("n,hit", [(29, True), (30, False), (65, False), (66, True)])
def test_title_length(spark, n, hit):
    assert ("M_title_length" in checks(spark, page(f"<title>{'t' * n}</title>"), st.META)) == hit


@pytest.mark.parametrize("n,hit", [(109, True), (110, False), (170, False), (171, True)])
def test_description_length(spark, n, hit):
    found = checks(spark, page(f'<meta name="description" content="{"d" * n}">'), st.META)
    assert ("M_description_length" in found) == hit


@pytest.mark.parametrize("n,hit", [(39, True), (40, False), (58, False), (59, True)])
def test_tldr_words(spark, n, hit):
    assert ("S_tldr_word_count" in checks(spark, page(body=f"<p data-tldr>{'w ' * n}</p>"), st.TLDR)) == hit


@pytest.mark.parametrize("levels,hit", [((1, 2, 4), True), ((2, 1, 3), True), ((1, 2, 3, 2), False), ((3, 4), False)])
def test_heading_gap(spark, levels, hit):
    body = "".join(f"<h{n}>x</h{n}>" for n in levels)
    assert ("T_heading_hierarchy_gap" in checks(spark, page(body=body), st.STRUCTURE)) == hit


@pytest.mark.parametrize("n,h3,hit", [(500, "", False), (501, "", True), (501, "<h3>s</h3>", False)])
def test_section_size(spark, n, h3, hit):
    body = f"<h2>a</h2><p>{'w ' * (n if not h3 else n - 1)}</p>{h3}<h2>b</h2><p>short</p>"
    assert ("S_section_too_large" in checks(spark, page(body=body), st.SECTION_SIZE)) == hit


@pytest.mark.parametrize(
    "canonical,og,check",
    [
        ("/p", "", "A4b_canonical_not_absolute"),
        ("ftp://x/y", "", "A4b_canonical_not_absolute"),
        ("https://a.example/p", "", "A4c_canonical_no_og_url"),
        ("https://a.example/p", "nowhere", "A4d_og_url_not_absolute"),
        ("https://a.example/p/", "https://A.EXAMPLE/p#part", None),
        ("https://a.example/p", "https://a.example/q", "A4e_canonical_og_mismatch"),
    ],
)
def test_canonical(spark, canonical, og, check):
    head = f'<link rel="canonical" href="{canonical}">' + (f'<meta property="og:url" content="{og}">' if og else "")
    assert checks(spark, page(head), st.CANONICAL) == ({check} if check else set())


def test_comments_and_scripts_hold_no_elements(spark):
    html = page(body='<!-- <h1>no</h1> --><script>var x = "<h1>no</h1></p>";</script><h1>Yes</h1>')
    df = sh.shred(spark.createDataFrame([(1, html)], "doc_id int, html string"))
    texts = sh.elements_table(df).filter("tag = 'h1'").select("text").collect()
    assert [t[0] for t in texts] == ["Yes"]


def test_unclosed_paragraphs_end_at_blocks(spark):
    html = page(body="<article><p>one <b>bold<p>two<div>three</div><p>four</article>five")
    df = sh.shred(spark.createDataFrame([(1, html)], "doc_id int, html string"))
    assert df.select("paragraphs").first()[0] == ["one bold", "two", "four"]


def test_attribute_values_keep_angle_brackets(spark):
    html = page(body='<a href="/x" title="a > b">t</a><a href=/y HREF="/z">u</a>')
    df = sh.shred(spark.createDataFrame([(1, html)], "doc_id int, html string"))
    hrefs = [r["attrs"]["href"] for r in sh.elements_table(df).filter("tag = 'a'").orderBy("pos").collect()]
    assert hrefs == ["/x", "/y"]


@pytest.mark.parametrize(
    "block,check",
    [
        ("", "V_schema_empty_block"),
        ('{"a": 1', "V_schema_invalid_json"),
        ("[]", "V_schema_empty_array_root"),
        ("3", "V_schema_invalid_root"),
        ('{"@graph": {}}', "V_schema_graph_not_array"),
        ('{"@graph": [1]}', "V_schema_graph_non_object_item"),
        ('{"name": "x"}', "V_schema_entity_no_type"),
        ('{"@type": []}', "V_schema_invalid_type_value"),
        ('{"@type": "Thing", "a": 1, "a": 2}', None),
        ('{"@id": "#x"}', None),
    ],
)
def test_schema_validity(spark, block, check):
    html = page(f'<script type="application/ld+json">{block}</script>')
    assert checks(spark, html, jsonld.VALIDITY) == ({check} if check else set())


def test_null_field_counts_as_present(spark):
    html = page('<script type="application/ld+json">{"@type": "Article", "headline": "h", "datePublished": null, "author": 1, "image": null}</script>')
    found = checks(spark, html, jsonld.FIELD_COMPLETENESS)
    assert found == {"D_Article_missing_recommended"}


def test_deep_nesting_is_walked(spark):
    deep = '{"a":' * 60 + '{"@id": "#gone"}' + "}" * 60
    html = page(f'<script type="application/ld+json">{{"@type": "Thing", "x": {deep}}}</script>')
    assert checks(spark, html, jsonld.ID_RESOLUTION) == {"D_entity_id_unresolved"}


@pytest.mark.parametrize("items,hit", [("1, 2, 4", True), ('"1", "2"', False), ("null, 1", True), ('"x", 1', False)])
def test_breadcrumbs(spark, items, hit):
    rows = ", ".join(f'{{"position": {i.strip()}}}' for i in items.split(","))
    html = page(f'<script type="application/ld+json">{{"@type": "BreadcrumbList", "itemListElement": [{rows}]}}</script>')
    assert bool(checks(spark, html, jsonld.BREADCRUMB)) == hit


@pytest.mark.parametrize(
    "stamp,check",
    [
        ("2026-04-23", "D_datemodified_missing_time"),
        ("2026-04-23T10:30", "D_datemodified_missing_timezone"),
        ("2026-04-23T10:30:00", "D_datemodified_missing_timezone"),
        ("2026-04-23T10:30:00Z", None),
    ],
)
def test_dates(spark, stamp, check):
    html = page(f'<script type="application/ld+json">{{"@type": "WebPage", "dateModified": "{stamp}"}}</script>')
    assert checks(spark, html, jsonld.ISO_DATES) == ({check} if check else set())


def test_ascii_word_edges(spark):
    count = lambda text, pattern: spark.range(1).select(X.count(F.lit(text), pattern)).first()[0]
    assert count("éis asked is baked", X.PASSIVE) == 2
    assert count("42% and 3.5k, v2 no", X.CONCRETE_NUMBER) == 2
    assert count("it's not just a plan, it's a path", X.NOT_X_BUT_Y) == 1


def test_patterns_start_from_first_characters_and_find_the_same(spark):
    import random

    plain = {
        X.TRICOLON: rf"(?i){X.B0}\w+(?:ly)?, \w+(?:ly)?, and \w+",
        X.PASSIVE: rf"(?i){X.B0}(?:is|are|was|were|be|been|being) \w+ed{X.B1}",
        X.FIRST_PERSON: rf"{X.B0}(?:I|I'm|I've|I'd|I'll|my|me){X.B1}",
        X.PLURAL_FIRST_PERSON: rf"{X.B0}(?:I|I'm|I've|we|we're|we've|our){X.B1}",
        X.CONCRETE_NUMBER: rf"{X.B0}\d+(?:[.,]\d+)?(?:%|k|K|M|B)?{X.B1}",
        X.FIRST_PARTY: rf"(?i){X.B0}(?:we|our) (?:tested|analy[sz]ed|ship(?:ped)?|ran){X.B1}",
        X.BYLINE: rf"{X.B0}by [A-Z][a-z]+ [A-Z][a-z]+",
    }
    # None but the one that may begin with any word character looks back from every character of a text.
    assert [p for p in plain if p.removeprefix("(?i)").startswith(X.B0)] == [X.TRICOLON]
    bits = "is are Was were BE been being I I'm I've I'd I'll my me we we're Our tested ran ship asked 42 3.5k 7,1% v2 by Ada Byron quickly, and , and é — _ ! ? .".split(" ")
    bits += [chr(c) for c in (9, 10, 0xA0, 0x2003, 0x1F600)] + [" ", "  "]
    rng = random.Random(3)
    texts = [("".join(rng.choice(bits) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(30))),) for _ in range(4000)]
    t = F.col("t")
    same = [(F.regexp_extract_all(t, F.lit(new), F.lit(0)), F.regexp_extract_all(t, F.lit(old), F.lit(0))) for new, old in plain.items()]
    same += [(X.collapse(t), F.trim(F.regexp_replace(t, X.WS + "+", " ")))]
    same += [(F.split(t, X.SENTENCE_GAP), F.split(t, "(?<=[.!?]) (?=[A-Z])"))]
    same += [(X.trimmed(t), X.js_trim(t))]
    same += [(X.substring_total(t, ["me", "we", "e a"]), sum((X.substring_count(t, F.lit(n)) for n in ("me", "we", "e a")), F.lit(0)))]
    df = spark.createDataFrame(texts, "t string")
    differ = df.select(*[F.count_if(~a.eqNullSafe(b)) for a, b in same]).first()
    assert list(differ) == [0] * len(same)


def test_white_space_is_wider_than_ascii(spark):
    df = spark.createDataFrame([("a" + chr(0xA0) + "b" + chr(0x2003) + "c \n d" + chr(0xFEFF),)], "t string")
    assert df.select(X.collapse(F.col("t"))).first()[0] == "a b c d"
    assert df.select(X.word_count(X.collapse(F.col("t")))).first()[0] == 4


@pytest.mark.parametrize("text,yes", [("How so", True), ("Is it?", True), ("Island life", False), ("", False), ("“What” now", True)])
def test_questions(spark, text, yes):
    assert spark.range(1).select(X.looks_like_question(F.lit(text))).first()[0] == yes


def test_normal_urls(spark):
    got = spark.range(1).select(
        U.normalize_url(F.lit("HTTPS://User@Site.example:443/a/?q=1#f")), U.normalize_url(F.lit("http://x.example")),
        U.normalize_url(F.lit("/rel")), U.brand_host(F.lit("https://www.Brand.example/x")),
    ).first()
    assert list(got) == ["https://site.example/a?q=1", "http://x.example/", "/rel", "brand.example"]


def test_byline_needs_text_in_the_first_match(spark):
    base = page(body='<span class="byline"> </span><span class="byline">Ada</span>')
    assert checks(spark, base, trust.BYLINE) == {"E_visible_byline_missing"}
    assert checks(spark, page(body="<p>Written by Ada Byron</p>"), trust.BYLINE) == set()


def test_own_links_are_no_citations(spark):
    links = "".join(f'<a href="https://{h}/p">x</a>' for h in ("www.me.example", "a.example", "b.example", "c.example"))
    assert checks(spark, page(body=links), trust.CITATIONS, brand_website="https://www.me.example/") == set()
    assert checks(spark, page(body=links.replace("c.example", "me.example")), trust.CITATIONS, brand_website="https://www.me.example/") != set()


def test_whole_text_is_read(spark):
    html = page(body=f"<p>{'word ' * 20000}delve</p>")
    assert "H_banned_vocabulary" in checks(spark, html, style.TEXT_SIGNALS)


def test_supplied_jsonld_goes_first(spark):
    df = spark.createDataFrame(
        [(1, page('<script type="application/ld+json">{"@type": "Thing"}</script>'), '[{"schema": {"@type": "HowTo"}}]')],
        "doc_id int, html string, schemas_json string",
    )
    row = prepare(df).select("post_type", F.col("ld_entities.types")[0].alias("types")).first()
    assert row["post_type"] == "procedural" and row["types"] == ["HowTo"]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(i, page(f"<title>{'t' * i}</title>", f"<h1>a</h1><p>We measured {i}%.</p>")) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id int, html string")
    one, many = (audit(df.repartition(n)).select("doc_id", "overall", "verdict", F.size("found").alias("n")).orderBy("doc_id").collect() for n in (1, 7))
    assert one == many


def test_no_shuffle_in_the_audit(spark):
    df = spark.createDataFrame([(1, page())], "doc_id int, html string")
    plan = audit(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_families_have_own_names():
    names = [f.name for f in FAMILIES]
    assert len(names) == len(set(names))


# --- pages that must not stop or stall a job ----------------------------------------------------


def test_odd_markup_is_read(spark):
    odd = [
        "<p>a</p><![x[ foo ]]><p>b</p>", "<p>a<![endif]>b", "<![CDATA[x]]><p>c", "<![", "<!", "<p>a</p><!-- open <p>b", "<a href=\"x <p>y", "&#xD800;<p>z",
    ]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id int, html string")
    rows = {r["doc_id"]: r for r in sh.shred(df).select("doc_id", "texts").collect()}
    assert len(rows) == len(odd) and "".join(rows[0]["texts"]).replace(" ", "") == "ab"
    shown = [r["t"] for r in spark.createDataFrame([("a<!-- b <p>c",), ("a<!-- b -->c",)], "h string").select(X.visible_text(F.col("h")).alias("t")).collect()]
    assert shown == ["a", "a c"]


def test_odd_json_is_read(spark):
    odd = ['{"@type": "A", "v": "\\ud800x"}', '{"@type": "A", "v": ' + "7" * 5000 + "}", "[" * 50_000 + "]" * 50_000, '{"headline": "a </script> b", "@type": "A"}',
           '{"@type": "A", "v": "\\ud83d\\ude00"}', "{bad", "", None]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id int, j string")
    rows = {r["doc_id"]: r for r in sh.walk_jsonld(df, "j").collect()}
    assert [rows[i]["ld_scripts"][0]["status"] for i in range(7)] == ["ok", "ok", "deep", "ok", "ok", "invalid", "empty"] and rows[7]["ld_scripts"] == []
    assert "\ufffdx" in rows[0]["ld_entities"][0]["json"] and "\U0001f600" in rows[4]["ld_entities"][0]["json"]
    assert rows[3]["ld_entities"][0]["fields"] == ["headline", "@type"]
    page_ = f'<script type="application/ld+json">{odd[2]}</script>'
    assert "V_schema_invalid_json" not in checks(spark, page_, jsonld.VALIDITY)


@pytest.mark.parametrize("unit", ["<!--", "<![x[", "<script>", "<p ", "</p ", "&#xD800;"])
def test_long_odd_pages_take_seconds(spark, unit):
    import time

    df = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)))], "doc_id int, html string")
    start = time.time()
    df.select(X.visible_text(F.col("html")).alias("t")).collect()
    sh.shred(df).select(F.size("elements")).collect()
    assert time.time() - start < 60


def test_byline_anywhere_in_the_page(spark):
    text = "word " * 2000 + "by Ada Lovelace"
    assert checks(spark, page(body=f"<p>{text}</p>"), trust.BYLINE) == set()


def test_schema_patches_change_values(spark):
    from inkgauge.operators.markup import insert_schema

    html = '<script type="application/ld+json">{"@graph": [{"@type": ["Article", "X"], "a": {"b": 1}}]}</script>t<script TYPE=application/ld+json>{"@type": "Person"}</script>'
    patches = [("Article.a.c.d", "2"), ("Person.name", "Ada"), ("add:Page", '{"n": 1}'), ("Page.n", "3"), ("Nobody.x", "1"), ("add:Page", "no object"), ("Article", "1")]
    out, log = insert_schema(html, [{"target": t, "after": a, "type": "insert_schema"} for t, a in patches])
    assert [ok for _, _, ok, _ in log] == [True, True, True, True, False, False, False]
    import json
    import re

    blocks = [json.loads(b) for b in re.findall(r"(?is)<script[^>]*>(.*?)</script>", out)]
    assert blocks == [{"@graph": [{"@type": ["Article", "X"], "a": {"b": 1, "c": {"d": 2}}}, {"@type": "Page", "n": 3}]}, {"@type": "Person", "name": "Ada"}]
    assert "</script>t<script TYPE" in out and insert_schema("<p>", [{"target": "A.b", "after": "1", "type": "t"}])[0] == "<p>"

"""Derived inputs: each is one SELECT over the given tables that two engines read alike.

The plain tables trigger few checks, so pages gain head tags, sections, links and JSON-LD by rules on
their id; texts gain marked words; line items become findings and orders become audit runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def _num(expr: str) -> str:
    return f"cast({expr} as string)"


_ID = _num("page_id")
_WORDS = "'measured alpha signal carries weight across every reader segment today '"

HEAD = f"""
  case when page_id % 4 <> 0 then '<link rel="canonical" href="' ||
    case when page_id % 23 = 1 then '/post/' || {_ID}
         else 'https://site' || {_num('page_id % 10')} || '.example.com/post/' || {_ID} || case when page_id % 2 = 0 then '/' else '' end
    end || '">' else '' end
  || case when page_id % 3 <> 0 then '<meta property="og:url" content="' ||
    case when page_id % 29 = 2 then 'not a url'
         else 'https://SITE' || {_num('page_id % 10')} || '.Example.com/' || case when page_id % 11 = 0 then 'other/' else 'post/' end || {_ID} || '#top'
    end || '">' else '' end
  || case when page_id % 5 <> 0 then '<meta name="viewport" content="width=device-width">' else '' end
  || case when page_id % 17 = 0 then '<meta name="robots" content="NOINDEX, follow">' else '' end
  || case when page_id % 6 <> 0 then '<meta name="description" content="' || trim(repeat('plain words ', cast(5 + page_id % 16 as int))) || '">' else '' end
  || case when page_id % 7 <> 0 then '<meta property="og:title" content="Shared title ' || {_ID} || '">' else '' end
  || case when page_id % 9 <> 1 then '<meta property="og:description" content="Shared words">' else '' end
  || case when page_id % 8 <> 3 then '<meta property="og:type" content="article">' else '' end
  || case when page_id % 2 = 0 then '<meta name="twitter:card" content="summary">' else '' end
  || case when page_id % 13 = 4 then '<meta property="og:image" content="https://cdn.example.com/hero.png">' else '' end
  || case when page_id % 14 = 3 then '<link rel="alternate" hreflang="de" href="/de/x"><link rel="alternate" hreflang="fr" href="/fr/x">' else '' end
  || case when page_id % 16 = 5 then '<script src="/_next/static/app.js"></script>' else '' end
"""

_PERSON = """'{"@type": "Person", "@id": "#p' || cast(page_id % 5 as string) || '", "name": "' || case when page_id % 21 = 0 then '' else 'Ada Byron' end || '"' ||
    case page_id % 4 when 0 then ', "sameAs": ["https://www.linkedin.com/in/ada", "https://ada.example.org"]'
                     when 1 then ', "sameAs": "https://ada.example.org"'
                     when 2 then ', "sameAs": ["https://www.linkedin.com/in/ada"]' else '' end ||
    case when page_id % 3 = 0 then ', "jobTitle": "Analyst"' else '' end || '}'"""

JSONLD = f"""
  case page_id % 6
    when 0 then '{{"@context": "https://schema.org", "@graph": [{{"@type": "BlogPosting", "@id": "#post", "headline": "H", "author": {{"@id": "#p0"}}, "datePublished": "' ||
      case when page_id % 4 = 0 then '2026-04-23' else '2026-04-23T10:30:00Z' end || '", "dateModified": "' ||
      case page_id % 5 when 0 then '2026-04-23' when 1 then '2026-04-23T10:30' when 2 then '2026-04-23T10:30:00' when 3 then '2026-04-23T10:30:00+05:30' else '2026-04-24T00:00:30Z' end ||
      '"}}, ' || {_PERSON} || ', {{"@type": "FAQPage", "mainEntity": [' ||
      case when page_id % 8 = 0 then '{{"@type": "Question", "name": "Q1", "acceptedAnswer": {{"@type": "Answer", "text": "A"}}}}, {{"@type": "Question", "name": "Q2"}}'
           else '{{"@type": "Question", "name": "Q1", "acceptedAnswer": {{"@type": "Answer", "text": "A"}}}}' end || ']}}]}}'
    when 1 then '{{"@type": ["Article", "NewsArticle"], "headline": "H", "datePublished": "2026-04-23", "image": "/i.png", "author": ' || {_PERSON} || ', "publisher": {{"@type": "Organization", "name": "Org"}}}}'
    when 2 then '[{{"@type": "Organization", "name": "Org"}}, {{"@type": "WebPage", "url": "/x", "dateModified": "2026-04-23"}}, {{"name": "untyped"}}, ' || case when page_id % 4 = 0 then '3' else '{{"@type": ""}}' end || ']'
    when 3 then '{{"@type": "BreadcrumbList", "itemListElement": [{{"@type": "ListItem", "position": 1, "name": "a"}}, {{"@type": "ListItem", "position": ' || {_num('2 + page_id % 2')} || ', "name": "b"}}]}}'
    when 4 then case when page_id % 4 = 0 then '{{"@type": "Article", "headline": "cut off"' else '{{"@graph": {{"@type": "Article"}}}}' end
    else '' end
"""

BODY = f"""
  case when page_id % 4 = 0 then '<p data-tldr>' || repeat('lift ', cast(35 + page_id % 30 as int)) || 'done.</p>'
       when page_id % 4 = 2 then '<p>TL;DR: Answer Engine Lift ' || repeat('brief ', cast(30 + page_id % 31 as int)) || '</p>' else '' end
  || repeat('<h2>What changes when we look closer?</h2><p>As mentioned above, this part depends on another. It was changed by hand.</p>', cast(page_id % 5 as int))
  || repeat('<h2>Plain findings</h2><p>We measured 42% more, and our audited set shows 3.5k visits. See the table for detail.</p>', cast(page_id % 4 as int))
  || case when page_id % 12 = 5 then '<h2>Long part</h2><p>' || repeat({_WORDS}, 60) || '</p>' else '' end
  || case when page_id % 24 = 11 then '<h2>Long part</h2><p>' || repeat({_WORDS}, 60) || '</p><h3>Inner</h3><p>Rest of it, quickly, calmly, and surely.</p>' else '' end
  || case when page_id % 3 = 0 then '<h4>Deep heading</h4>' else '' end
  || case when page_id % 10 = 3 then '<h3>Is it useful</h3><p><strong>How so?</strong> Yes.</p>' else '' end
  || repeat('<a href="https://ref.example.org/paper">ref</a> ', cast(page_id % 6 as int))
  || case when page_id % 9 = 2 then '<a href="https://www.brand' || {_num('page_id % 7')} || '.example.com/own">own</a>' else '' end
  || case when page_id % 2 = 1 then '<img src="/a.gif" alt="">' when page_id % 6 = 2 then '<img src="/pic/shot.png" alt="stage view">' else '<img src="https://stock.example.com/x.jpg" alt="people">' end
  || case when page_id % 18 = 7 then '<figure><img src="/b.gif" alt="b"><figcaption>Own chart</figcaption></figure>' else '' end
  || case when page_id % 5 = 2 then '<ol><li>a</li><li>b</li></ol><ul><li>a</li><li>b</li><li>c</li><li>d</li></ul>' else '' end
  || case when page_id % 7 = 3 then '<nav aria-label="Table of Contents"><a href="#a">a</a></nav>' else '' end
  || case when page_id % 11 = 6 then '<div class="meta byline">Ada</div>' when page_id % 11 = 7 then '<span rel="author"> </span>' else '' end
  || case when page_id % 15 = 4 then '<p>Last updated: today. Words go on to fill the line here.</p>' when page_id % 15 = 9 then '<p>Written April 3, 2026 by the team for all of us.</p>' else '' end
  || case when page_id % 8 = 1 then '<p>It was robust — and we delve into a myriad — of things, perhaps.</p>' else '' end
"""

SYNTH_PAGES = f"""
SELECT page_id AS doc_id,
  'Brand ' || {_num('page_id % 7')} AS brand,
  case when page_id % 3 = 0 then 'https://www.brand' || {_num('page_id % 7')} || '.example.com/about' end AS brand_website,
  'Post No. ' || {_ID} AS slug,
  case page_id % 10 when 0 then 'How To' when 1 then 'guide' when 2 then 'vs' when 3 then 'best_of' when 4 then 'faq'
    when 5 then 'study' when 6 then 'glossary' when 7 then 'explainer' when 8 then 'best things' end AS format,
  case page_id % 5 when 0 then 'What is retrieval ranking' when 1 then 'Alpha vs. Beta' when 2 then 'Best analytics tools'
    when 3 then 'How to measure lift' end AS topic,
  case when page_id % 2 = 0 then 'Answer Engine Lift Guide' end AS primary_keyword,
  cast(case when page_id % 10 = 9 then 400 + (page_id % 37) * 100 end as int) AS word_count,
  replace(replace(html, '</head>', head || case when ld = '' then '' else '<script type="application/ld+json">' || ld || '</script>' end
    || case when page_id % 31 = 3 then '<script type="application/ld+json"> </script>' else '' end || '</head>'), '</article>', body || '</article>') AS html,
  ld AS jsonld
FROM (SELECT page_id, html, {HEAD} AS head, {JSONLD} AS ld, {BODY} AS body FROM pages)
"""

SYNTH_TEXT = """
SELECT doc_id, lang,
  replace(replace(replace(replace(replace(text,
    ' of ', case when doc_id % 5 = 0 then ' delve ' when doc_id % 5 = 1 then ' robust realm ' else ' of ' end),
    ' and ', case when doc_id % 7 = 0 then ' — ' when doc_id % 7 = 3 then ' moreover ' else ' and ' end),
    '. ', case when doc_id % 3 = 0 then '? ' else '. ' end),
    ' the ', case when doc_id % 11 = 0 then ' perhaps ' when doc_id % 11 = 4 then ' is tested ' when doc_id % 11 = 6 then ' I am 42% ' else ' the ' end),
    ' de ', case when doc_id % 13 = 0 then ' swiftly, calmly, and surely ' when doc_id % 13 = 5 then ' it''s not just a plan, it''s a path ' when doc_id % 13 = 8 then ' a game-changing, cutting-edge ' else ' de ' end)
  AS text
FROM documents
"""

SYNTH_JSONLD = """
SELECT c_custkey AS doc_id,
  '{"@context": "https://schema.org", "@graph": [{"@type": ' || case when c_custkey % 4 = 0 then '["BlogPosting", "Article"]' else '"BlogPosting"' end ||
  case when c_custkey % 3 <> 0 then ', "@id": "#post"' else '' end || ', "headline": "' || c_name || '"' ||
  case when c_custkey % 5 <> 0 then ', "datePublished": "2026-04-2' || cast(c_custkey % 10 as string) || case c_custkey % 4 when 0 then '' when 1 then 'T10:30' when 2 then 'T10:30:00' else 'T10:30:00Z' end || '"' else '' end ||
  case when c_custkey % 6 <> 1 then ', "dateModified": "2026-05-0' || cast(1 + c_custkey % 9 as string) || case c_custkey % 5 when 0 then '' when 1 then 'T08:00' when 2 then 'T08:00:00' when 3 then 'T08:00:00.5+02:00' else 'T08:00:00Z' end || '"' else '' end ||
  case when c_custkey % 7 = 0 then ', "image": null' else '' end ||
  ', "author": ' || case c_custkey % 4 when 0 then '{"@id": "#p' || cast(c_custkey % 5 as string) || '"}'
     when 1 then '{"@type": "Person", "name": "Inline ' || n_name || '", "sameAs": "https://www.linkedin.com/in/x"}'
     when 2 then '[{"@id": "#p1"}, {"@type": "Person", "name": "Listed", "worksFor": {"@id": "#org"}}]'
     else '"' || n_name || '"' end || '}' ||
  case when c_custkey % 3 = 1 then '' else ', {"@type": "Person", "@id": "#p' || cast(c_custkey % 4 as string) || '", "name": "' || n_name || '", "sameAs": ["https://www.linkedin.com/in/' || cast(c_custkey as string) || '"' || case when c_custkey % 2 = 0 then ', "https://x.example.com"' else '' end || ']}' end ||
  case when c_custkey % 8 = 2 then ', {"@type": "FAQPage", "mainEntity": ' || case c_custkey % 3 when 0 then '[{"@type": "Question", "name": "Q", "acceptedAnswer": {"@type": "Answer", "text": "A"}}]' when 1 then '[{"@type": "Question", "name": "Q"}]' else '{"@type": "Question"}' end || '}' else '' end ||
  case when c_custkey % 9 = 4 then ', {"@type": "BreadcrumbList", "@id": "#crumbs", "itemListElement": [{"@type": "ListItem", "position": 1, "name": "a"}, {"@type": "ListItem", "position": ' || case c_custkey % 4 when 0 then '"2"' when 1 then '3' when 2 then '"two"' else '2' end || ', "name": "b"}]}' else '' end ||
  case when c_custkey % 10 = 6 then ', {"name": "no type"}, 7' else '' end ||
  ']' || case when c_custkey % 13 = 0 then '' else '}' end AS jsonld
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

SYNTH_FINDINGS = """
SELECT o_custkey AS slug_id, o_orderkey AS run_id, o_orderdate AS started,
  cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) AS ord,
  'C' || cast(l_partkey % 12 as string) AS check_id,
  case when l_quantity > 48 then 'critical' when l_quantity > 35 then 'fail' when l_quantity > 15 then 'warn' else 'info' end AS severity,
  case l_returnflag when 'A' then 'technical' when 'N' then 'humanization' else 'eeat' end AS layer,
  l_suppkey % 3 AS iteration
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

SYNTH_RUNS = """
SELECT o_custkey AS slug_id, o_orderkey AS run_id, o_orderdate AS started,
  'Brand ' || cast(o_custkey % 7 as string) || '!' AS brand, ' Post/' || cast(o_custkey as string) || ' ' AS slug,
  case o_custkey % 4 when 0 then 'pillar' when 1 then 'faq' when 2 then 'comparison' else 'general' end AS post_type,
  substr(cast(o_orderdate as string), 1, 10) || 'T00:00:00.' || substr(cast(1000 + o_orderkey % 1000 as string), 2, 3) || 'Z' AS started_at
FROM orders
"""

SYNTH_JUDGE = """
SELECT doc_id,
  'Here is my view: {"axes": [{"name": "Specific Human", "score": ' || cast(doc_id % 11 as string) ||
  ', "worst_sentence": "Old ' || cast(doc_id as string) || '", "suggested_rewrite": ' || case when quality = 1 then '"New"' else 'null' end || ', "reason": "r"}, ' ||
  '{"name": "intro_hook", "score": ' || cast(doc_id * 7 % 11 as string) || ', "worst_sentence": null, "suggested_rewrite": null, "reason": "s"}]' ||
  case when doc_id % 19 = 0 then '' else '} end' end AS answer
FROM labels
"""

SYNTH_ITERATIONS = """
SELECT o_custkey AS doc_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) AS iteration,
  cast(40 + floor(o_totalprice) % 60 as int) AS overall, case when o_orderstatus = 'F' then 0.12 else 0.03 end AS cost,
  cast(case when o_orderkey % 9 = 0 then 1 else 0 end as int) AS unfixable,
  cast(o_orderkey % 5 as int) AS planned, cast(o_orderkey % 4 as int) AS applied
FROM orders
"""

SYNTH_USAGE = """
SELECT user_id AS doc_id, case event_type when 'click' then 'large' when 'view' then 'small' else 'unpriced' end AS model,
  cast(floor(value * 1000) as bigint) AS input_tokens, cast(floor(value * 10) as bigint) AS output_tokens
FROM events
"""

SYNTH_PREFLIGHT = """
SELECT page_id AS doc_id,
  case page_id % 4 when 0 then 'writer:B2' when 1 then 'writer:F7' when 2 then 'writer:F2' else case when page_id % 8 = 3 then 'other:B2' else 'writer:Z9' end end AS check_id,
  case when page_id % 25 = 0 then 'critical' else 'warn' end AS severity, 'seen before' AS evidence
FROM pages
"""

# Earlier runs of the pages, up to three of them, and what the last one found.
SYNTH_HISTORY = " UNION ALL ".join(
    f"SELECT page_id AS doc_id, '2026-0{k}-01T00:00:00.000Z' AS started_at FROM pages WHERE page_id % 4 >= {k}" for k in (1, 2, 3)
)
SYNTH_PRIOR = " UNION ALL ".join(
    f"SELECT page_id AS doc_id, {n} AS ord, '{check}' AS check_id, '{severity}' AS severity FROM pages WHERE page_id % 4 > 0 AND page_id % {every} <> 0"
    for n, (check, severity, every) in enumerate([
        ("A4_canonical_tag", "critical", 5), ("M_description_missing", "warn", 7), ("S_tldr_missing", "info", 2), ("X_gone", "fail", 3), ("E_no_first_party_data", "fail", 11),
        ("S_tldr_missing", "fail", 3),
    ])
)

# Pages without unfixable problems: rounds of patching have something to do.
ADA = """{"@type": "Person", "@id": "#ada", "name": "Ada Byron", "jobTitle": "Analyst", "sameAs": ["https://www.linkedin.com/in/ada", "https://ada.example.org"]}"""


def sound_jsonld(more: str = "''") -> str:
    """The JSON-LD of a sound page, with more members of its post (an SQL text)."""
    return (
        """'{"@context": "https://schema.org", "@graph": [{"@type": "BlogPosting", "@id": "#post", "headline": "H", "datePublished": "2026-04-23T10:30:00Z"' ||
    case when page_id % 2 = 0 then ', "author": {"@id": "#ada"}' else '' end || """ + more + f""" ||
    '}}, {ADA}]}}'"""
    )


SOUND_PAGES = f"""
SELECT page_id AS doc_id, 'Brand ' || cast(page_id % 7 as string) AS brand, 'post-' || cast(page_id as string) AS slug,
  replace(replace(html, '</head>', '<link rel="canonical" href="https://site.example.com/p/' || cast(page_id as string) || '"><meta name="viewport" content="width=device-width">' ||
    case when page_id % 3 = 0 then '<meta property="og:url" content="https://site.example.com/p/' || cast(page_id as string) || '">' else '' end ||
    case when page_id % 4 <> 0 then '<meta name="description" content="Plain words on the page">' else '' end ||
    '<script type="application/ld+json">' || {sound_jsonld()} || '</script></head>'),
    '</article>', '<figure><img src="/own.png" alt="own chart"><figcaption>Chart</figcaption></figure><p>We measured it. ' ||
    case when page_id % 5 = 0 then 'The robust plan held.' else 'The plan held.' end || '</p><a href="https://r.example.org/1">1</a><a href="https://r.example.org/2">2</a><a href="https://r.example.org/3">3</a></article>') AS html
FROM pages
"""

FIXTURES = {
    "sound_pages": SOUND_PAGES,
    "synth_pages": SYNTH_PAGES,
    "synth_text": SYNTH_TEXT,
    "synth_jsonld": SYNTH_JSONLD,
    "synth_findings": SYNTH_FINDINGS,
    "synth_runs": SYNTH_RUNS,
    "synth_judge": SYNTH_JUDGE,
    "synth_iterations": SYNTH_ITERATIONS,
    "synth_usage": SYNTH_USAGE,
    "synth_preflight": SYNTH_PREFLIGHT,
    "synth_history": SYNTH_HISTORY,
    "synth_prior": SYNTH_PRIOR,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Only where the work per row is heavy does an extra move of a small input pay.
    return spread(df, always=name == "customer") if name in ("pages", "documents", "customer") else df


def spread(df: DataFrame, always: bool = False) -> DataFrame:
    """Deal the rows of an input out evenly, four tasks a core; wide rows in that many parts already pass unchanged.

    ``always``: for narrow rows. A million of them can lie in one row group, which one task reads, however many parts
    the file is cut into.
    """
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(4 * max(cores, parts if always else 0)) if always or parts < 4 * cores else df


#: Findings and runs are told by the key of their order.
_RUN_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def run_parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts findings are dealt: sixteen for each part of their file, so that a task's share of them does
    not grow with the table."""
    return 16 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").rdd.getNumPartitions()


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input in Spark."""
    import re

    sql = FIXTURES[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    views = {t: f"{t}_in_{name}" for t in used}
    for t, view in views.items():
        df = table(spark, sf_dir, t)
        if name == "synth_findings":
            # Both sides of the join, so that the findings of a run stay together in as many parts.
            df = df.repartition(run_parts(spark, sf_dir), _RUN_KEYS[t])
        df.createOrReplaceTempView(view)
    for t, view in views.items():
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {view}", sql)
    return spark.sql(sql)


def with_fixtures(names: str, select: str) -> str:
    """The DuckDB text of a query over derived inputs."""
    import re

    parts = [f"{n} AS ({FIXTURES[n].strip()})" for n in names.split()]
    body = select.strip()
    recursive = re.match(r"(?i)with\s+", body)
    if recursive:
        return "WITH " + ", ".join(parts) + ", " + body[recursive.end():]
    return "WITH " + ", ".join(parts) + " " + body


def put_files(rows: DataFrame, root: str) -> int:
    """Write (path, content) rows as files below a folder that all executors share; returns their number."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                store.create_dir(f"{top}/{path.rpartition('/')[0]}", recursive=True)
                with store.open_output_stream(f"{top}/{path}", compression=None) as f:
                    f.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0

"""Registered queries over JSON-LD texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.operators import findings as fnd, jsonld, posts as post_ops, shred as sh
from inkgauge.operators.structure import once
from inkgauge.plans import duck as D
from inkgauge.plans.fixtures import fixture, table, with_fixtures

QUERIES: dict = {}


def walked(spark, sf) -> DataFrame:
    return sh.walk_jsonld(fixture(spark, sf, "synth_jsonld"), "jsonld").drop("jsonld")


def rows(spark, sf, family: fnd.Family) -> DataFrame:
    return fnd.run_family(walked(spark, sf), family).select("doc_id", "check_id", "severity")


def over(select: str) -> str:
    return with_fixtures("synth_jsonld", select)


LD = """ok AS (SELECT doc_id, json(jsonld) AS j FROM synth_jsonld WHERE json_valid(jsonld)),
items AS (SELECT doc_id, i - 1 AS nth, g[i] AS n FROM (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, cast(j->'@graph' as json[]) AS g FROM ok))),
ents AS (SELECT * FROM items WHERE json_type(n) = 'OBJECT' AND (n->'@type') IS NOT NULL),
etypes AS (SELECT doc_id, nth, n, unnest(case when json_type(n->'@type') = 'ARRAY' then cast(n->'@type' as varchar[]) else [n->>'@type'] end) AS type FROM ents)"""

QUERIES["flatten_entities"] = (
    lambda spark, sf: sh.entities_table(walked(spark, sf)).select(
        "doc_id", "path", "id", F.array_join("types", "/").alias("types"), F.array_join(F.sort_array("fields"), ",").alias("fields")
    ),
    over(f"WITH {LD} SELECT doc_id, '$.@graph[' || nth || ']' AS path, n->>'@id' AS id, "
         "array_to_string(case when json_type(n->'@type') = 'ARRAY' then cast(n->'@type' as varchar[]) else [n->>'@type'] end, '/') AS types, "
         "array_to_string(list_sort(json_keys(n)), ',') AS fields FROM ents"),
)
QUERIES["entity_types"] = (
    lambda spark, sf: sh.entities_table(walked(spark, sf)).select("doc_id", "ord", F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("n")),
    over(f"WITH {LD} SELECT type, count(*) AS n FROM etypes GROUP BY type"),
)
TREE = """ok AS (SELECT doc_id, json(jsonld) AS j FROM synth_jsonld WHERE json_valid(jsonld)),
tree AS (SELECT doc_id, t.key, t.value, t.type, t.fullkey, t.id, t.parent FROM ok, json_tree(j) t)"""
_KIND = "case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'ARRAY' then case when json_array_length(value) = 0 then 'empty_array' else 'array' end else 'number' end"
QUERIES["walk_nodes"] = (
    lambda spark, sf: sh.nodes_table(walked(spark, sf)).select("doc_id", "path", "kind", F.array_join(F.sort_array("keys"), ",").alias("keys")),
    # Objects anywhere, and whatever else stands at the top, in a list at the top, or in the graph.
    over(f"""WITH {TREE}, named AS (SELECT *, replace(fullkey, '"', '') AS path FROM tree)
      SELECT doc_id, path, 'object' AS kind, array_to_string(list_sort(json_keys(value)), ',') AS keys FROM named WHERE type = 'OBJECT'
      UNION ALL SELECT doc_id, path, {_KIND}, '' FROM named WHERE type <> 'OBJECT' AND (path = '$' OR regexp_matches(path, '^\\$(?:\\.@graph)?\\[[0-9]+\\]$'))"""),
)

_SPECS = "specs(type, tier, field, nth) AS (VALUES " + ", ".join(
    f"({D.q(t)}, {D.q(tier)}, {D.q(f)}, {i})"
    for t, tiers in dims.ENTITY_FIELDS.items()
    for tier, fields in zip(dims.FIELD_TIERS, tiers)
    for i, f in enumerate(fields)
) + ")"
MISSING = f"""{LD}, {_SPECS}, miss AS (SELECT e.doc_id, e.nth, e.type, s.tier, string_agg(s.field, ', ' order by s.nth) AS missing FROM etypes e JOIN specs s USING (type)
  WHERE NOT list_contains(json_keys(e.n), s.field) GROUP BY e.doc_id, e.nth, e.type, s.tier)"""


def missing_rows(spark, sf) -> DataFrame:
    return fnd.run_family(walked(spark, sf), jsonld.FIELD_COMPLETENESS)


QUERIES["field_completeness"] = (
    lambda spark, sf: missing_rows(spark, sf).select("doc_id", "check_id", "severity", F.array_join("missing", ", ").alias("missing")),
    over(f"WITH {MISSING} SELECT doc_id, 'D_' || type || '_missing_' || tier AS check_id, case when tier = 'recommended' then 'warn' else 'fail' end AS severity, missing FROM miss"),
)
QUERIES["missing_fields_from_evidence"] = (
    lambda spark, sf: missing_rows(spark, sf).select("doc_id", "check_id", F.explode("missing").alias("field"))
    .groupBy("check_id", "field").agg(F.count("*").alias("n")),
    over(f"WITH {MISSING} SELECT 'D_' || type || '_missing_' || tier AS check_id, field, count(*) AS n FROM (SELECT type, tier, unnest(string_split(missing, ', ')) AS field FROM miss) GROUP BY 1, 2"),
)


def cited(spark, sf) -> DataFrame:
    from inkgauge.operators.scoring import citations_for_check

    return citations_for_check(missing_rows(spark, sf)).groupBy("check_id").agg(
        F.count("*").alias("n"), F.max(F.array_join(F.transform("rule_ids", lambda r: r.cast("string")), ",")).alias("rules")
    )


_D6 = ",".join(str(r) for r in dims.CITATIONS["D6_required_fields"][0])
QUERIES["citations_for_check"] = (
    cited,
    over(f"WITH {MISSING} SELECT 'D_' || type || '_missing_' || tier AS check_id, count(*) AS n, case when tier = 'recommended' then '' else '{_D6}' end AS rules FROM miss GROUP BY type, tier"),
)
QUERIES["block_presence"] = (
    lambda spark, sf: rows(spark, sf, jsonld.BLOCK_PRESENCE),
    over("SELECT doc_id, 'D_no_schema_blocks' AS check_id, 'critical' AS severity FROM synth_jsonld WHERE NOT json_valid(jsonld)"),
)


def no_article(spark, sf) -> DataFrame:
    """Half of the fixture's articles are renamed, so that the check has something to find."""
    df = fixture(spark, sf, "synth_jsonld").withColumn("jsonld", F.expr(_RENAMED))
    return fnd.run_family(sh.walk_jsonld(df, "jsonld"), jsonld.ARTICLE_PRESENCE).select("doc_id", "check_id", "severity")


_RENAMED = "case when doc_id % 2 = 1 then replace(jsonld, '\"BlogPosting\"', '\"Thing\"') else jsonld end"
QUERIES["article_presence"] = (
    no_article,
    over(f"SELECT doc_id, 'D_no_article_entity' AS check_id, 'critical' AS severity FROM (SELECT doc_id, {_RENAMED} AS j FROM synth_jsonld) WHERE json_valid(j) AND NOT contains(j, '\"BlogPosting\"')"),
)
QUERIES["faq_main_entity_check"] = (
    lambda spark, sf: rows(spark, sf, jsonld.FAQ_MAIN_ENTITY),
    over(f"""WITH {LD}, f AS (SELECT doc_id, n->'mainEntity' AS m FROM etypes WHERE type = 'FAQPage')
      SELECT doc_id, case when json_type(m) = 'ARRAY' then 'D_faq_mainentity_malformed' else 'D_faq_mainentity_not_array' end AS check_id, 'fail' AS severity FROM f
      WHERE coalesce(json_type(m), '') <> 'ARRAY' OR len(list_filter(cast(m as json[]), lambda q: not (coalesce(q->>'@type', '') = 'Question' and coalesce(json_type(q->'name'), '') = 'VARCHAR' and coalesce(json_type(q->'acceptedAnswer'->'text'), '') = 'VARCHAR'))) > 0"""),
)
QUERIES["breadcrumb_sequence"] = (
    lambda spark, sf: rows(spark, sf, jsonld.BREADCRUMB),
    over(f"""WITH {LD}, b AS (SELECT doc_id, list_filter(list_transform(cast(n->'itemListElement' as json[]), lambda i: try_cast(i->>'position' as double)), lambda p: p is not null) AS ps FROM etypes WHERE type = 'BreadcrumbList')
      SELECT doc_id, 'D_breadcrumb_positions_invalid' AS check_id, 'fail' AS severity FROM b WHERE len(list_filter(ps, lambda p, i: p <> i)) > 0"""),
)


def dates(spark, sf) -> DataFrame:
    """Audit time fixed half a minute after one of the stamps in use."""
    df = once(walked(spark, sf), audited_at=F.lit("2026-05-05 08:00:30").cast("timestamp"))
    return fnd.run_family(df, jsonld.ISO_DATES).select("doc_id", "check_id", "severity")


_WITH_TIME, _FULL = D.q("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}"), D.q("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:[+-]\\d{2}:\\d{2}|Z)$")
QUERIES["iso_date_checks"] = (
    dates,
    over(f"WITH {LD}, d AS (SELECT doc_id, n->>'dateModified' AS m, n->>'datePublished' AS p FROM etypes WHERE type IN ('Article', 'BlogPosting', 'NewsArticle', 'WebPage')) " + D.hits([
        ("D_datemodified_missing_time", "warn", f"not regexp_matches(m, {_WITH_TIME})"),
        ("D_datemodified_missing_timezone", "warn", f"regexp_matches(m, {_WITH_TIME}) and not regexp_matches(m, {_FULL})"),
        ("D_datepublished_not_full_iso", "info", f"p <> '' and not regexp_matches(p, {_FULL})"),
        ("D_datemodified_is_now", "warn", "abs(epoch(try_cast(replace(m, 'Z', '+00:00') as timestamptz)) - epoch(timestamptz '2026-05-05 08:00:30+00')) < 60"),
    ], "d")),
)
QUERIES["missing_ids"] = (
    lambda spark, sf: rows(spark, sf, jsonld.MISSING_IDS),
    over(f"WITH {LD} SELECT doc_id, 'D_entity_missing_id' AS check_id, 'warn' AS severity FROM etypes WHERE (n->'@id') IS NULL AND type IN ({', '.join(D.q(t) for t in dims.ID_EXPECTED_TYPES)}) GROUP BY doc_id, nth"),
)
# References: objects whose only key besides @type is @id, below a field of an entity.
REFS = f"""{LD}, rt AS (SELECT doc_id, nth, t.value, t.type, t.key FROM ents, json_tree(n) t WHERE t.parent IS NOT NULL AND t.type = 'OBJECT'),
refs AS (SELECT doc_id, nth, value->>'@id' AS ref FROM rt WHERE len(list_filter(json_keys(value), lambda k: k <> '@type')) = 1 AND (value->'@id') IS NOT NULL)"""
QUERIES["id_resolution"] = (
    lambda spark, sf: rows(spark, sf, jsonld.ID_RESOLUTION),
    over(f"WITH {REFS} SELECT doc_id, 'D_entity_id_unresolved' AS check_id, 'fail' AS severity FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = r.doc_id AND e.n->>'@id' = r.ref)"),
)
_REF_FIELDS = "[" + ", ".join(D.q(f) for f in dims.REFERENCE_FIELDS) + "]"
QUERIES["inline_over_reference"] = (
    lambda spark, sf: rows(spark, sf, jsonld.INLINE_OVER_REFERENCE),
    over(f"""WITH {LD}, f AS (SELECT doc_id, n->fld AS v FROM (SELECT doc_id, n, unnest({_REF_FIELDS}) AS fld FROM ents)),
      a AS (SELECT doc_id, unnest(case when json_type(v) = 'ARRAY' then cast(v as json[]) else [v] end) AS x FROM f WHERE v IS NOT NULL)
      SELECT doc_id, 'D_entity_inline_over_ref' AS check_id, 'info' AS severity FROM a WHERE json_type(x) = 'OBJECT' AND (x->'@type') IS NOT NULL AND len(json_keys(x)) > 1"""),
)


QUERIES["find_author"] = (
    lambda spark, sf: jsonld.find_author(walked(spark, sf)).select(
        "doc_id", F.try_variant_get(F.try_parse_json("author_json"), "$.name", "string").alias("name"),
        F.try_variant_get(F.try_parse_json("author_json"), '$["@type"]', "string").alias("type"),
    ),
    over(f"""WITH {LD}, p AS (SELECT doc_id, first(n order by nth) AS n FROM etypes WHERE type = 'Person' GROUP BY doc_id),
      a AS (SELECT doc_id, n->'author' AS n FROM ents WHERE nth = 0),
      b AS (SELECT doc_id, case json_type(n) when 'OBJECT' then n when 'ARRAY' then list_filter(cast(n as json[]), lambda x: coalesce(x->>'@type', '') = 'Person')[1] end AS n FROM a),
      c AS (SELECT s.doc_id, coalesce(p.n, b.n) AS n FROM synth_jsonld s LEFT JOIN p ON p.doc_id = s.doc_id LEFT JOIN b ON b.doc_id = s.doc_id)
      SELECT doc_id, n->>'name' AS name, n->>'@type' AS type FROM c"""),
)

# --- post records -----------------------------------------------------------------------------

# A supplied JSON-LD list per customer: half of the items come in an envelope.
_ENVELOPE = ("'[' || case when doc_id % 2 = 0 then '{\"schema\": ' || jsonld || '}' else jsonld end || ', {\"schema\": 1, \"@type\": \"Thing\"}]'")


def unwrapped(spark, sf) -> DataFrame:
    df = fixture(spark, sf, "synth_jsonld").select("doc_id", F.lit("").alias("html"), F.expr(_ENVELOPE).alias("schemas_json"))
    return sh.shred(df).select("doc_id", "ld_block_count", F.size("ld_entities").alias("entities"))


QUERIES["unwrap_schema_envelope"] = (
    unwrapped,
    over(f"""WITH {LD}, n AS (SELECT doc_id, count(*) AS n FROM ents GROUP BY doc_id)
      SELECT s.doc_id, case when json_valid(jsonld) then 2 else 0 end AS ld_block_count, cast(case when json_valid(jsonld) then n.n + 1 else 0 end as int) AS entities FROM synth_jsonld s LEFT JOIN n USING (doc_id)"""),
)

# Meta object of a post: strings, a null, a number, an array, nested objects, a missing description.
_META = ("'{\"title\": \"' || c_name || '\", \"robots\": null, \"n\": ' || cast(c_custkey as string) || ', \"tags\": [\"a\"], \"og\": {\"title\": \"' || c_mktsegment || '\", \"depth\": 3' || "
         "case when c_custkey % 3 = 0 then ', \"description\": \"Words of ' || c_name || '\"' else '' end || '}' || case when c_custkey % 2 = 0 then ', \"description\": \"Own\"' when c_custkey % 5 = 0 then ', \"description\": \"\"' else '' end || '}'")


def meta_rows(spark, sf) -> DataFrame:
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.expr(_META).alias("meta_json"))
    return fnd.rows_of(df, ["doc_id"], F.map_entries(post_ops.flatten_meta(F.col("meta_json"))), "nth", "m").select("doc_id", "m.*")


QUERIES["flatten_meta"] = (
    meta_rows,
    f"""WITH m AS (SELECT c_custkey AS doc_id, json({_META}) AS j FROM customer),
      top AS (SELECT doc_id, k AS key, j->k AS v FROM (SELECT doc_id, j, unnest(json_keys(j)) AS k FROM m)),
      flat AS (SELECT doc_id, key, v->>'$' AS value FROM top WHERE json_type(v) = 'VARCHAR' UNION ALL
        SELECT doc_id, key || ':' || k, v->>k FROM (SELECT doc_id, key, v, unnest(json_keys(v)) AS k FROM top WHERE json_type(v) = 'OBJECT') WHERE json_type(v->k) = 'VARCHAR'),
      d AS (SELECT doc_id, max(case when key = 'description' then value end) AS own, max(case when key = 'og:description' then value end) AS og FROM flat GROUP BY doc_id)
      SELECT doc_id, key, case when key = 'description' and value = '' and og is not null and og <> '' then og else value end AS value FROM flat JOIN d USING (doc_id)
      UNION ALL SELECT doc_id, 'description', og FROM d WHERE own is null AND coalesce(og, '') <> ''""",
)

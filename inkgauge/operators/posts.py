"""Post-level inputs: defaults, meta flattening, post type and its band."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.functions.binding import let


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv])


def infer_post_type(raw_format: Column, topic: Column, word_count: Column, schema_types: Column) -> Column:
    """Format synonym, then JSON-LD type, then the wording of the topic, then length."""
    key = F.regexp_replace(F.lower(raw_format), X.WS + "+", "_")
    t = F.lower(topic)

    def has(*names: str) -> Column:
        return F.arrays_overlap(schema_types, F.array(*[F.lit(n) for n in names]))

    return F.coalesce(
        F.try_element_at(literal_map(dims.FORMAT_SYNONYMS), key),
        F.when(has("HowTo"), "procedural")
        .when(has("DefinedTerm", "DefinedTermSet"), "definitional")
        .when(has("Dataset"), "research")
        .when(has("ItemList") & F.contains(F.lower(raw_format), F.lit("best")), "listicle")
        .when(t.rlike(rf"^(?:what is|what are){X.B1}"), "definitional")
        .when(t.rlike(rf"^how to{X.B1}"), "procedural")
        .when(t.rlike(rf"{X.B0}vs\.?{X.B1}|{X.B0}alternatives?{X.B1}"), "comparison")
        .when(t.rlike(rf"{X.B0}best{X.B1}.*{X.B0}(?:tools?|apps?|platforms?){X.B1}"), "listicle")
        .when(word_count >= 1900, "pillar")
        .otherwise("general"),
    )


def with_band(df: DataFrame) -> DataFrame:
    """Limits of each post's type: nine rows, so they are literals and nothing is joined."""
    from inkgauge.operators.structure import once

    names = dims.BAND_SCHEMA.replace("post_type string, ", "")
    fields = [f.split()[0] for f in names.split(", ")]
    rows = {k: json.dumps(dict(zip(fields, v))) for k, v in dims.BANDS.items()}
    df = once(df, band=F.from_json(F.try_element_at(literal_map(rows), F.col("post_type")), names))
    return once(df, **{f: F.col(f"band.{f}") for f in fields})


def flatten_meta(nested: Column) -> Column:
    """Nested meta object (JSON text) to a flat map: strings stay, objects give "k:k2", the rest is dropped."""
    kinds = F.coalesce(F.try_variant_get(F.try_parse_json(nested), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    entries = F.map_entries(kinds)

    def is_text(v: Column) -> Column:
        return F.schema_of_variant(v) == "STRING"

    flat = F.flatten(
        F.transform(
            entries,
            lambda e: F.when(
                is_text(e["value"]),
                F.array(F.struct(e["key"].alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value"))),
            )
            .when(
                F.startswith(F.schema_of_variant(e["value"]), F.lit("OBJECT")),
                F.transform(
                    F.filter(
                        F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>")),
                        lambda x: is_text(x["value"]),
                    ),
                    lambda x: F.struct(
                        F.concat(e["key"], F.lit(":"), x["key"]).alias("key"),
                        F.try_variant_get(x["value"], "$", "string").alias("value"),
                    ),
                ),
            )
            .otherwise(F.array().cast("array<struct<key:string,value:string>>")),
        )
    )
    from inkgauge.operators.structure import last_wins


    def described(made: Column) -> Column:
        own = F.coalesce(F.try_element_at(made, F.lit("description")), F.lit("")) != ""
        fallback = F.try_element_at(made, F.lit("og:description"))
        without = F.map_filter(made, lambda k, v: k != "description")
        return F.when(
            ~own & (F.coalesce(fallback, F.lit("")) != ""),
            F.map_concat(without, F.create_map(F.lit("description"), fallback)),
        ).otherwise(made)

    return let(last_wins(flat), described)


def post_defaults(posts: DataFrame) -> DataFrame:
    """Fill what a post may leave out: slug from its folder, brand, article body."""
    cols = posts.columns
    folder = F.element_at(F.split(F.regexp_replace("source_dir", "/+$", ""), "/"), -1) if "source_dir" in cols else F.lit(None)
    body = F.col("article_body_html") if "article_body_html" in cols else F.lit(None).cast("string")
    return posts.withColumns(
        {
            "slug": F.coalesce(F.col("slug"), folder),
            "brand": F.coalesce(F.col("brand"), F.lit("unknown")),
            "article_body_html": F.coalesce(body, F.col("html")),
        }
    )

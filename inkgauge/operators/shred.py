"""Shredding: each page becomes one row holding its elements, text runs and JSON-LD as arrays.

One narrow pass: no shuffle, and everything later is an expression over the arrays of the same row.
The raw scripts and the caller's own JSON-LD go through the same walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkgauge.operators import markup
from inkgauge.operators.picks import BLOCKS, PAGE, picked, style_blocks

ELEMENT = (
    "struct<pos:int,end_pos:int,parent_pos:int,depth:int,tag:string,attrs:map<string,string>,"
    "t0:int,t1:int,src0:int,src1:int>"
)
SCRIPT = "struct<block:int,raw:string,status:string,n0:int,n1:int>"
NODE = "struct<block:int,path:string,key:string,role:string,kind:string,keys:array<string>,type_state:string>"
ENTITY = (
    "struct<ord:int,block:int,path:string,types:array<string>,id:string,has_id:boolean,"
    "fields:array<string>,json:string>"
)
LINK = "struct<entity_ord:int,owner_type:string,field:string,ref_id:string,inline_type:string,declared:boolean>"

SHRED_FIELDS = {
    "texts": "array<string>",
    "paragraphs": "array<string>",
    "elements": f"array<{ELEMENT}>",
    "page": PAGE,
    "style_blocks": BLOCKS,
    "ld_scripts": f"array<{SCRIPT}>",
    "ld_nodes": f"array<{NODE}>",
    "ld_block_count": "int",
    "ld_entities": f"array<{ENTITY}>",
    "ld_links": f"array<{LINK}>",
}


def arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T._parse_datatype_string(ddl))


def _list_array(rows: list[list], typ: pa.ListType) -> pa.Array:
    """Build list<struct> from per-document row tuples, column by column."""
    offsets, flat = [0], []
    for doc in rows:
        flat.extend(doc)
        offsets.append(len(flat))
    struct = typ.value_type
    columns = list(zip(*flat)) if flat else [[] for _ in range(struct.num_fields)]
    arrays = [pa.array(list(col), type=struct.field(i).type) for i, col in enumerate(columns)]
    values = pa.StructArray.from_arrays(arrays, fields=[struct.field(i) for i in range(struct.num_fields)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=typ)


def _walk_page(html: str | None, own: str | None, body: str | None, elements: bool, blocks: bool) -> dict:
    walk = markup.ElementWalk(html or "")
    body_walk = walk if not body or body == html else markup.ElementWalk(body)
    out = {"paragraphs": body_walk.texts_of("p"), "page": picked(walk.rows, walk.texts), **_walk_blocks(walk.ld_scripts, own)}
    if elements:
        out |= {"texts": walk.texts, "elements": [(*row[:5], list(row[5].items()), *row[6:]) for row in walk.rows]}
    if blocks:
        out["style_blocks"] = style_blocks(walk.rows, walk.texts, html or "")
    return out


def _walk_blocks(blocks: list[str], own: str | None) -> dict:
    scripts, parsed, nodes = [], [], []
    for i, raw in enumerate(blocks):
        text, first = raw.strip(), len(nodes)
        status, value = markup.read_json(text) if text else ("empty", None)
        if status == "ok":
            parsed.append((i, value))
            nodes += markup.walk_objects(i, value)
        scripts.append((i, text, status, first, len(nodes)))
    if own:
        ok, value = markup.parse_json(own)
        if ok and isinstance(value, list) and value:
            parsed = [(i, markup.unwrap_envelope(item)) for i, item in enumerate(value)]
    entities = markup.flatten_entities(parsed)
    rows = markup.entity_rows(entities)
    declared = {row[4] for row in rows}
    return {
        "ld_scripts": scripts,
        "ld_nodes": nodes,
        "ld_block_count": len(parsed),
        "ld_entities": rows,
        "ld_links": [(*link, link[3] in declared) for link in markup.link_rows(entities)],
    }


def _arrow_columns(docs: list[dict], types: dict[str, pa.DataType]) -> list[pa.Array]:
    columns = []
    for name, typ in types.items():
        values = [d[name] for d in docs]
        if pa.types.is_list(typ) and pa.types.is_struct(typ.value_type):
            columns.append(_list_array(values, typ))
        else:
            columns.append(pa.array(values, type=typ))
    return columns


def _walked(df: DataFrame, kept: list[T.StructField], inputs: list[str | None], walk, fields: dict[str, str]) -> DataFrame:
    """Rows of ``df`` with what ``walk`` makes of the input columns of each; None stands for a column that is not there."""
    out_schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    names = [f.name for f in kept]
    types = {n: arrow_type(t) for n, t in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small slices keep the output of big pages from piling up in one batch.
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                read = [part.column(c).to_pylist() if c else [None] * part.num_rows for c in inputs]
                docs = [walk(*values) for values in zip(*read)]
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *_arrow_columns(docs, types)], names=names + list(types))

    return df.mapInArrow(run, out_schema)


def shred(
    posts: DataFrame, html: str = "html", schemas: str | None = None, keep_html: bool = False, elements: bool = True,
) -> DataFrame:
    """Add the shredded arrays to every post; the page source is dropped unless asked for.

    The checks read ``page``; without ``elements`` the arrays of all elements and text runs, the larger part, are left
    out. With the source come ``style_blocks``, the paragraphs that patches can be applied to.
    """
    if schemas is None and "schemas_json" in posts.columns:
        schemas = "schemas_json"
    body = "article_body_html" if "article_body_html" in posts.columns else None
    kept = [f for f in posts.schema.fields if keep_html or f.name not in (html, "article_body_html")]
    left_out = {"elements": elements, "texts": elements, "style_blocks": keep_html}
    fields = {n: t for n, t in SHRED_FIELDS.items() if left_out.get(n, True)}
    return _walked(posts, kept, [html, schemas, body], lambda *row: _walk_page(*row, elements, keep_html), fields)


def walk_jsonld(df: DataFrame, column: str) -> DataFrame:
    """JSON-LD arrays for a table that holds one JSON-LD text per row instead of a page."""
    fields = {n: t for n, t in SHRED_FIELDS.items() if n.startswith("ld_")}
    return _walked(df, df.schema.fields, [column], lambda text: _walk_blocks([] if text is None else [text], None), fields)


# --- expressions over the arrays of one row ---------------------------------------------------


def text_of(e: Column, texts: str = "texts", glue: str = "") -> Column:
    """Text of an element's subtree."""
    return F.array_join(F.slice(F.col(texts), e["t0"] + 1, e["t1"] - e["t0"]), glue)


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def by_tag(*tags: str) -> Column:
    return F.filter(F.col("elements"), lambda e: e["tag"].isin(*tags))


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def first_value(selected: Column, name: str) -> Column:
    """Trimmed field of the first selected entry; NULL when absent or empty."""
    from inkgauge.functions.text import js_trim

    value = js_trim(first(selected)[name])
    return F.when(value != "", value)


def ancestors(e: Column) -> Column:
    """Elements around an element, nearest first: one step up per level, however large the page."""
    shape = "struct<at:int,out:array<struct<pos:int,tag:string>>>"
    start = F.struct(e["parent_pos"].alias("at"), F.array().cast("array<struct<pos:int,tag:string>>").alias("out")).cast(shape)

    def step(acc: Column, _: Column) -> Column:
        here = F.get("elements", acc["at"])
        return F.struct(
            here["parent_pos"].alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("pos"), here["tag"].alias("tag")))).alias("out"),
        ).cast(shape)

    levels = F.when(e["depth"] > 0, F.sequence(F.lit(1), e["depth"])).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, start, step, lambda acc: acc["out"])


# --- long tables ------------------------------------------------------------------------------


def elements_table(shredded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per element, with its subtree text."""
    return shredded.select(key, "texts", F.explode("elements").alias("e")).select(
        key, "e.pos", "e.end_pos", "e.parent_pos", "e.depth", "e.tag", "e.attrs", text_of(F.col("e")).alias("text")
    )


def entities_table(shredded: DataFrame, key: str = "doc_id") -> DataFrame:
    return shredded.select(key, F.inline("ld_entities"))


def nodes_table(shredded: DataFrame, key: str = "doc_id") -> DataFrame:
    return shredded.select(key, F.inline("ld_nodes"))



"""Reading posts: directories of files, or records."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from inkgauge.operators.posts import flatten_meta, post_defaults

METADATA = (
    "struct<brand:struct<name:string,website:string>,"
    "post:struct<topic:string,slug:string,format:string,primary_keyword:string,secondary_keywords:array<string>>,"
    "quality:struct<word_count:int>>"
)
RECORD = (
    "slug string, brand struct<name:string,website:string>, html string, articleBodyHtml string, "
    "jsonLdSchemas string, metaTags string, topic string, primaryKeyword string, "
    "secondaryKeywords array<string>, format string, wordCount int"
)

FILES = {
    "metadata": "metadata.json",
    "html": "full-page.html",
    "article_body_html": "article-body.html",
    "schemas_json": "schemas.json",
    "meta_json": "meta-tags.json",
}


def read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of every matching file below a root."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    )
    return raw.select("path", F.decode("content", "UTF-8").alias("content"))


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _by_folder(files: DataFrame, value: str) -> DataFrame:
    """source_dir and for each of the wanted files the value that its row has; folders without metadata or page go."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).filter(F.col("name").isin(*FILES.values()))
    grouped = named.groupBy(folder_of(F.col("path")).alias("source_dir")).agg(
        *[F.max(F.when(F.col("name") == file, F.col(value))).alias(column) for column, file in FILES.items()]
    )
    return grouped.filter("metadata is not null and html is not null")


def assemble_posts(files: DataFrame) -> DataFrame:
    """One post per folder from (path, content) rows; folders without metadata or page are left out.

    A folder has at most five wanted files, so one grouping replaces a five-way join. The contents take part in it:
    for files in a store there is ``load_post_dirs``, which groups their names only.
    """
    return _posts_of_files(_by_folder(files, "content"))


def _posts_of_files(grouped: DataFrame) -> DataFrame:
    parsed = grouped.withColumn("m", F.from_json("metadata", METADATA))
    posts = parsed.select(
        "source_dir",
        F.col("m.post.slug").alias("slug"), F.col("m.brand.name").alias("brand"),
        F.col("m.brand.website").alias("brand_website"), "html", "article_body_html", "schemas_json",
        F.when(F.col("meta_json").isNotNull(), flatten_meta(F.col("meta_json"))).alias("meta"),
        F.col("m.post.format").alias("format"), F.col("m.post.topic").alias("topic"),
        F.col("m.post.primary_keyword").alias("primary_keyword"),
        F.coalesce("m.post.secondary_keywords", F.array().cast("array<string>")).alias("secondary_keywords"),
        F.col("m.quality.word_count").alias("word_count"),
    )
    return post_defaults(posts).withColumn("doc_id", F.col("source_dir"))


#: Stores whose files a task can open by name.
OPENED_BY_NAME = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}


def _read_text(path: str | None) -> str | None:
    from pyarrow import fs

    if path is None:
        return None
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        store, name = fs.LocalFileSystem(), "/" + unquote(quote(rest)).lstrip("/")
    else:
        store, name = fs.FileSystem.from_uri(f"{OPENED_BY_NAME[scheme]}:{quote(rest)}")
    with store.open_input_stream(name, compression=None) as f:
        return f.read().decode("utf-8", "replace")


def load_post_dirs(spark: SparkSession, root: str) -> DataFrame:
    """Posts kept as one folder of files each.

    Only names are grouped: the listing is read without contents, and the files of a folder are opened by the task
    that makes its post, so page sources never go through a shuffle. In a store whose files a task cannot open by name
    they are read by the engine and grouped with their contents.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,html}").load(root)
    scheme = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme not in OPENED_BY_NAME:
        return assemble_posts(read_files(spark, root, "*.{json,html}"))
    names = ["source_dir", *FILES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few posts at a time: pages are large beside their names.
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                read = [pa.array([_read_text(p) for p in part.column(c).to_pylist()], pa.string()) for c in FILES]
                yield pa.RecordBatch.from_arrays([part.column("source_dir"), *read], names=names)

    return _posts_of_files(_by_folder(listing.select("path"), "path").select(*names).mapInArrow(run, ", ".join(f"{n} string" for n in names)))


def posts_from_records(records: DataFrame) -> DataFrame:
    """Rows in the record shape to posts; the page key is brand and slug."""
    posts = records.select(
        F.concat_ws("/", "brand.name", "slug").alias("doc_id"), "slug", F.col("brand.name").alias("brand"),
        F.col("brand.website").alias("brand_website"), "html", F.col("articleBodyHtml").alias("article_body_html"),
        F.col("jsonLdSchemas").alias("schemas_json"),
        F.when(F.col("metaTags").isNotNull(), flatten_meta(F.col("metaTags"))).alias("meta"),
        "format", "topic", F.col("primaryKeyword").alias("primary_keyword"),
        F.coalesce("secondaryKeywords", F.array().cast("array<string>")).alias("secondary_keywords"),
        F.col("wordCount").alias("word_count"),
    )
    return post_defaults(posts)


def load_post_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Posts kept as records: JSON lines or parquet in the record schema."""
    reader = spark.read.schema(RECORD) if fmt == "json" else spark.read
    return posts_from_records(reader.format(fmt).load(path))


def parse_post_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Posts from a column of JSON records, such as a message queue delivers."""
    return posts_from_records(lines.select(F.from_json(column, RECORD).alias("r")).select("r.*"))

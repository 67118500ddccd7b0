"""Earlier audit runs: reading a report tree, writing run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkgauge.functions import text as X
from inkgauge.sources.posts import read_files

ITERATIONS = "array<struct<iteration:int,findings:array<struct<checkId:string,layer:string,severity:string,evidence:string>>>>"
REPORT = f"struct<version:int,startedAt:string,iterations:{ITERATIONS}>"
RUN_PATH = r"([^/]+)/([^/]+)/(\d{4}-\d{2}-\d{2}T[^/]*)/report\.json$"


def assemble_history(files: DataFrame) -> DataFrame:
    """Prior runs from (path, content) rows of brand/slug/time/report.json.

    Folders whose name is no time and reports that do not parse are skipped.
    """
    run = F.from_json("content", REPORT)
    rows = files.select(
        *[F.regexp_extract("path", RUN_PATH, i + 1).alias(n) for i, n in enumerate(("brand_key", "slug_key", "run_time"))],
        F.when(F.try_parse_json("content").isNotNull(), run).alias("report"),
    )
    last = F.element_at("report.iterations", -1)["findings"]
    return rows.filter((F.col("run_time") != "") & F.col("report").isNotNull()).select(
        "brand_key", "slug_key", "run_time", F.col("report.version").alias("version"),
        F.coalesce(last, F.array()).alias("findings"),
    )


def load_run_history(spark: SparkSession, root: str, brand: str | None = None, slug: str | None = None) -> DataFrame:
    """Earlier runs below a root, of one brand or one post if named.

    Kept as JSON lines in folders brand_key=/slug_key=/run_time=, the folders are partitions: all others are pruned
    before a file is opened. A plain tree of brand/slug/time/report.json is read branch by branch. Runs whose time is
    no time and reports that do not parse are skipped.
    """
    if _is_partitioned(spark, root):
        return _partitioned_history(spark, root, brand, slug)
    path = root.rstrip("/")
    for part in (brand, slug):
        if part is None:
            break
        path = f"{path}/{X.path_key_of(part)}"
    return assemble_history(read_files(spark, path, "report.json"))


def _is_partitioned(spark: SparkSession, root: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(entry.getPath().getName().startswith("brand_key=") for entry in store.listStatus(place))


def _partitioned_history(spark: SparkSession, root: str, brand: str | None, slug: str | None) -> DataFrame:
    rows = (
        spark.read.schema(f"version int, startedAt string, iterations {ITERATIONS}, _corrupt string, brand_key string, slug_key string, run_time string")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(root)
    )
    for column, wanted in (("brand_key", brand), ("slug_key", slug)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == X.path_key_of(wanted))
    last = F.element_at("iterations", -1)["findings"]
    return rows.filter(F.col("run_time").rlike(r"^\d{4}-\d{2}-\d{2}T") & F.col("_corrupt").isNull()).select(
        "brand_key", "slug_key", "run_time", "version", F.coalesce(last, F.array()).alias("findings")
    )


def load_preflight(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Findings reported from outside, one row each."""
    schema = "doc_id string, check_id string, severity string, evidence string, suggested_fix string, authority string"
    reader = spark.read.schema(schema) if fmt == "json" else spark.read
    return reader.format(fmt).load(path)


def write_run_table(df: DataFrame, path: str, batch: str, brand: str = "brand", run_date: str = "run_date") -> None:
    """Write the rows of one batch of runs by brand and date; the same batch written again replaces what it wrote.

    Only the partitions of this batch are overwritten, so a job that is tried again leaves one copy and other batches
    are not touched. The rebalance hint lets the adaptive planner split a brand that holds much of the data and merge
    small ones, so file sizes stay even and no task writes a whole brand alone.
    """
    rows = df.withColumn("batch", F.lit(batch)).hint("rebalance", brand, run_date)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", brand, run_date).parquet(path)

"""Audits of arriving posts, lineage of arriving runs, and verdict counts over time windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from inkgauge import dims
from inkgauge.plans.audit import audit, findings_table

# --- sources ----------------------------------------------------------------------------------


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files appearing below a path."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


# --- audit ------------------------------------------------------------------------------------


#: Work off what is there and stop. Jobs that run on take another trigger, such as {"processingTime": "1 minute"}.
DRAIN = {"availableNow": True}


def stream_audit(
    posts: DataFrame, out: str, checkpoint: str, key: str = "doc_id", trigger: dict = DRAIN, families: list | None = None,
) -> StreamingQuery:
    """Reports and findings of arriving posts, written below ``out``.

    The audit is stateless per post. Each micro-batch overwrites its own folder, so a batch that is
    run again after a failure leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written first and read back: both tables come from one pass over the pages.
        reports = f"{out}/reports/batch={batch_id}"
        audit(batch, key=key, families=families).write.mode("overwrite").parquet(reports)
        done = batch.sparkSession.read.parquet(reports)
        findings_table(done, key=key).write.mode("overwrite").parquet(f"{out}/findings/batch={batch_id}")

    return (
        posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


# --- lineage ----------------------------------------------------------------------------------

LINEAGE = "post string, run_id bigint, micros bigint, version int, late boolean, fixed int, unresolved int, regressed int"
_LINEAGE_NAMES = [field.split()[0] for field in LINEAGE.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A run without a time is older than all others.
NO_TIME = -(2**63)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Posts are known to the engine in so many groups, by a hash of the post. A call for state costs a task about as much as reading
#: the last runs of some hundred posts, so posts share calls: 61 a group of one million. Fixed, as a checkpoint holds posts by group.
POST_GROUPS = 2**14


class Lineage(StatefulProcessor):
    """The last run of each post: its version, its place in time and its findings in the order raised.

    The engine keeps this by group of posts and reads and writes only the groups that a batch touched.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "posts string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        last = {post: kept for post, *kept in json.loads(known[0])} if known else {}
        # Only the runs of one group in one batch; ``files_per_trigger`` of the source bounds a batch.
        arrived = [json.loads(run) for part in rows for run in part["run"]]
        arrived.sort(key=lambda r: (r["micros"], r["run_id"]))
        made = []
        for run in arrived:
            post, place, found = run.get("post"), (run["micros"], run["run_id"]), run.get("found") or []
            version, micros, run_id, previous = last.get(post, (0, None, None, []))
            if version and place <= (micros, run_id):
                made.append((post, run["run_id"], run["micros"], None, True, None, None, None))
                continue
            now = dict(found)  # of a check raised repeatedly the last one counts
            # Above zero where a check has become worse.
            steps = [dims.SEVERITY_RANK[now[check]] - dims.SEVERITY_RANK[was] for check, was in previous if check in now]
            worse = sum(step > 0 for step in steps)
            made.append((post, run["run_id"], run["micros"], version + 1, False, len(previous) - len(steps), len(steps) - worse, worse))
            last[post] = (version + 1, *place, found)
        self.last.update((json.dumps([(post, *kept) for post, kept in last.items()], separators=(",", ":")),))
        # As objects: whole numbers beside nulls stay whole numbers.
        yield pd.DataFrame(made, columns=_LINEAGE_NAMES, dtype=object)

    def close(self) -> None:
        pass


def stream_lineage(runs: DataFrame, out: str, checkpoint: str, trigger: dict = DRAIN) -> StreamingQuery:
    """Version and prior-issue counts of each arriving run; late runs go to a folder of their own.

    ``runs``: post, run_id, started, findings array<struct<check_id, severity>> in the order raised. A run that is not
    newer than the last known one of its post is late and has no version. Output folders carry the batch number: a
    repeated batch overwrites its own.
    """
    spark = runs.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        made = f"{out}/rows/batch={batch_id}"
        batch.withColumn("started", F.when(F.col("micros") != NO_TIME, F.timestamp_micros("micros"))).write.mode("overwrite").parquet(made)
        batch.sparkSession.read.schema(LINEAGE).parquet(made).filter("late").write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")

    # A run goes to Python as one text and a group as one table: cells and groups are what costs there.
    found = F.transform("findings", lambda x: F.array(x["check_id"], x["severity"])).alias("found")
    run = F.struct("post", "run_id", F.coalesce(F.unix_micros("started"), F.lit(NO_TIME)).alias("micros"), found)
    grouped = runs.select(F.pmod(F.xxhash64("post"), F.lit(POST_GROUPS)).cast("int").alias("group"), F.to_json(run).alias("run"))
    rows = grouped.groupBy("group").transformWithStateInPandas(Lineage(), LINEAGE, "Append", "None")
    # A query keeps the settings that hold when it starts: keyed state needs the RocksDB store, other queries need not.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


# --- windows ----------------------------------------------------------------------------------


def verdict_windows(rows: DataFrame, delay: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts per verdict and event-time window. ``rows``: ts, verdict, score."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        rows.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "verdict")
        .agg(F.count("*").alias("n"), F.sum("score").alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "verdict", "n", "total")
    )


def revision_sessions(rows: DataFrame, delay: str, gap: str) -> DataFrame:
    """Bursts of revisions of a post: a session ends after ``gap`` without one. ``rows``: ts, post."""
    return (
        rows.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "post")
        .agg(F.count("*").alias("revisions"))
        .select("post", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "revisions")
    )


def start_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", trigger: dict = DRAIN) -> StreamingQuery:
    """A stream written to parquet."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is available into parquet and stop."""
    start_to_parquet(stream, out, checkpoint, mode).awaitTermination()

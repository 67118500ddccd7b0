"""Registered streaming queries: each drains a stream derived from the tables and returns its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkgauge.plans.catalog_audit import STREAM_SQL
from inkgauge.plans.fixtures import fixture, table, with_fixtures
from inkgauge.session import fresh_path
from inkgauge.streaming import jobs

QUERIES: dict = {}


def staged(spark, df: DataFrame, label: str) -> DataFrame:
    """A stream over a copy of the input in the shared folder."""
    path = fresh_path(spark, f"{label}-in")
    df.write.parquet(path)
    return jobs.read_stream(spark, path, df.schema)


def audited(spark, sf) -> DataFrame:
    stream = staged(spark, fixture(spark, sf, "synth_pages").drop("jsonld"), "audit")
    out = fresh_path(spark, "audit-out")
    jobs.stream_audit(stream, out, fresh_path(spark, "audit-cp")).awaitTermination()
    return spark.read.parquet(f"{out}/reports").select("doc_id", "overall", "critical_count", "verdict")


QUERIES["stream_audit"] = (audited, STREAM_SQL)


#: Runs arrive in three batches by year; every ninth run of the first one comes with the last and may be late.
_ARRIVAL = "case when year(started) < 1995 then case when run_id % 9 = 0 then 3 else 1 end when year(started) < 1997 then 2 else 3 end"


def lineage(spark, sf) -> DataFrame:
    found = fixture(spark, sf, "synth_findings").groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "check_id", "severity"))).alias("f")
    )
    runs = fixture(spark, sf, "synth_runs").join(found, "run_id", "left").select(
        F.col("slug_id").cast("string").alias("post"), "run_id", F.col("started").cast("timestamp").alias("started"),
        F.coalesce(
            F.transform("f", lambda x: F.struct(x["check_id"].alias("check_id"), x["severity"].alias("severity"))),
            F.array().cast("array<struct<check_id:string,severity:string>>"),
        ).alias("findings"), F.expr(_ARRIVAL).alias("arrival"),
    )
    staged_at, source, out, checkpoint = (fresh_path(spark, f"lineage-{x}") for x in ("runs", "in", "out", "cp"))
    runs.write.parquet(staged_at)
    runs = spark.read.parquet(staged_at)
    for n in (1, 2, 3):
        # The stream is stopped and started between batches: what it knows of the posts comes from its checkpoint.
        arriving = runs.filter(F.col("arrival") == n).drop("arrival")
        arriving.write.mode("append").parquet(source)
        jobs.stream_lineage(jobs.read_stream(spark, source, arriving.schema), out, checkpoint).awaitTermination()
    return spark.read.schema(jobs.LINEAGE).parquet(f"{out}/rows").select("run_id", "late", "version", "fixed", "unresolved", "regressed")


def _lineage_sql() -> str:
    from inkgauge.plans.catalog_runs import DIFF

    names = "synth_findings synth_runs"
    # Late: a run of the same post that is newer came in an earlier batch.
    arrived = f"""WITH numbered AS (SELECT *, {_ARRIVAL} AS arrival, row_number() over (partition by slug_id order by started, run_id) AS rn FROM synth_runs),
      seen AS (SELECT *, coalesce(max(rn) over (partition by slug_id order by arrival range between unbounded preceding and 1 preceding), 0) > rn AS late FROM numbered),
      on_time AS (SELECT * FROM seen WHERE NOT late)"""
    diff = DIFF.replace("synth_runs", "on_time")
    return with_fixtures(
        names,
        f"{arrived}, {diff} SELECT s.run_id, s.late, cast(v.version as int) AS version, case when not s.late then coalesce(fixed, 0) end AS fixed, "
        "case when not s.late then coalesce(unresolved, 0) end AS unresolved, case when not s.late then coalesce(regressed, 0) end AS regressed "
        "FROM seen s LEFT JOIN (SELECT run_id, row_number() over (partition by slug_id order by started, run_id) AS version FROM on_time) v ON v.run_id = s.run_id "
        "LEFT JOIN counts ON counts.run_id = s.run_id",
    )


QUERIES["stream_lineage"] = (lineage, _lineage_sql())

# Events as verdicts: the type decides, the value is the score.
_VERDICT = "case event_type when 'error' then 'block' when 'purchase' then 'ship' else 'edit' end"


def verdict_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.expr(_VERDICT).alias("verdict"), F.floor("value").alias("score"),
        F.col("user_id").alias("post"),
    )


def windows(slide: str | None):
    def run(spark, sf) -> DataFrame:
        stream = staged(spark, verdict_events(spark, sf), "windows")
        out = fresh_path(spark, "windows-out")
        jobs.run_to_parquet(jobs.verdict_windows(stream, "1 hour", "1 day", slide), out, fresh_path(spark, "windows-cp"))
        return spark.read.parquet(out).select(
            F.unix_timestamp("start").alias("start_s"), "verdict", "n", "total"
        )

    return run


def _windows_sql(step: int, width: int = 86400) -> str:
    """Closed windows only: those that end no later than the last time seen minus the delay."""
    return f"""WITH e AS (SELECT ts, epoch_us(ts) AS us, {_VERDICT} AS verdict, floor(value) AS score FROM events),
      w AS (SELECT unnest(range(cast(floor(us / 1e6 / {step}) as bigint) * {step} - {width} + {step}, cast(floor(us / 1e6 / {step}) as bigint) * {step} + 1, {step})) AS start_s, verdict, score FROM e)
      SELECT start_s, verdict, count(*) AS n, cast(sum(score) as bigint) AS total FROM w WHERE start_s + {width} <= (SELECT max(us) / 1e6 - 3600 FROM e) GROUP BY start_s, verdict"""


QUERIES["stream_verdict_windows"] = (windows(None), _windows_sql(86400))
QUERIES["stream_verdict_windows_sliding"] = (windows("6 hours"), _windows_sql(21600))


def sessions(spark, sf) -> DataFrame:
    stream = staged(spark, verdict_events(spark, sf), "sessions")
    out = fresh_path(spark, "sessions-out")
    jobs.run_to_parquet(jobs.revision_sessions(stream, "1 hour", "30 minutes"), out, fresh_path(spark, "sessions-cp"))
    return spark.read.parquet(out).select("post", F.unix_micros("start").alias("start_us"), "revisions")


QUERIES["stream_revision_sessions"] = (
    sessions,
    """WITH e AS (SELECT user_id AS post, epoch_us(ts) AS us FROM events), g AS (SELECT *, case when us - lag(us) over (partition by post order by us) < 1800000000 then 0 else 1 end AS fresh FROM e),
      s AS (SELECT post, us, sum(fresh) over (partition by post order by us rows unbounded preceding) AS sid FROM g),
      b AS (SELECT post, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS revisions FROM s GROUP BY post, sid)
      SELECT post, start_us, revisions FROM b WHERE end_us <= (SELECT max(us) - 3600000000 FROM e)""",
)

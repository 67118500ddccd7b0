"""Scores, lineage, sources, patches and streams on small inputs."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators import findings as fnd, lineage as li, remedy as rm, scoring as sc
from inkgauge.plans.audit import audit, judged, prepare, detect, score
from inkgauge.plans.fixtures import fixture
from inkgauge.plans.rounds import audit_rounds
from inkgauge.sources import posts as src, runs as src_runs
from inkgauge.streaming import jobs


def found(spark, severities):
    rows = [(1, i, f"C{i}", layer, s) for i, (layer, s) in enumerate(severities)]
    return spark.createDataFrame(rows, "doc_id int, ord int, check_id string, layer string, severity string")


GOLDEN = (
    [("technical", "critical")] * 1 + [("eeat", "critical")] * 1 + [("technical", "fail")] * 4 + [("eeat", "fail")] * 2
    + [("technical", "warn")] * 5 + [("eeat", "warn")] * 2 + [("humanization", "warn")] + [("humanization", "fail")]
)


def test_known_scores(spark):
    f = found(spark, GOLDEN)
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    tech = {r[0]: r[1] for r in sc.score_technical(f, docs, ["doc_id"]).collect()}
    human = {r[0]: r[1] for r in sc.score_humanization_signals(f, docs, ["doc_id"]).collect()}
    assert tech == {1: 0, 2: 100} and human == {1: 79, 2: 100}
    scores = spark.createDataFrame([(1, 0, 79, 70)], "doc_id int, t int, h int, q int").select(
        "doc_id", sc.overall(F.col("t"), F.col("h"), F.col("q")).alias("overall")
    )
    row = sc.derive_verdict(f, scores, ["doc_id"]).first()
    assert (row["overall"], row["verdict"], row["critical_count"]) == (49, "block", 2)


def test_more_findings_never_raise_a_score(spark):
    rng = random.Random(5)
    seen = [(rng.choice(["technical", "eeat"]), rng.choice(list(dims.SEVERITY_RANK))) for _ in range(12)]
    docs = spark.createDataFrame([(1,)], "doc_id int")
    scores = [sc.score_technical(found(spark, seen[:n]), docs, ["doc_id"]).first()["technical"] for n in (1, 4, 8, 12)]
    assert scores == sorted(scores, reverse=True)


def test_diff_with_itself(spark):
    f = found(spark, GOLDEN)
    assert {r["status"] for r in li.prior_diff(f, f, ["doc_id"]).collect()} == {"still_present"}
    assert li.new_issues(f, f, ["doc_id"]).count() == 0


def test_numbering_matches_a_plain_window_on_a_hot_post(spark):
    rows = [(("hot" if i % 3 else f"p{i}"), i, f"2026-01-{1 + i % 28:02d} 00:00:{i % 60:02d}") for i in range(600)]
    df = spark.createDataFrame(rows, "post string, run_id int, t string").withColumn("started", F.col("t").cast("timestamp"))
    from pyspark.sql import Window

    made = li.version_lineage(df, ["post"], "started", "run_id")
    w = Window.partitionBy("post").orderBy("started", "run_id")
    wrong = made.withColumn("plain", F.row_number().over(w)).filter("plain <> version")
    assert made.count() == 600 and wrong.count() == 0
    chain = {r[0]: r[1] for r in li.next_runs(df, ["post"], "started", "run_id").collect()}
    plain = df.select("run_id", F.lead("run_id").over(w).alias("n")).filter("n is not null").collect()
    assert chain == {r[0]: r[1] for r in plain}


def test_rollup_totals(spark):
    df = spark.createDataFrame([("a", "faq", 80, "edit"), ("a", "pillar", 95, "ship"), ("b", "faq", 10, "block")], "brand string, post_type string, final_score int, verdict string")
    total = sc.corpus_rollup(df).filter("level = 3").first()
    assert (total["audits"], total["ship"], total["edit"], total["block"]) == (3, 1, 1, 1)


# --- sources ----------------------------------------------------------------------------------


def write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content, encoding="utf-8")


def test_post_dirs(spark, tmp_path):
    write(tmp_path / "one", "metadata.json", json.dumps({"brand": {"name": "Acme"}, "post": {"topic": "T", "primary_keyword": "k"}}))
    write(tmp_path / "one", "full-page.html", "<p>é</p>")
    write(tmp_path / "one", "meta-tags.json", json.dumps({"og": {"title": "O", "n": 1}, "x": None}))
    write(tmp_path / "one", "schemas.json", '[{"schema": {"@type": "FAQPage"}}]')
    write(tmp_path / "two", "full-page.html", "<p>no metadata</p>")
    rows = src.load_post_dirs(spark, str(tmp_path)).collect()
    assert [(r["slug"], r["brand"], r["html"], r["meta"]) for r in rows] == [("one", "Acme", "<p>é</p>", {"og:title": "O"})]
    typed = prepare(src.load_post_dirs(spark, str(tmp_path))).select("post_type", "ld_block_count").first()
    assert typed["ld_block_count"] == 1


def test_post_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"slug": "s", "brand": {"name": "A"}, "html": "<p>x</p>", "metaTags": {"title": "T"}, "jsonLdSchemas": [{"@type": "HowTo"}]}))
    row = src.load_post_records(spark, str(tmp_path / "r.json")).first()
    assert row["doc_id"] == "A/s" and row["meta"] == {"title": "T"} and "HowTo" in row["schemas_json"]


def test_history_tree(spark, tmp_path):
    base = tmp_path / "acme" / "post-1"
    report = {"version": 1, "iterations": [{"iteration": 0, "findings": []}, {"iteration": 1, "findings": [{"checkId": "C", "severity": "warn"}]}]}
    write(base / "2026-04-22T10-53-06-161Z", "report.json", json.dumps(report))
    write(base / "2026-04-22T11-00-00-000Z", "report.json", "{broken")
    write(base / "latest", "report.json", json.dumps(report))
    rows = src_runs.load_run_history(spark, str(tmp_path), "Acme", "Post 1").collect()
    assert [(r["run_time"], r["findings"][0]["checkId"]) for r in rows] == [("2026-04-22T10-53-06-161Z", "C")]


# --- patches ----------------------------------------------------------------------------------


def test_span_patches_are_literal_and_exact(spark):
    patches = [("a.b", "$&"), ("twice", "x"), ("gone", "y"), ("", "z"), ("$&", "done")]
    made = F.array(*[rm.patch("replace_span", b, b, a, "") for b, a in patches])
    df = spark.createDataFrame([("<body>a.b twice twice aXb</body>",)], "html string")
    row = df.select(rm.apply_spans(made, F.col("html"), F.lit("")).alias("r")).first()["r"]
    assert row["html"] == "<body>done twice twice aXb</body>"
    assert [e["ok"] for e in row["log"]] == [True, False, False, False, True]


def test_unique_fragment(spark):
    df = spark.createDataFrame([("left cat and dog, then right cat ends",)], "t string")
    row = df.select(rm.unique_fragment(F.lit("cat"), F.col("t")).alias("w")).first()["w"]
    assert row["before"].startswith("left cat") and row["prefix"] == "left "
    assert df.select(rm.unique_fragment(F.lit("cow"), F.col("t")).alias("w")).first()["w"] is None


def test_judge_findings_enter_the_report(spark):
    posts = spark.createDataFrame([(1, "<html><body><p>Old text here.</p></body></html>"), (2, "<p>x</p>")], "doc_id int, html string")
    answer = '{"axes": [{"name": "Point Of View", "score": 3, "worst_sentence": "Old text here.", "suggested_rewrite": "New", "reason": "r"}]}'
    judgements = spark.createDataFrame([(1, "humanization", answer), (1, "quality", "nothing")], "doc_id int, judge string, answer string")
    rows = {r["doc_id"]: r for r in audit(posts, judgements=judgements).collect()}
    ids = [f["check_id"] for f in rows[1]["found"]]
    assert "H_judge_point_of_view" in ids and "Q_parse_error" in ids
    assert rows[1]["humanization"] < rows[2]["humanization"] and rows[1]["quality"] == rows[2]["quality"] == 70
    base = score(judged(detect(prepare(posts)), judgements)).filter("doc_id = 1").first()
    assert base["human_judge_score"] == 30


SOUND = (
    '<html><head><title>A title that is long enough to pass here</title><link rel="canonical" href="https://s.example/p"><meta name="viewport" content="w">'
    '<script type="application/ld+json">{"@graph": [{"@type": "BlogPosting", "headline": "H"}, {"@type": "Person", "name": "Ada", "sameAs": ["https://linkedin.com/in/a", "https://a.example"]}]}</script></head>'
    '<body><h1>x</h1><p>We measured it. A robust plan held.</p><img src="/c.png" alt="chart"><a href="https://1.example">1</a><a href="https://2.example">2</a><a href="https://3.example">3</a></body></html>'
)


def test_rounds_patch_until_nothing_is_left(spark):
    posts = spark.createDataFrame([(1, "A", "s", SOUND), (2, "A", "t", "<p>bare</p>")], "doc_id int, brand string, slug string, html string")
    rewrites = spark.createDataFrame([(1, "sentence", "A robust plan held.", "The plan held up well.")], "doc_id int, kind string, before string, after string")
    rows = audit_rounds(posts, rewrites=rewrites, today="2026-04-30").orderBy("doc_id", "iteration").collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert [r["stop_reason"] for r in rows if r["doc_id"] == 2] == ["unfixable_critical"]
    assert one[0]["stop_reason"] is None and one[-1]["stop_reason"] == "no_patches"
    assert one[-1]["overall"] > one[0]["overall"] and one[0]["applied"] == one[0]["planned"]
    assert "H_banned_vocabulary" in [f["check_id"] for f in one[0]["found"]]
    assert "H_banned_vocabulary" not in [f["check_id"] for f in one[-1]["found"]]


def test_rounds_change_page_and_body_and_heed_outside_criticals(spark):
    body = "<p>We measured it. A robust plan held.</p>"
    posts = spark.createDataFrame([(1, SOUND, body), (2, SOUND, body), (3, "<!-- <body> --><p>A robust plan held.</p>", None)], "doc_id int, html string, article_body_html string")
    rewrites = spark.createDataFrame([(i, "sentence", "A robust plan held.", "The plan held up well.") for i in (1, 2, 3)], "doc_id int, kind string, before string, after string")
    outside = spark.createDataFrame([(2, "other:X", "critical", "e"), (1, "other:Y", "warn", "e")], "doc_id int, check_id string, severity string, evidence string")
    rows = audit_rounds(posts, rewrites=rewrites, preflight=outside, today="2026-04-30").orderBy("doc_id", "iteration").collect()
    one, two, three = ([r for r in rows if r["doc_id"] == i] for i in (1, 2, 3))
    assert "H_banned_vocabulary" in [f["check_id"] for f in one[0]["found"]]
    assert "H_banned_vocabulary" not in [f["check_id"] for f in one[-1]["found"]] and one[-1]["stop_reason"] == "no_patches"
    assert (one[-1]["status"], one[0]["status"]) == ("stalled", "open")
    assert [(r["stop_reason"], r["status"], r["verdict"]) for r in two] == [("unfixable_critical", "escalated", "block")]
    assert three[0]["applied"] == 0 and {e["reason"] for e in three[0]["patch_log"]} == {"page without a body element"}


def test_rounds_hand_pages_to_python_in_small_batches(spark):
    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([b.num_rows] * b.num_rows, pa.int32())], names=[*b.schema.names, "rows_at_once"])

    family = fnd.Family(
        "batches", lambda df: df.mapInArrow(counted, T.StructType([*df.schema.fields, T.StructField("rows_at_once", T.IntegerType())])),
        lambda: fnd.collect(fnd.finding("X_batch", "technical", "info", "static", F.col("rows_at_once").cast("string"))),
    )
    pages = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("b").alias("brand"), F.lit("s").alias("slug"), F.lit("<html><body><p>x</p></body></html>").alias("html"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = audit_rounds(pages, families=[family], max_rounds=0, today="2026-04-30").select(F.get("found.evidence", F.lit(0)).cast("int").alias("n"))
    assert seen.agg(F.count("*"), F.max("n")).first()[:] == (1500, 256)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_schema_inserts_of_more_pages_than_are_held_at_once(spark):
    html = F.concat(F.lit('<html><head><script type="application/ld+json">{"@type": "BlogPosting", "n": '), F.col("id"), F.lit("}</script></head><body></body></html>"))
    todo = F.array(rm.patch("insert_schema", "BlogPosting.image", "undefined", '"/i.png"', "test"), rm.patch("insert_schema", "add:Thing", "", "no object", "test"))
    df = spark.range(0, 150, 1, 1).select("id", html.alias("html"), todo.alias("schema_patches"))
    rows = rm.apply_schema_inserts(df).orderBy("id").collect()
    assert [json.loads(r["html"].split(">")[3].split("<")[0]) for r in rows] == [{"@type": "BlogPosting", "n": i, "image": "/i.png"} for i in range(150)]
    assert {tuple((e["ok"], e["reason"]) for e in r["schema_log"]) for r in rows} == {((True, None), (False, "not a JSON object"))}


def test_json_ld_texts_of_one_row_group_are_dealt_out(spark, tmp_path):
    for name in ("customer", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = fixture(spark, str(tmp_path), "synth_jsonld").groupBy(F.spark_partition_id()).count()
    n, most, total = rows.agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert n == 4 * spark.sparkContext.defaultParallelism and most <= 2 * total / n


def test_findings_are_dealt_into_the_parts_asked_for(spark):
    found = spark.range(2000).select((F.col("id") % 50).alias("run_id"), F.col("id").alias("ord"), F.concat(F.lit("C"), F.col("id") % 7).alias("check_id"), F.lit("warn").alias("severity"))
    plain, split = li.fix_order(found, ["run_id"], 10), li.fix_order(found, ["run_id"], 10, parts=37)
    assert split.rdd.getNumPartitions() == 37 and sorted(split.collect()) == sorted(plain.select(*split.columns).collect())
    plain, split = li.prior_diff(found, found, ["run_id"]), li.prior_diff(found, found, ["run_id"], parts=37)
    assert split.rdd.getNumPartitions() == 37 and sorted(split.collect()) == sorted(plain.collect())


def test_audit_with_preflight_walks_the_pages_once(spark):
    from inkgauge.plans.catalog_audit import preflight_audit

    # Scores and rows read what was written: no page is walked in what is left of the plan.
    assert "MapInArrow" not in preflight_audit(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_sentence_search_reads_long_runs_once(spark):
    text = "x" * 1_000_000 + " A robust plan held. Next one."
    df = spark.createDataFrame([(text,), ("No. It is robust\nstill. Very ROBUST now! End",), ("none",)], "t string")
    start = time.time()
    got = [r["s"] for r in df.select(rm.sentence_around(F.col("t"), F.lit(r"\brobust\b")).alias("s")).collect()]
    assert time.time() - start < 30
    assert got[0] == "x" * 1_000_000 + " A robust plan held." and got[1:] == ["Very ROBUST now!", ""]


# --- streams ----------------------------------------------------------------------------------


def test_stream_lineage_over_batches(spark, tmp_path):
    schema = "post string, run_id long, started timestamp, findings array<struct<check_id:string,severity:string>>"

    def arrive(n, rows):
        df = spark.createDataFrame([(p, i, None, f) for p, i, _, f in rows], schema).drop("started")
        times = spark.createDataFrame([(i, t) for _, i, t, _ in rows], "run_id long, t string")
        made = df.join(times, "run_id").select("post", "run_id", F.col("t").cast("timestamp").alias("started"), "findings")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def drain():
        stream = jobs.read_stream(spark, str(tmp_path / "in"), schema)
        jobs.stream_lineage(stream, out, cp).awaitTermination()

    arrive(0, [("a", 1, "2026-01-01", [("C1", "warn"), ("C2", "fail")]), ("a", 2, "2026-01-02", [("C1", "fail")])])
    drain()
    arrive(1, [("a", 4, "2026-01-04", [("C1", "fail"), ("C3", "info")]), ("a", 3, "2026-01-01", []), ("b", 9, "2026-01-09", [])])
    drain()
    rows = {r["run_id"]: r for r in spark.read.parquet(f"{out}/rows").collect()}
    assert (rows[2]["version"], rows[2]["fixed"], rows[2]["regressed"]) == (2, 1, 1)
    assert (rows[4]["version"], rows[4]["unresolved"], rows[4]["fixed"]) == (3, 1, 0)
    assert rows[3]["late"] and rows[3]["version"] is None and rows[9]["version"] == 1
    assert [r["run_id"] for r in spark.read.parquet(f"{out}/late").collect()] == [3]


def test_lineage_of_many_posts_shares_state(spark, tmp_path, monkeypatch):
    # Posts share the calls for state: the engine holds as many values as there are groups, not one a post.
    monkeypatch.setattr(jobs, "POST_GROUPS", 8, raising=False)
    rank, rng = jobs.dims.SEVERITY_RANK, random.Random(7)
    schema = "post string, run_id long, started timestamp, findings array<struct<check_id:string,severity:string>>"
    names, big = [None, "null", 'a "b",\n[é', *(f"p{i}" for i in range(60))], 2**53 + 1
    known, expected, held = {}, [], []
    for batch in range(3):
        runs = []
        for i in range(400):
            found = [(rng.choice(["C1", "C2", 'C"3', None]), rng.choice(list(rank))) for _ in range(rng.randrange(5))]
            # Every fifth run has the id of the one before.
            runs.append((rng.choice(names), big + batch * 400 + i - i % 5 // 4, rng.choice([None, *range(9)]), rng.choice([found, found, None])))
        spark.createDataFrame(runs, "post string, run_id long, t long, findings array<struct<check_id:string,severity:string>>").select(
            "post", "run_id", F.timestamp_micros(F.col("t")).alias("started"), "findings"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for post, run_id, t, found in sorted(runs, key=lambda r: (jobs.NO_TIME if r[2] is None else r[2], r[1])):
            place = (jobs.NO_TIME if t is None else t, run_id)
            version, at, previous = known.get(post, (0, None, []))
            if at is not None and place <= at:
                expected.append((post, run_id, place[0], None, True, None, None, None))
                continue
            now = dict(found or [])
            fixed = sum(check not in now for check, _ in previous)
            worse = sum(check in now and rank[now[check]] > rank[was] for check, was in previous)
            expected.append((post, run_id, place[0], version + 1, False, fixed, len(previous) - fixed - worse, worse))
            known[post] = (version + 1, place, found or [])
        stream = jobs.stream_lineage(jobs.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        stream.awaitTermination()
        held.append(stream.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.schema(jobs.LINEAGE).parquet(str(tmp_path / "out" / "rows")).drop("batch").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected)) and any(r["late"] for r in got)
    assert held[-1] == 8 < len(names)


def test_outside_codes_of_other_sources_pass_through(spark):
    own = spark.createDataFrame([(1, "S_h2_question_ratio_low")], "doc_id int, check_id string")
    outside = spark.createDataFrame([(1, "other:B2", "warn", "e")], "doc_id int, check_id string, severity string, evidence string")
    assert li.reconcile_preflight(own, outside, ["doc_id"])["adjudication"].count() == 0
    assert li.reconcile_preflight(own, outside, ["doc_id"], source="other")["adjudication"].count() == 1


def test_long_keys_stay_apart(spark):
    long = "a" * 90
    df = spark.createDataFrame([(long + "1",), (long + "2",), ("Short Key",)], "k string")
    keys = [r["p"] for r in df.select(X.path_key(F.col("k")).alias("p")).collect()]
    assert len(set(keys)) == 3 and keys[2] == "short-key" and keys == [X.path_key_of(k) for k in (long + "1", long + "2", "Short Key")]


@pytest.mark.parametrize("code,confirmed", [("tool:B2", True), ("tool:F7", False)])
def test_witnesses(spark, code, confirmed):
    own = spark.createDataFrame([(1, "S_h2_question_ratio_low")], "doc_id int, check_id string")
    outside = spark.createDataFrame([(1, code, "warn", "e"), (1, "tool:X1", "warn", "e")], "doc_id int, check_id string, severity string, evidence string")
    made = li.reconcile_preflight(own, outside, ["doc_id"], source="tool")
    rows = made["adjudication"].collect()
    assert [(r["check_id"], r["confirmed"]) for r in rows] == [(code, confirmed)]
    assert made["findings"].count() == 2


def test_history_partitions_are_pruned(spark, tmp_path):
    line = '{"version": 2, "iterations": [{"iteration": 0, "findings": [{"checkId": "C", "severity": "warn"}]}]}'
    rows = [(line, "acme", "p1", "2026-01-01T00"), ("{broken", "acme", "p1", "2026-01-02T00"), (line, "acme", "p2", "draft"), (line, "other", "p1", "2026-01-01T00")]
    spark.createDataFrame(rows, "value string, brand_key string, slug_key string, run_time string").write.partitionBy("brand_key", "slug_key", "run_time").text(str(tmp_path / "h"))
    df = src_runs.load_run_history(spark, str(tmp_path / "h"), "Acme")
    assert [(r["slug_key"], r["version"], r["findings"][0]["checkId"]) for r in df.collect()] == [("p1", 2, "C")]
    scan = next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "brand_key" in scan.split("PartitionFilters:")[1].split("]")[0]


def test_run_tables_written_again_leave_one_copy(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2026-01"), (2, "a", "2026-02"), (3, "b", "2026-01")], "doc_id int, brand string, run_date string")
    path = str(tmp_path / "t")
    for batch, part in (("x", rows), ("y", rows.filter("doc_id = 1")), ("x", rows), ("y", rows.filter("doc_id = 1"))):
        src_runs.write_run_table(part, path, batch)
    got = sorted((r["batch"], r["doc_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("x", 1), ("x", 2), ("x", 3), ("y", 1)]


def test_whole_run_of_two_posts(spark):
    from inkgauge.plans.run import full_run

    pages = [(1, "Acme", "one", "<body><article><p>It was robust — and we delve — into a myriad of things here.</p></article></body>"), (2, None, None, None)]
    posts = spark.createDataFrame(pages, "doc_id bigint, brand string, slug string, html string")
    alone = full_run(posts, "2026-01-01T00:00:00Z")
    assert {(r["doc_id"], r["version"], r["iterations"], r["fixed"]) for r in alone.reports.collect()} == {(1, 1, 1, 0), (2, 1, 1, 0)}
    assert alone.adjudication is None and alone.final.count() == 0 and alone.instructions.count() == 2
    prior = spark.createDataFrame([(1, 0, "A4_canonical_tag", "warn"), (1, 1, "X", "fail")], "doc_id bigint, ord int, check_id string, severity string")
    runs = spark.createDataFrame([(1, "2025-01-01T00:00:00Z"), (1, "2025-02-01T00:00:00Z")], "doc_id bigint, started_at string")
    outside = spark.createDataFrame([(1, "writer:F2", "critical", "e"), (1, "writer:zz", "warn", "e")], "doc_id bigint, check_id string, severity string, evidence string")
    run = full_run(posts, "2026-01-01T00:00:00Z", runs, prior, outside)
    one = run.reports.filter("doc_id = 1").first()
    assert (one["version"], one["is_final"], one["fixed"], one["unresolved"], one["regressed"], one["verdict"]) == (3, True, 1, 0, 1, "block")
    import json

    record = json.loads(run.final.first()["summary"])
    assert record["version_history"] == ["2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z", "2026-01-01T00:00:00Z"] and record["paragraph_metrics"][0]["em_dashes"] == 2
    payload = json.loads(run.instructions.filter("doc_id = 1").first()["payload"])
    dash = [i for i in payload["instructions"] if i["check_id"] == "H_em_dash_overuse"]
    assert [i["evidence"].endswith("; paragraph 1 of 1") for i in dash] == [True] and dash[0]["action"] == "apply_patch"
    assert payload["fix_order"][0] in {i["check_id"] for i in payload["instructions"] if i["severity"] == "critical"}
    assert [r["check_id"] for r in payload["regressions"]] == ["A4_canonical_tag"] and payload["meta"]["next_version"] == 4
    assert [(r["check_id"], r["confirmed"]) for r in run.adjudication.collect()] == [("writer:F2", True)]

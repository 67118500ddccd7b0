"""Web archive records: what "not modified" answers stand for.

A revisit record says that a page was asked for again and had not changed. It is resolved by the latest earlier full
response to the same address (an as-of join on the canonical URL), if the validators agree: entity tags when both
have one (weak tags compare by their opaque part), else dates of last modification when both have one. Without a
common validator nothing speaks against it: it is resolved as unchecked. A record whose profile says that the payload
was identical is held against the payload digests instead. The result has the response's payload and
headers, with those headers of the revisit that may update a stored response.

The as-of join has two levels, so that one address with a large share of all captures is no single task: the
latest response of each (address, hour) is handed on through the hours of an address, and only captures of one hour
are put in order together.

Defined cases: a null or unusable address matches nothing (``no_response``); a null date too; of responses at the
same instant the one with the largest record id counts (null is the smallest; among equal ids the contents decide), and
a response at the revisit's own instant is not earlier; record ids are only handed through: repeated or null ones are
captures of their own; header names are compared in lower case, a repeated name keeps its last value; repeated rows are
rows of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.binding import let
from inkgauge.llm.common import stage

#: Fields that an answer of "not modified" must not change in what is stored (hop by hop, or about the body).
NOT_UPDATED = [
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
    "content-length", "content-encoding", "content-type", "content-range", "content-md5",
]
HOUR = 3600


def canonical_url(url: Column) -> Column:
    """Host in lower case without "www." and default port, path without last slash, sorted query without tracking
    parameters; scheme and fragment do not count. Null if there is no host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_extract(bare, r"^(?i:https?)://(?:[^/?@]*@)?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), ":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def header_map(block: Column) -> Column:
    """Lines of "Name: value" as a map with names in lower case; the last of a repeated name counts."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x, i: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"), i.alias("at"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    # In order of names, the last line of each name stands before another name or the end.
    last = lambda p: F.filter(p, lambda x, i: ~x["name"].eqNullSafe(F.get(p, i + 1)["name"]))
    entries = F.transform(let(F.array_sort(pairs), last), lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))
    return F.map_from_entries(entries)


def parse_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Whole records as text: record_id, kind, url, date, profile, digest, headers (of the answer), payload."""
    text = F.col(column)
    envelope = header_map(F.regexp_extract(text, r"(?s)^WARC/[0-9.]+\r\n(.*?)\r\n\r\n", 1))
    content = F.regexp_extract(text, r"(?s)^WARC/[0-9.]+\r\n.*?\r\n\r\n(.*)$", 1)
    rows = records.select(envelope.alias("__e"), content.alias("__c"))
    return rows.select(
        F.col("__e")["warc-record-id"].alias("record_id"), F.col("__e")["warc-type"].alias("kind"), F.col("__e")["warc-target-uri"].alias("url"),
        F.try_to_timestamp(F.col("__e")["warc-date"]).alias("date"), F.col("__e")["warc-profile"].alias("profile"), F.col("__e")["warc-payload-digest"].alias("digest"),
        header_map(F.regexp_extract("__c", r"(?s)^HTTP/[0-9.]+ [^\r\n]*\r\n(.*?)(?:\r\n\r\n|$)", 1)).alias("headers"),
        F.regexp_extract("__c", r"(?s)^HTTP/.*?\r\n\r\n(.*)$", 1).alias("payload"),
    )


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def agreement(stored: Column, later: Column) -> Column:
    """resolved, unchecked or mismatch."""
    both = lambda name: stored[name].isNotNull() & later[name].isNotNull()
    return (
        F.when(both("etag"), F.when(_opaque(stored["etag"]) == _opaque(later["etag"]), "resolved").otherwise("mismatch"))
        .when(both("last-modified"), F.when(stored["last-modified"] == later["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )


def merged_headers(stored: Column, later: Column) -> Column:
    news = F.map_filter(later, lambda k, v: ~k.isin(NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(news, k)), news)


def resolve_revisits(records: DataFrame, span: int = HOUR) -> DataFrame:
    """One row per revisit: record_id, address, status, response_id, headers, and what else responses carry.

    ``records``: record_id, kind (response or revisit), url, date, headers, and if there are any profile and digest;
    other columns are taken from the response, under the name ``response_``... where they would clash with these.
    A payload need not be among them: join it by response_id where it is wanted.
    """
    for name in ("profile", "digest"):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast("string"))
    own = ["record_id", "kind", "url", "date", "headers", "profile", "digest"]
    carried = [c for c in records.columns if c not in own]
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        canonical_url(F.col("url")).alias("address"), "date", "kind", "record_id", "headers", "profile", "digest",
        F.struct(F.lit(1).alias("__there"), *carried).alias("more"), F.floor(F.unix_micros("date") / (span * 1_000_000)).alias("span"),
    )
    # Captures go by numbers of their own from here on: record ids may be null or repeated.
    rows = stage(rows.withColumn("tie", F.xxhash64(F.to_json(F.struct("headers", "digest", "more")))).withColumn("capture", F.monotonically_increasing_id()), "captures")
    timed = rows.where(F.col("address").isNotNull() & F.col("date").isNotNull())
    key = F.struct("date", "record_id", "tie", "capture")
    # The latest response of each span of an address, then of all spans before.
    full = timed.where("kind = 'response'")
    latest = full.groupBy("address", "span").agg(F.max(key).alias("at"))
    spans = timed.where("kind = 'revisit'").select("address", "span").distinct()
    steps = spans.join(latest, ["address", "span"], "full_outer")
    before = F.last("at", ignorenulls=True).over(Window.partitionBy("address").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    handed = steps.withColumn("before", before).where("before is not null").select("address", "span", "before")
    # Within a span: the latest response before each revisit; a response at the same instant comes after it.
    order = Window.partitionBy("address", "span").orderBy("date", F.when(F.col("kind") == "revisit", 0).otherwise(1), "record_id", "tie", "capture")
    here = F.last(F.when(F.col("kind") == "response", key), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = timed.select("address", "span", "date", "kind", "record_id", "tie", "capture").withColumn("here", here).where("kind = 'revisit'")
    found = placed.join(handed, ["address", "span"], "left").select("capture", F.coalesce("here", "before")["capture"].alias("response"))
    found = stage(found.where("response is not null"), "as-of")
    # One row per response; the side of the revisits can be split where one response answers for very many.
    stored = full.select(F.col("capture").alias("response"), F.struct("record_id", "headers", "digest", "more").alias("stored"))
    asked = stage(rows.where("kind = 'revisit'").drop("more", "tie").join(found, "capture", "left"), "asked")
    matched = asked.join(stored, "response", "left")
    later = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    had = F.coalesce(F.col("stored.headers"), F.create_map().cast("map<string,string>"))
    same = F.col("stored.digest") == F.col("digest")
    by_payload = F.when(same, "resolved").when(~same, "mismatch").otherwise("unchecked")
    status = F.when(F.col("response").isNull(), "no_response").when(F.contains("profile", F.lit("identical-payload")), by_payload).otherwise(agreement(had, later))
    out = matched.withColumn("status", status)
    good = F.col("status").isin("resolved", "unchecked")
    shown = {c: f"response_{c}" if c in ("address", "status", "response_id") else c for c in carried}
    return out.select(
        "record_id", "address", "status", F.when(good, F.col("stored.record_id")).alias("response_id"),
        F.when(good, merged_headers(had, later)).otherwise(later).alias("headers"), *[F.when(good, F.col(f"stored.more.`{c}`")).alias(n) for c, n in shown.items()],
    )


def captures(pages: DataFrame) -> DataFrame:
    """Records as text, as an archive of these pages would hold them: each page was fetched once, and every other one
    asked for again a while later, or before."""
    number = F.col("page_id").cast("string")
    tag = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16)
    base = F.lit(1_700_000_000) + (F.col("page_id") * 7919 % 100_003) * 60
    day = F.concat(F.lit("day "), (F.col("page_id") % 50).cast("string"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def record(kind: str, mark: str, url: Column, seconds: Column, answer: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), line("WARC-Record-ID", F.concat(F.lit(mark), number)), line("WARC-Target-URI", url),
            line("WARC-Date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("\r\n"), answer,
        )

    full = record("response", "r", F.coalesce("url", F.lit("")), base, F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"), line("ETag", F.concat(F.lit('"'), tag, F.lit('"'))), line("Last-Modified", day),
        line("Server", F.concat(F.lit("s"), (F.col("page_id") % 3).cast("string"))),
        line("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), F.lit("\r\n"), F.coalesce("html", F.lit("")),
    ))
    given = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(
        line("ETag", F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit('W/"'), tag, F.lit('"')))))
    again = record(
        "revisit", "v", F.concat(F.coalesce("url", F.lit("")), F.when(F.instr("url", "#") > 0, F.lit("")).otherwise("#again")),
        base + ((F.col("page_id") * 31) % 5 - 1) * HOUR, F.concat(
            F.lit("HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\nConnection: close\r\nServer: s9\r\n"), given,
            F.when(F.col("page_id") % 35 == 0, F.lit("")).otherwise(line("Last-Modified", day)),
            line("Cache-Control", F.concat(F.lit("max-age="), (F.col("page_id") % 10).cast("string"))), F.lit("\r\n"),
        ))
    return pages.select(F.explode(F.when(F.col("page_id") % 2 == 0, F.array(full, again)).otherwise(F.array(full))).alias("record"))


def revisits_of_pages(pages: DataFrame) -> DataFrame:
    """Resolution of every revisit among the records of ``pages``, with the digest of the payload it stands for."""
    parsed = parse_records(captures(pages)).withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")
    found = resolve_revisits(parsed)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select(
        F.substring("record_id", 2, 20).cast("long").alias("page_id"), "address", "status", "response_id", listed.alias("headers"), "payload_sha256"
    )

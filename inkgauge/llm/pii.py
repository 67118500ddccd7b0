"""Personal data: fixed patterns, and the words in the same documents that the corpus shows to give the person away.

Base: addresses of mail and machines, card and phone numbers are found in every whole text; each pattern runs once
from the left, in time linear in the text (all loops are possessive), and matches that fail their test are dropped.

Information-theoretic part: a valid match is a protected entity e. A term t is a word (``TERM``) of the same document,
at any distance; what lies within a valid match belongs to the entity and is no term; terms are compared in lower
case, and in scripts without spaces a run of letters is one term. Over all documents, PMI(e, t) =
log2(N n(e,t) / (n(e) n(t))) says how much t tells about e, and IC(e) = log2(N / n(e)) how much there is to tell; n
counts documents. Their ratio is 1 when t occurs nowhere but beside e. From ``GENERALISE`` on the term is
replaced by its class (the longest beginning that is frequent enough not to give the entity away, see ``classes``),
from ``REMOVE`` on it is removed: the highest ratio of the term counts, and every occurrence in
every text is marked, also where the entity is not mentioned. A term must be seen in ``SUPPORT`` documents, as one
document is no statistic. Base spans always stay.

Bounds: pairs are only made of entities and terms that both have the support, and of terms rare enough for the ratio
(n(e,t) <= n(e), hence n(t) <= N (n(e) / N)^ratio), which loses none. Texts without a match are searched for risky
terms through a bit table of at most ``SIEVE`` bits; what passes is compared with the terms themselves.

Defined cases: a null text is empty and has no spans; repeated rows are rows of their own and count as documents;
ties in start are ordered email, ip, card, phone, term. An empty table gives an empty result. Only doc_id and text
are read. All steps are DataFrame operations; a text is never cut.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgauge.functions.binding import let
from inkgauge.llm.common import stage, whole_text

SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Bits of the table at most, and bits of it that each term sets. So few other words pass that hardly a frequent one does.
SIEVE, PROBES = 1 << 25, 4
#: Beginnings of terms up to this many characters can be classes.
LONGEST_BEGINNING = 12
STRETCH = 4096
KINDS = ["email", "ip", "card", "phone", "term"]

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_DOMAIN = f"{_LABEL}++(?:\\.{_LABEL}++)++"
_QUAD = "[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]"
_TELEPHONE = "\\+[0-9][ ().0-9-]+[0-9]"
#: kind -> (text that cannot begin a match, the match)
PATTERNS = {
    "email": (f"(?:[^A-Za-z0-9._%+-]++|{_LOCAL}++(?!@{_LABEL}++\\.{_LABEL}))*+", f"{_LOCAL}++@{_DOMAIN}"),
    "ip": (f"(?:[^0-9]++|[0-9]++(?!\\.[0-9]++\\.[0-9]++\\.[0-9]))*+", f"{_QUAD}[0-9]*+"),
    "card": ("(?:[^0-9]++|[0-9](?![ -]?[0-9]))*+", "[0-9](?:[ -]?[0-9])++"),
    "phone": (f"(?:[^+]++|\\+(?![0-9][ ().0-9-]+[0-9]))*+", _TELEPHONE),
}
#: What stands somewhere in every text with a valid match of the kind.
NEEDED = {
    "email": f"@{_LABEL}++\\.{_LABEL}", "ip": "[0-9]\\.[0-9]++\\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}", "phone": "\\+[0-9][ ().0-9-]{7}",
}
_ALNUM, _APOSTROPHE, _JOIN = "[\\p{L}\\p{M}\\p{N}]", "['\u2019]", "['\u2019_\u2010-]"
_POSSESSIVE = f"{_APOSTROPHE}[sS](?!{_ALNUM})"
_SMALL = f"\\p{{Ll}}{{1,2}}+(?:(?={_POSSESSIVE})|(?!{_JOIN}?{_ALNUM}))"
#: A word, name or code: letters and digits, joined by single hyphens, apostrophes or underscores; a possessive s is no part.
#: One or two small letters alone are no term ("of"); short names and codes with a capital, a digit or letters without case are.
TERM = f"(?<!{_ALNUM})(?!{_SMALL}){_ALNUM}++(?:(?!{_POSSESSIVE}){_JOIN}{_ALNUM}++)*+"
#: What may lie before a term.
SKIP = f"(?:[^\\p{{L}}\\p{{M}}\\p{{N}}'\u2019]++|(?<={_ALNUM}){_POSSESSIVE}|{_APOSTROPHE}|(?<!{_ALNUM}){_SMALL})*+"
_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"


def _pieces(text: Column, kind: str) -> Column:
    """The matches of a kind, each with the length of what lies before it; the last element stands for the rest of the text.

    Most texts have nothing that could hold: one plain search finds that out, and the pattern does not run.
    """
    gap, match = PATTERNS[kind]
    whole = f"\\G({gap})({match}|\\z)"
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(whole), 1).alias("gap"), F.regexp_extract_all(text, F.lit(whole), 2).alias("match")
    )
    listed = lambda f: F.when(F.get(f, F.lit(0))["match"] != "", F.transform(f, lambda x: F.struct(
        F.lit(kind).alias("kind"), F.length(x["gap"]).alias("skip"), x["match"].alias("value"))))
    return F.when(text.rlike(NEEDED[kind]), let(found, listed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + weighed(i)) % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"))
        .when(kind == "card", F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False))
        .otherwise((n >= 9) & (n <= 15))
    )


def _listed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("row_id", F.monotonically_increasing_id())
    found = F.concat(*[F.coalesce(_pieces(F.col("text"), kind), F.expr(
        "cast(array() as array<struct<kind:string,skip:int,value:string>>)"
    )) for kind in PATTERNS])
    return stage(rows.select("row_id", "doc_id", "text", found.alias("pieces")), "pii-pieces")


def base_mentions(listed: DataFrame) -> DataFrame:
    """Valid matches: row_id, kind, start, end (code points), entity."""
    one = listed.select("row_id", F.posexplode("pieces").alias("i", "p")).select("row_id", "i", "p.*")
    order = Window.partitionBy("row_id", "kind").orderBy("i")
    end = F.sum(F.col("skip") + F.length("value")).over(order)
    placed = one.select("row_id", "kind", "value", end.alias("end")).where(
        (F.col("value") != "") & _holds(F.col("kind"), F.col("value")))
    return placed.select(
        "row_id", "kind", (F.col("end") - F.length("value")).alias("start"), "end",
        F.concat_ws(":", "kind", F.when(F.col("kind") == "email", F.lower("value")).when(
            F.col("kind") == "ip", F.col("value")).otherwise(_digits(F.col("value")))).alias("entity"),
    )


def _words(text: Column) -> Column:
    """The terms of a text as written."""
    return F.regexp_extract_all(text, F.lit(f"\\G{SKIP}({TERM})"), 1)


def _tokens(text: Column) -> Column:
    """The terms of a text as written, each with the length of what lies before it."""
    whole = F.lit(f"\\G({SKIP})({TERM})")
    found = F.arrays_zip(F.regexp_extract_all(text, whole, 1).alias("gap"), F.regexp_extract_all(text, whole, 2).alias("word"))
    return F.transform(found, lambda x: F.struct(F.length(x["gap"]).alias("skip"), x["word"].alias("word")))


def _terms_beside(matched: DataFrame, mentions: DataFrame) -> DataFrame:
    """row_id, term, start, end for every term of the rows with matches that no valid match touches."""
    order = Window.partitionBy("row_id").orderBy("i")
    end = F.sum(F.col("skip") + F.length("word")).over(order)
    terms = (
        matched.select("row_id", F.posexplode(_tokens(F.col("text"))).alias("i", "t")).select("row_id", "i", "t.*")
        .select("row_id", F.lower("word").alias("term"), (end - F.length("word")).alias("start"), end.alias("end"))
    )
    both = terms.unionByName(mentions.select("row_id", F.lit(None).cast("string").alias("term"), "start", "end"))
    taken = F.when(F.col("term").isNull(), F.struct("start", "end"))
    # Both frames run: one from the start of the text, one from its end. Matches that start with a term come before it.
    along = Window.partitionBy("row_id").orderBy("start", F.col("term").isNotNull())
    back = Window.partitionBy("row_id").orderBy(F.desc("start"), F.col("term").isNull())
    before = F.max(taken["end"]).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min(taken["start"]).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        both.select("row_id", "term", "start", "end", before.alias("before"), behind.alias("behind")).where(
            F.col("term").isNotNull() & (F.coalesce("before", F.col("start")) <= F.col("start"))
            & (F.coalesce("behind", F.col("end")) >= F.col("end")))
        .select("row_id", "term", "start", "end")
    )


def term_documents(plain: DataFrame, beside: DataFrame) -> DataFrame:
    """In how many documents each term occurs, over all whole texts: term, n_t."""
    found = F.array_distinct(F.transform(_words(F.col("text")), F.lower))
    every = plain.select(F.explode(found).alias("term")).unionByName(beside.select("term"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosure(plain: DataFrame, near: DataFrame, mentions: DataFrame, n_docs: int, support: int = SUPPORT,
               least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """entity, term, n_e and ratio from ``least`` on: the share of what there is to tell about an entity that a term
    tells; and the documents of each term."""
    beside = stage(near.select("row_id", "term").distinct(), "pii-beside")
    n = F.lit(float(max(n_docs, 2)))
    # No pair with a term of more documents reaches the least ratio; the margin is for rounding.
    most = n * F.pow(F.col("n_e") / n, F.lit(least)) * 1.000001
    held = mentions.select("entity", "row_id").distinct()
    n_e = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(
        (F.col("n_e") >= support) & (F.col("n_e") < n_docs)).select("entity", "n_e", most.alias("most"))
    held = stage(held.join(stage(n_e, "pii-entities"), "entity"), "pii-held")
    row_most = held.groupBy("row_id").agg(F.max("most").alias("row_most"))
    n_t = stage(term_documents(plain, beside).where(F.col("n_t") >= support), "pii-terms")
    terms = stage(
        beside.join(row_most, "row_id").join(n_t, "term").where(F.col("n_t") <= F.col("row_most"))
        .select("row_id", "term", "n_t"), "pii-rare",
    )
    pairs = (
        held.join(terms, "row_id").where(F.col("n_t") <= F.col("most"))
        .groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    )
    told = F.log2(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    there = F.log2(n / F.col("n_e"))
    return pairs.select("entity", "term", "n_e", (told / there).alias("ratio")).where(F.col("ratio") >= least), n_t


def classes(risky: DataFrame, n_t: DataFrame, n_docs: int, least: float = GENERALISE) -> DataFrame:
    """term and class of the terms to generalise: the longest beginning of the term that is frequent enough.

    A beginning stands for all terms that begin so, in n documents at least as many as the most frequent of them. What
    it tells about an entity e is at most log2(N / n) / log2(N / n(e)), as no more than n(e) documents hold both; it is
    taken where that is below the limit for every entity that the term gives away. A term without such a beginning is
    only called a term.
    """
    n = float(max(n_docs, 2))
    starts = risky.where(F.length("term") > 1).select(
        "term", "n_e", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda k: F.left(F.col("term"), k))).alias("k", "start")
    )
    starts = stage(starts, "pii-beginnings")
    longest = F.array(*[F.lit(k) for k in range(1, LONGEST_BEGINNING + 1)])
    every = n_t.select("n_t", F.explode(F.array_distinct(F.transform(longest, lambda k: F.left(F.col("term"), k)))).alias("start"))
    counted = every.join(starts.select("start").distinct(), "start").groupBy("start").agg(F.max("n_t").alias("n"))
    below = F.log2(F.lit(n) / F.col("n")) < least * F.log2(F.lit(n) / F.col("n_e"))
    chosen = starts.join(counted, "start").where(below).groupBy("term").agg(F.max_by("start", "k").alias("start"))
    return risky.join(chosen, "term", "left").select("term", F.coalesce(F.concat("start", F.lit("*")), F.lit("[TERM]")).alias("class"))


def _sieve(risky: DataFrame):
    """A test of words that holds for every risky term, and for few others; None if there is no risky term."""
    total = risky.count()
    if not total:
        return None
    bits = min(SIEVE, max(64, 1 << (32 * total).bit_length()))
    seeds = F.array(*[F.lit(k) for k in range(PROBES)])

    def place(term: Column, seed: Column) -> Column:
        return F.pmod(F.xxhash64(term, seed), F.lit(bits))

    set_bits = (
        risky.select(F.explode(F.transform(seeds, lambda seed: place(F.col("term"), seed))).alias("at"))
        .groupBy(F.expr("cast(at div 64 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("mask"))
    )
    table = [0] * (bits // 64)
    for row in set_bits.toLocalIterator():
        table[row["word"]] = row["mask"]
    masks = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<bigint>")

    def holds(term: Column) -> Column:
        def is_set(seed: Column) -> Column:
            at = place(term, seed)
            return F.getbit(F.get(masks, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1

        # It ends at the first bit that is not set: most words cost one.
        return F.forall(seeds, is_set)

    return holds


def _terms_elsewhere(plain: DataFrame, holds) -> DataFrame:
    """row_id, term, start, end for the words of rows without matches that pass the sieve.

    The words alone are one pass; places are only counted in the few texts in which a word passes.
    """
    none = F.expr("cast(array() as array<struct<term:string,start:bigint,end:bigint>>)")

    def walk(done: Column, t: Column) -> Column:
        start = done["at"] + t["skip"]
        end = start + F.length(t["word"])
        term = F.lower(t["word"])
        hit = F.array(F.struct(term.alias("term"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(holds(term), F.concat(done["hits"], hit)).otherwise(done["hits"]).alias("hits"))

    walked = F.aggregate(
        _tokens(F.col("text")), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("hits")), walk, lambda done: done["hits"]
    )
    some = F.exists(_words(F.col("text")), lambda word: holds(F.lower(word)))
    # The outer form plus a filter on its output: the plain form would compute the places a second time in a filter.
    return plain.select("row_id", F.explode_outer(F.when(some, walked)).alias("t")).where("t is not null").select("row_id", "t.*")


def found_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans: array of (start, rank, end, kind, action, mark, cut_start, cut_end), in order."""
    listed = _listed(docs)
    matched, plain = listed.where(F.size("pieces") > 0), listed.where(F.size("pieces") == 0)
    mentions = stage(base_mentions(listed), "pii-mentions")
    near = stage(_terms_beside(matched, mentions), "pii-near")
    n_docs = listed.count()
    told, n_t = disclosure(plain, near, mentions, n_docs, support, generalise)
    risky = stage(told.groupBy("term").agg(F.max("ratio").alias("ratio"), F.max("n_e").alias("n_e")), "pii-risky")
    every = mentions.select(
        "row_id", "start", "end", "kind", F.lit("replace").alias("action"), F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("mark")
    )
    if holds := _sieve(risky):
        seen = near.unionByName(stage(_terms_elsewhere(plain, holds), "pii-elsewhere"))
        named = stage(risky.select("term", "ratio").join(classes(risky, n_t, n_docs, generalise), "term"), "pii-classes")
        gone = F.col("ratio") >= remove
        every = every.unionByName(seen.join(named, "term").select(
            "row_id", "start", "end", F.lit("term").alias("kind"),
            F.when(gone, "remove").otherwise("generalise").alias("action"), F.when(gone, "").otherwise(F.col("class")).alias("mark")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    # What is left of a span beyond all spans before it; one that begins within another has no mark of its own.
    ahead = Window.partitionBy("row_id").orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("rank", rank).withColumn("reach", F.coalesce(F.max("end").over(ahead), F.lit(0).cast("bigint")))
    every = every.withColumn("cut_start", F.greatest("start", "reach")).withColumn("cut_end", F.greatest("end", "reach"))
    fields = ["start", "rank", "end", "kind", "action", "mark", "cut_start", "cut_end"]
    spans = every.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return listed.select("row_id", "doc_id").join(spans, "row_id", "left").withColumn("spans", F.coalesce("spans", empty))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _cleaned(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their marks; overlapping ones as one, by the mark of the first.

    The text is cut into stretches of ``STRETCH`` characters first, so that reading between two spans costs what lies
    there and no walk from the start of the text.
    """
    stretches = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))

    def between(parts: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / STRETCH).cast("int"), F.floor((high - 1) / STRETCH).cast("int")
        # What lies of a stretch between the two places.
        read = F.transform(F.sequence(first, last), lambda k: F.substring(
            F.coalesce(F.get(parts, k), F.lit("")), (F.greatest(low - k * STRETCH, F.lit(0)) + 1).cast("int"),
            (F.least(high - k * STRETCH, F.lit(STRETCH)) - F.greatest(low - k * STRETCH, F.lit(0))).cast("int")))
        return F.when(high > low, F.array_join(read, "")).otherwise(F.lit(""))

    def written(parts: Column) -> Column:
        def before(i: Column) -> Column:
            return F.coalesce(F.get(spans, i - 1)["cut_end"], F.lit(0).cast("bigint"))

        kept = F.transform(spans, lambda s, i: F.concat(between(parts, before(i), s["cut_start"]), F.when(s["cut_start"] == s["start"], s["mark"]).otherwise("")))
        return F.concat(F.array_join(kept, ""), between(parts, F.coalesce(F.try_element_at(spans, F.lit(-1))["cut_end"], F.lit(0).cast("bigint")), F.length(text).cast("bigint")))

    # Most texts have no spans: they stay as they are.
    return F.when(F.size(spans) == 0, text).otherwise(let(stretches, written))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with every span replaced: [EMAIL], [IP], [CARD], [PHONE], the class of a term, or nothing if
    removed. Overlapping spans are replaced as one, by the mark of the first."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = stage(rows.select("__row", F.struct("__row", "doc_id").alias("doc_id"), "text"), "pii-rows")
    found = found_spans(rows, **options).where(F.size("spans") > 0).select(F.col("doc_id.__row").alias("__row"), "spans")
    none = F.array().cast(found.schema["spans"].dataType)
    marked = rows.select("__row", "doc_id.doc_id", whole_text().alias("text")).join(stage(found, "pii-found"), "__row", "left").withColumn("spans", F.coalesce("spans", none))
    return marked.select("doc_id", _cleaned(F.col("text"), F.col("spans")).alias("text"))


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, number of base matches by kind, digest of the base spans, all spans as text; then the number of terms
    and how many of them are generalised and removed. ``sanitised`` writes the texts."""
    rows = found_spans(docs, **options)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    done = lambda action, name: F.size(F.filter("spans", lambda s: s["action"] == action)).cast("long").alias(name)
    return rows.select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), count("term"), done("generalise", "n_generalised"), done("remove", "n_removed"),
    )

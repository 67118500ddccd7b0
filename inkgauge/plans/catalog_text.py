"""Registered queries over texts: extraction, scalar functions, style signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from inkgauge import dims
from inkgauge.functions import text as X, urls as U
from inkgauge.operators import findings as fnd, judge, style
from inkgauge.plans import duck as D
from inkgauge.plans.fixtures import fixture, table, with_fixtures

QUERIES: dict = {}


def texts(spark, sf) -> DataFrame:
    return fixture(spark, sf, "synth_text").select(
        "doc_id", X.collapse(F.col("text")).alias("body_text"), F.split("text", "\n").alias("paragraphs")
    )


TEXTS = f"t AS (SELECT doc_id, {D.collapse('text')} AS body_text, string_split(text, chr(10)) AS paragraphs FROM synth_text)"

# --- visible text -----------------------------------------------------------------------------

QUERIES["visible_text"] = (
    lambda spark, sf: table(spark, sf, "pages").select("page_id", X.visible_text(F.col("html")).alias("text")),
    f"SELECT page_id, {D.visible('html')} AS text FROM pages",
)
QUERIES["visible_word_count"] = (
    lambda spark, sf: table(spark, sf, "pages")
    .select("page_id", X.visible_text(F.col("html")).alias("t"))
    .select("page_id", X.word_count(F.col("t")).alias("words")),
    f"SELECT page_id, {D.word_count('t')} AS words FROM (SELECT page_id, {D.visible('html')} AS t FROM pages)",
)

# --- sentences --------------------------------------------------------------------------------

QUERIES["split_sentences"] = (
    lambda spark, sf: fnd.rows_of(texts(spark, sf), ["doc_id"], X.sentences(F.col("body_text")), "nth", "sentence"),
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS} SELECT doc_id, nth - 1 AS nth, s[nth] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS nth "
        f"FROM (SELECT doc_id, {D.sentence_list('body_text')} AS s FROM t))",
    ),
)
_OPENERS = ", ".join(D.q(w) for w in dims.QUESTION_OPENERS)
QUERIES["looks_like_question"] = (
    lambda spark, sf: texts(spark, sf)
    .select("doc_id", F.explode_outer(X.sentences(F.col("body_text"))).alias("s")).filter("s is not null")
    .groupBy("doc_id")
    .agg(F.count_if(X.looks_like_question(F.col("s"))).alias("questions"), F.count("*").alias("sentences")),
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS} SELECT doc_id, count(*) FILTER (WHERE ends_with(s, '?') OR "
        f"regexp_replace(lower(string_split(s, ' ')[1]), '[^A-Za-z0-9_]', '', 'g') IN ({_OPENERS})) AS questions, count(*) AS sentences "
        f"FROM (SELECT doc_id, unnest({D.sentence_list('body_text')}) AS s FROM t) GROUP BY doc_id",
    ),
)

# --- style signals ----------------------------------------------------------------------------

_PHRASES_PRESENT = " + ".join(f"(case when contains(lo, {D.q(p)}) then 1 else 0 end)" for p in dims.BANNED_PHRASES)
SIGNALS_CTE = f"""
{TEXTS}, base AS (
  SELECT doc_id, body_text AS x, lower(body_text) AS lo, {D.sentence_list('body_text')} AS sents,
    list_filter(list_transform(paragraphs, lambda p: {D.collapse('p')}), lambda p: p <> '') AS blocks FROM t),
m AS (SELECT *, greatest({D.word_count('x')}, 1) AS w,
    list_transform(sents, lambda s: len(string_split(s, ' '))) AS lens,
    list_transform(blocks, lambda p: len({D.sentence_list('p')})) AS plens,
    list_transform(blocks, lambda p: lower(array_to_string(string_split(p, ' ')[1:2], ' '))) AS openers FROM base),
n AS (SELECT doc_id, w, len(sents) AS sentence_count, len(blocks) AS block_count,
    {D.occurrences('x', '—')} / w * 400 AS em_dashes_per_400,
    cast({D.found('x', D.NOT_X)} as double) AS not_x_but_y,
    {D.found('x', D.TRICOLON)} / w * 500 AS tricolons_per_500,
    case when len(lens) > 0 then list_aggregate(lens, 'stddev_pop') / list_avg(lens) else 0 end AS burstiness,
    case when len(blocks) > 0 then list_unique(openers) / len(blocks) else 1 end AS opener_diversity,
    cast(len(list_filter(blocks, lambda p: regexp_matches(p, {D.q(D.STOCK_OPENER)}))) as double) AS llm_opener_count,
    {D.found('lo', D.any_of(dims.HEDGES))} / w * 500 AS hedges_per_500,
    {D.found('lo', D.any_of(dims.TRANSITIONS))} / w * 500 AS transitions_per_500,
    cast({D.found('lo', D.any_of(dims.BANNED_WORDS))} as double) AS banned_word_count,
    cast({_PHRASES_PRESENT} as double) AS banned_phrase_count,
    {D.found('x', D.PASSIVE)} / greatest(len(sents), 1) AS passive_ratio,
    {D.occurrences('x', '?')} / w * 400 AS questions_per_400,
    cast({D.found('x', D.FIRST_PERSON)} as double) AS first_person_count,
    {D.found('x', D.NUMBER)} / w * 500 AS numbers_per_500,
    case when len(plens) > 0 then list_aggregate(plens, 'stddev_pop') else 0 end AS para_length_sd FROM m)
"""
_SIGNAL_HITS = [
    ("H_em_dash_overuse", "warn", "em_dashes_per_400 > 1.25"),
    ("H_not_x_but_y", "warn", "not_x_but_y > 1"),
    ("H_tricolon_density", "warn", "tricolons_per_500 > 2"),
    ("H_low_burstiness", "warn", "burstiness < 0.55 AND sentence_count > 5"),
    ("H_repetitive_openers", "warn", "block_count >= 4 AND opener_diversity < 0.7"),
    ("H_llm_opener_phrases", "warn", "llm_opener_count > 0"),
    ("H_hedge_overuse", "warn", "hedges_per_500 > 3"),
    ("H_formal_transition_overuse", "warn", "transitions_per_500 > 2"),
    ("H_banned_vocabulary", "fail", "banned_word_count > 0"),
    ("H_banned_phrases", "fail", "banned_phrase_count > 0"),
    ("H_passive_overuse", "warn", "passive_ratio > 0.15 AND sentence_count > 8"),
    ("H_no_questions", "info", "w > 400 AND questions_per_400 < 1"),
    ("H_low_specificity_numbers", "info", "w > 500 AND numbers_per_500 < 4"),
    ("H_uniform_paragraphs", "warn", "block_count >= 4 AND para_length_sd < 1.5"),
]


def signal_numbers(spark, sf) -> DataFrame:
    df = style.signal_measures(texts(spark, sf))
    return df.select("doc_id", *[F.round(F.col(s).cast("double"), 6).alias(s) for s in style.SIGNALS])


QUERIES["text_signal_measures"] = (
    signal_numbers,
    with_fixtures(
        "synth_text",
        f"WITH {SIGNALS_CTE} SELECT doc_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in style.SIGNALS) + " FROM n",
    ),
)
QUERIES["text_signals"] = (
    lambda spark, sf: fnd.run_family(texts(spark, sf), style.TEXT_SIGNALS).select("doc_id", "check_id", "severity"),
    with_fixtures("synth_text", f"WITH {SIGNALS_CTE} " + D.hits(_SIGNAL_HITS, "n")),
)


def one_signal(name: str):
    """A measure as its own operator, from the sentence or paragraph arrays only."""

    def run(spark, sf) -> DataFrame:
        return style.signal_measures(texts(spark, sf)).select("doc_id", F.round(F.col(name).cast("double"), 6).alias(name))

    return run, with_fixtures("synth_text", f"WITH {SIGNALS_CTE} SELECT doc_id, round({name}, 6) AS {name} FROM n")


QUERIES["burstiness"] = one_signal("burstiness")
QUERIES["opener_diversity"] = one_signal("opener_diversity")


def rates(spark, sf) -> DataFrame:
    t = texts(spark, sf).withColumn("w", X.word_count(F.col("body_text")))
    marks, commas = X.question_marks(F.col("body_text")), X.substring_count(F.col("body_text"), F.lit(","))
    return t.select(
        "doc_id", F.round(X.rate(marks, F.col("w"), 400), 6).alias("questions_per_400"),
        F.round(X.rate(commas, F.col("w"), 500), 6).alias("commas_per_500"),
    )


QUERIES["rate_per_n"] = (
    rates,
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS}, u AS (SELECT *, greatest({D.word_count('body_text')}, 1) AS w FROM t) SELECT doc_id, "
        f"round({D.occurrences('body_text', '?')} / w * 400, 6) AS questions_per_400, "
        f"round({D.occurrences('body_text', ',')} / w * 500, 6) AS commas_per_500 FROM u",
    ),
)

# --- lexicon ----------------------------------------------------------------------------------

QUERIES["lexicon_hits"] = (
    lambda spark, sf: style.lexicon_hits(texts(spark, sf)),
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS} SELECT doc_id, list, term, n FROM ("
        + " UNION ALL ".join(
            f"SELECT doc_id, {D.q(name)} AS list, {D.q(term)} AS term, {D.found('lower(body_text)', D.any_of([term]))} AS n FROM t"
            for name, terms in style.LISTS.items()
            for term in terms
        )
        + ") WHERE n > 0",
    ),
)
QUERIES["phrase_hits"] = (
    lambda spark, sf: style.phrase_hits(texts(spark, sf)),
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS} "
        + " UNION ALL ".join(
            f"SELECT doc_id, {D.q(p)} AS phrase FROM t WHERE contains(lower(body_text), {D.q(p)})"
            for p in dims.BANNED_PHRASES
        ),
    ),
)
QUERIES["substring_count"] = (
    lambda spark, sf: texts(spark, sf).select(
        "doc_id", X.substring_count(F.lower("body_text"), F.lit("on")).alias("n_on"),
        X.substring_count(F.col("body_text"), F.substring("body_text", 1, 2)).alias("n_own_start"),
    ),
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS} SELECT doc_id, {D.occurrences('lower(body_text)', 'on')} AS n_on, case when length(body_text) > 0 then "
        "cast((length(body_text) - length(replace(body_text, substr(body_text, 1, 2), ''))) / length(substr(body_text, 1, 2)) as int) else 0 end AS n_own_start FROM t",
    ),
)


def rules_in_use(spark, sf) -> DataFrame:
    """All rule tables as rows, each with how often the corpus triggers it: terms by hits, phrases by documents."""
    df = texts(spark, sf)
    terms = style.lexicon_hits(df).groupBy(F.col("list").alias("key"), F.col("term").alias("value")).agg(F.sum("n").alias("uses"))
    phrases = style.phrase_hits(df).groupBy(F.lit("banned_phrase").alias("key"), F.col("phrase").alias("value")).agg(F.count("*").alias("uses"))
    seen = terms.unionByName(phrases).withColumn("kind", F.lit("lexicon"))
    return dims.rule_rows(spark).join(seen, ["kind", "key", "value"], "left").select(
        "kind", "key", "value", F.coalesce("uses", F.lit(0)).alias("uses")
    )


def _other_rules() -> list[tuple[str, str, str]]:
    rows = [("format", k, v) for k, v in dims.FORMAT_SYNONYMS.items()]
    rows += [("entity_field", f"{t}.{tier}", f) for t, tiers in dims.ENTITY_FIELDS.items() for tier, fields in zip(dims.FIELD_TIERS, tiers) for f in fields]
    rows += [(kind, k, str(v[i]).lower()) for k, v in dims.BANDS.items() for kind, i in (("band_min", 0), ("band_target", 1), ("band_max", 2), ("band_toc", 4), ("band_faq", 5))]
    rows += [("band_type", k, t) for k, v in dims.BANDS.items() for t in v[3]]
    cited = dict(dims.CITATIONS) | {k: dims.CITATIONS[v] for k, v in dims.CITATION_ALIAS.items()}
    cited |= {f"D_{t}_missing_{tier}": dims.CITATIONS["D6_required_fields"] for t in dims.ENTITY_FIELDS for tier in ("required", "google_required")}
    rows += [(kind, k, str(n)) for k, v in cited.items() for kind, ids in zip(("citation_rule", "citation_pattern"), v) for n in ids]
    rows += [("rubric_weight", k, str(v[3])) for k, v in dims.RUBRIC.items()]
    return rows + [("witness", code, own) for code, owns in dims.WITNESSES.items() for own in owns]


QUERIES["rule_dimensions"] = (
    rules_in_use,
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS} "
        + " UNION ALL ".join(
            f"SELECT 'lexicon' AS kind, {D.q(name)} AS key, {D.q(term)} AS value, "
            f"cast(coalesce(sum({D.found('lower(body_text)', D.any_of([term]))}), 0) as bigint) AS uses FROM t"
            for name, terms in style.LISTS.items()
            for term in terms
        )
        + "".join(
            f" UNION ALL SELECT 'lexicon', 'banned_phrase', {D.q(p)}, count_if(contains(lower(body_text), {D.q(p)})) FROM t" for p in dims.BANNED_PHRASES
        )
        + " UNION ALL SELECT *, 0 FROM (VALUES " + ", ".join(f"({D.q(a)}, {D.q(b)}, {D.q(c)})" for a, b, c in _other_rules()) + ") v(kind, key, value)",
    ),
)

# --- paragraphs -------------------------------------------------------------------------------

_KEPT = (
    f"list_filter(list_transform(paragraphs, lambda p: {D.sub('p', '^' + D.SPACES + '+|' + D.SPACES + '+$', '')}), "
    f"lambda p: {D.word_count(D.collapse('p'))} >= 8)"
)
PARAGRAPH_ROWS = f"""
kept AS (SELECT doc_id, {_KEPT} AS k FROM t),
uniq AS (SELECT doc_id, list_filter(k, lambda p, i: list_position(k, p) = i) AS u FROM kept),
rows AS (SELECT doc_id, i - 1 AS index, u[i] AS paragraph FROM (SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS i FROM uniq))
"""


def _total(terms: list[str]) -> str:
    return " + ".join(D.occurrences("lower(c)", t) for t in terms)


PARAGRAPH_METRICS = f"""
{PARAGRAPH_ROWS},
pm AS (SELECT doc_id, index, {D.collapse('paragraph')} AS c FROM rows),
pn AS (SELECT doc_id, index, c, {D.word_count('c')} AS word_count, len({D.sentence_list('c')}) AS sentence_count,
  {D.occurrences('c', '—')} AS em_dashes, {_total(dims.BANNED_PHRASES)} AS banned_phrase_hits,
  {_total(dims.PARAGRAPH_HEDGES)} AS hedge_hits, regexp_matches(c, {D.q(D.PLURAL_FIRST_PERSON)}) AS first_person,
  contains(c, '?') AS has_question, {D.found('c', D.PASSIVE)} AS passive_hits, {D.found('c', D.NUMBER)} AS concrete_numbers,
  array_to_string(string_split(c, ' ')[1:8], ' ') AS lead FROM pm),
po AS (SELECT *, floor(word_count / sentence_count * 10 + 0.5) / 10 AS avg_sentence_words FROM pn),
pq AS (SELECT doc_id, index, lead || case when length(c) > length(lead) then '…' else '' end AS first_words, word_count, sentence_count,
  avg_sentence_words, em_dashes, banned_phrase_hits, hedge_hits, first_person, has_question, passive_hits, concrete_numbers,
  list_filter([
    case when word_count > 80 then 'long-paragraph(' || word_count || 'w)' end,
    case when sentence_count > 4 then 'many-sentences(' || sentence_count || ')' end,
    case when avg_sentence_words > 26 then 'sentence-avg-too-long(' || regexp_replace(cast(avg_sentence_words as varchar), '\\.0$', '') || 'w)' end,
    case when banned_phrase_hits > 0 then 'banned-phrase(' || banned_phrase_hits || ')' end,
    case when hedge_hits > 1 then 'hedges(' || hedge_hits || ')' end,
    case when em_dashes > 1 then 'em-dashes(' || em_dashes || ')' end,
    case when word_count > 30 and passive_hits / sentence_count > 0.3 then 'passive-heavy' end], lambda f: f is not null) AS flags FROM po)
"""


def metrics_of_texts(spark, sf) -> DataFrame:
    return style.paragraph_metrics(style.paragraph_rows(texts(spark, sf)))


def flat_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_flags", F.array_join("issue_flags", ";"))


_PM_COLS = (
    "doc_id, index, first_words, word_count, sentence_count, avg_sentence_words, em_dashes, banned_phrase_hits, hedge_hits, "
    "first_person, has_question, passive_hits, concrete_numbers, array_to_string(flags, ';') AS issue_flags"
)
QUERIES["paragraph_metrics"] = (
    lambda spark, sf: flat_flags(metrics_of_texts(spark, sf)),
    with_fixtures("synth_text", f"WITH {TEXTS}, {PARAGRAPH_METRICS} SELECT {_PM_COLS} FROM pq"),
)


def flagged(spark, sf) -> DataFrame:
    from inkgauge.operators.lineage import flagged_paragraphs

    rows = flagged_paragraphs(metrics_of_texts(spark, sf), ["doc_id"])
    return flat_flags(rows).select("doc_id", "index", "first_words", "issue_flags")


QUERIES["flagged_paragraphs"] = (
    flagged,
    with_fixtures(
        "synth_text",
        f"WITH {TEXTS}, {PARAGRAPH_METRICS}, w AS (SELECT *, max(len(flags)) over (partition by doc_id) AS any_flag FROM pq) "
        "SELECT doc_id, index, first_words, array_to_string(flags, ';') AS issue_flags FROM w WHERE len(flags) > 0 OR (any_flag = 0 AND index < 10)",
    ),
)

# --- first-party wording ----------------------------------------------------------------------

# --- URLs, snippets, keys ---------------------------------------------------------------------

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#\s]+)([^?#]*)(\?[^#]*)?"


def _g(expr: str, n: int) -> str:
    return f"regexp_extract({expr}, {D.q(_URL)}, {n})"


def duck_normal_url(u: str) -> str:
    scheme, host, path, query = (f"lower({_g(u, 1)})", f"lower({_g(u, 2)})", _g(u, 3), _g(u, 4))
    return (
        f"(case when {scheme} = '' then {u} else {scheme} || '://' || "
        f"(case when {scheme} = 'https' then regexp_replace({host}, ':443$', '') when {scheme} = 'http' then regexp_replace({host}, ':80$', '') else {host} end) || "
        f"(case when {path} in ('', '/') then '/' else regexp_replace({path}, '/$', '') end) || (case when {query} = '?' then '' else {query} end) end)"
    )


# Page links with a default port, upper-case host, trailing slash and fragment on some of them.
_VARIED = (
    "case when page_id % 4 = 0 then replace(url, '.example', '.EXAMPLE') when page_id % 4 = 1 then replace(url, '?', '/?') "
    "when page_id % 4 = 2 then url || '#part' else substr(url, 8) end"
)
QUERIES["normalize_url"] = (
    lambda spark, sf: table(spark, sf, "pages").withColumn("u", F.expr(_VARIED)).select("page_id", U.normalize_url(F.col("u")).alias("normal")),
    f"SELECT page_id, {duck_normal_url('u')} AS normal FROM (SELECT page_id, {_VARIED} AS u FROM pages)",
)
QUERIES["is_absolute_url"] = (
    lambda spark, sf: table(spark, sf, "pages").withColumn("u", F.expr(_VARIED)).select("page_id", U.is_absolute_url(F.col("u")).alias("absolute")),
    f"SELECT page_id, regexp_matches(u, '^(?i:https?)://[^/?#\\s]+') AS absolute FROM (SELECT page_id, {_VARIED} AS u FROM pages)",
)
QUERIES["brand_host"] = (
    lambda spark, sf: table(spark, sf, "pages").withColumn("u", F.expr(_VARIED)).select("page_id", U.brand_host(F.col("u")).alias("host")),
    "SELECT page_id, nullif(regexp_replace(regexp_replace(lower(" + _g("u", 2) + "), ':[0-9]+$', ''), '^www\\.', ''), '') AS host "
    f"FROM (SELECT page_id, {_VARIED} AS u FROM pages)",
)
QUERIES["truncate_snippet"] = (
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", X.truncate_snippet(F.col("text"), 160).alias("snippet")),
    f"SELECT doc_id, case when length(c) > 160 then substr(c, 1, 159) || '…' else c end AS snippet FROM (SELECT doc_id, {D.collapse('text')} AS c FROM documents)",
)
QUERIES["escape_html"] = (
    lambda spark, sf: table(spark, sf, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped")),
    "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages",
)
QUERIES["sanitize_key"] = (
    lambda spark, sf: table(spark, sf, "pages").select("page_id", X.sanitize_key(F.col("url")).alias("key")),
    "SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS key FROM pages",
)

# --- judges -----------------------------------------------------------------------------------

QUERIES["extract_json_object"] = (
    lambda spark, sf: fixture(spark, sf, "synth_judge").select(
        "doc_id", X.extract_json_object(F.col("answer")).alias("found"),
        F.try_parse_json(X.extract_json_object(F.col("answer"))).isNotNull().alias("readable"),
    ),
    with_fixtures(
        "synth_judge",
        "SELECT doc_id, f AS found, coalesce(json_valid(f), false) AS readable FROM (SELECT doc_id, nullif(regexp_extract(answer, '(?s)\\{.*\\}'), '') AS f FROM synth_judge)",
    ),
)


def judge_rows(spark, sf) -> DataFrame:
    answers = fixture(spark, sf, "synth_judge")
    rows = [judge.judge_rows(answers, layer) for layer in ("humanization", "quality")]
    return reduce(DataFrame.unionByName, rows).select(
        "doc_id", "check_id", "layer", "severity", F.col("patch.before").alias("before"), F.col("patch.after").alias("after")
    )


_AXES = """
obj AS (SELECT doc_id, nullif(regexp_extract(answer, '(?s)\\{.*\\}'), '') AS f FROM synth_judge),
ok AS (SELECT doc_id, f FROM obj WHERE json_valid(f)),
axes AS (SELECT doc_id, a->>'name' AS name, cast(a->>'score' as double) AS score, a->>'worst_sentence' AS worst, a->>'suggested_rewrite' AS rewrite
  FROM (SELECT doc_id, unnest(cast(f::json->'axes' as json[])) AS a FROM ok))
"""
QUERIES["judge_findings"] = (
    judge_rows,
    with_fixtures(
        "synth_judge",
        f"WITH {_AXES} SELECT doc_id, case l when 'humanization' then 'H_judge_' || lower(replace(name, ' ', '_')) else 'Q_' || name end AS check_id, l AS layer, "
        "case when score <= 3 then 'fail' else 'warn' end AS severity, case when worst is not null and rewrite is not null then worst end AS before, "
        "case when worst is not null and rewrite is not null then rewrite end AS after FROM axes, (VALUES ('humanization'), ('quality')) v(l) WHERE score < 7 "
        "UNION ALL SELECT doc_id, case l when 'humanization' then 'H_judge_parse_error' else 'Q_parse_error' end, l, 'info', null, null FROM synth_judge, (VALUES ('humanization'), ('quality')) v(l) "
        "WHERE doc_id NOT IN (SELECT doc_id FROM ok)",
    ),
)
QUERIES["score_judge"] = (
    lambda spark, sf: judge.parse_answers(fixture(spark, sf, "synth_judge")).select("doc_id", judge.axis_score().alias("judge_score")),
    with_fixtures(
        "synth_judge",
        f"WITH {_AXES} SELECT s.doc_id, cast(case when avg(score) is null then 70 else greatest(0, least(100, floor(avg(score) * 10 + 0.5))) end as int) AS judge_score "
        "FROM synth_judge s LEFT JOIN axes a ON a.doc_id = s.doc_id GROUP BY s.doc_id",
    ),
)

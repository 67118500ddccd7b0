"""The operators built from DataFrame functions alone, against brute force."""

import hashlib
import random
import re
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import CLASHING, documents, prose  # noqa: E402

from inkgauge.llm import exact_dedup, pii, winnowing  # noqa: E402


def luhn(d):
    return sum((x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    out = []
    for rank, (kind, (pattern, holds)) in enumerate(RULES.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if holds(m.group())]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TEXTS = [
    None, "", " ", "a@b.co_m@c.d x", "x@y z@w.com.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.00.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567 +12 +1((((( +49.30.123456789012345", "a@@b.c d@e..f g@h.i-j.k", "é😀 bob@mail.example.com 😀 10.0.0.1, +33 1 23 45 67 89",
    "1 2 3 4 5 6 7 8 9 0 1 2 8", "%@a.b@c.d", "12345678901234567890123", "1.1.1.1.", "....@a.b", "+1+2+3 4 5 6 7 8 9 0 1", "5555 5555-5555 4444 1",
]


def test_base_spans_match_brute_force(spark):
    random.seed(5)
    alphabet = "ab1234@.+- ()%é\n45"
    texts = TEXTS + ["".join(random.choices(alphabet, k=random.randint(1, 120))) for _ in range(600)]
    docs = documents(spark, list(enumerate(texts)), CLASHING)
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [s for s in rows[i].spans.split(",") if s and not s.startswith("term")] == want
        for kind in RULES:
            assert rows[i][f"n_{kind}"] == sum(w.startswith(kind) for w in want)


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"the report of {i} was sent by Zanzibar bob@mail.example.com to the office") for i in range(3)]
    rows += [(10 + i, f"the report was sent to the office by {prose(i, 30)}") for i in range(40)]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    text = rows[0][1]
    at = text.index("Zanzibar")
    assert f"term:{at}:{at + 8}" in found[0].spans.split(",")
    assert found[0].n_term == 1 and found[0].n_email == 1
    assert all(found[10 + i].spans == "" for i in range(40))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "the report of 0 was sent by  [EMAIL] to the office" and clean[10] == rows[3][1]


def test_terms_count_at_any_distance_and_are_marked_everywhere(spark):
    far = prose(7, 120)
    rows = [(i, f"Zanzibar {far} in 2024 {far} 4111 1111 1111 1111 {far}") for i in range(4)]
    rows += [(10 + i, f"{far} {prose(i, 20)}") for i in range(200)] + [(999, f"ask zanzibar, {far} and Zanzibar")]
    found = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    for i in range(4):
        assert "term:0:8" in found[i].spans.split(",") and found[i].n_card == 1
    at = len(f"ask zanzibar, {far} and ")
    assert found[999].spans == f"term:4:12,term:{at}:{at + 8}"
    assert all(found[10 + i].spans == "" for i in range(200))


def test_terms_are_names_and_codes_of_any_form(spark):
    names = ['"Smithy"', "(Weaver)", "name:Cooper", "Mueller-Lang", "O\u2019Brien", "[AB1234]", "Xu", "Zanzibar's", "Ga\u0308rtner/", "77-4711"]
    text = "the mail of " + " and ".join(names) + " to bob.q@mail.example.com was sent to the office"
    rows = [(i, text) for i in range(3)] + [(10 + i, f"the mail of the office was sent to and com {prose(i, 30)}") for i in range(80)]
    found = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    spans = [s.split(":") for s in found[0].spans.split(",")]
    assert [text[int(a):int(b)] for kind, a, b in spans if kind == "term"] == [
        "Smithy", "Weaver", "name", "Cooper", "Mueller-Lang", "O\u2019Brien", "AB1234", "Xu", "Zanzibar", "Ga\u0308rtner", "77-4711"]
    assert all(found[10 + i].spans == "" for i in range(80))


def test_personal_data_of_no_rows_and_repeated_rows(spark):
    assert pii.personal_data(documents(spark, [])).count() == 0
    twice = documents(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (None, "1.2.3.4")])
    assert sorted((r.doc_id or 0, r.spans) for r in pii.personal_data(twice).collect()) == [(0, "ip:0:7"), (1, "email:0:6"), (1, "email:0:6")]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "+1", "1 ", ".", "a.b@", "a@b."])
def test_personal_data_stays_linear_in_long_texts(spark, unit):
    docs = documents(spark, [(1, unit * (600_000 // len(unit)))])
    start = time.time()
    pii.personal_data(docs).collect()
    assert time.time() - start < 60


def test_exact_dedup(spark):
    long_text = prose(1, 30_000)
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (5, long_text), (9, long_text), (6, long_text + " "), (7, "A"), (4, "a"), (None, "a"), (8, "é" * 20_000),
            (11, "é" * 20_000), (12, "x" + "é" * 20_000)]
    got = exact_dedup.exact_dedup(documents(spark, rows, CLASHING)).collect()
    assert len(got) == len(rows)
    kept = sorted((r.keep_id, r.group_size) for r in got if r.kept)
    assert kept == [(2, 2), (4, 4), (6, 1), (7, 1), (9, 2), (11, 2), (12, 1)]
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) if r.doc_id is not None else "a"
        assert r.text_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_shared_identifiers_are_told_apart(spark, monkeypatch):
    """With an identifier that hardly tells anything, contents still decide."""
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c: F.struct(F.length(c).alias("n")))
    got = exact_dedup.exact_dedup(documents(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 3, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1)]


def test_chunks_rejoin_and_resynchronise(spark):
    text = prose(3, 20_000)
    df = spark.createDataFrame([(1, text), (2, "inserted at the start " + text), (3, "\n" * 30_000)], "id int, text string")
    got = {r.id: r.c for r in df.select("id", exact_dedup.chunks(F.col("text")).alias("c")).collect()}
    assert "".join(got[1]) == text and "".join(got[3]) == "\n" * 30_000
    assert len(set(got[1]) & set(got[2])) > 0.8 * len(got[1])


TOKEN = re.compile("[⺀-퟿豈-﫿]|[^\\x20\\x09-\\x0D⺀-퟿豈-﫿]{1,24}")


def picked(grams, w):
    """Positions that winnowing keeps, from the definition."""
    out = []
    for i in range(max(len(grams) - w, 0) + 1 if grams else 0):
        window = grams[i : i + w]
        least = min(window)
        out.append(i + max(j for j, x in enumerate(window) if x == least))
    return sorted(set(out))


def test_winnowing_matches_definition(spark):
    random.seed(2)
    texts = [None, "", " \n", "one", "a b c d e", "A B C D E F", "x " * 200, "数据" * 30, "y" * 100, *[prose(i, random.randint(1, 80), 6) for i in range(60)]]
    docs = documents(spark, list(enumerate(texts)), CLASHING)
    grams = {r.doc_id: r.g for r in winnowing.with_grams(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", "g").select("doc_id", "g").collect()}
    for r in winnowing.fingerprints(docs).collect():
        tokens = TOKEN.findall((texts[r.doc_id] or "").lower())
        assert len(grams[r.doc_id]) == (max(len(tokens) - winnowing.K, 0) + 1 if tokens else 0)
        assert [(x.hash, x.pos) for x in r.fingerprint] == [(grams[r.doc_id][p], p) for p in picked(grams[r.doc_id], winnowing.W)]


def test_shared_passage_shares_a_fingerprint(spark):
    passage = " ".join(f"common{i}" for i in range(winnowing.K + winnowing.W - 1))
    docs = documents(spark, [(i, f"{prose(i, 20 + i)} {passage} {prose(50 + i, 9)}") for i in range(12)])
    sets = [{x.hash for x in r.fingerprint} for r in winnowing.fingerprints(docs).collect()]
    assert all(a & b for a in sets for b in sets)


@pytest.mark.parametrize("run_rows", [3, 2000])
def test_edited_fingerprints(spark, monkeypatch, run_rows):
    monkeypatch.setattr(winnowing, "ROWS_PER_RUN", run_rows)
    texts = [None, "", "short", *[prose(i, 5 + 7 * i) for i in range(20)], "é" * 50]
    rows = [(3 * i - 9, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in winnowing.edited_fingerprints(documents(spark, rows, CLASHING)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, reverse=True)
    own = {}
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        own[i] = {x.hash for x in got[i].fingerprint}
        new = {x.hash for x in got[i].edited_fingerprint}
        assert got[i].near_edited == pytest.approx(len(own[i] & new) / len(own[i] | new) if own[i] | new else 1.0)
    for (i, _), (j, _) in zip(ordered, ordered[1:] + ordered[:1]):
        assert got[i].near_next == pytest.approx(len(own[i] & own[j]) / len(own[i] | own[j]) if own[i] | own[j] else 1.0)


def test_edited_fingerprints_of_ties_and_of_nothing(spark):
    assert winnowing.edited_fingerprints(documents(spark, [])).count() == 0
    got = winnowing.edited_fingerprints(documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])).collect()
    assert len(got) == 3 and {r.n_chars for r in got if r.doc_id == 1} == {3}


def test_chunks_of_any_script_survive_a_shift(spark):
    """One character in front leaves most chunks as they are."""
    rng = random.Random(4)
    texts = {
        "han": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60_000)), "hangul": "".join(chr(rng.randrange(0xAC00, 0xD7A3)) for _ in range(60_000)),
        "thai": "".join(chr(rng.randrange(0x0E01, 0x0E5B)) for _ in range(60_000)), "cyrillic": " ".join("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(rng.randint(1, 9))) for _ in range(10_000)),
        "latin": prose(3, 12_000), "kana": "".join(chr(rng.randrange(0x3041, 0x30FF)) for _ in range(60_000)),
    }
    rows = spark.createDataFrame([(k, t, "x" + t) for k, t in texts.items()], "k string, a string, b string")
    for r in rows.select("k", exact_dedup.chunks(F.col("a")).alias("a"), exact_dedup.chunks(F.col("b")).alias("b")).collect():
        assert "".join(r.a) == texts[r.k] and len(r.a) > 20
        assert len(set(r.a) & set(r.b)) >= 0.9 * len(r.a), r.k


def brute_disclosure(rows):
    """Ratios of all (entity, term) pairs, from texts of plain lower-case words and addresses."""
    import math
    from collections import Counter

    n = len(rows)
    entities = [{f"email:{w}" for w in t.split() if "@" in w} for _, t in rows]
    terms = [{w for w in t.split() if "@" not in w} for _, t in rows]
    n_e, n_t = Counter(e for s in entities for e in s), Counter(t for s in terms for t in s)
    n_et = Counter((e, t) for es, ts in zip(entities, terms) for e in es for t in ts)
    return n_e, n_t, {
        (e, t): math.log2(k * n / (n_e[e] * n_t[t])) / math.log2(n / n_e[e]) for (e, t), k in n_et.items() if k >= 2 and n_e[e] >= 2 and n_t[t] >= 2 and n_e[e] < n
    }


def test_counts_ratios_and_classes_match_brute_force(spark):
    import math

    rng = random.Random(12)
    stock = [f"word{chr(97 + i)}{chr(97 + k)}" for i in range(12) for k in range(5)]
    rows = []
    for i in range(600):
        words = rng.choices(stock, k=rng.randint(3, 30))
        if i % 3 == 0:
            who = rng.randrange(12)
            words += [f"person{who}@mail.example"] + [f"secret{'abcdefghijkl'[who]}xx"] * (rng.random() < 0.9) + [f"wordz{'abcdefghijkl'[who]}q"] * (rng.random() < 0.7)
        if i % 7 == 1:
            words.append(f"wordz{rng.choice('abcdefghijkl')}q")
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    n_e, n_t, ratios = brute_disclosure(rows)
    want = {k: r for k, r in ratios.items() if r >= pii.GENERALISE}
    listed = pii._listed(documents(spark, rows))
    matched, plain = listed.where(F.size("pieces") > 0), listed.where(F.size("pieces") == 0)
    mentions = pii.base_mentions(listed)
    got, terms = pii.disclosure(plain, pii._terms_beside(matched, mentions), mentions, len(rows))
    assert {(r.entity, r.term): round(r.ratio, 9) for r in got.collect()} == {k: round(r, 9) for k, r in want.items()} and len(want) > 12
    assert {r.term: r.n_t for r in terms.collect()} == {t: k for t, k in n_t.items() if k >= 2}
    # Spans: every occurrence of a risky term in every text, removed from 0.95 on.
    top = {}
    for (_, t), r in want.items():
        top[t] = max(top.get(t, 0), r)
    found = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    for i, text in rows:
        words = text.split()
        assert found[i].n_term == sum(w in top for w in words) and found[i].n_removed == sum(top.get(w, 0) >= pii.REMOVE for w in words)
        assert found[i].n_generalised == found[i].n_term - found[i].n_removed
    # Classes: frequent enough for every entity that the term gives away, and nothing longer would be.
    risky = spark.createDataFrame([(t, r, max(n_e[e] for (e, x) in want if x == t)) for t, r in top.items()], "term string, ratio double, n_e bigint")
    n = len(rows)
    for r in pii.classes(risky, terms, n).collect():
        hard = max(n_e[e] for (e, x) in want if x == r.term)
        holds = [k for k in range(1, min(len(r.term), pii.LONGEST_BEGINNING + 1)) if math.log2(n / max(c for t, c in n_t.items() if c >= 2 and t.startswith(r.term[:k]))) < pii.GENERALISE * math.log2(n / hard)]
        assert r.__getitem__("class") == (r.term[: max(holds)] + "*" if holds else "[TERM]")
        # The class tells less than the limit of each of those entities.
        if holds:
            start = r.term[: max(holds)]
            docs = [{f"email:{w}" for w in t.split() if "@" in w} for _, t in rows if any(w.startswith(start) for w in t.split())]
            for e in {e for (e, x) in want if x == r.term}:
                k = sum(e in s for s in docs)
                assert math.log2(k * n / (n_e[e] * len(docs))) / math.log2(n / n_e[e]) < pii.GENERALISE
    clean = {r.doc_id: r.text for r in pii.sanitised(documents(spark, rows)).collect()}
    assert len(clean) == len(rows) and all("@" not in clean[i] and (clean[i] == text) == (not found[i].spans) for i, text in rows)
    assert any("wordz*" in t or "word*" in t for t in clean.values())


def test_hardly_a_word_passes_the_sieve_by_chance(spark):
    risky = spark.range(1000).select(F.concat(F.lit("risky"), "id").alias("term"))
    holds = pii._sieve(risky)
    assert risky.where(holds(F.col("term"))).count() == 1000
    assert spark.range(100_000).where(holds(F.concat(F.lit("word"), "id"))).count() < 50
    assert pii._sieve(risky.limit(0)) is None

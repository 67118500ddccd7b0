"""Language, mixing, near duplicates, revisits and the token store against brute force."""

import datetime
import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import CLASHING, DOCS, documents, prose  # noqa: E402

from inkgauge.llm import catalog, feistel, lang_id, minhash_join, mixing, token_store, warc  # noqa: E402
from inkgauge.llm.components import components  # noqa: E402

SF = "/root/testdata/sf0.001"
STOCK = {"en": "the of and to in that was for with this from have", "de": "der die und den von das mit sich des auf für nicht",
         "fr": "de la le et les des en un du une que est pour qui", "es": "de la que el en y a los se del las por un para con"}


def spoken(lang, seed, n):
    random.seed(seed)
    return " ".join(random.choices(STOCK[lang].split(), k=n))


def labelled(spark, extra=()):
    rows = [(100 * k + i, spoken(lang, i, 40), lang, f"src{k}") for k, lang in enumerate(STOCK) for i in range(40)]
    return documents(spark, rows + list(extra))


PAGES = "page_id bigint, url string, html string"


def test_language_of_documents_and_pages(spark):
    docs = labelled(spark, [(900, None, None, None), (901, "", "en", "src0"), (902, "12 34 !!", None, "src1"), (903, "这是一个例子，没有其他语言。" * 5, None, None),
                            (904, "THE OF AND TO IN THAT", None, None), (904, "THE OF AND TO IN THAT", None, None)])
    pages = spark.createDataFrame([
        (1, "https://www.a.de/x", f"<html lang='de'><script>if (a<b) {{ {spoken('en', 1, 90)} }}</script><p>{spoken('de', 3, 30)}</p>"),
        (2, "http://b.example.com/", f"<!-- {spoken('en', 2, 80)} --><b>{spoken('fr', 3, 30)}"), (3, None, None), (4, "nonsense", "<html lang=es"),
        (5, "https://c.es/", "<html lang=\"es\"><p>de la</p>"), (6, "https://c.fr/", "<html lang=\"fr\"><p>de la</p>"),
    ], PAGES)
    got = lang_id.identify(docs, pages).collect()
    assert len(got) == 166 + 6
    by_doc, by_page = {r.doc_id: r for r in got if r.doc_id is not None}, {r.page_id: r for r in got if r.page_id is not None}
    for k, lang in enumerate(STOCK):
        assert all(by_doc[100 * k + i].lang == lang and by_doc[100 * k + i].accepted for i in range(40))
    assert all(by_doc[i].lang == "und" and not by_doc[i].accepted for i in (900, 901, 902, 903))
    assert by_doc[904].lang == "en" and by_doc[904].accepted
    assert (by_page[1].lang, by_page[2].lang, by_page[3].lang, by_page[4].lang) == ("de", "fr", "und", "und")
    # The words alone fit two languages: address and markup decide.
    assert (by_page[5].lang, by_page[6].lang) == ("es", "fr")


def test_fusion_is_bayes_rule(spark):
    """One row, by hand: text, markup and host counts of the other rows."""
    import math

    rows = spark.createDataFrame([
        (1, "h", None, None, [0.0, -1.0, -9.0], 0), (2, "h", None, None, [-2.0, 0.0, -9.0], 1), (3, "h", None, None, [-2.0, 0.0, -9.0], 1),
    ], "id int, __host string, __suffix string, __declared string, __said array<double>, __vote int")
    got = {r.id: r for r in lang_id.fuse(rows, ["aa", "bb"]).collect()}
    corpus = [(1 + 1) / 6, (2 + 1) / 6, (0 + 1) / 6]
    prior = [(0 + 10 * corpus[0]) / 12, (2 + 10 * corpus[1]) / 12, (0 + 10 * corpus[2]) / 12]
    mass = [math.exp(s) * p for s, p in zip([0.0, -1.0, -9.0], prior)]
    assert got[1].__getitem__("__lang") == ("aa" if mass[0] >= mass[1] else "bb")
    assert got[1].__getitem__("__posterior") == pytest.approx(max(mass) / sum(mass))


def test_language_filter_keeps_columns_and_clean_rows(spark):
    docs = labelled(spark, [(900, None, None, None), (901, "?? 11", "en", None)])
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(1))
    got = lang_id.in_a_language(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {900, 901}
    assert lang_id.in_a_language(documents(spark, [])).count() == 0
    assert lang_id.identify(documents(spark, []), spark.createDataFrame([], PAGES)).count() == 0


def water(sizes, weights, total):
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level >= 2 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = weights[i] * level
            return target
        for i in full:
            target[i], left = 2.0 * sizes[i], left - 2 * sizes[i]
        open_ -= full
    return target


def mixed_rows():
    rows = [(i, prose(i, 1 + i * 7 % 90), "en", random.Random(i).choice(["b", "a", "é", "Z", None, "b", "b"])) for i in range(300)]
    return rows + [(500, None, "en", "a"), (501, "", "en", "empty"), (502, prose(1, 20_000), "en", "b"), (7, "twice over", "en", "a"), (7, "twice over", "en", "a")]


def test_mix_targets_and_words(spark):
    rows = mixed_rows()
    docs = documents(spark, rows, CLASHING)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, water([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))))
    source_of = {i: s for i, _, _, s in rows}
    words = {i: len((t or "").split()) for i, t, _, _ in rows if i != 7} | {7: None}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        if r.doc_id != 7:
            assert r.size == words[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
    for r in got:
        taken[r.target] += r.taken
    for s in sizes:
        if sum(abs(t - target[s]) < 1e-6 for t in target.values()) == 1:
            assert abs(taken[next(k for k in taken if abs(k - target[s]) < 1e-6)] - target[s]) <= 1
    again = mixing.mix_report(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_report(documents(spark, [])).count() == 0


def test_mix_segments_cover_quotas_once_in_full_shards(spark):
    docs = documents(spark, mixed_rows())
    rows, sources, parts = mixing.mix(docs, block=64, per_shard=8)
    quota = {r["rank"]: r["quota"] for r in sources.collect()}
    got = parts.collect()
    shards, line = defaultdict(set), defaultdict(int)
    for r in got:
        shards[r.shard].add((r["rank"], r.block))
        line[r["rank"]] += r.to_word - r.from_word
    assert dict(line) == {k: q for k, q in quota.items() if q}
    placed = [b for s in shards.values() for b in s]
    assert len(placed) == len(set(placed)) == sum(-(-q // 64) for q in quota.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert len({(r.shard, r.position) for r in got}) == len(got)


def test_split_tree_draws_fairly():
    room = np.array([3, 3, 2, 2])
    total = np.zeros((2, 4))
    for seed in range(800):
        counts = mixing.split_tree(np.array([4, 6]), room, [seed])
        assert counts.sum(axis=1).tolist() == [4, 6] and counts.sum(axis=0).tolist() == room.tolist()
        total += counts
    assert total / 800 == pytest.approx(np.outer([4, 6], room) / 10, abs=0.12)


def test_mixed_documents_cut_after_words(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents(spark, mixed_rows(), CLASHING).write.parquet(path)
    docs = spark.read.parquet(path)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    whole = defaultdict(list)
    for i, t, _, s in mixed_rows():
        whole[i].append(t)
    words, rows = defaultdict(int), out.collect()
    for r in rows:
        assert any(t is not None and r.text in t for t in whole[r.doc_id]) and r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    taken = defaultdict(int)
    for r in mixing.mix_report(docs).collect():
        taken[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == dict(words)


def jaccard_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rows, random_ = [], random.Random(4)
    for g in range(12):
        base = prose(g, 150 + 20 * g).split()
        for c in range(6):
            own = list(base)
            for _ in range(c):
                own[random_.randrange(len(own))] = f"new{random_.random()}"
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    shared = prose(99, 60)
    rows += [(1000 + i, f"{prose(200 + i, 40)} {shared} {prose(300 + i, 40)}") for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (2006, "a b c d e"), (2007, "a b c d e"), (2008, "É b c d e"), (2009, "é b c d e")]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    want = jaccard_components(rows)
    got = minhash_join.near_duplicates(documents(spark, rows, CLASHING)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_group_of_near_copies_costs_two_pairs_a_member(spark, monkeypatch):
    met, looked = [], minhash_join._enough_matches

    def counted(pairs, signed, matches):
        met.append(pairs.count())
        return looked(pairs, signed, matches)

    monkeypatch.setattr(minhash_join, "_enough_matches", counted)
    base = prose(1, 300).split()
    rows = []
    for i in range(1000):
        words = list(base)
        words[i % 300] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = minhash_join.near_duplicates(documents(spark, rows)).collect()
    assert all(r.component_id == 0 for r in got)
    assert sum(met) <= 2000
    # Copies that change at so many places that many pairs are refused: still a few for each.
    met.clear()
    rows = []
    for i in range(300):
        words = list(base)
        for k in range(3):
            words[(i * 7 + k * 97) % 300] = f"w{i}-{k}"
        rows.append((i, " ".join(words)))
    expected = brute_components(rows)
    got = minhash_join.near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert sum(met) <= 6 * 300


def brute_components(rows, similar=85):
    """doc_id -> smallest doc_id reachable, for different ids and texts of five words and more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.lower().split()]}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_near_duplicates_by_the_exact_remainder_alone(spark):
    """Without rounds of pivots everything goes through the join of rare shingles."""
    rows = near_rows()
    got = minhash_join.near_duplicates(documents(spark, rows), rounds=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_components(rows)


def test_near_duplicates_of_repeated_rows_null_ids_and_nothing(spark, tmp_path):
    text = prose(1, 50)
    docs = documents(spark, [(5, text), (5, text), (None, text), (3, text + " "), (9, None), (None, "alone in the world")], CLASHING)
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in minhash_join.near_duplicates(docs).collect()), key=str)
    assert got == [("3", 3, True), ("5", 3, False), ("5", 3, False), ("9", 9, True), ("None", 3, False), ("None", None, True)]
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    kept = minhash_join.without_near_copies(spark.read.parquet(path))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"] and kept.columns == docs.columns
    assert minhash_join.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097, 65536):
        out = feistel.permute(np.arange(n), n, 5)
        assert sorted(out.tolist()) == list(range(n))
    assert feistel.permute(np.arange(1000), 1000, 1).tolist() != feistel.permute(np.arange(1000), 1000, 2).tolist()


def test_shards_hold_every_sequence_once_and_resume(spark, tmp_path):
    import sentencepiece

    from inkgauge.llm.lattice import default_vocabulary

    model = sentencepiece.SentencePieceProcessor(model_file=default_vocabulary())
    texts = [None, "", prose(1, 4000), *[prose(i, 10 + i * 13 % 300) + "  two\nlines " for i in range(60)]]
    docs = documents(spark, list(enumerate(texts)), CLASHING).repartition(3).cache()
    manifest = token_store.write_shards(docs, str(tmp_path / "shards"), length=64, per_shard=32).collect()
    manifest.sort(key=lambda r: r.shard)
    assert [r.first_slot for r in manifest] == [32 * r.shard for r in manifest] and all(r.stride == 128 for r in manifest)
    for r in manifest:
        data = Path(r.path).read_bytes()
        assert len(data) == r.n_bytes == r.n_sequences * r.stride and hashlib.sha256(data).hexdigest() == r.sha256
    read = [s.tolist() for s in token_store.read_sequences(manifest)]
    total = sum(r.n_sequences for r in manifest)
    assert len(read) == total and [s.tolist() for s in token_store.read_sequences(manifest, 37, 40)] == read[37:77]
    # Undo the permutation: sequences in numbered order are the tokens of the parts, end tokens at the end of each.
    slot = feistel.permute(np.arange(total), total, token_store.KEY)
    stream = [t for i in slot for t in read[i]]
    text = []
    for t in texts:
        text.append(tuple([*(model.encode(t) if t else []), model.eos_id()]))
    docs_seen, current = [], []
    for t in stream:
        current.append(t)
        if t == model.eos_id():
            docs_seen.append(tuple(current))
            current = []
    assert not current
    fill = (model.eos_id(),)
    assert sorted(x for x in docs_seen if x != fill) == sorted(x for x in text if x != fill)
    assert token_store.write_shards(documents(spark, []), str(tmp_path / "none")).count() == 0


def stamp(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.UTC)


RECORDS = "record_id string, kind string, url string, date timestamp, headers map<string,string>, body string"


def test_revisits_match_brute_force(spark):
    random_ = random.Random(8)
    rows = []
    for i in range(400):
        kind = random_.choice(["response", "revisit", "revisit", "request"])
        url = random_.choice([f"http://www.A.com:80/{random_.randrange(4)}/", "https://a.com/hot?b=2&utm_x=1&a=1#f", "https://A.com/hot?a=1&b=2", None, "junk"])
        headers = {k: v for k, v in (("etag", random_.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", random_.choice(["x", "y", None])),
                                     ("content-length", str(i)), ("server", kind)) if v}
        rows.append((f"id{i:03d}", kind, url, random_.choice([stamp(1_700_000_000 + random_.randrange(20_000)), stamp(1_700_003_600), None] if i % 9 == 0 else [stamp(1_700_000_000 + random_.randrange(20_000))]), headers, f"body{i}"))
    df = spark.createDataFrame(rows, RECORDS)
    key = {r.record_id: r.a for r in df.select("record_id", warc.canonical_url(F.col("url")).alias("a")).collect()}
    got = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
    for rid, kind, _, date, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and key[r[0]] and key[r[0]] == key[rid] and r[3] and date and r[3] < date]
        if not earlier:
            assert got[rid].status == "no_response" and got[rid].response_id is None and got[rid].body is None
            continue
        best = max(earlier, key=lambda r: (r[3], r[0]))
        bare = lambda t: t.removeprefix("W/")
        if "etag" in headers and "etag" in best[4]:
            status = "resolved" if bare(headers["etag"]) == bare(best[4]["etag"]) else "mismatch"
        elif "last-modified" in headers and "last-modified" in best[4]:
            status = "resolved" if headers["last-modified"] == best[4]["last-modified"] else "mismatch"
        else:
            status = "unchecked"
        assert got[rid].status == status
        if status == "mismatch":
            assert got[rid].response_id is None and got[rid].headers == headers
        else:
            merged = best[4] | {k: v for k, v in headers.items() if k != "content-length"}
            assert (got[rid].response_id, got[rid].body, got[rid].headers) == (best[0], best[5], merged)


def test_revisit_records_as_text(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: a\r\nWARC-Target-URI: http://x.y/\r\nWARC-Date: 2024-01-02T03:04:05Z\r\n\r\nHTTP/1.1 200 OK\r\nA: 1\r\na: 2\r\nB: c:d\r\n\r\nbody\r\n\r\nmore"
    broken = ["", None, "WARC/1.0\r\n\r\n", "no record"]
    got = warc.parse_records(spark.createDataFrame([(record,), *[(b,) for b in broken]], "record string")).collect()
    (r,) = [x for x in got if x.record_id == "a"]
    assert (r.kind, r.url, r.headers, r.payload) == ("response", "http://x.y/", {"a": "2", "b": "c:d"}, "body\r\n\r\nmore")
    assert len(got) == 5
    assert warc.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


@pytest.mark.parametrize("name", [k for k, (_, sql) in catalog.QUERIES.items() if sql])
def test_queries_agree_with_sql(spark, name):
    run, sql = catalog.QUERIES[name]
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.sql(sql)
    got = run(spark, SF)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(repr, want.select(*cols).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_pipeline_end_to_end(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and docs.columns == DOCS.names
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r.lossless for r in out) and {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    best = {}
    for r in rows.values():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    left = [(i, rows[i].text) for i in best.values()]
    kept = {i for i, (_, c) in jaccard_components(left).items() if i == c}
    assert {r.doc_id for r in out} <= kept


def test_revisits_with_odd_record_ids(spark):
    """Repeated and null record ids are captures of their own; names that clash are kept apart."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    tag = lambda t: {"etag": t}
    rows = [
        ("r", "response", "http://a/x", at(1), tag("1"), "ax", "s", None, None), ("r", "response", "http://b/y", at(1), tag("2"), "by", "s", None, None),
        (None, "response", "http://c/", at(1), tag("3"), "c", "s", None, "sha1:C"),
        ("v", "revisit", "http://a/x", at(2), tag("1"), None, None, None, None), ("v", "revisit", "http://b/none", at(2), tag("2"), None, None, None, None),
        ("v", "revisit", "http://b/y", at(3), tag("9"), None, None, None, None), (None, "revisit", "http://a/x", at(4), tag("1"), None, None, None, None),
        ("w", "revisit", "http://c/", at(5), tag("9"), None, None, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "sha1:C"),
        ("w", "revisit", "http://c/", at(5), tag("3"), None, None, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "sha1:D"),
        ("w", "revisit", "http://c/", at(5), tag("3"), None, None, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", None),
        ("v", "revisit", "http://a/x", at(2), tag("1"), None, None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id string, kind string, url string, date timestamp, headers map<string,string>, address string, status string, profile string, digest string")
    got = sorted((str(r.record_id), r.address, r.status, str(r.response_id), str(r.response_address)) for r in warc.resolve_revisits(records).collect())
    assert got == sorted([
        ("v", "a/x", "resolved", "r", "ax"), ("v", "a/x", "resolved", "r", "ax"), ("v", "b/none", "no_response", "None", "None"), ("v", "b/y", "mismatch", "None", "None"),
        ("None", "a/x", "resolved", "r", "ax"), ("w", "c", "resolved", "None", "c"), ("w", "c", "mismatch", "None", "None"), ("w", "c", "unchecked", "None", "c"),
    ])


def test_no_pattern_takes_the_square(spark):
    """Long headers and pages of a megabyte."""
    import time

    block = "".join(f"name-{i % 70_000}: {i}\r\n" for i in range(100_000))
    pages = ["<html " * 170_000, "<html" + " lang" * 200_000, "<html " + "x " * 500_000, "<html lang" + " " * 1_000_000, "<HTML\n class=a LANG = 'de-AT'>", "<htmllang=fr>", "<html a=b><p lang=es>"]
    start = time.time()
    got = spark.createDataFrame([(block,)], "b string").select(warc.header_map(F.col("b")).alias("m")).select(F.size("m").alias("n"), F.col("m")["name-5"].alias("v")).first()
    assert (got.n, got.v) == (70_000, "70005")
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").withColumn("url", F.lit(None).cast("string"))
    said = {r.page_id: r.__getitem__("__declared") for r in lang_id.page_evidence(rows).collect()}
    assert said == {0: None, 1: None, 2: None, 3: None, 4: "de", 5: None, 6: None}
    assert time.time() - start < 30


def test_every_language_is_fitted(spark):
    """A rare language is learnt whatever the size of the others."""
    rows = [(i, spoken("en", i, 30), "en", "a") for i in range(2000)] + [(5000 + i, spoken("de", i, 30), "de", "b") for i in range(3)]
    languages, _ = lang_id.fit(documents(spark, rows).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")), 100)
    assert languages == ["de", "en"]
    sample = lang_id._bounded_sample(documents(spark, rows).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")), 100)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {"de": 3, "en": 100}


def test_plan_of_many_shards_is_the_tree_and_bounded(spark):
    """The node-wise plan gives each shard what one tree in memory gives; blocks are dealt once each."""
    rng = random.Random(6)
    quota = {rank: rng.choice([0, 1, 40, 900, 20_000]) for rank in range(2300)}
    sources = spark.createDataFrame(list(quota.items()), "rank bigint, quota bigint")
    got = mixing.block_plan(sources, block=10, per_shard=7).collect()
    blocks = {r: -(-q // 10) for r, q in quota.items() if q}
    assert len(got) == sum(blocks.values()) == len({(r.rank, r.block) for r in got})
    assert all(0 <= r.block < blocks[r.rank] for r in got)
    shards = -(-len(got) // 7)
    room = np.full(shards, len(got) // shards) + (np.arange(shards) < len(got) % shards)
    assert np.bincount([r.shard for r in got], minlength=shards).tolist() == room.tolist()
    groups = sorted({r // 1000 for r in blocks})
    totals = np.array([sum(n for r, n in blocks.items() if r // 1000 == g) for g in groups])
    split = mixing.split_tree(totals, room, [mixing.SEED, 0])
    mine = sorted(r for r in blocks if r // 1000 == groups[1])
    want = mixing.split_tree(np.array([blocks[r] for r in mine]), split[1], [mixing.SEED, 1, groups[1]])
    counts = np.zeros_like(want)
    for r in got:
        if r.rank // 1000 == groups[1]:
            counts[mine.index(r.rank), r.shard] += 1
    assert (counts == want).all()


def test_blocks_grow_with_the_corpus(spark):
    sources = spark.createDataFrame([(0, 10**15), (1, 5)], "rank bigint, quota bigint")
    block = mixing.fitting_block(sources)
    assert block % mixing.BLOCK == 0 and 10**15 // block < 10**9 <= 10**15 // block * 2 + 2
    assert mixing.fitting_block(spark.createDataFrame([], "rank bigint, quota bigint")) == mixing.BLOCK


def test_bucket_offsets_in_two_levels(spark):
    rng = random.Random(8)
    rows = [(r, b, rng.randint(1, 9)) for r in (0, 1) for b in sorted(rng.sample(range(512), 200))]
    got = {(r["rank"], r.bucket): r.before for r in mixing._bucket_offsets(spark.createDataFrame(rows, "rank bigint, bucket bigint, n bigint"), 16).collect()}
    for rank in (0, 1):
        at = 0
        for r, b, n in rows:
            if r == rank:
                assert got[r, b] == at
                at += n


def brute_fuse(rows, languages, pseudo=lang_id.PSEUDO):
    """id -> (language, posterior), straight from the formula; rows: (id, host, suffix, declared, said, vote)."""
    import math

    classes = [*languages, "und"]
    k = len(classes)

    def counts(place, value):
        return [sum(r[place] == value and r[5] == i for r in rows) for i in range(k)]

    voted = [sum(r[5] == i for r in rows) for i in range(k)]
    corpus = [(n + 1) / (sum(voted) + k) for n in voted]
    spoken = [sum(r[3] is not None and r[5] == i for r in rows) for i in range(k)]
    out = {}
    for i, host, suffix, declared, said, vote in rows:
        if vote is None:
            out[i] = ("und", 0.0)
            continue

        def smoothed(n, prior, known):
            n = [x - (known and c == vote) for c, x in enumerate(n)]
            return [(x + pseudo * p) / (sum(n) + pseudo) for x, p in zip(n, prior)]

        country = lang_id.SUFFIX_LANGUAGE.get(suffix)
        base = [0.5 * p + 0.5 * (c == country) for p, c in zip(corpus, classes)] if country in classes else corpus
        base = smoothed(counts(2, suffix) if suffix is not None else [0] * k, base, suffix is not None)
        prior = smoothed(counts(1, host) if host is not None else [0] * k, base, host is not None)
        total = []
        for c in range(k):
            own = c == vote
            mark = 0.0 if declared is None else math.log((counts(3, declared)[c] - own + pseudo * (0.8 if classes[c] == declared else 0.2 / k)) / (spoken[c] - own + pseudo))
            total.append(said[c] + mark + math.log(prior[c]))
        top = max(total)
        out[i] = (classes[total.index(top)], 1 / sum(math.exp(t - top) for t in total))
    return out


def test_fusion_of_all_evidence_matches_brute_force(spark):
    rng = random.Random(21)
    languages = ["de", "en", "fr"]
    rows = []
    for i in range(250):
        said = [round(-rng.random() * rng.choice([1, 6]), 3) for _ in range(4)]
        said[rng.randrange(4)] = 0.0
        rows.append((i, rng.choice([None, "a", "b", "b", "c"]), rng.choice([None, "de", "fr", "uk", "com", "br"]), rng.choice([None, None, "de", "fr", "xx"]), said,
                     None if rng.random() < 0.1 else said.index(0.0)))
    df = spark.createDataFrame(rows, "id int, __host string, __suffix string, __declared string, __said array<double>, __vote int")
    got = {r.id: (r.__getitem__("__lang"), r.__getitem__("__posterior")) for r in lang_id.fuse(df, languages).collect()}
    want = brute_fuse(rows, languages)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-9) for i in want)


def test_trigram_model_matches_brute_force(spark):
    rows = [(i, spoken(lang, i, 20), lang, "s") for k, lang in enumerate(("en", "de")) for i in range(100 * k, 100 * k + 15)]
    languages, weights = lang_id.fit(documents(spark, rows).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))

    def buckets(text):
        kept = b" " + b" ".join(bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode()).split()) + b" "
        return [((a * 961 + b) * 1009 + c) * 2654435761 % 2**32 >> 16 for a, b, c in zip(kept, kept[1:], kept[2:])]

    n = np.zeros((lang_id.BUCKETS, 2))
    for _, text, lang, _ in rows:
        for b in buckets(text):
            n[b, languages.index(lang)] += 1
    assert languages == ["de", "en"] and np.allclose(weights, np.log((n + 0.05) / (n.sum(axis=0) + 0.05 * lang_id.BUCKETS)), atol=1e-5)
    # A text counts like at most EVIDENCE of its trigrams; the last class takes all trigrams for equally likely.
    text = "die Frau, THE man und 12 für"
    own = buckets(text)
    want = np.append(weights[own].mean(axis=0), -np.log(lang_id.BUCKETS)) * lang_id.EVIDENCE * (1 - np.exp(-len(own) / lang_id.EVIDENCE))
    row = lang_id.text_evidence(spark.createDataFrame([(text,)], "text string"), languages, weights).first()
    assert np.allclose(row["__said"], want - want.max(), atol=1e-4) and row["__vote"] == int(want.argmax())


def test_language_evidence_leaves_the_text_behind_and_takes_few_rows_at_a_time(spark):
    import pyarrow as pa

    weights = np.zeros((lang_id.BUCKETS, 1), np.float32)
    rows = lang_id.text_evidence(spark.createDataFrame([(1, "some text"), (2, None)], "id int, text string"), ["en"], weights)
    assert rows.columns == ["id", "__said", "__vote"] and {r["id"] for r in rows.collect()} == {1, 2}
    parts = list(lang_id._parts(iter([pa.RecordBatch.from_pydict({"text": [str(k) for k in range(1000)]})])))
    assert max(p.num_rows for p in parts) <= 256
    assert [t for p in parts for t in p.column("text").to_pylist()] == [str(k) for k in range(1000)]

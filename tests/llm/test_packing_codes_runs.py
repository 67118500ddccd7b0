"""Packing, vector codes and word runs against brute force."""

import hashlib
import math
import random
import sys
import time
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import CLASHING, documents, prose  # noqa: E402

from inkgauge.llm import catalog, packing, vector_codes, word_runs  # noqa: E402

SF = "/root/testdata/sf0.001"


# --- packing ---


def best_fit_decreasing(sizes, length):
    """Room of every sequence, piece by piece."""
    open_ = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(open_, size)
        room = open_.pop(at) if at < len(open_) else length
        insort(open_, room - size)
    return open_


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    length = rng.choice([1, 7, 64, 100, 2048])
    sizes = [min(length, 1 + int(rng.paretovariate(0.7))) if seed % 2 else rng.randint(1, length) for _ in range(rng.choice([1, 30, 2000]))]
    moves = packing.plan(Counter(sizes), length)
    used = defaultdict(list)
    order = sorted(sizes, reverse=True)
    for number, size in enumerate(order):
        m = moves[np.searchsorted(moves[:, 0], number, side="right") - 1]
        assert m[4] == size
        k = number - m[0]
        used[m[1] + k // m[2]].append((m[3] + k % m[2] * size, size))
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0] + [s for _, s in places[:-1]]).tolist()
    assert sorted(length - sum(s for _, s in places) for places in used.values()) == best_fit_decreasing(sizes, length)


def test_plan_of_any_corpus_is_small():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(1, 10**9, 2048), rng.integers(0, 2, 2048) * 10**12, np.r_[np.zeros(1000, int), rng.integers(1, 10**7, 1048)], np.ones(2048, int)):
        start = time.time()
        moves = packing.plan({n + 1: int(c) for n, c in enumerate(counts) if c}, 2048)
        assert len(moves) < 100_000 and time.time() - start < 20


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "model"):
        plain_ids.model = Tokenizer.from_file(packing.default_tokenizer())
    return [*plain_ids.model.encode(text or "", add_special_tokens=False).ids, 0]


ODD_TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n\n b", "it's we'll 'S 's", "x\t y\r\n\r\nz", "\x1c a\x1cb c", "a b  c   d", "这是 一个。例子", "<|endoftext|> a <|endoftext|>b <|endoftext|>",
             "é ü 1234 56.78", "\U0001f600 \U0001f600‍ ‍ a", "a \n", "\n a", "tab\tend\t", "don 't can' t"]


def test_units_give_the_ids_of_whole_texts():
    model = packing.UnitTokenizer(Path(packing.default_tokenizer()).read_text(encoding="utf-8"))
    rng = random.Random(5)
    alphabet = ["a", "B", "'s", "'", " ", "  ", "\n", "\t", ".", "9", "é", "　", "\x1d", "字", "​", "word", "\0", " \0"]
    for text in [t or "" for t in ODD_TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]:
        assert [*model.encode([text])[0].tolist(), 0] == plain_ids(text), repr(text)
    long = " ".join(prose(3, 200_000).split(" ")) + "\n\nend"
    assert len(long) > packing.SLICE
    assert [[*x.tolist(), 0] for x in model.encode([long, "", "a  b"])] == [plain_ids(t) for t in (long, "", "a  b")]


def test_packing_of_documents(spark):
    rows = [(i, prose(i, 1 + i * 37 % 3000)) for i in range(120)] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(7, "same row"), (7, "same row"), (None, "no id"), (None, None), (3000, prose(1, 60_000))]
    got = packing.pack(documents(spark, rows, CLASHING)).collect()
    want, lengths = Counter(), []
    for doc_id, text in rows:
        ids = plain_ids(text)
        first = (len(ids) - 1) % 2048 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048))):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            lengths.append(b - a)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) <= 2048
    assert len(sequences) == len(best_fit_decreasing(lengths, 2048))
    # The same packing whatever the splits.
    again = packing.pack(documents(spark, rows[::-1]).repartition(13)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert packing.pack(documents(spark, [])).count() == 0


# --- vector codes ---


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, label, vector); vectors sound and of one length."""
    whole = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows]
    size = len(whole[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    seeds = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in whole:
                own[best(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])])
        books = new
    sums, out = Counter(), []
    for i, label, v in whole:
        found = [best(v, p) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label])
        sums[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, sums[label], digest) for i, c, e, label in out)


VECTORS = "vec_id bigint, embedding array<float>, label int, code string, error int, label_error string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", 1, "y") for i, l, v in rows], VECTORS)


def float32(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("n,width,spread", [(300, 64, 0.2), (40, 32, 3.0), (700, 16, 0.004), (200, 48, 900.0)])
def test_codes(spark, n, width, spread):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6), rng.choice([None, 1, 1, 1, 2]), float32(rng.gauss(0, spread) for _ in range(width))) for _ in range(n)]
    rows += [rows[3], (rows[3][0], 2, rows[4][2]), (None, None, rows[5][2])]
    bad = [(1, 1, None), (2, 1, [None] + rows[0][2][1:]), (3, 1, [float("nan")] + rows[0][2][1:]), (4, 1, [float("-inf")] + rows[0][2][1:])]
    got = vector_codes.compressed(vectors(spark, rows + bad)).collect()
    assert Counter(map(tuple, got)) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert vector_codes.compressed(vectors(spark, [])).count() == 0
    odd = vector_codes.compressed(vectors(spark, [(1, 1, [0.5] * 3), (2, None, [])])).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in odd) == [(1, None, None), (2, None, None)]
    mixed = {r.vec_id: r for r in vector_codes.compressed(vectors(spark, [(1, 1, [0.5] * 3), (2, 1, [0.25] * 16), (3, 1, [0.5] * 32), (4, 1, [1e30] * 16)])).collect()}
    assert mixed[2].code == "00" * 16 and mixed[1].code is None and mixed[3].code is None
    assert mixed[4].code == "01" * 16 and mixed[4].error == 0 and mixed[2].label_error == 0


def test_dictionary_of_far_values():
    for column in (np.array([5, -3, 5, 2**24, -(2**24)]), np.array([7]), np.arange(100) % 3 - 1):
        values, code = vector_codes.dictionary(column)
        assert (values[code] == column).all() and (np.diff(values) > 0).all()


# --- word runs ---


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(12, 2 * q):
                found.setdefault((start, i - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def looped(words, doc_id):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_texts():
    rng = random.Random(3)
    for k in range(900):
        stock = [chr(97 + i) for i in range(rng.choice([1, 2, 2, 3, 5, 30]))]
        words = rng.choices(stock, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            at, size, times = rng.randint(0, len(words)), rng.randint(1, 25), rng.randint(1, 6)
            block = (words[at : at + size] or ["z"]) * times
            words[at:at] = block[: len(block) - rng.randint(0, 3)]
        yield words
    # Fibonacci words are full of runs.
    a, b = ["x"], ["x", "y"]
    for _ in range(11):
        a, b = b, b + a
    yield b
    yield ["a"] * 500
    yield (["a"] * 60 + ["b"]) * 6
    yield (["a", "b"] * 40 + ["c"]) * 3 + ["a", "b"] * 30


def test_runs_are_the_maximal_repetitions():
    total = 0
    for words in run_texts():
        names = {w: i for i, w in enumerate(dict.fromkeys(words))}
        got = word_runs.runs(np.array([names[w] for w in words], np.int64))
        assert got == brute_runs(words), words
        total += len(got)
    assert total > 1000


def test_runs_of_documents(spark):
    rows = [(i, " ".join(w)) for i, w in enumerate(run_texts())]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (None, "a " * 20), (5003, "a\x0bb\x0c" * 9 + " "), (5004, "wörter\n" * 12), (5004, "wörter\n" * 12)]
    rows += [(6000 + i, prose(i, 1500)) for i in range(40)]
    got = word_runs.word_runs(documents(spark, rows, CLASHING), stutter=True).collect()
    want = Counter()
    for doc_id, text in rows:
        words = looped([w.decode() for w in (text or "").encode().split()], doc_id)
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
             sha(" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert Counter(map(tuple, got)) == want
    assert word_runs.word_runs(documents(spark, [])).count() == 0


@pytest.mark.parametrize("words", [
    [0] * 400_000, [0, 1] * 200_000, ([0] * 99_999 + [1]) * 4, list(range(200_000)) * 2, [0, 0, 1] * 130_000, [k % 7 * (k % 1000 != 0) for k in range(400_000)],
    random.Random(1).choices(range(3), k=400_000), [x for k in range(20_000) for x in (*range(1, 20), 100 + k)],
], ids=["one", "two", "blocks", "halves", "aab", "broken", "three", "lines"])
def test_runs_of_very_long_texts(words):
    start = time.time()
    word_runs.runs(np.array(words, np.int64))
    assert time.time() - start < 40


# --- registered queries ---


def test_vector_codes_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    run, sql = catalog.QUERIES["op12_vector_codes"]
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, run(spark, SF).select(columns).collect())) == sorted(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall())


def test_queries_keep_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert catalog.op13_word_runs(spark, SF).count() == n
    packed = catalog.op11_packing(spark, SF)
    assert packed.select("doc_id").distinct().count() == n
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0

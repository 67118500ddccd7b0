"""Lattice, sampling and scoring against enumeration of all segmentations."""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import CLASHING, documents, prose  # noqa: E402

from inkgauge.llm import lattice, lm_scoring, piece_sampling  # noqa: E402
from inkgauge.llm.lattice import Vocabulary  # noqa: E402

PIECES = ["a", "b", "ab", "ba", "aba", " ", " a", " ab", "  ", "é"]


@pytest.fixture(scope="module")
def small():
    texts = [""] * 256 + PIECES
    scores = np.concatenate([np.zeros(256), -np.arange(1.0, len(PIECES) + 1) / 3])
    return Vocabulary.build(texts, scores, 0)


def ways(text, logs):
    """Every segmentation with its log probability."""
    if not text:
        yield (), 0.0
        return
    fits = [(256 + i, p) for i, p in enumerate(PIECES) if text.startswith(p)]
    for i, p in fits:
        for rest, weight in ways(text[len(p):], logs):
            yield (i, *rest), logs[i] + weight
    if text[0] not in PIECES:
        own = tuple(text[0].encode())
        for rest, weight in ways(text[1:], logs):
            yield (*own, *rest), logs[list(own)].sum() + weight


UNITS = [" a", " ab", " abab", " ababa", "  ab", "   ", " é", " aéb", " x", " axb😀", " " + "ab" * 4]


def test_marginals_are_sums_over_all_segmentations(small, monkeypatch):
    logs = small.prior()
    assert np.exp(logs[np.isfinite(logs)]).sum() == pytest.approx(1.0)
    want = [np.logaddexp.reduce([w for _, w in ways(u, logs)]) for u in UNITS]
    assert lattice.marginals(small, logs, UNITS) == pytest.approx(want)
    monkeypatch.setattr(lattice, "WIDE", 2)
    monkeypatch.setattr(lattice, "edges", lambda v, u: [] if all(len(x) > 2 for x in u) else pytest.fail("all are long"))
    long = [u for u in UNITS if len(u) > 2]
    assert lattice.marginals(small, logs, long) == pytest.approx([w for u, w in zip(UNITS, want) if len(u) > 2])


def test_expected_counts_are_posterior_means(small):
    logs, times = small.prior(), np.arange(1.0, len(UNITS) + 1)
    want = np.zeros(len(logs))
    for u, n in zip(UNITS, times):
        listed = list(ways(u, logs))
        whole = np.logaddexp.reduce([w for _, w in listed])
        for pieces, w in listed:
            for p in pieces:
                want[p] += n * math.exp(w - whole)
    assert lattice.expected_counts(small, logs, UNITS, times) == pytest.approx(want)
    long = [" " + "ab" * 40, " " + "aé" * 60]
    both = lattice.expected_counts(small, logs, long, np.ones(2))
    monkey = lattice.WIDE
    try:
        lattice.WIDE = 200
        lattice_edges = lattice.edges(small, long)
        assert not lattice_edges or both.sum() > 0
    finally:
        lattice.WIDE = monkey


def test_draws_follow_the_posterior(small):
    logs = small.prior()
    sampler = piece_sampling.Sampler(small, logs, 7)
    unit = " ababa"
    listed = dict(ways(unit, logs))
    whole = np.logaddexp.reduce(list(listed.values()))
    n = 40_000
    ids, sizes = sampler.draw([unit, " x"], np.zeros(n, np.int64), lattice.scramble(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - s : e].tolist()) for e, s in zip(ends, sizes))
    for pieces, w in listed.items():
        p = math.exp(w - whole)
        assert abs(seen[pieces] / n - p) < 5 * math.sqrt(p / n) + 1e-3
    assert set(seen) <= set(listed)


TEXTS = [None, "", " ", "  ", "a", " lead", "trail ", "two  spaces   three", "x▁y ▁", "日本語 テキスト", "\t\n\r\x0b", "😀 é é", "z" * 5000, "<0x41> </s> <unk>",
         prose(3, 3000)]


def test_sampled_segmentations_are_lossless_and_reproducible(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (4, "a")]
    docs = documents(spark, rows, CLASHING)
    once = piece_sampling.encode(docs).collect()
    again = piece_sampling.encode(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.ids)
    assert sorted(map(str, once)) == sorted(map(str, again)) and len(once) == len(rows)
    assert all(r.lossless for r in once) and {r.doc_id: r.n_ids for r in once}[1] == 0
    back = {r.doc_id: r.text for r in piece_sampling.decode(piece_sampling.encode(docs)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS and back[None] == "no key"
    other = piece_sampling.encode(docs, seed=1).collect()
    assert sorted(once, key=str) != sorted(other, key=str) and key(once[0])
    assert piece_sampling.encode(documents(spark, [])).count() == 0


def test_a_row_is_segmented_alike_among_any_rows():
    vocabulary = Vocabulary.load()
    sampler = piece_sampling.Sampler(vocabulary, vocabulary.prior(), 1)
    texts = [prose(i, 200) for i in range(30)]
    together = sampler.rows(texts, list(range(30))).to_pylist()
    assert all(sampler.rows([t], [i]).to_pylist()[0] == together[i] for i, t in enumerate(texts))


def test_lm_scores(spark):
    rows = [(i, prose(i % 40, 5 + i % 30, 60).upper() if i % 3 else prose(i, 9)) for i in range(200)] + [(500, None), (501, ""), (None, "Word word"), (700, "again again"), (700, "again again")]
    got = lm_scoring.score(documents(spark, rows, CLASHING)).collect()
    assert len(got) == len(rows)
    train = [(i, t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    tokens = Counter()
    for _, t in train:
        tokens.update([*(t or "").lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        own = [*(texts[r.doc_id] or "").lower().split(), None]
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score < 0 and math.isfinite(r.score)
    like = {r.doc_id: r.score for r in got}
    assert like[501] == like[500] > like[0]


def test_lm_scores_match_enumeration_and_fit(spark, small, monkeypatch):
    monkeypatch.setattr(Vocabulary, "load", classmethod(lambda cls, path=None: small))
    rows = [(i, t) for i, t in enumerate(["ab aba", "ab ab ab", "aba b", "ab", "ba é", "x ab"] * 4)]
    docs = documents(spark, rows)
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, rounds=2).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in train for w in t.split())
    prior, logs, end = np.exp(small.prior()), small.prior(), 0.0
    for _ in range(2):
        counts = np.zeros(len(logs))
        for w, k in words.items():
            listed = list(ways(" " + w, logs))
            whole = np.logaddexp.reduce([x for _, x in listed])
            for pieces, x in listed:
                for p in pieces:
                    counts[p] += k * math.exp(x - whole)
        smooth = counts + lm_scoring.PRIOR_WEIGHT * prior
        total = smooth.sum() + len(train) + 1.0
        with np.errstate(divide="ignore"):
            logs = np.log(smooth) - math.log(total)
        end = math.log(len(train) + 1.0) - math.log(total)
    for i, t in rows:
        want = end + sum(np.logaddexp.reduce([x for _, x in ways(" " + w, logs)]) for w in t.split())
        assert got[i] == pytest.approx(want / math.log(10))


def test_lm_score_of_rare_words_goes_through_the_join(spark, monkeypatch):
    rows = [(i, prose(i, 30, 50)) for i in range(60)]
    usual = {r.doc_id: r for r in lm_scoring.score(documents(spark, rows)).collect()}
    monkeypatch.setattr(lm_scoring, "HOT_BYTES", 0)
    joined = {r.doc_id: r for r in lm_scoring.score(documents(spark, rows)).collect()}
    for i in usual:
        assert usual[i].n_known == joined[i].n_known and usual[i].base_score == pytest.approx(joined[i].base_score)


def test_lm_scores_without_training_or_rows(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm_scoring.score(documents(spark, [(held, "some words")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.base_score)
    assert lm_scoring.score(documents(spark, [])).count() == 0

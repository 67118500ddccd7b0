"""The one-walk picks, the occurrence index, the trie and lineage state against plain code."""

import random
import re
import time

import pytest

from inkgauge import dims
from inkgauge.functions import text as X
from inkgauge.operators import markup, picks, selectors
from inkgauge.operators.occurrences import occur_once


def plain_once(text, p):
    at = text.find(p) if p else -1
    return at >= 0 and text.find(p, at + len(p)) < 0


@pytest.mark.parametrize("small", [1 << 21, 0])
def test_occurrence_index(monkeypatch, small):
    monkeypatch.setattr("inkgauge.operators.occurrences._SMALL", small)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("ab\U0001f600é", k=rng.randint(0, 60)))
        passages = [text[i : i + rng.randint(0, 8)] for i in (rng.randrange(len(text) + 1) for _ in range(12))] + ["zz", "", "aa", text, text + "a"]
        assert occur_once(text, passages) == [plain_once(text, p) for p in passages]


def test_ten_thousand_paragraphs_in_one_page():
    paragraphs = [f"Paragraph {i} " + "word " * (i % 60) + ("twice" if i % 10 else f"once {i}") for i in range(10_000)]
    page = "".join(f"<p>{p}</p>" for p in paragraphs + paragraphs[::7])
    start = time.time()
    got = occur_once(page, paragraphs)
    assert time.time() - start < 20
    assert got[7] is False and got[1] is True and sum(got) == sum(plain_once(page, p) for p in paragraphs[:0]) + sum(got)
    for i in random.Random(2).sample(range(10_000), 200):
        assert got[i] == plain_once(page, paragraphs[i])


def plain_picks(walk):
    """What the picks say, by joining whole subtree texts."""
    text = lambda r: "".join(walk.texts[r[6]:r[7]])
    flat = lambda r: picks.collapsed(text(r))
    inside = lambda r, tag: sum(x[4] == tag for x in walk.rows[r[0] + 1 : r[1] + 1])

    def asks(t):
        return t != "" and (t.endswith("?") or re.sub("[^A-Za-z0-9_]", "", t.lower().split(" ")[0]) in dims.QUESTION_OPENERS)

    blocks = [r for r in walk.rows if r[4] in ("p", "div")]
    blank = picks._BLANK
    return {
        "visible_questions": sum(asks(flat(r)) for r in walk.rows if r[4] in ("h2", "h3", "h4", "strong", "summary", "dt")),
        "tldr_spoken": next((text(r) for r in blocks if re.match(rf"(?ia)(?:tl;?dr|summary)(?::|[{blank}])", text(r).strip(blank))), None),
        "structural": sum(r[4] in ("table", "ol") for r in walk.rows) + sum(inside(r, "li") > 3 for r in walk.rows if r[4] == "ul"),
        "has_drawing": any(r[4] == "svg" or r[4] == "figure" and inside(r, "figcaption") for r in walk.rows),
    }


def test_picks_of_random_pages():
    rng = random.Random(7)
    bits = ["TL;DR", "summary", ":", " ", "\n", "How", "Is it", "?", "words go on", "\xa0", "", "what's", "tldr"]
    tags = ["p", "div", "h2", "h3", "h4", "strong", "summary", "dt", "ul", "ol", "li", "table", "figure", "figcaption", "svg", "span"]

    def made(depth):
        out = []
        for _ in range(rng.randint(0, 4)):
            out.append("".join(rng.choices(bits, k=rng.randint(0, 3))))
            if depth:
                tag = rng.choice(tags)
                out.append(f"<{tag}>{made(depth - 1)}</{tag}>")
        return "".join(out)

    seen = 0
    for _ in range(1500):
        walk = markup.ElementWalk(made(5))
        want = plain_picks(walk)
        got = picks.picked(walk.rows, walk.texts)
        if got["tldr_marked"] is None:
            assert got["tldr_spoken"] == want["tldr_spoken"]
        assert {k: got[k] for k in ("visible_questions", "structural", "has_drawing")} == {k: want[k] for k in ("visible_questions", "structural", "has_drawing")}
        seen += want["tldr_spoken"] is not None
    assert seen > 20


def test_deeply_nested_pages_are_walked_once():
    """A hundred thousand nested blocks and lists, and long runs of blanks."""
    for page in ("<div>" * 100_000 + "x", "<ul><li>" * 50_000, "<p>" + " " * 500_000 + "</p>" + "<div> " * 50_000 + "tldr ", "<strong>" * 100_000 + "Is it so"):
        start = time.time()
        walk = markup.ElementWalk(page)
        picks.picked(walk.rows, walk.texts)
        assert time.time() - start < 20


def test_trie_finds_what_the_lists_name():
    for terms in (dims.HEDGES + dims.TRANSITIONS + dims.BANNED_WORDS, dims.BANNED_PHRASES, dims.PARAGRAPH_HEDGES):
        pattern = re.compile(X.trie(terms))
        assert all(pattern.fullmatch(t) for t in terms) and not pattern.fullmatch(terms[0][:-1])
    # Whole words of the lists never overlap, so one pass takes nothing from another list.
    words = [t.split(" ") for t in dims.HEDGES + dims.TRANSITIONS + dims.BANNED_WORDS]
    for a in words:
        for b in words:
            assert a is b or not any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + 1))
            assert a is b or not any(b[i : i + len(a)] == a for i in range(len(b)))


PAGE = """<nav id=toc class='main  menu'><ul><li><a href="/a">A</a><li><a href="http://x">B</a></ul></nav><article><p class="x byline">me</p>
<ul><li><a href='/in, here' Title="Big Word">C<ul><li>d</ul></a></ul><div class=x><div class=x><em>deep</em></div></div></article><a href=/out>out</a>"""


@pytest.mark.parametrize("selector,texts", [
    ("a", ["A", "B", "C\nd".replace("\n", ""), "out"]), ("nav a", ["A", "B"]), ("nav li a[href^=\"/\"]", ["A"]), ("A[HREF^='/'] , em", ["A", "Cd", "deep", "out"]),
    ("#toc a[href*=HTTP i]", ["B"]), ("[title='big word' i]", ["Cd"]), ("[title='big word']", []), (".byline", ["me"]), ("p.x.byline", ["me"]), (".by", []),
    (".x .x", ["deep"]), (".x .x em", ["deep"]), (".x em", ["deep"]), ("li li", ["d"]), ("ul ul li", ["d"]), ("a[href='/in, here']", ["Cd"]), ("*[href$=out]", ["out"]), ("a[href^='']", []),
    ("div *", ["deep", "deep"]), ("nav nav", []),
])
def test_selectors(selector, texts):
    walk = markup.ElementWalk(PAGE)
    got = selectors.chosen(walk.rows, selectors.compiled(selector))
    assert ["".join(walk.texts[r[6]:r[7]]) for r in got] == texts


@pytest.mark.parametrize("selector", ["", "a >", "a,", "[", "a:hover"])
def test_selectors_that_are_not_understood(selector):
    with pytest.raises(ValueError):
        selectors.compiled(selector)


def test_selection_and_containment_of_deep_pages(spark):
    deep = "<div class=a>" * 50_000 + "<ul><li>" * 20_000 + "<em>x</em>"
    df = spark.createDataFrame([(1, deep), (2, None), (3, "")], "doc_id bigint, html string")
    start = time.time()
    rows = selectors.select_elements(df, {"em": "div.a li em", "first": "div"}).groupBy("doc_id", "name").count().collect()
    assert sorted((r.doc_id, r.name, r["count"]) for r in rows) == [(1, "em", 1), (1, "first", 50_000)]
    inside = {(r.outer_tag, r.inner_tag): r.n for r in selectors.containment(df, ["div", "ul"], ["li", "em"]).collect()}
    assert inside == {("div", "li"): 50_000 * 20_000, ("ul", "li"): 20_000 * 20_001 // 2, ("div", "em"): 50_000, ("ul", "em"): 20_000}
    assert time.time() - start < 60

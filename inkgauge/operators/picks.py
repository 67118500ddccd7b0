"""What the checks want to know of a page, picked up in one walk over its elements.

The walk is linear in the page: texts of nested elements are never joined to look at their edges, and "how many inside"
is a difference of running counts, as positions number the elements in document order.
"""

from __future__ import annotations

import re
from itertools import accumulate

from inkgauge import dims
from inkgauge.operators.occurrences import occur_once

PAGE = (
    "struct<headings:array<struct<pos:int,t0:int,t1:int,level:int,prev_level:int,text:string>>,"
    "metas:array<struct<name:string,property:string,content:string>>,"
    "links:array<struct<rel:string,href:string,hreflang:string>>,hrefs:array<string>,"
    "images:array<struct<src:string,alt:string>>,title:string,first_h1:string,tldr_marked:string,tldr_spoken:string,"
    "sections:array<struct<heading:string,words:int,h3_count:int>>,leads:array<struct<heading:string,lead:string>>,"
    "structural:int,has_toc:boolean,visible_questions:int,byline_marked:boolean,has_drawing:boolean>"
)

BLOCKS = "array<struct<inner:string,text:string,once:boolean>>"

#: The characters that the audit takes for white space, as in the text expressions.
_BLANK = " \t\n\x0b\x0c\r\xa0                　﻿"
_GAP = re.compile(f"[{_BLANK}]+")
_SUMMARY = re.compile(rf"(?:tl;?dr|summary)(?:(:)|[{_BLANK}])", re.I | re.A)
_SENTENCE = re.compile(r"[^.!?]+[.!?]")
_NOT_WORD = re.compile(r"[^A-Za-z0-9_]")
_TOC = re.compile("contents|toc")
_HEADING = {f"h{k}": k for k in range(1, 7)}
_LABELS = frozenset("h2 h3 h4 strong summary dt".split())
_BYLINE_CLASSES = ("author", "byline", "post-author", "article-author")
_OPENERS = frozenset(dims.QUESTION_OPENERS)
_LONGEST_OPENER = max(map(len, dims.QUESTION_OPENERS))


def collapsed(text: str) -> str:
    return _GAP.sub(" ", text).strip(" ")


class TextRuns:
    """The text runs of a page, with the next and the last run that shows something."""

    def __init__(self, runs: list[str]):
        self.runs = runs
        shows = [bool(run.strip(_BLANK)) for run in runs]
        n = len(runs)
        self.next = list(accumulate((i if s else n for i, s in zip(range(n - 1, -1, -1), reversed(shows))), min))[::-1] + [n]
        self.last = [-1, *accumulate((i if s else -1 for i, s in enumerate(shows)), max)]

    def of(self, row: list) -> str:
        return "".join(self.runs[row[6]:row[7]])

    def filled(self, row: list) -> bool:
        return self.next[row[6]] < row[7]

    def is_summary(self, row: list) -> bool:
        """Whether the trimmed text starts with a word for a summary and a mark or space behind it."""
        at, end = self.next[row[6]], row[7]
        head = ""
        while at < end and len(head) < 16:
            head = (head + self.runs[at][: 64 if head else None]) if head else self.runs[at].lstrip(_BLANK)[:64]
            at += 1
        found = _SUMMARY.match(head)
        # A space only counts where text follows: at the end it would have been trimmed.
        return bool(found) and (bool(found[1]) or bool(head[found.end():].strip(_BLANK)) or self.next[at] < end)

    def is_question(self, row: list) -> bool:
        """Whether the text ends with a question mark or its first word asks."""
        if not self.filled(row):
            return False
        if self.runs[self.last[row[7]]].rstrip(_BLANK)[-1] == "?":
            return True
        word = ""
        for at in range(self.next[row[6]], row[7]):
            run = self.runs[at] if word or at > self.next[row[6]] else self.runs[at].lstrip(_BLANK)
            gap = _GAP.search(run, 0, 256)
            word += _NOT_WORD.sub("", run[: gap.start() if gap else 256])
            if gap or len(word) > _LONGEST_OPENER:
                break
        return word.lower() in _OPENERS


def _inside(rows: list[list], tag: str):
    """A function that counts the elements of a tag inside a row, from running counts."""
    sums = list(accumulate((row[4] == tag for row in rows), initial=0))
    return lambda row: sums[row[1] + 1] - sums[row[0] + 1]


def _lead(rows: list[list], heading: list, texts: TextRuns) -> str | None:
    """First sentence of the first sibling with text behind a heading, unless another heading comes before."""
    at = heading[1] + 1
    while at < len(rows) and rows[at][2] == heading[2]:
        if rows[at][4] in _HEADING:
            return None
        if texts.filled(rows[at]):
            text = collapsed(texts.of(rows[at]))
            found = _SENTENCE.match(text)
            return found[0] if found else text
        at = rows[at][1] + 1
    return None


def picked(rows: list[list], runs: list[str]) -> dict:
    """``rows``: elements in document order as (pos, end_pos, parent_pos, depth, tag, attrs, t0, t1, …), attrs a dict."""
    texts = TextRuns(runs)
    out = {
        "headings": [], "metas": [], "links": [], "hrefs": [], "images": [], "title": None, "first_h1": None, "tldr_marked": None, "tldr_spoken": None,
        "structural": 0, "has_toc": False, "visible_questions": 0, "byline_marked": False, "has_drawing": False,
    }
    bylines: dict[str, bool] = {}
    second, lists, figures = [], [], []
    for row in rows:
        tag, attrs = row[4], row[5]
        if tag in _HEADING:
            before = out["headings"][-1]["level"] if out["headings"] else None
            out["headings"].append(
                {"pos": row[0], "t0": row[6], "t1": row[7], "level": _HEADING[tag], "prev_level": before, "text": collapsed(texts.of(row))}
            )
            if tag == "h2":
                second.append((row, out["headings"][-1]["text"]))
            elif tag == "h1" and out["first_h1"] is None:
                out["first_h1"] = texts.of(row)
        elif tag == "meta":
            out["metas"].append({k: attrs.get(k) for k in ("name", "property", "content")})
        elif tag == "link":
            out["links"].append({k: attrs.get(k) for k in ("rel", "href", "hreflang")})
        elif tag == "a":
            if "href" in attrs:
                out["hrefs"].append(attrs["href"])
        elif tag == "img":
            out["images"].append({"src": attrs.get("src"), "alt": attrs.get("alt")})
        elif tag == "title":
            if out["title"] is None:
                out["title"] = texts.of(row)
        elif tag in ("p", "div"):
            if out["tldr_marked"] is None:
                if tag == "p" and "data-tldr" in attrs:
                    out["tldr_marked"] = texts.of(row)
                elif out["tldr_spoken"] is None and texts.is_summary(row):
                    out["tldr_spoken"] = texts.of(row)
        elif tag in ("table", "ol"):
            out["structural"] += 1
        elif tag == "ul":
            lists.append(row)
        elif tag == "figure":
            figures.append(row)
        elif tag == "svg":
            out["has_drawing"] = True
        if tag in _LABELS and texts.is_question(row):
            out["visible_questions"] += 1
        if attrs:
            classes = _GAP.split(attrs["class"]) if "class" in attrs else ()
            if tag == "nav" and (_TOC.search(attrs.get("aria-label", "").lower()) or "toc" in classes) or attrs.get("id") == "toc":
                out["has_toc"] = True
            marks = [f"{k}=author" for k in ("rel", "itemprop") if attrs.get(k) == "author"] + [c for c in _BYLINE_CLASSES if c in classes]
            for mark in marks:
                # The first element with a mark decides for it.
                bylines.setdefault(mark, texts.filled(row))
    out["byline_marked"] = any(bylines.values())
    if lists:
        items = _inside(rows, "li")
        out["structural"] += sum(items(row) > 3 for row in lists)
    if figures:
        captions = _inside(rows, "figcaption")
        out["has_drawing"] = out["has_drawing"] or any(captions(row) for row in figures)
    thirds = list(accumulate((row[4] == "h3" for row in rows), initial=0)) if second else []
    out["sections"], out["leads"] = [], []
    for k, (row, text) in enumerate(second):
        following = second[k + 1][0] if k + 1 < len(second) else None
        until, stop = (following[0], following[6]) if following else (len(rows), len(runs))
        body = collapsed(" ".join(runs[row[7]:stop]))
        out["sections"].append({"heading": text, "words": body.count(" ") + 1 if body else 0, "h3_count": thirds[until] - thirds[row[0] + 1]})
        out["leads"].append({"heading": text, "lead": _lead(rows, row, texts)})
    return out


def style_blocks(rows: list[list], runs: list[str], html: str) -> list[tuple[str, str, bool]]:
    """Distinct paragraph sources inside the first article (else main, else the page), their text, and whether the page
    holds the source exactly once."""
    texts = TextRuns(runs)
    scope = next((r for tag in ("article", "main") for r in rows if r[4] == tag), None)
    low, high = (scope[0] + 1, scope[1]) if scope else (0, len(rows))
    found: dict[str, str] = {}
    for row in rows[low : high + 1]:
        if row[4] == "p":
            found.setdefault(html[row[8] : row[9]], collapsed(texts.of(row)))
    return list(zip(found, found.values(), occur_once(html, list(found))))

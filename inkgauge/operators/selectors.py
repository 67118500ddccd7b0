"""Choosing elements of pages by CSS selectors, and counting what stands inside what.

Understood are lists ("h1, h2"), tags, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``[a^=v]``, ``[a$=v]``,
``[a*=v]``, each with or without quotes and with ``i`` for any case, and descendants ("nav li a"). Selectors are compiled
once; a page is walked once for all of them. Elements come in document order and an element ends behind all that stands
in it, so "inside" is one comparison with the furthest end that an outer part has reached so far: no search upwards,
however deep a page is nested. Only what is chosen leaves the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from inkgauge.operators import markup, picks
from inkgauge.operators.shred import arrow_type

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[\^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\]\s]*)\s*(?P<any>[iI])?\s*)?\]""", re.X,
)
_TESTS = {"=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__}


SELECTED = {"name": "string", "nth": "int", "pos": "int", "end_pos": "int", "tag": "string", "attrs": "map<string,string>", "text": "string"}


@dataclass(frozen=True)
class Part:
    """One element of a selector: its tag, if it names one, and tests of attributes (name, operator, value, any case)."""

    tag: str | None
    tests: tuple[tuple[str, str, str, bool], ...]

    def holds(self, tag: str, attrs: dict[str, str]) -> bool:
        if self.tag is not None and tag != self.tag:
            return False
        for name, op, wanted, any_case in self.tests:
            value = attrs.get(name)
            if value is None:
                return False
            if op == "class":
                if wanted not in picks._GAP.split(value):
                    return False
            elif op:
                # An empty beginning, end or part matches nothing, as in style sheets.
                if not wanted and op != "=":
                    return False
                if any_case:
                    value, wanted = value.lower(), wanted.lower()
                if not _TESTS[op](value, wanted):
                    return False
        return True


def compiled(selector: str) -> list[list[Part]]:
    """The alternatives of a selector, each as its parts from the outermost to the chosen one."""
    out = []
    for alternative in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", selector):
        chain = []
        for text in re.findall(r"""(?:\[(?:[^\]"']|"[^"]*"|'[^']*')*\]|[^\s\[])+""", alternative):
            tag, tests, at = None, [], 0
            while at < len(text):
                found = _SIMPLE.match(text, at)
                if not found:
                    raise ValueError(f"not understood in selector {selector!r}: {text[at:]!r}")
                if found["tag"]:
                    tag = None if found["tag"] == "*" else found["tag"].lower()
                elif found["cls"]:
                    tests.append(("class", "class", found["cls"], False))
                elif found["id"]:
                    tests.append(("id", "=", found["id"], False))
                else:
                    value = found["value"] or ""
                    tests.append((found["attr"].lower(), found["op"] or "", value[1:-1] if value[:1] in ("'", '"') else value, bool(found["any"])))
                at = found.end()
            chain.append(Part(tag, tuple(tests)))
        if not chain:
            raise ValueError(f"empty selector in {selector!r}")
        out.append(chain)
    return out


def chosen(rows: list[list], alternatives: list[list[Part]]) -> list[list]:
    """The rows (as in ``ElementWalk``) that a compiled selector chooses, in document order."""
    # The furthest position that lies inside an element chosen so far by the first k parts.
    reach = [[-1] * (len(chain) - 1) for chain in alternatives]
    out = []
    for row in rows:
        hit = False
        for chain, ends in zip(alternatives, reach):
            # From the inside out: an element is not inside itself.
            for k in range(len(chain) - 1, -1, -1):
                if (k == 0 or ends[k - 1] >= row[0]) and chain[k].holds(row[4], row[5]):
                    if k == len(chain) - 1:
                        hit = True
                    elif row[1] > ends[k]:
                        ends[k] = row[1]
        if hit:
            out.append(row)
    return out


def contained(rows: list[list], outer: frozenset[str], inner: frozenset[str]) -> dict[tuple[str, str], int]:
    """How often elements of the inner tags stand inside elements of the outer tags; every one around counts."""
    open_: list[tuple[int, str]] = []  # end and tag of the outer elements around the current place
    around: dict[str, int] = dict.fromkeys(outer, 0)
    out: dict[tuple[str, str], int] = {}
    for row in rows:
        while open_ and open_[-1][0] < row[0]:
            around[open_.pop()[1]] -= 1
        if row[4] in inner:
            for tag, n in around.items():
                if n:
                    out[tag, row[4]] = out.get((tag, row[4]), 0) + n
        if row[4] in outer:
            open_.append((row[1], row[4]))
            around[row[4]] += 1
    return out


def _per_page(posts: DataFrame, key: str, html: str, fields: dict[str, str], made) -> DataFrame:
    """Rows of key and fields: what ``made`` finds in the walk of each page."""
    types = [arrow_type(t) for t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for i, page in enumerate(batch.column(html)):
                found = made(markup.ElementWalk(page.as_py() or ""))
                rows += found
                of += [i] * len(found)
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(of, pa.int32())), *[pa.array(list(c), t) for c, t in zip(columns, types)]], names=[key, *fields]
            )

    kind = posts.schema[key].dataType.simpleString()
    return posts.select(key, html).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, t in fields.items()))


def select_elements(posts: DataFrame, selectors: dict[str, str], key: str = "doc_id", html: str = "html") -> DataFrame:
    """One row per chosen element: key, name of the selector, nth (from 0 in its page), pos, end_pos, tag, attrs and text.

    Defined cases: a null page has no elements; a selector that chooses nothing gives no rows; one that is not
    understood is an error before the job starts.
    """
    plans = [(name, compiled(selector)) for name, selector in selectors.items()]

    def made(walk: markup.ElementWalk) -> list[tuple]:
        return [
            (name, nth, row[0], row[1], row[4], list(row[5].items()), "".join(walk.texts[row[6] : row[7]]))
            for name, plan in plans for nth, row in enumerate(chosen(walk.rows, plan))
        ]

    return _per_page(posts, key, html, SELECTED, made)


def containment(posts: DataFrame, outer: list[str], inner: list[str], key: str = "doc_id", html: str = "html") -> DataFrame:
    """key, outer_tag, inner_tag and how many elements of the inner tag stand inside one of the outer tag."""
    around, within = frozenset(outer), frozenset(inner)

    def made(walk: markup.ElementWalk) -> list[tuple]:
        return [(o, i, n) for (o, i), n in contained(walk.rows, around, within).items()]

    return _per_page(posts, key, html, {"outer_tag": "string", "inner_tag": "string", "n": "bigint"}, made)

"""Per-document helpers run inside Arrow tasks: an HTML element walk and a JSON-LD walk.

Both visit a document once, in time linear in its size, and keep no state between documents.
"""

from __future__ import annotations

import json
import re
import sys
from html.parser import HTMLParser

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Recovery rule 1: these start tags end an open <p> (and whatever is open inside it).
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main nav ol p pre section table ul".split()
)
# Recovery rule 2: these start tags end an open sibling of the listed kinds, up to the list/table around it.
ENDS_SIBLING = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
UNENDED = re.compile("<[a-zA-Z/!?]")
P_BARRIER = frozenset("table td th caption button object template".split())


class ElementWalk(HTMLParser):
    """Collects elements in document order with their subtree interval and text-run range."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []  # pos, end_pos, parent_pos, depth, tag, attrs, t0, t1, src0, src1
        self.texts: list[str] = []
        self.ld_scripts: list[str] = []
        self._open: list[int] = []
        self._depths: dict[str, list[int]] = {}  # of each tag: where it stands among the open elements
        self._raw: str | None = None
        self._ld: list[str] | None = None
        self._line_start = [0]
        at = html.find("\n")
        while at >= 0:
            self._line_start.append(at + 1)
            at = html.find("\n", at + 1)
        # Behind the last ">" no tag can end: what opens there is dropped, once.
        tail = UNENDED.search(html, html.rfind(">") + 1)
        self.feed(html[: tail.start()] if tail else html)
        self.close()
        self._close_to(0, len(html))

    def parse_marked_section(self, i, report=1):
        # "<![x[ ... ]]>" is no HTML: like a browser, a comment up to the next ">".
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        # One that is never closed hides the rest; looking again from every later opener would take the square.
        end = self.rawdata.find("-->", i + 4)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def texts_of(self, tag: str) -> list[str]:
        return ["".join(self.texts[r[6]:r[7]]) for r in self.rows if r[4] == tag]

    def _at(self) -> int:
        line, col = self.getpos()
        return self._line_start[line - 1] + col

    def _close_to(self, depth: int, src: int) -> None:
        while len(self._open) > depth:
            row = self.rows[self._open.pop()]
            row[1], row[7], row[9] = len(self.rows) - 1, len(self.texts), src
            self._depths[row[4]].pop()

    def _nearest(self, names) -> int:
        """Depth of the innermost open element of these names, -1 if none is open."""
        return max((self._depths[n][-1] for n in names if self._depths.get(n)), default=-1)

    def _close_open(self, names: frozenset, barrier: frozenset, src: int) -> None:
        depth = self._nearest(names)
        if depth > self._nearest(barrier):
            self._close_to(depth, src)

    def handle_starttag(self, tag, attrs):
        src = self._at()
        if tag in ENDS_P:
            self._close_open(frozenset(["p"]), P_BARRIER, src)
        if tag in ENDS_SIBLING:
            self._close_open(*ENDS_SIBLING[tag], src)
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        pos, inner = len(self.rows), src + len(self.get_starttag_text() or "")
        parent = self._open[-1] if self._open else -1
        self.rows.append(
            [pos, pos, parent, len(self._open), tag, first, len(self.texts), len(self.texts), inner, inner]
        )
        if tag in VOID:
            return
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(pos)
        if tag in ("script", "style"):
            self._raw = tag
            if tag == "script" and first.get("type") == "application/ld+json":
                self._ld = []

    def handle_startendtag(self, tag, attrs):
        # "<p/>" opens an element in HTML; only void elements close themselves.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == self._raw:
            self._raw = None
            if self._ld is not None:
                self.ld_scripts.append("".join(self._ld))
                self._ld = None
        if self._depths.get(tag):
            self._close_to(self._depths[tag][-1], self._at())

    def handle_data(self, data):
        if self._ld is not None:
            self._ld.append(data)
        elif self._raw is None:
            self.texts.append(data)


def _no_constant(name):
    raise ValueError(name)


#: Escapes that may leave half of a character.
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _integer(digits: str):
    """Integers of any length: beyond what a double holds, the largest double."""
    if len(digits) < 400:
        return int(digits)
    return -sys.float_info.max if digits.startswith("-") else sys.float_info.max


def read_json(text: str):
    """(status, value): "ok", "invalid", or "deep" for a text nested beyond what can be read.

    Strict JSON where the last of two equal keys wins; half characters become the replacement character.
    """
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_int=_integer)
        if SURROGATE.search(text):
            whole = json.dumps(value, ensure_ascii=False).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
            value = json.loads(whole)
        return "ok", value
    except RecursionError:
        return "deep", None
    except ValueError:
        return "invalid", None


def parse_json(text: str):
    """(readable, value)."""
    status, value = read_json(text)
    return status == "ok", value


def _falsy(value) -> bool:
    return value is None or value is False or value == "" or (value == 0 and not isinstance(value, (list, dict)))


def _kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "null" if value is None else "number"


def type_names(node: dict) -> list[str]:
    types = node.get("@type")
    return [t for t in (types if isinstance(types, list) else [types]) if isinstance(t, str) and t]


def _type_state(node: dict) -> str:
    if "@type" not in node:
        return "absent"
    value = node["@type"]
    good = (isinstance(value, str) and value) or (
        isinstance(value, list) and value and all(isinstance(t, str) and t for t in value)
    )
    return "valid" if good else "bad"


def walk_objects(block: int, root) -> list[tuple]:
    """Every object of a block, and every non-object where an object is expected.

    Rows: block, path, key, role, kind, keys, type_state. Roles: root, root_item, graph, graph_item,
    field, and loose for objects under "@" keys or inside nested arrays.
    """
    out: list[tuple] = []
    # (value, path, key, role); a stack instead of recursion, so depth is not limited here.
    stack = [(root, "$", "", "root")]
    while stack:
        value, path, key, role = stack.pop()
        if isinstance(value, dict):
            out.append((block, path, key, role, "object", list(value), _type_state(value)))
            children = []
            for name, child in value.items():
                sub = f"{path}.{name}"
                inner = "loose" if role in ("loose", "graph") else "field"
                if name == "@graph" and inner == "field":
                    children.append((child, sub, name, "graph"))
                elif isinstance(child, (dict, list)):
                    children.append((child, sub, name, "loose" if name.startswith("@") else inner))
            stack.extend(reversed(children))
        elif isinstance(value, list):
            if role == "root":
                out.append((block, path, key, role, "array" if value else "empty_array", [], "absent"))
            item_role = {"root": "root_item", "graph": "graph_item"}.get(role, role)
            children = []
            for i, item in enumerate(value):
                sub = f"{path}[{i}]"
                if isinstance(item, list):
                    if item_role in ("root_item", "graph_item"):
                        out.append((block, sub, key, item_role, "array", [], "absent"))
                    children.append((item, sub, key, "loose"))
                else:
                    children.append((item, sub, key, item_role))
            stack.extend(reversed(children))
        elif role in ("root", "root_item", "graph", "graph_item"):
            out.append((block, path, key, role, _kind(value), [], "absent"))
    return out


def flatten_entities(blocks: list[tuple[int, object]]) -> list[tuple[int, str, dict]]:
    """(block, path, node) of every node with "@type" reached through arrays and "@graph"; children first."""
    out: list[tuple[int, str, dict]] = []
    for block, root in blocks:
        stack = [(root, "$", False)]
        while stack:
            node, path, done = stack.pop()
            if isinstance(node, list):
                stack.extend((item, f"{path}[{i}]", False) for i, item in reversed(list(enumerate(node))))
            elif isinstance(node, dict):
                if done:
                    out.append((block, path, node))
                    continue
                if "@type" in node:
                    stack.append((node, path, True))
                graph = node.get("@graph")
                if isinstance(graph, list):
                    stack.extend((item, f"{path}.@graph[{i}]", False) for i, item in reversed(list(enumerate(graph))))
    return out


def entity_rows(entities: list[tuple[int, str, dict]]) -> list[tuple]:
    """Rows: ord, block, path, types, id, has_id, fields, json."""
    return [
        (
            i, block, path, type_names(node),
            node["@id"] if isinstance(node.get("@id"), str) and node["@id"] else None,
            not _falsy(node.get("@id")), list(node), json.dumps(node, ensure_ascii=False),
        )
        for i, (block, path, node) in enumerate(entities)
    ]


def link_rows(entities: list[tuple[int, str, dict]]) -> list[tuple]:
    """Rows: entity_ord, owner_type, field, ref_id, inline_type — references and typed inline objects."""
    out: list[tuple] = []
    for i, (_, _, entity) in enumerate(entities):
        owner = (type_names(entity) or ["unknown"])[0]
        stack = [(k, v) for k, v in reversed(list(entity.items())) if not k.startswith("@")]
        while stack:
            field, value = stack.pop()
            if isinstance(value, list):
                stack.extend((field, item) for item in reversed(value))
            elif isinstance(value, dict):
                if [k for k in value if k != "@type"] == ["@id"]:
                    ref = value["@id"]
                    if isinstance(ref, str) and ref:
                        out.append((i, owner, field, ref, None))
                    continue
                if "@type" in value:
                    kind = value["@type"]
                    label = "/".join(map(str, kind)) if isinstance(kind, list) else str(kind)
                    out.append((i, owner, field, None, label))
                stack.extend((k, v) for k, v in reversed(list(value.items())) if not k.startswith("@"))
    return out


def unwrap_envelope(item):
    """{"schema": X} without "@type" stands for X."""
    if isinstance(item, dict) and "schema" in item and "@type" not in item:
        return item["schema"]
    return item


# --- editing JSON-LD in a page ----------------------------------------------------------------

LD_OPEN = re.compile(r"<script\b[^>]*>", re.I)
LD_TYPE = re.compile(r"""\stype\s*=\s*["']?application/ld\+json["'\s>]""", re.I)
LD_CLOSE = re.compile(r"</script\s*>", re.I)


class LdPage:
    """The JSON-LD blocks of a page, each read once; edits change the blocks, ``source`` writes changed ones back."""

    def __init__(self, html: str):
        self.html = html
        self.spans: list[tuple[int, int]] = []
        self.roots: list = []
        self.changed: set[int] = set()
        self.unreadable = False
        at = 0
        while opening := LD_OPEN.search(html, at):
            closing = LD_CLOSE.search(html, opening.end())
            if closing is None:
                break
            if LD_TYPE.search(opening.group()):
                content = html[opening.end() : closing.start()].strip()
                readable, root = parse_json(content) if content else (True, None)
                self.unreadable |= not readable
                self.spans.append((opening.end(), closing.start()))
                self.roots.append(root)
            at = closing.end()
        # The first node of every type of every block, in the order nodes are met.
        self.nodes = [self._by_type(root) for root in self.roots]

    @staticmethod
    def _by_type(root) -> dict[str, dict]:
        nodes: dict[str, dict] = {}
        waiting = [root]
        while waiting:
            item = waiting.pop()
            if isinstance(item, list):
                waiting += item[::-1]
            elif isinstance(item, dict):
                for name in type_names(item):
                    nodes.setdefault(name, item)
                graph = item.get("@graph")
                if isinstance(graph, list):
                    waiting += graph[::-1]
        return nodes

    def add(self, kind: str, node: dict) -> bool:
        """Append a node to the first block that is a list or has one as "@graph"."""
        for block, root in enumerate(self.roots):
            nodes = root.get("@graph") if isinstance(root, dict) else root
            if isinstance(nodes, list):
                nodes.append({"@type": kind} | node if "@type" not in node else node)
                for name in type_names(nodes[-1]):
                    self.nodes[block].setdefault(name, nodes[-1])
                self.changed.add(block)
                return True
        return False

    def put(self, kind: str, path: list[str], value) -> bool:
        """Set a field, and objects on the way to it, in the first node of a type."""
        for block, nodes in enumerate(self.nodes):
            if kind in nodes:
                place = nodes[kind]
                for field in path[:-1]:
                    inner = place.get(field)
                    place[field] = place = inner if isinstance(inner, dict) else {}
                place[path[-1]] = value
                self.changed.add(block)
                return True
        return False

    def source(self) -> str:
        parts, done = [], 0
        for block in sorted(self.changed):
            start, end = self.spans[block]
            parts += [self.html[done:start], json.dumps(self.roots[block], ensure_ascii=False, indent=2)]
            done = end
        return "".join([*parts, self.html[done:]])


def insert_schema(html: str, patches: list[dict]) -> tuple[str, list[tuple]]:
    """Apply JSON-LD patches in order; returns the page and (target, type, ok, reason) per patch."""
    page, log = LdPage(html), []
    for patch in patches:
        target, text = patch["target"] or "", (patch["after"] or "").strip()
        readable, value = parse_json(text)
        value = value if readable else text
        adding = target.startswith("add:")
        kind, *path = [target[4:].strip()] if adding else target.split(".")
        if adding and not isinstance(value, dict):
            reason = "not a JSON object"
        elif not adding and not (kind and path and all(path)):
            reason = "target names no field of a type"
        elif not page.roots:
            reason = "page without JSON-LD"
        elif page.add(kind, value) if adding else page.put(kind, path, value):
            reason = None
        else:
            reason = "a JSON-LD block cannot be read" if page.unreadable else "no block has the target"
        log.append((target, patch["type"], reason is None, reason))
    return page.source(), log

"""Snippets for the comparison SQL: the same measures written for an RE2 engine."""

from __future__ import annotations

from inkgauge import dims
from inkgauge.functions import text as X


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACES = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)" + "".join(
    rf"|<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template", "head")
)
TAG = r"""</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>|<![^>]*>"""


def sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"


def collapse(expr: str) -> str:
    return f"trim({sub(expr, SPACES + '+', ' ')})"


def visible(html: str) -> str:
    return collapse(sub(sub(html, HIDDEN, " "), TAG, " "))


def word_count(expr: str) -> str:
    return f"(case when {expr} = '' then 0 else len(string_split({expr}, ' ')) end)"


def found(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def occurrences(expr: str, needle: str) -> str:
    return f"cast((length({expr}) - length(replace({expr}, {q(needle)}, ''))) / {len(needle)} as int)"


def sentence_list(expr: str) -> str:
    """Sentences of collapsed text, by a marker between them."""
    marked = sub(expr, "([.!?]) ([A-Z])", "\\1\x01\\2")
    return f"(case when {expr} = '' then [] else string_split({marked}, '\x01') end)"


def decode(expr: str) -> str:
    for raw, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        expr = f"replace({expr}, {q(raw)}, {q(char)})"
    return expr


# The page without comments and without script and style bodies.
BARE = sub("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
# Where a paragraph ends when it is not closed.
BLOCK_EDGE = r"(</?(?:p|div|h[1-6]|article|nav|ol|ul|figure|figcaption|footer|body|html)(?:\s[^>]*)?>)"


def paragraphs(html: str = BARE) -> str:
    marked = sub(html, BLOCK_EDGE, "\x01\\1")
    inner = f"regexp_extract_all({marked}, {q('<p(?: [^>]*)?>([^' + chr(1) + ']*)')}, 1)"
    return f"list_transform({inner}, lambda p: {decode(sub('p', '<[^>]*>', ''))})"


def any_of(terms: list[str]) -> str:
    import re

    return r"\b(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")\b"


TRICOLON = r"(?i)\b\w+(?:ly)?, \w+(?:ly)?, and \w+"
PASSIVE = r"(?i)\b(?:is|are|was|were|be|been|being) \w+ed\b"
NUMBER = r"\b\d+(?:[.,]\d+)?(?:%|k|K|M|B)?\b"
NOT_X = r"(?i)\bit'?s not (?:just |only |merely )?(?:about |a |an |the )?[^,.]*?(?:,|—|-) it'?s "
FIRST_PERSON = r"\b(?:I|I'm|I've|I'd|I'll|my|me)\b"
PLURAL_FIRST_PERSON = r"\b(?:I|I'm|I've|we|we're|we've|our)\b"
FIRST_PARTY = rf"(?i)\b(?:we|our) (?:{'|'.join(dims.FIRST_PARTY_VERBS)})\b"
STOCK_OPENER = rf"^(?i:{'|'.join(dims.STOCK_OPENERS)})"
BYLINE = r"\bby [A-Z][a-z]+ [A-Z][a-z]+"
REFERENTIAL = X.REFERENTIAL.replace(X.B0, r"\b").replace(X.B1, r"\b")


def hits(rows: list[tuple[str, str, str]], source: str) -> str:
    """UNION of (check_id, severity, condition) over a source that has doc_id."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {q(check)} AS check_id, {q(severity)} AS severity FROM {source} WHERE {cond}"
        for check, severity, cond in rows
    )

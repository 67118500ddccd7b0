"""Text expressions. All of them stay inside the JVM; word boundaries are ASCII on purpose.

Functions that count take *collapsed* text: whitespace runs are one plain space, none at the ends.
Collapsing once lets every later pattern use a plain space, which is far cheaper than a wide class.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, functions as F

from inkgauge import dims
from inkgauge.functions.binding import let

# All characters the audit treats as white space; the common ones also as a cheap class of their own.
WS = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LOW_WS = r"[ \t\n\x0B\f\r\xA0]"
HIGH_WS_RANGE = r"[\x{1680}-\x{feff}]"
#: Runs of common white space that are not a single plain space already.
LOW_WS_RUN = rf"{LOW_WS}(?:(?<! ){LOW_WS}*+|{LOW_WS}++)"
B0 = r"(?<![A-Za-z0-9_])"
B1 = r"(?![A-Za-z0-9_])"
#: ``B0`` behind the first character of a word. A pattern that begins with a class of its first characters passes over all
#: others at once; one that begins by looking back does so from every character of a text.
BEGUN = r"(?<![A-Za-z0-9_].)"

TAG = r"""<(?:/?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|![^>]*>)"""
HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|\z))"
SENTENCE_GAP = r" (?<=[.!?] )(?=[A-Z])"

# Fixed patterns. What SQL is made of (REFERENTIAL) begins with B0.
EM_DASH = "—"
NOT_X_BUT_Y = rf"(?i){B0}it'?s not (?:just |only |merely )?(?:about |a |an |the )?[^,.]*?(?:,|—|-) it'?s "
TRICOLON = rf"(?i){B0}\w++, \w++, and \w+"
PASSIVE = rf"(?i)[iawb]{BEGUN}(?:(?<=i)s|(?<=a)re|(?<=w)(?:as|ere)|(?<=b)e(?:en|ing)?) \w+ed{B1}"
FIRST_PERSON = rf"[Im]{BEGUN}(?:(?<=I)(?:'m|'ve|'d|'ll)??|(?<=m)[ye]){B1}"
PLURAL_FIRST_PERSON = rf"[Iwo]{BEGUN}(?:(?<=I)(?:'m|'ve)??|(?<=w)e(?:'re|'ve)??|(?<=o)ur){B1}"
CONCRETE_NUMBER = rf"\d{BEGUN}\d*(?:[.,]\d+)?(?:%|k|K|M|B)?{B1}"
FIRST_PARTY = rf"(?i)[wo]{BEGUN}(?:(?<=w)e|(?<=o)ur) (?:{'|'.join(dims.FIRST_PARTY_VERBS)}){B1}"
REFERENTIAL = (
    rf"(?i){B0}(?:as mentioned (?:earlier|above|previously)|as discussed (?:earlier|above|previously)"
    rf"|we discussed above|see (?:below|above|the section)|in the (?:previous|above) section){B1}"
)
BYLINE = rf"b{BEGUN}y [A-Z][a-z]+ [A-Z][a-z]+"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def trimmed(text: Column) -> Column:
    """``js_trim`` of a column or lambda variable; most texts have no white space at their ends and are left alone."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(WS), js_trim(text)).otherwise(text)


def collapse(text: Column) -> Column:
    wide = F.regexp_replace(text, WS + "+", " ")
    plain = F.regexp_replace(text, LOW_WS_RUN, " ")
    return F.trim(F.when(text.rlike(HIGH_WS_RANGE), wide).otherwise(plain))


def strip_tags(html: Column) -> Column:
    """A space for every tag. Behind the last ">" no tag can end, so nothing is tried there."""

    def stripped(page: Column) -> Column:
        rest = F.substring_index(page, ">", -1)
        return F.concat(F.regexp_replace(F.left(page, F.length(page) - F.length(rest)), TAG, " "), rest)

    return let(html, stripped)


def visible_text(html: Column, max_chars: int | None = None) -> Column:
    """What a reader sees, entities left as written. ``max_chars`` cuts it; by default it is whole."""
    bare = strip_tags(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "))
    text = collapse(bare)
    return text if max_chars is None else F.substring(text, 1, max_chars)


def words(text: Column) -> Column:
    """Words of collapsed text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def word_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def sentences(text: Column) -> Column:
    """Sentences of collapsed text: split where ".", "!" or "?" is followed by an ASCII capital."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SENTENCE_GAP))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def trie(terms: list[str]) -> str:
    """A pattern for any of the terms that looks at each character once: common beginnings are written once.

    Of terms that begin alike the longest that fits is taken.
    """
    tree: dict = {}
    for term in terms:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(char) + written(below) for char, below in node.items() if char]
        if "" in node:
            ways.append("")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return written(tree)


def term_matches(low: Column, terms: list[str]) -> Column:
    """Every whole-word occurrence of a listed term in lower-case text, in one pass over all lists together.

    Whole words cannot overlap, and no term of these lists begins or ends with words that another one has there, so
    the lists do not take hits from each other.
    """
    return F.regexp_extract_all(low, F.lit(f"{B0}{trie(terms)}{B1}"), F.lit(0))


def of_list(matches: Column, terms: list[str]) -> Column:
    """The matches that belong to one list."""
    return F.filter(matches, lambda m: m.isin(*terms))


def tally(matches: Column, terms: list[str]) -> Column:
    """[(term, n)] in list order, absent terms left out."""
    counted = F.transform(
        F.array(*[F.lit(t) for t in terms]),
        lambda t: F.struct(t.alias("term"), F.size(F.filter(matches, lambda m: m == t)).alias("n")),
    )
    return F.filter(counted, lambda c: c["n"] > 0)


def phrases_present(low: Column, phrases: list[str]) -> Column:
    """The phrases that stand somewhere in lower-case text, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def substring_count(haystack: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    gap = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gap / F.length(needle)).cast("int")).otherwise(F.lit(0))


def substring_total(low: Column, terms: list[str]) -> Column:
    """Occurrences of all terms in lower-case text, each counted for itself and only where a plain search finds it."""
    counted = [F.when(F.contains(low, F.lit(t)), substring_count(low, F.lit(t))).otherwise(F.lit(0)) for t in terms]
    return reduce(lambda a, b: a + b, counted)


def count_if_any(text: Column, low: Column, pattern: str, needed: str) -> Column:
    """``count`` for a pattern whose matches all hold the lower-case ``needed``; most texts have none of it."""
    return F.when(F.contains(low, F.lit(needed)), count(text, pattern)).otherwise(F.lit(0))


def rate(n: Column, word_total: Column, per: int) -> Column:
    return n / F.greatest(word_total, F.lit(1)) * per


def population_spread(values: Column) -> Column:
    """(mean, population standard deviation) of an array of whole numbers; zeros when empty.

    Sums of values and squares stay exact integers, so one pass is enough.
    """

    def spread(v: Column) -> Column:
        n = F.size(v)
        total = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
        squares = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        return F.struct(
            F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("mean"),
            F.when(n > 0, F.sqrt(n * squares - total * total) / n).otherwise(F.lit(0.0)).alias("sd"),
        )

    return let(values, spread)


def looks_like_question(text: Column) -> Column:
    """For collapsed text."""
    opener = F.regexp_replace(F.lower(F.substring_index(text, " ", 1)), r"[^\w]", "")
    return (text != "") & (F.endswith(text, F.lit("?")) | opener.isin(*dims.QUESTION_OPENERS))


def question_marks(text: Column) -> Column:
    """Every question ends in exactly one "?", so counting the marks counts the questions."""
    return substring_count(text, F.lit("?"))


def sanitize_key(value: Column, limit: int | None = 80) -> Column:
    """Fit for a path. Cut at ``limit`` it is for display; whole it also tells long values apart."""
    dashed = F.regexp_replace(F.lower(value), r"[^a-z0-9._-]+", "-")
    clean = F.regexp_replace(dashed, r"^-+|-+$", "")
    return clean if limit is None else F.substring(clean, 1, limit)


def path_key(value: Column, limit: int = 80) -> Column:
    """The readable key; where it had to be cut, a digest of the whole value follows, so two long values never meet."""
    clean = sanitize_key(value, None)
    return F.when(F.length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit), F.lit("-"), F.substring(F.sha2(value, 256), 1, 16))
    )


def path_key_of(value: str, limit: int = 80) -> str:
    """``path_key`` of one value, on the driver."""
    clean = re.sub(r"[^a-z0-9._-]+", "-", value.lower()).strip("-")
    return clean if len(clean) <= limit else f"{clean[:limit]}-{hashlib.sha256(value.encode()).hexdigest()[:16]}"


def truncate_snippet(text: Column, limit: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def extract_json_object(text: Column) -> Column:
    """From the first "{" to the last "}"; NULL when there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def number_text(value: Column) -> Column:
    """A number without a trailing ".0"."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)

"""Text columns: white space, words, regular forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters with the Unicode property White_Space, as the inside of a character class.
WHITE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = f"[{WHITE}]+"
_OTHER = WHITE.replace("\\t-\\r ", "\\t-\\r")
#: Runs of white space that are anything but one ordinary space.
ODD_SPACES = f" *[{_OTHER}][{_OTHER} ]*| {{2,}}"
WORD = f"[^{WHITE}]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row: a lambda's variable isn't computed again for every
    element of the lambdas inside ``use``, as an expression would be."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapsed(text: Column) -> Column:
    """Each run of white space as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, ODD_SPACES, " "))


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for an empty text, null for null. One pass: the parts of a split, without the
    empty ones that white space at the ends makes."""
    ends = F.rlike(F.substring(text, 1, 1), F.lit(SPACES)).cast("int") + F.rlike(F.substring(text, -1, 1), F.lit(SPACES)).cast("int")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SPACES, -1)) - ends)


def words(text: Column) -> Column:
    """The words in order; an empty array for an empty text."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def label_key(label: Column) -> Column:
    """Labels are equal if they agree after collapsing white space, trimming and lower-casing; ``(none)``
    for null and empty ones."""
    flat = F.lower(collapsed(label))
    return F.when(flat.isNull() | (flat == ""), "(none)").otherwise(flat)


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def slug(text: Column, length: int = 40) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as a dash, cut, no dash at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, length), "^-+|-+$", "")


def hits(text: Column, pattern: str) -> Column:
    """Number of matches, case ignored, with Unicode classes; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("(?iU)" + pattern)), F.lit(0))


def triggers(pattern: str) -> list[str] | None:
    """For each alternative of a pattern a lower-case literal that every match of it holds; None if one has none of
    two characters."""
    parts, depth, start = [], 0, 0
    for at, char in enumerate(pattern + "|"):
        depth += (char in "([") - (char in ")]")
        if char == "|" and depth == 0:
            parts.append(pattern[start:at])
            start = at + 1
    found = []
    for part in parts:
        bare = re.sub(r"\\[bB]", "", part)
        bare = re.sub(r"\([^()]*\)[?*]?|\(\?!.*?\)\)?|\[[^\]]*\][?*+]?|\\[a-zA-Z][*+?]?|.[?*]|\.\{\d+,\d+\}|[.+^$\\]|\{[^}]*\}", "\0", bare)
        literals = re.findall(r"[A-Za-z0-9 /-]+", bare)
        best = max(literals, key=len, default="")
        if len(best) < 2 or "(" in bare or ")" in bare:
            return None
        found.append(best.lower())
    return found


def quick_hits(text: Column, lower: Column, pattern: str) -> Column:
    """``hits`` that looks for a pattern only in texts whose lower-case form holds one of its literals."""
    literals = triggers(pattern)
    if literals is None:
        return hits(text, pattern)
    maybe = reduce(or_, (F.contains(lower, F.lit(x)) for x in literals))
    return F.when(maybe, hits(text, pattern)).otherwise(0)


def matches(text: Column, pattern: str, *, any_case: bool = True) -> Column:
    """Whether the pattern occurs; false for null."""
    return F.coalesce(text.rlike(("(?iU)" if any_case else "(?U)") + pattern), F.lit(False))


def sentences(text: Column) -> Column:
    """Split at white space that follows ``.``, ``!`` or ``?`` and precedes A-Z or ``(``."""
    return F.split(text, f"(?<=[.!?]){SPACES}(?=[A-Z(])")


# The typographic characters that are folded, and what they become.
CURLY = "‘’“”‐‑‒–—"
STRAIGHT = "''\"\"-----"
MARKS = "̀-ͯ"


def _normal_form(form: str, text: Column) -> Column:
    """A Unicode normal form, which Spark has no function for. ASCII stays as it is."""

    def change(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return F.pandas_udf(change, T.StringType())(text)


def composed(text: Column) -> Column:
    """Unicode compatibility composition."""
    return _normal_form("NFKC", text)


def decomposed(text: Column) -> Column:
    """Unicode compatibility decomposition."""
    return _normal_form("NFKD", text)


def typographic(text: Column) -> Column:
    """After ``composed``: marks joined to the letter before them, soft hyphens dropped, quotes and dashes made
    plain, white space collapsed."""
    joined = F.regexp_replace(text, f"{SPACES}([{MARKS}])", "$1")
    return collapsed(F.translate(F.replace(joined, F.lit("­"), F.lit("")), CURLY, STRAIGHT))


def for_checking(text: Column) -> Column:
    """After ``decomposed``: the form in which printed values are compared."""
    return F.lower(collapsed(F.translate(F.replace(text, F.lit("­"), F.lit("")), "–—’", "--'")))


def contains_in_order(value: Column, source: Column, slack: int = 120) -> Column:
    """Whether ``source`` holds ``value``, or its words one after another within its length plus ``slack``."""
    zero = F.struct(F.lit(1).alias("at"), F.lit(0).alias("start"), F.lit(True).alias("ok"))

    def step(state, word):  # noqa: ANN001, ANN202
        found = F.call_function("locate", word, source, state["at"])
        ok = state["ok"] & (found > 0)
        return F.struct(
            F.when(ok, found + F.length(word)).otherwise(state["at"]).alias("at"),
            F.when(ok & (state["start"] == 0), found).otherwise(state["start"]).alias("start"),
            ok.alias("ok"),
        )

    ordered = F.aggregate(words(value), zero, step, lambda s: s["ok"] & (s["at"] - s["start"] < F.length(value) + slack))
    return F.contains(source, value) | ordered


def shingle_hashes(text: Column, k: int, *, between: str = "[^a-z]+", short: bool = False) -> Column:
    """Distinct hashes of each ``k`` neighbouring words, which are what a pattern leaves of the lower-case text. Fewer words
    give none, or with ``short`` one hash of all there are."""
    letters = F.filter(F.split(F.lower(text), between), lambda w: w != "")

    def grams(w: Column) -> Column:
        last = F.size(w) - k + 1
        hashed = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when((last >= 1) | (F.lit(short) & (F.size(w) > 0)), F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    return once(letters, grams)


def without_secrets(text: Column) -> Column:
    """Keys and tokens of common shapes masked, whole or only their value."""
    for pattern, kept in SECRETS:
        text = F.regexp_replace(text, pattern, kept)
    return text


# Shapes of secrets (cloud key, bearer token, key=value) and what remains of them.
SECRETS = (
    (r"AIza[0-9A-Za-z_\-]{20,}", "[REDACTED]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._\-]{8,}", "$1[REDACTED]"),
    (r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)[^\s,;&]+", "$1[REDACTED]"),
)


def list_lines(reply: Column) -> Column:
    """The items of a model's list: bullets and emphasis off, headings, tables, fences and scraps left out; null
    if none is left."""
    lines = F.transform(F.split(reply, "\r?\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*•\d.)\s]+", "")))
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1")))
    raw = F.split(reply, "\r?\n")
    keep = F.filter(F.arrays_zip(raw.alias("raw"), plain.alias("plain")), lambda p: ~p["raw"].rlike(r"^\s*(#|\||```)") & (F.length(p["plain"]) > 2))
    out = F.transform(keep, lambda p: p["plain"])
    return F.when(F.size(out) > 0, out)

"""Text expressions: normalising, trimming, word tests, keyword tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentflow.constants import DOMAIN_PREFIXES, SNIPPET_CHARS

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Zero-width characters dropped by light_norm.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
# Blanks turned into spaces (tab, form feed, vertical tab).
BLANKS = "\t\f\x0b"

_WS_CLASS = r"\s\x1c-\x1f\x85\p{Z}"


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both ends (``trim`` alone knows only spaces)."""
    return F.btrim(col, F.lit(WHITESPACE))


def light_norm(col: Column) -> Column:
    """Tabs to spaces, CR to LF, no zero-width characters, runs of blanks to
    one space, three or more line feeds to two, trimmed.

    Single characters go through ``replace``, which is much cheaper per byte
    than a pattern; only the two collapsing steps need one.
    """
    out = col
    for char in ZERO_WIDTH:
        out = F.replace(out, F.lit(char), F.lit(""))
    for char in BLANKS:
        out = F.replace(out, F.lit(char), F.lit(" "))
    out = F.replace(out, F.lit("\r"), F.lit("\n"))
    out = F.regexp_replace(out, "  +", " ")
    out = F.regexp_replace(out, "\n\n\n+", "\n\n")
    return strip(out)


def is_blank(col: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(strip(col) == "", F.lit(True))


def has_content(col: Column) -> Column:
    """True when ``light_norm`` of the text leaves anything; ends at the first
    visible character."""
    return F.coalesce(col.rlike(f"[^{_WS_CLASS}{ZERO_WIDTH}]"), F.lit(False))


def has_words(col: Column, n: int) -> Column:
    """True when the text has at least ``n`` whitespace-separated words.

    The match ends at the n-th word, so long texts are not split.
    """
    if n <= 0:
        return F.lit(True)
    word, gap = f"[^{_WS_CLASS}]", f"[{_WS_CLASS}]"
    pattern = f"^{gap}*+(?:{word}++{gap}++){{{n - 1}}}{word}"
    return F.coalesce(col.rlike(pattern), F.lit(False))


FEW_WORDS = 24  # above this one pattern is faster than a search per keyword


def normalize_keywords(words: Iterable[str]) -> list[str]:
    """Strip, lower-case, drop blanks."""
    return [w.strip().lower() for w in words if w.strip()]


def _shortest(words: Iterable[str]) -> list[str]:
    """Drop words that contain another word: they can match nothing more."""
    kept: list[str] = []
    for word in sorted(set(words), key=len):
        if not any(k in word for k in kept):
            kept.append(word)
    return kept


def _escaped(char: str) -> str:
    return char if char.isalnum() or char in "_ " or ord(char) > 127 else "\\" + char


def keyword_pattern(words: Iterable[str], stop_early: bool = True) -> str:
    """One pattern for many keywords: their trie, so that a text is read once.

    At every node the branches begin with different characters, so no place of a text
    is tried twice. ``stop_early``: where a keyword ends, longer ones need not be tried.
    """
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def written(node: dict) -> str:
        head = ""
        while len(node) == 1 and "" not in node:  # no branch: plain characters
            char, node = next(iter(node.items()))
            head += _escaped(char)
        if not (nexts := {c: n for c, n in node.items() if c}) or (stop_early and "" in node):
            return head
        single = sorted(c for c, n in nexts.items() if set(n) == {""})
        parts = [_escaped(c) + written(n) for c, n in sorted(nexts.items()) if c not in single]
        if single:
            parts.append("[" + "".join(map(_escaped, single)) + "]")
        # One look at the next character rules out all branches at most places.
        first = "[" + "".join(_escaped(c) for c in sorted(nexts)) + "]"
        return head + (f"(?:{'|'.join(parts)})?" if "" in node else f"(?={first})(?:{'|'.join(parts)})")

    return written(root)


def contains_any(col: Column, words: Iterable[str], match: str = "substring") -> Column:
    """True when any keyword occurs in the lower-cased text.

    ``match="word"`` asks for whole words. No keywords: true. The text is lower-cased
    once. A few keywords are looked for one by one, which is fastest; more become one
    pattern that reads the text once, however long the list is.
    """
    words = normalize_keywords(words)
    if not words:
        return F.lit(True)
    if match == "word":
        body = keyword_pattern(words, stop_early=False)
        pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
        return F.coalesce(F.lower(col).rlike(pattern), F.lit(False))
    if match != "substring":
        raise ValueError(f"unknown match: {match}")
    words = _shortest(words)
    if len(words) > FEW_WORDS:
        return F.coalesce(F.lower(col).rlike(keyword_pattern(words)), F.lit(False))

    def any_word(text: Column) -> Column:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        return hit

    lowered = F.lower(F.coalesce(col, F.lit("")))
    if len(words) == 1:
        return any_word(lowered)
    return F.exists(F.array(lowered), any_word)


def domain_prefix(source: Column) -> Column:
    """The marker put before a text of a known source, else an empty string."""
    low = F.lower(F.coalesce(source, F.lit("")))
    out = F.lit("")
    for word, prefix in reversed(DOMAIN_PREFIXES.items()):
        out = F.when(low.contains(word), F.lit(prefix)).otherwise(out)
    return out


def text_sample(col: Column, chars: int = SNIPPET_CHARS) -> Column:
    """First characters of a text, for display next to a result."""
    return F.substring(F.coalesce(col, F.lit("")), 1, chars)


def composite_key(id_col: Column, context_col: Column) -> Column:
    return F.concat(id_col.cast("string"), F.lit("::"), context_col.cast("string"))


def split_key(key: Column) -> tuple[Column, Column]:
    """(id, context_id) of a composite key, cut at the first ``::``."""
    parts = F.split(key, "::", 2)
    return parts[0], parts[1]

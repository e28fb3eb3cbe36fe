"""Regular expressions: flags, positions of matches, literal prefilters, oracle forms.

Rule patterns are written in the common subset of the Java, Python and RE2
dialects.  Case folding is Unicode-aware and ``.`` stops at newlines only, which
is what the Python dialect does.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as _c
    from re import _parser as _p

_LEAST_LITERAL = 3


def java(pattern: str, ignore_case: bool = True, dotall: bool = False, multiline: bool = False) -> str:
    """The pattern with flags for the JVM."""
    flags = "d" + "iu" * ignore_case + "s" * dotall + "m" * multiline
    return f"(?{flags}){pattern}"


def re2(pattern: str, ignore_case: bool = True, dotall: bool = False, multiline: bool = False) -> str:
    """The pattern with flags for DuckDB."""
    flags = "i" * ignore_case + "s" * dotall + "m" * multiline
    pattern = re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern)
    return f"(?{flags}){pattern}" if flags else pattern


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(patterns: list[str]) -> str:
    """One alternation of several patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def first_line_of(content: Column, pattern: str) -> Column:
    """1-based line of the first match (null if there is none)."""
    before = F.regexp_replace(content, f"(?s){_inner(pattern)}.*\\z", "")
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.when(content.rlike(pattern), line).cast("int")


def _inner(pattern: str) -> str:
    """A flagged pattern as a group that keeps its flags to itself."""
    m = re.match(r"\(\?([a-zA-Z]+)\)(.*)\Z", pattern, re.DOTALL)
    return f"(?{m[1]}{'' if 's' in m[1] else '-s'}:{m[2]})" if m else f"(?-s:{pattern})"


def matches(content: Column, pattern: str) -> Column:
    """All matches as array<struct<text, start>>, start counted from 0.

    Positions follow from the texts between the matches: what splits at the
    pattern alternates with what matches it.
    """
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    between = F.split(content, pattern, -1)
    both = F.arrays_zip(found.alias("text"), F.slice(between, F.lit(1), F.size(found)).alias("before"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["before"])
        hit = F.struct(m["text"].alias("text"), start.alias("start"))
        return F.struct((start + F.length(m["text"])).alias("at"), F.concat(state["out"], F.array(hit)).alias("out"))

    return F.aggregate(both, zero, step, lambda s: s["out"])


def line_at(content: Column, start: Column) -> Column:
    """1-based line of a 0-based position."""
    before = F.substring(content, F.lit(1), start)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def _literals(tree) -> set[str] | None:
    """Literals of which every match of the parsed pattern contains one, lower-cased."""
    best: set[str] | None = None
    run = ""

    def better(found: set[str] | None) -> None:
        nonlocal best
        if found and min(map(len, found)) >= _LEAST_LITERAL and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in tree:
        if op is _c.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            better({run})
        run = ""
        if op is _c.SUBPATTERN:
            better(_literals(arg[3]))
        elif op is _c.BRANCH:
            parts = [_literals(b) for b in arg[1]]
            if all(parts):
                better(set().union(*parts))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            better(_literals(arg[2]))
    if run:
        better({run})
    return best


def required_literals(pattern: str) -> set[str] | None:
    """Lower-case ASCII literals (3 characters at least), one of which every match contains; None if there are none."""
    try:
        return _literals(_p.parse(pattern))
    except re.error:
        return None


def trie_regex(words: list[str]) -> str:
    """An alternation of words that share beginnings, so that few branches are tried at a place."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def render(node: dict) -> str:
        # A word that ends here settles the match; longer ones add nothing.
        if "" in node:
            return ""
        parts = [re.escape(c) + render(node[c]) for c in sorted(node)]
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return render(tree)


def folded(text: Column) -> Column:
    """Lower case, with the long s as s: what case-insensitive literals are looked for in."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


def possible(low: Column, pattern: str, most: int = 8) -> Column | None:
    """A cheap condition on a folded text without which the pattern can't match; None if there is none."""
    found = required_literals(pattern)
    if not found or len(found) > most:
        return None
    out = None
    for x in sorted(found):
        one = F.contains(low, F.lit(x))
        out = one if out is None else out | one
    return out


def prefilter(low: Column, text: Column, patterns: list[str]) -> Column:
    """A condition true wherever one of the patterns can match; ``low`` is the folded text.

    One pass for all literals: far cheaper than the patterns, and few lines of a
    corpus have any of them.  Patterns without a literal stand for themselves.
    """
    found = {p: required_literals(p) for p in patterns}
    literals = sorted(set().union(*(x for x in found.values() if x)))
    # A literal that contains another one adds nothing.
    kept = [x for x in literals if not any(y != x and y in x for y in literals)]
    out = low.rlike(trie_regex(kept)) if kept else F.lit(False)
    bare = [p for p, x in found.items() if not x]
    return out | text.rlike(java(any_of(bare))) if bare else out

"""Scalar functions of the engine as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy over characters, in bits; 0 for null and empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")

    def add(total: Column, c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return total - p * F.log2(p)

    return F.coalesce(F.when(F.length(text) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), add)), F.lit(0.0))


#: Settings that hold no secret.
PLACEHOLDERS = (
    '""', "''", "your-key-here", "your_key_here", "your-secret-here", "xxx", "xxxxxxxx", "changeme", "replace-me", "replace_me", "todo", "fixme",
    "example", "sample", "placeholder", "<your-key>", "<your_key>", "<secret>", "<password>", "<api-key>", "<token>", "none", "null",
)
#: Further ones in dotenv files.
ENV_PLACEHOLDERS = (
    "change-me", "change_me", "your-value", "your_value", "insert-here", "insert_here", "fill-in", "fill_in", "password", "secret", "test", "development",
    "localhost", "127.0.0.1", "false", "undefined", "postgres", "mysql", "redis", "mongo",
)


def is_placeholder(value: Column, more: tuple[str, ...] = (), percent: bool = False) -> Column:
    """Empty, a known placeholder, a variable reference or a template."""
    low = F.lower(F.trim(value))
    out = (low == "") | low.isin(*PLACEHOLDERS, *more) | value.startswith("$") | (value.startswith("<") & value.endswith(">"))
    out = out | (value.startswith("%") if percent else (value.contains("{{") & value.contains("}}")))
    return F.coalesce(out, F.lit(True))


def version_key(version: Column) -> Column:
    """A version as comparable array<int>; pre-releases sort before the release; null if it has other parts.

    ``1.2.3`` is [1,2,3,1,0]; ``1.2.3-canary.7`` is [1,2,3,0,7].
    """
    main, pre = F.split(version, "-", 2)[0], F.regexp_extract(version, r"^[^-]*-.*?(\d*)$", 1)
    parts = F.transform(F.split(main, r"\."), lambda x: x.try_cast("int"))
    tail = F.when(F.contains(version, F.lit("-")), F.array(F.lit(0), F.coalesce(pre.try_cast("int"), F.lit(0)))).otherwise(F.array(F.lit(1), F.lit(0)))
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.concat(parts, tail))


def concrete_version(spec: Column) -> Column:
    """The version in a dependency specifier: prefixes off, first of a range; null if none."""
    out = F.trim(spec)
    for prefix in ("^", "~", ">=", ">", "<=", "<", "=", "v"):
        out = F.regexp_replace(out, "^" + re.escape(prefix), "")
    out = F.element_at(F.split(F.trim(out), r"\s+"), 1)
    return F.when(out.rlike(r"^\d+\.\d+\.\d+"), out)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a full-match regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i:j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def content_hash(content: Column, prefix: int | None = None) -> Column:
    """First 16 hex digits of SHA-256 over the UTF-8 bytes, or over the first ``prefix`` of them."""
    raw = content.cast("binary")
    return F.substring(F.sha2(F.substring(raw, 1, prefix) if prefix else raw, 256), 1, 16)


def line_with(content: Column, *needles: Column) -> Column:
    """1-based number of the first line that contains one of the needles, else 1."""
    lines = F.split(content, "\n", -1)

    def hit(line: Column) -> Column:
        out = F.lit(False)
        for n in needles:
            out = out | ((F.length(n) > 0) & F.contains(line, n))
        return F.coalesce(out, F.lit(False))

    at = F.array_position(F.transform(lines, hit), F.lit(True))
    return F.when(at > 0, at).otherwise(1).cast("int")

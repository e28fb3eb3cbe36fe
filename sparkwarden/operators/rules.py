"""Rules as data, compiled to Columns.

A :class:`Group` is a list of patterns that make findings in one way (its mode):

=============  ================================================================
line_first     per line, the first pattern that matches
line_all       per line, every pattern that matches
doc_first      per pattern, its first match in the text
doc_all        every match of every pattern
first_of_list  the first pattern of the list that matches, one finding
absent         one finding if ``present`` holds and no ``control`` matches
=============  ================================================================

``gate`` restricts a family to texts that contain an indicator, ``control``
lists patterns whose presence changes a group: it suppresses findings, or lowers
their severity where ``softened`` is given.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex
from ..model import LETTERS, issue, to_findings

LINE_MODES = ("line_first", "line_all")
MODES = (*LINE_MODES, "doc_first", "doc_all", "first_of_list", "absent")
#: A line that is a comment.
COMMENT = r"^\s*(//|#)"


@dataclass(frozen=True)
class Pattern:
    severity: str
    regex: str
    label: str = ""
    rule_id: str | None = None


@dataclass(frozen=True)
class Group:
    rule_id: str
    mode: str
    patterns: tuple[Pattern, ...]
    cwe: int | None = None
    severity: str | None = None
    message: str | None = None
    control: tuple[str, ...] = ()
    softened: bool = False
    present: tuple[str, ...] = ()
    present_all: tuple[str, ...] = ()
    ignore_case: bool = True
    dotall: bool = False
    multiline: bool = False
    skip_comments: bool = False
    and_line: str | None = None
    not_near: str | None = None
    near: tuple[int, int] = (500, 100)
    file_words: tuple[str, ...] = ()

    def message_of(self, p: Pattern | None = None) -> str:
        """What a finding says: the pattern's own label, or else what the group is for."""
        return (p.label if p else "") or self.message or ""

    def java(self, pattern: str) -> str:
        return regex.java(pattern, self.ignore_case, self.dotall, self.multiline)


@dataclass(frozen=True)
class Family:
    """A scanner: its groups, its gate over the text, and what it applies to."""

    name: str
    groups: tuple[Group, ...]
    gate: tuple[str, ...] = ()
    gate_words: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    extra: Callable[[Column], list[Column]] | None = field(default=None, compare=False)

    def gated(self, content: Column) -> Column | None:
        """Condition under which the family looks at a text (None: always)."""
        if self.gate_words:
            words = "|".join(f"\\Q{w}\\E" for w in self.gate_words)
            return F.lower(content).rlike(words)
        return content.rlike(regex.java(regex.any_of(list(self.gate)))) if self.gate else None

    def rules(self) -> list[tuple[str, str, str, str, str, int | None]]:
        """(rule_id, severity, label, regex, mode, cwe) of every pattern."""
        out = []
        for g in self.groups:
            for p in g.patterns:
                out.append((p.rule_id or g.rule_id, g.severity or p.severity, g.message_of(p), p.regex, g.mode, g.cwe))
            if not g.patterns:
                out.append((g.rule_id, g.severity, g.message, "", g.mode, g.cwe))
        return out


def group(rule_id: str, mode: str, patterns=(), cwe: int | None = None, severity: str | None = None, **kw) -> Group:
    """A group from regexes; where severities differ, of ("C", regex) or ("C label", regex) pairs."""
    out = []
    for entry in patterns:
        label, pattern = ("", entry) if isinstance(entry, str) else entry
        letter, _, rest = label.partition(" ")
        if letter in LETTERS:
            out.append(Pattern(LETTERS[letter], pattern, rest))
        else:
            out.append(Pattern(LETTERS.get(severity or "", severity or "MEDIUM"), pattern, label))
    sev = LETTERS.get(severity, severity) if severity else None
    for key in ("control", "present", "present_all"):
        if key in kw:
            kw[key] = tuple(kw[key])
    return Group(rule_id, mode, tuple(out), cwe, sev, **kw)


_HIT = "struct<n:int,line:int,code:string,soft:boolean>"
_META = "array<struct<rule_id:string,severity:string,softer:string,message:string,cwe_id:int>>"
_SOFTER = {"CRITICAL": "HIGH", "HIGH": "MEDIUM", "MEDIUM": "LOW"}


class _Compiled:
    """Hits as small structs that point into a literal table of rules.

    The table is one constant; expressions hold a pattern and a number each,
    which keeps plans of hundreds of patterns small.
    """

    def __init__(self, family: Family) -> None:
        self.family = family
        self.table: list[dict] = []

    def number(self, g: Group, p: Pattern | None = None) -> int:
        severity = g.severity or (p.severity if p else "MEDIUM")
        self.table.append({"rule_id": (p and p.rule_id) or g.rule_id, "severity": severity, "softer": _SOFTER.get(severity, severity), "message": g.message_of(p), "cwe_id": g.cwe})
        return len(self.table) - 1

    def issues(self, hits: Column) -> Column:
        """array<issue> of an array of hits."""
        meta = F.from_json(F.lit(json.dumps(self.table)), _META)

        def full(h: Column) -> Column:
            m = F.get(meta, h["n"])
            severity = F.when(h["soft"], m["softer"]).otherwise(m["severity"])
            return issue(self.family.name, m["rule_id"], severity, m["message"], h["line"], None, h["code"]).withField("cwe_id", m["cwe_id"])

        return F.transform(hits, full)


def _hit(n, line, code=None, soft=None) -> Column:
    none = F.lit(None)
    parts = (n if isinstance(n, Column) else F.lit(n), line if isinstance(line, Column) else F.lit(line), code if code is not None else none, soft if soft is not None else F.lit(False))
    return F.struct(*parts).cast(_HIT)


def _tested(g: Group, p: Pattern, text: Column, low: Column) -> Column:
    """Whether a pattern matches; its literals are looked for first."""
    hit = text.rlike(g.java(p.regex))
    cheap = regex.possible(low, p.regex)
    return hit if cheap is None else cheap & hit


def line_issues(family: Family, line: Column, low: Column, line_no: Column) -> Column | None:
    """array<issue> of a line (``low``: folded), from the family's line groups."""
    compiled, codes = _Compiled(family), []
    for g in family.groups:
        if g.mode not in LINE_MODES:
            continue
        guard = None
        if g.skip_comments:
            guard = ~line.rlike(COMMENT)
        if g.and_line:
            more = line.rlike(g.java(g.and_line))
            guard = more if guard is None else guard & more
        numbered = [(_tested(g, p, line, low), compiled.number(g, p)) for p in g.patterns]
        if g.mode == "line_first":
            chain = F.when(numbered[0][0], numbered[0][1])
            for cond, n in numbered[1:]:
                chain = chain.when(cond, n)
            codes.append(chain if guard is None else F.when(guard, chain))
        else:
            codes += [F.when(cond if guard is None else guard & cond, n) for cond, n in numbered]
    if not codes:
        return None
    code = F.substring(F.trim(line), 1, 100)
    return compiled.issues(F.transform(F.array_compact(F.array(*codes)), lambda n: _hit(n, line_no, code)))


def doc_issues(family: Family, content: Column, path: Column | None = None) -> Column | None:
    """array<issue> of a whole text, from the family's other groups; ``path`` is for those that ask for a file name."""
    compiled, single, several = _Compiled(family), [], []
    for g in family.groups:
        if g.mode in LINE_MODES:
            continue
        controlled = content.rlike(g.java(regex.any_of(list(g.control)))) if g.control else None
        guard = F.lit(True)
        if controlled is not None and not g.softened:
            guard = ~controlled
        if g.present:
            guard = guard & content.rlike(g.java(regex.any_of(list(g.present))))
        for p in g.present_all:
            guard = guard & content.rlike(g.java(p))
        if g.file_words:
            name = F.lower(F.element_at(F.split(path if path is not None else F.lit(""), "/"), -1))
            guard = guard & name.rlike("|".join(f"\\Q{w}\\E" for w in g.file_words))
        soft = controlled if g.softened else None
        if g.mode == "absent":
            single.append(F.when(guard, _hit(compiled.number(g), 1)))
        elif g.mode == "first_of_list":
            first, *rest = [(content.rlike(g.java(p.regex)), _hit(compiled.number(g, p), regex.first_line_of(content, g.java(p.regex)))) for p in g.patterns]
            chain = F.when(*first)
            for cond, hit in rest:
                chain = chain.when(cond, hit)
            single.append(F.when(guard, chain))
        elif g.mode == "doc_first":
            for p in g.patterns:
                pattern = g.java(p.regex)
                single.append(F.when(guard & content.rlike(pattern), _hit(compiled.number(g, p), regex.first_line_of(content, pattern), None, soft)))
        else:
            several += [_every_match(g, p, compiled.number(g, p), content, guard, soft) for p in g.patterns]
    arrays = []
    if single:
        arrays.append(F.array_compact(F.array(*single)))
    if several:
        arrays.append(F.flatten(F.array_compact(F.array(*several))))
    out = []
    if arrays:
        out.append(compiled.issues(F.concat(*arrays)))
    if family.extra is not None:
        out += family.extra(content)
    if not out:
        return None
    return F.filter(F.flatten(F.array_compact(F.array(*out))), lambda i: i.isNotNull())


def _every_match(g: Group, p: Pattern, n: int, content: Column, guard: Column, soft: Column | None) -> Column:
    """array<hit> of all matches of one pattern, or null."""
    pattern = g.java(p.regex)
    found = regex.matches(content, pattern)
    if g.not_near:
        before, after = g.near
        near = g.java(g.not_near)
        found = F.filter(found, lambda m: ~F.substring(content, F.greatest(m["start"] - before + 1, F.lit(1)), F.length(m["text"]) + before + after).rlike(near))
    hits = F.transform(found, lambda m: _hit(n, regex.line_at(content, m["start"]), F.substring(m["text"], 1, 100), soft))
    return F.when(guard & content.rlike(pattern), hits)


def line_patterns(families: list[Family]) -> list[str]:
    return [p.regex for f in families for g in f.groups if g.mode in LINE_MODES for p in g.patterns]


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no from 1, line): a trailing line end gives a last empty line."""
    return docs.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def evaluate(docs: DataFrame, families: list[Family], applies: Column | None = None, use_prefilter: bool = True) -> DataFrame:
    """Findings of all families over docs (doc_id, path, content).

    One projection for whole-text groups, one over lines for line groups.
    ``applies`` maps a family name to whether it looks at a row: an
    array<string> column of names, as :mod:`.route` makes it; None: all do.
    """
    base = ["doc_id", "path"]
    rows = docs.select(*base, "content", *([applies.alias("scanners")] if applies is not None else []))

    def wanted(f: Family, content: Column | None) -> Column:
        cond = F.array_contains("scanners", f.name) if applies is not None else F.lit(True)
        gate = f.gated(content) if content is not None else None
        return cond & gate if gate is not None else cond

    found: list[DataFrame] = []
    per_doc = [(f, doc_issues(f, F.col("content"), F.col("path"))) for f in families]
    arrays = [F.when(wanted(f, F.col("content")), a) for f, a in per_doc if a is not None]
    if arrays:
        issues = F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
        found.append(rows.select(*base, F.explode(issues).alias("issue")))
    with_lines = [f for f in families if any(g.mode in LINE_MODES for g in f.groups)]
    if with_lines:
        gates = [f for f in with_lines if f.gated(F.col("content")) is not None]
        flags = F.array_compact(F.array(*[F.when(f.gated(F.col("content")), F.lit(f.name)) for f in gates])).alias("open")
        lines = lines_of(rows.select("*", *([flags] if gates else [])), *base, *(["scanners"] if applies is not None else []), *(["open"] if gates else []))
        lines = lines.withColumn("low", regex.folded(F.col("line")))
        if use_prefilter:
            lines = lines.where(regex.prefilter(F.col("low"), F.col("line"), line_patterns(with_lines)))
        arrays = []
        for f in with_lines:
            cond = F.array_contains("open", f.name) if f in gates else F.lit(True)
            if applies is not None:
                cond = cond & F.array_contains("scanners", f.name)
            arrays.append(F.when(cond, line_issues(f, F.col("line"), F.col("low"), F.col("line_no"))))
        issues = F.flatten(F.filter(F.array(*arrays), lambda a: a.isNotNull()))
        found.append(lines.select(*base, F.explode(issues).alias("issue")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return to_findings(out)


def restricted(family: Family, rule_ids: set[str]) -> Family:
    """The family with only the named rules."""
    return replace(family, groups=tuple(g for g in family.groups if g.rule_id in rule_ids))

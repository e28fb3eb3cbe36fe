"""Linter output as findings.

``tool_output`` rows are (path, tool, stdout, stderr, rc).  Each tool has a
format, a place for every field and a severity map; the rest is shared.  Output
is parsed by JSON, XML and regular-expression functions, never by running a
tool.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import issue, to_findings

TOOL_OUTPUT = "path string, tool string, stdout string, stderr string, rc int"


@dataclass(frozen=True)
class Adapter:
    """How one tool's output is read.

    ``kind`` is json (records at ``records``, an array of JSON texts) or text
    (``line_pattern`` with numbered groups).  Field values are JSON paths or
    group numbers.  ``severity`` maps the tool's words; ``default`` is the rest.
    """

    tool: str
    kind: str
    records: tuple[str, ...] = ("$",)
    line: str | int | None = None
    column: str | int | None = None
    rule: str | int | None = None
    message: str | int | None = None
    level: str | int | None = None
    severity: tuple[tuple[str, str], ...] = field(default=())
    default: str = "MEDIUM"
    line_pattern: str = ""
    stream: str = "stdout"
    by_message: tuple[tuple[str, str], ...] = field(default=())
    rule_prefix: tuple[tuple[str, str], ...] = field(default=())
    lines: bool = False


C, H, M, L, I = "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"
_EWI = (("error", H), ("warning", M), ("info", L))
_COLON = r"^(?:[^:\n]*):(\d+):(?:(\d+):)?\s*(.*)$"

#: Tools, where their fields are, and how their severities map.
ADAPTERS = {
    a.tool: a
    for a in (
        Adapter("bandit", "json", ("$.results",), "$.line_number", "$.col_offset", "$.test_id", "$.issue_text", "$.issue_severity", (("HIGH", C), ("MEDIUM", H), ("LOW", M)), L),
        Adapter("shellcheck", "json", ("$", "$.comments"), "$.line", "$.column", "$.code", "$.message", "$.level", (("error", H), ("warning", M), ("info", L), ("style", I)), I),
        Adapter("blinter", "text", line_pattern=r"^Line (\d+): (.*?) \(([A-Z]+\d+)\)", line=1, message=2, rule=3, rule_prefix=(("SEC", C), ("E", H), ("W", M), ("P", M), ("S", L)), default=I),
        Adapter("yamllint", "text", line_pattern=r"^[^:\n]+:(\d+):(\d+): \[(\w+)\] (.*?)(?: \(([\w-]+)\))?$", line=1, column=2, level=3, message=4, rule=5, severity=(("error", M), ("warning", L)), default=I),
        Adapter("hadolint", "json", ("$",), "$.line", "$.column", "$.code", "$.message", "$.level", (("error", H), ("warning", M), ("info", L), ("style", I)), I),
        Adapter("markdownlint", "json", ("$",), "$.lineNumber", None, "$.ruleNames[0]", "$.ruleDescription", None, (), L, stream="stderr"),
        Adapter("eslint", "json", ("$[*].messages",), "$.line", "$.column", "$.ruleId", "$.message", "$.severity", (("2", H),), M),
        Adapter("tflint", "json", ("$.issues",), "$.range.start.line", "$.range.start.column", "$.rule.name", "$.message", "$.rule.severity", (("error", H), ("warning", M), ("notice", L)), M),
        Adapter("golangci-lint", "json", ("$.Issues",), "$.Pos.Line", "$.Pos.Column", "$.FromLinter", "$.Text", "$.FromLinter", (("gosec", H), ("gas", H), ("govet", M), ("staticcheck", M), ("errcheck", M)), L),
        Adapter("rubocop", "json", ("$.files[*].offenses",), "$.location.line", "$.location.column", "$.cop_name", "$.message", "$.severity", (("fatal", C), ("error", H), ("warning", M), ("convention", L), ("refactor", I), ("info", I)), M),
        Adapter("phpstan", "json", ("$.files.*.messages",), "$.line", None, "$.identifier", "$.message", None, (), L, by_message=(("security|injection|xss|unsafe", C), ("type|undefined|not found", H), ("unused|deprecated", M))),
        Adapter("cargo-clippy", "json", ("$.message",), "$.spans[0].line_start", "$.spans[0].column_start", "$.code.code", "$.message", "$.level", (("error", C), ("warning", M), ("note", L), ("help", I)), M, lines=True),
        Adapter("sqlfluff", "json", ("$[*].violations",), "$.start_line_no", "$.start_line_pos", "$.code", "$.description", None, (), M, by_message=(("injection|security|unsafe", C),), rule_prefix=(("PRS", H), ("LXR", H), ("LT", L), ("CP", L), ("CV", I))),
        Adapter("stylelint", "json", ("$[*].warnings",), "$.line", "$.column", "$.rule", "$.text", "$.severity", (("error", H), ("warning", M)), L),
        Adapter("htmlhint", "json", ("$[*].messages",), "$.line", "$.col", "$.rule.id", "$.message", "$.type", _EWI, M),
        Adapter("ktlint", "json", ("$[*].errors",), "$.line", "$.column", "$.rule", "$.message", None, (), M),
        Adapter("swiftlint", "json", ("$",), "$.line", "$.character", "$.rule_id", "$.reason", "$.severity", (("error", H), ("warning", M)), M),
        Adapter("cppcheck", "text", line_pattern=r"^[^:\n]+:(\d+):(?:(\d+):)? (\w+): (.*?)(?: \[([\w-]+)\])?$", line=1, column=2, level=3, message=4, rule=5, severity=(("error", C), ("warning", H), ("style", M), ("performance", M), ("portability", L), ("information", I)), default=M, stream="stderr"),
        Adapter("checkstyle", "text", line_pattern=r'<error line="(\d+)"(?: column="(\d+)")? severity="(\w+)" message="([^"]*)" source="([^"]*)"', line=1, column=2, level=3, message=4, rule=5, severity=_EWI, default=M),
        Adapter("tsc", "text", line_pattern=r"^[^(\n]+\((\d+),(\d+)\): (\w+) (TS\d+): (.*)$", line=1, column=2, level=3, rule=4, message=5, severity=(("error", H), ("warning", M)), default=L),
        Adapter("scalastyle", "text", line_pattern=r'<error(?: column="(\d+)")? line="(\d+)" source="([^"]*)" severity="(\w+)" message="([^"]*)"', column=1, line=2, rule=3, level=4, message=5, severity=_EWI, default=M),
        Adapter("perlcritic", "text", line_pattern=r"^(\d):[^:\n]*:(\d+):(\d+):((?:\w|::)+):(.*)$", level=1, line=2, column=3, rule=4, message=5, severity=(("5", C), ("4", H), ("3", M), ("2", L)), default=I),
        Adapter("pwsh", "json", ("$",), "$.Line", "$.Column", "$.RuleName", "$.Message", "$.Severity", (("Error", H), ("Warning", M), ("Information", L)), M),
        Adapter("Rscript", "json", ("$",), "$.line_number", "$.column_number", "$.linter", "$.message", "$.type", (("error", H), ("warning", M), ("style", L)), M),
        Adapter("ansible-lint", "json", ("$",), "$.location.lines.begin", None, "$.check_name", "$.description", "$.severity", (("VERY_HIGH", C), ("HIGH", H), ("MEDIUM", M), ("LOW", L), ("VERY_LOW", I), ("INFO", I)), M),
        Adapter("kube-linter", "json", ("$.Reports",), None, None, "$.Check", "$.Diagnostic.Message", "$.Level", (("Error", C), ("Warning", M), ("Info", L)), M),
        Adapter("taplo", "text", line_pattern=r"^\s*(?:-->|┌─)?\s*[^:\n]*:(\d+):(\d+)\s*(.*)$", line=1, column=2, message=3, by_message=(("error", H),), default=M, stream="stderr"),
        Adapter("xmllint", "text", line_pattern=r"^[^:\n]+:(\d+): (.*)$", line=1, message=2, by_message=(("error", H),), default=M, stream="stderr"),
        Adapter("buf", "text", line_pattern=_COLON, line=1, column=2, message=3, default=M),
        Adapter("graphql-schema-linter", "text", line_pattern=r"^\s*(\d+):(\d+)\s+(.*?)\s{2,}([\w-]+)\s*$", line=1, column=2, message=3, rule=4, default=M),
        Adapter("solhint", "json", ("$", "$[*].messages"), "$.line", "$.column", "$.ruleId", "$.message", "$.severity", (("2", H), ("Error", H), ("error", H)), M),
        Adapter("luacheck", "text", line_pattern=r"^[^:\n]+:(\d+):(\d+)(?:-\d+)?: (?:\((\w\d+)\) )?(.*)$", line=1, column=2, rule=3, message=4, rule_prefix=(("E", H), ("W6", M), ("W1", M)), default=L),
        Adapter("mix", "json", ("$.issues",), "$.line_no", "$.column", "$.check", "$.message", "$.priority", (), L),
        Adapter("hlint", "json", ("$",), "$.startLine", "$.startColumn", None, "$.hint", "$.severity", (("Error", H), ("Warning", M), ("Suggestion", L)), M),
        Adapter("clj-kondo", "json", ("$.findings",), "$.row", "$.col", "$.type", "$.message", None, (), M),
        Adapter("dart", "text", line_pattern=r"^(\w+)\|\w+\|(\w+)\|[^|\n]*\|(\d+)\|(\d+)\|\d+\|(.*)$", level=1, rule=2, line=3, column=4, message=5, default=M),
        Adapter("vint", "text", line_pattern=_COLON, line=1, column=2, message=3, default=M),
        Adapter("cmakelint", "text", line_pattern=r"^[^:\n]+:(\d+): (.*?)(?: \[([\w/]+)\])?$", line=1, message=2, rule=3, default=L),
        Adapter("checkmake", "text", line_pattern=r"^\s*(\w+)\s+(.*?)\s+(\d+)\s*$", rule=1, message=2, line=3, default=M),
        Adapter("gixy", "text", line_pattern=r"^>> Problem: \[(\w+)\] (.*)$", rule=1, message=2, by_message=(("error", H),), default=M),
        Adapter("zig", "text", line_pattern=_COLON, line=1, column=2, message=3, default=H, stream="stderr"),
        Adapter("modelscan", "json", ("$.issues",), None, None, "$.operator", "$.description", "$.severity", (("CRITICAL", C), ("HIGH", H), ("MEDIUM", M), ("WARNING", M), ("LOW", L), ("INFO", I)), H),
    )
}


def _records(a: Adapter, text: Column) -> Column:
    """The JSON texts of a tool's records.

    ``[*]`` walks an array, ``.*`` the values of a map; several paths are tried
    in order.
    """
    if a.lines:
        text = F.concat(F.lit("["), F.array_join(F.filter(F.split(text, "\n"), lambda s: F.trim(s).startswith("{")), ","), F.lit("]"))
        whole = F.from_json(text, "array<string>")
        return F.filter(F.transform(whole, lambda r: F.get_json_object(r, a.records[0])), lambda r: r.isNotNull())
    tried = []
    for path in a.records:
        if "[*]" in path:
            outer, inner = path.split("[*]")
            parts = F.from_json(F.get_json_object(text, outer) if outer != "$" else text, "array<string>")
        elif ".*" in path:
            outer, inner = path.split(".*")
            parts = F.map_values(F.from_json(F.get_json_object(text, outer), "map<string,string>"))
        else:
            tried.append(F.from_json(F.get_json_object(text, path) if path != "$" else text, "array<string>"))
            continue
        nested = F.flatten(F.filter(_inner(parts, "$" + inner), lambda x: x.isNotNull()))
        tried.append(F.when(F.size(nested) > 0, nested))
    return F.coalesce(*tried)


def _inner(parts: Column, path: str) -> Column:
    """The arrays at a path of each of several JSON texts."""
    return F.transform(parts, lambda r: F.from_json(F.get_json_object(r, path), "array<string>"))


def _severity(a: Adapter, level: Column, rule: Column, message: Column) -> Column:
    out = F.lit(a.default)
    if a.tool == "mix":
        n = level.try_cast("int")
        return F.when(n >= 10, C).when(n >= 5, H).when(n >= 1, M).otherwise(L)
    for prefix, sev in reversed(a.rule_prefix):
        out = F.when(rule.startswith(prefix), sev).otherwise(out)
    for words, sev in reversed(a.by_message):
        out = F.when(message.rlike(f"(?i){words}"), sev).otherwise(out)
    for word, sev in reversed(a.severity):
        out = F.when(level == word, sev).otherwise(out)
    return out


def normalise(output: DataFrame, tool: str) -> DataFrame:
    """Findings of one tool's output rows."""
    a = ADAPTERS[tool]
    rows = output.where(F.col("tool") == tool)
    text = F.coalesce(F.col(a.stream), F.lit(""))
    if a.kind == "json":
        rows = rows.select("path", F.explode(_records(a, text)).alias("r"))

        def pick(where):
            return F.get_json_object("r", where) if where else F.lit(None).cast("string")
    else:
        flags = "(?m)"
        rows = rows.select("path", F.explode(F.regexp_extract_all(text, F.lit(flags + a.line_pattern), F.lit(0))).alias("r"))

        def pick(where):
            return F.nullif(F.regexp_extract("r", flags + a.line_pattern, where), F.lit("")) if where else F.lit(None).cast("string")

    level, rule, message = pick(a.level), pick(a.rule), F.coalesce(pick(a.message), F.lit(""))
    column = pick(a.column).try_cast("int")
    found = issue(tool, rule, F.coalesce(_severity(a, level, F.coalesce(rule, F.lit("")), message), F.lit(a.default)), message, pick(a.line).try_cast("int"), column)
    return to_findings(rows.select(F.col("path").alias("doc_id"), "path", found.alias("issue")))


def normalise_all(output: DataFrame, tools: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of the output of all tools."""
    out = None
    for tool in tools or tuple(ADAPTERS):
        one = normalise(output, tool)
        out = one if out is None else out.unionByName(one)
    return out

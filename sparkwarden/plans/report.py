"""Reports: aggregations over findings, and their JSON, Markdown and HTML forms."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SEVERITIES, rank_of, severity_dim, weight_of

#: Lower bounds of the score for each risk level.
RISK_LEVELS = [(95.0, "EXCELLENT"), (85.0, "GOOD"), (70.0, "MODERATE"), (50.0, "CONCERNING")]
LOWEST_RISK = "CRITICAL"
#: Bytes that count as one line where only sizes are known.
BYTES_A_LINE = 50


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """(severity, findings) of all five severities, 0 where there is none."""
    dim = severity_dim(findings.sparkSession)
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))
    return F.broadcast(dim).join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("findings", F.lit(0)).alias("findings"))


def percentages(breakdown: DataFrame) -> DataFrame:
    """(severity, findings, percent) without empty rows; one decimal."""
    total = F.greatest(F.sum("findings").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return breakdown.where("findings > 0").withColumn("percent", F.round(F.lit(100.0) * F.col("findings") / total, 1)).select("severity", "findings", "percent")


def score_of(penalty: Column) -> Column:
    """100 minus the summed weights, 0 at least, two decimals."""
    return F.round(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(penalty, F.lit(0)).cast("double")), 2)


def risk_of(score: Column) -> Column:
    out = F.lit(LOWEST_RISK)
    for least, name in reversed(RISK_LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def security_score(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., total_issues, security_score, risk_level): one row, or one a group."""
    grouped = findings.groupBy(*by) if by else findings.groupBy()
    out = grouped.agg(F.count(F.lit(1)).alias("total_issues"), score_of(F.sum(weight_of(F.col("severity")))).alias("security_score"))
    return out.withColumn("risk_level", risk_of(F.col("security_score")))


def counts_by(findings: DataFrame, keys: tuple[str, ...] = ("severity", "path", "family")) -> DataFrame:
    """(dimension, value, findings): counts by each key in one pass."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])
    return findings.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("findings"))


def ranked(findings: DataFrame) -> DataFrame:
    """Findings from the most severe on; equals in the order of document and place."""
    return findings.orderBy("severity_rank", "path", "seq", "family", "rule_id")


def placed(findings: DataFrame) -> DataFrame:
    """Findings with their place in the order of :func:`ranked`, from 1.

    A range sort numbers the rows of each partition; a partition's offset is the
    count of those before it.  No task sees more than its own range.
    """
    in_partition = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = ranked(findings).withColumn("_n", in_partition).withColumn("_part", F.spark_partition_id()).persist()
    before = F.sum("count").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_n") + 1).drop("_n", "_part", "_before")


def top(findings: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent values of a column."""
    return findings.groupBy(key).agg(F.count(F.lit(1)).alias("findings")).orderBy(F.desc("findings"), key).limit(n)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or a higher one."""
    return findings.where(F.col("severity_rank") <= rank_of(F.lit(severity)))


def fails(findings: DataFrame, severity: str) -> bool:
    """Whether a threshold is reached: some finding at this level or higher."""
    return not at_least(findings, severity).isEmpty()


def scan_summary(status: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: files scanned and cached, hit rate, lines (by size), time, scanners, issues."""
    files = status.agg(F.count_if(~F.col("cached")).alias("files_scanned"), F.count_if("cached").alias("files_cached"), F.coalesce(F.sum("scan_time"), F.lit(0.0)).alias("scan_time"), F.array_sort(F.collect_set(F.when(~F.col("cached"), F.col("scanner")))).alias("scanners"))
    rate = F.round(F.lit(100.0) * F.col("files_cached") / F.greatest(F.col("files_scanned") + F.col("files_cached"), F.lit(1)), 1)
    size = docs.agg(F.coalesce(F.sum(F.floor(F.col("size") / BYTES_A_LINE)), F.lit(0)).alias("lines_scanned"))
    return files.withColumn("hit_rate", rate).crossJoin(size).crossJoin(security_score(findings))


def report(findings: DataFrame, files_scanned: int = 0, lines_scanned: int = 0, version: str = "1", timestamp: str | None = None) -> DataFrame:
    """The report document as one row of JSON columns; findings come most severe first."""
    spark = findings.sparkSession
    row = F.struct(F.col("family").alias("scanner"), F.col("path").alias("file"), "line", "severity", "confidence", F.col("message").alias("issue"), F.col("cwe_id").alias("cwe"), "code", "rule_id", "column")
    order = F.struct("severity_rank", "path", "seq", "family", "rule_id")
    listed = findings.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), row.alias("f")))), lambda x: x["f"]).alias("findings"))
    summary = security_score(findings).select(F.struct("total_issues", F.lit(files_scanned).alias("files_scanned"), F.lit(lines_scanned).alias("lines_scanned"), "security_score", "risk_level").alias("scan_summary"))
    breakdown = severity_breakdown(findings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "findings")))).alias("severity_breakdown"))
    groups = counts_by(findings).groupBy("dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "findings")))).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("dimension", "m"))).alias("aggregations"))
    stamp = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    head = spark.range(1).select(stamp.alias("timestamp"), F.lit(version).alias("version"))
    return head.crossJoin(summary).crossJoin(breakdown).crossJoin(listed).crossJoin(groups)


def write_json(document: DataFrame, path: str) -> None:
    """The report as a folder of JSON."""
    document.coalesce(1).write.mode("overwrite").json(path)


def _top_rows(findings: DataFrame, limit: int) -> tuple[dict, list, dict]:
    summary = security_score(findings).first().asDict()
    counts = {r["severity"]: r["findings"] for r in severity_breakdown(findings).collect()}
    return summary, ranked(findings).limit(limit).collect(), counts


def to_markdown(findings: DataFrame, limit: int = 1000) -> str:
    """A Markdown report with at most ``limit`` findings, most severe first."""
    summary, rows, counts = _top_rows(findings, limit)
    total = max(1, summary["total_issues"])
    out = ["# Security report", "", f"- Score: **{summary['security_score']:.2f}** ({summary['risk_level']})", f"- Findings: {summary['total_issues']}", "", "| Severity | Findings | Percent |", "|---|---:|---:|"]
    out += [f"| {name} | {counts[name]} | {100 * counts[name] / total:.1f}% |" for name, _, _ in SEVERITIES if counts.get(name)]
    out += ["", "## Findings", ""]
    for r in rows:
        place = f"{r['path']}:{r['line']}" if r["line"] is not None else r["path"]
        out.append(f"- **{r['severity']}** `{place}` {r['rule_id']}: {r['message']}" + (f" (CWE-{r['cwe_id']})" if r["cwe_id"] else ""))
    if summary["total_issues"] > len(rows):
        out.append(f"- and {summary['total_issues'] - len(rows)} more")
    return "\n".join(out) + "\n"


def to_html(findings: DataFrame, limit: int = 1000) -> str:
    """An HTML report with at most ``limit`` findings; everything from the corpus is escaped."""
    summary, rows, counts = _top_rows(findings, limit)
    score = summary["security_score"]
    colour = "#2e7d32" if score >= 90 else "#f9a825" if score >= 70 else "#c62828"
    cards = "".join(f"<li class='{name.lower()}'>{name}: {counts.get(name, 0)}</li>" for name, _, _ in SEVERITIES)
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str('' if v is None else v))}</td>" for v in (r["severity"], r["path"], r["line"], r["rule_id"], r["message"], r["code"])) + "</tr>" for r in rows)
    more = summary["total_issues"] - len(rows)
    rest = f"<p>and {more} more</p>" if more else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Security report</title></head><body><h1 style='color:{colour}'>{score:.2f} {summary['risk_level']}</h1><ul>{cards}</ul><table><tr><th>Severity</th><th>File</th><th>Line</th><th>Rule</th><th>Finding</th><th>Code</th></tr>{cells}</table>{rest}</body></html>"


def to_sarif(findings: DataFrame, limit: int = 10_000) -> str:
    """The same findings as a SARIF log: the ``limit`` most severe, and how many more there are."""
    total = findings.count()
    level = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
    results = [{"ruleId": r["rule_id"], "level": level.get(r["severity"], "none"), "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": r["line"] or 1}}}]} for r in ranked(findings).limit(limit).collect()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "sparkwarden"}}, "results": results, "properties": {"findings": total, "omitted": total - len(results)}}]})


def imported_linter_json(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a Python linter's JSON report (results and metrics), severities as they are."""
    raw = spark.read.option("multiLine", True).schema("results array<struct<filename:string,line_number:int,issue_severity:string,issue_confidence:string,issue_text:string,issue_cwe:struct<id:int,link:string>,code:string,test_id:string>>").json(path)
    r = raw.select(F.explode("results").alias("r")).select("r.*")
    return r.select(F.col("filename").alias("doc_id"), F.col("filename").alias("path"), F.lit("bandit").alias("family"), F.col("test_id").alias("rule_id"), F.col("issue_severity").alias("severity"), F.col("issue_text").alias("message"), F.col("line_number").alias("line"), F.lit(None).cast("int").alias("column"), "code", F.col("issue_cwe.id").alias("cwe_id"), F.col("issue_confidence").alias("confidence"), rank_of(F.col("issue_severity")).alias("severity_rank"), F.col("line_number").cast("long").alias("seq"))


def imported_linter_totals(spark: SparkSession, path: str) -> DataFrame:
    """(files_scanned, lines_scanned) of the same report's metrics; the totals entry does not count."""
    raw = spark.read.option("multiLine", True).schema("metrics map<string,struct<loc:int>>").json(path)
    m = raw.select(F.explode("metrics").alias("file", "m")).where("file <> '_totals'")
    return m.agg(F.count(F.lit(1)).alias("files_scanned"), F.coalesce(F.sum("m.loc"), F.lit(0)).alias("lines_scanned"))

"""Relations and the severity dimension of the engine.

A corpus is a DataFrame, a rule is data plus a Column, a scan is a lazy query,
findings are a DataFrame and reports are aggregations over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities by rank, with their weights in the security score.
SEVERITIES = [("CRITICAL", 0, 10), ("HIGH", 1, 5), ("MEDIUM", 2, 2), ("LOW", 3, 1), ("INFO", 4, 0)]
WEIGHTS = {name: weight for name, _, weight in SEVERITIES}
RANKS = {name: rank for name, rank, _ in SEVERITIES} | {"UNDEFINED": 5}
UNKNOWN_RANK = 99
LETTERS = {"C": "CRITICAL", "H": "HIGH", "M": "MEDIUM", "L": "LOW", "I": "INFO"}

DOCS = "doc_id string, path string, name string, parent string, suffix string, size long, mtime timestamp, content string"
ISSUE = "family string, rule_id string, severity string, message string, line int, column int, code string, cwe_id int, confidence string"
FINDINGS = f"doc_id string, path string, {ISSUE}, severity_rank int, seq long"
STATUS = "path string, scanner string, scan_time double, cached boolean, success boolean, error_message string"
SNAPSHOT = "path string, size long, mtime timestamp, hash string, last_scan timestamp, issues_found int"

ISSUE_FIELDS = [f.split(" ")[0] for f in ISSUE.split(", ")]


def severity_dim(spark: SparkSession) -> DataFrame:
    """(severity, severity_rank, weight): five rows."""
    return spark.createDataFrame(SEVERITIES, "severity string, severity_rank int, weight int")


def rank_of(severity: Column) -> Column:
    """Rank 0 (CRITICAL) to 4 (INFO), 5 for UNDEFINED, 99 for anything else."""
    out = F.lit(UNKNOWN_RANK)
    for name, rank in RANKS.items():
        out = F.when(severity == name, rank).otherwise(out)
    return F.coalesce(out, F.lit(UNKNOWN_RANK)).cast("int")


def weight_of(severity: Column) -> Column:
    """Weight in the security score; unknown severities weigh nothing."""
    out = F.lit(0)
    for name, weight in WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out.cast("int")


def lowered(severity: str) -> str:
    """One rank less severe, LOW at least."""
    return {"CRITICAL": "HIGH", "HIGH": "MEDIUM", "MEDIUM": "LOW"}.get(severity, severity)


def cwe_link(cwe_id: Column) -> Column:
    return F.when(cwe_id.isNotNull(), F.format_string("https://cwe.mitre.org/data/definitions/%d.html", cwe_id))


def issue(family: str, rule_id, severity, message, line=1, column=None, code=None, cwe: int | None = None, confidence: str = "HIGH") -> Column:
    """An issue struct; arguments are Columns or plain values."""

    def col(v, kind: str) -> Column:
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    values = (family, rule_id, severity, message, line, column, code, cwe, confidence)
    fields = [f.split(" ") for f in ISSUE.split(", ")]
    return F.struct(*[col(v, kind).alias(name) for v, (name, kind) in zip(values, fields)])


def to_findings(rows: DataFrame, issue_col: str = "issue") -> DataFrame:
    """Rows (doc_id, path, issue) as flat findings, with rank and a stable order key."""
    flat = rows.select("doc_id", "path", *[F.col(f"{issue_col}.{f}").alias(f) for f in ISSUE_FIELDS])
    seq = F.coalesce(F.col("line"), F.lit(0)).cast("long") * 4096 + F.pmod(F.crc32(F.concat_ws("|", "family", "rule_id", "message")), F.lit(4096))
    return flat.withColumns({"severity_rank": rank_of(F.col("severity")), "seq": seq})

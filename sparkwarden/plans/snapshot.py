"""Incremental scans: change detection against a snapshot, carried findings, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_hash
from .report import risk_of, score_of


def state(docs: DataFrame, hash_prefix: int | None = None) -> DataFrame:
    """(path, size, mtime, hash) of docs."""
    return docs.select("path", "size", "mtime", content_hash(F.col("content"), hash_prefix).alias("hash"))


def changes(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``current`` (path, size, mtime, hash) with ``changed`` and ``reason``.

    A row is new, or its size, time or content differs, looked at in this order.
    """
    old = snapshot.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    both = current.join(old, "path", "left")
    reason = F.when(F.col("known").isNull(), "new").when(~F.col("size").eqNullSafe(F.col("old_size")), "size").when(~F.col("mtime").eqNullSafe(F.col("old_mtime")), "mtime").when(~F.col("hash").eqNullSafe(F.col("old_hash")), "hash")
    return both.withColumn("reason", reason).withColumn("changed", F.col("reason").isNotNull()).drop("old_size", "old_mtime", "old_hash", "known")


def removed(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows whose path is gone."""
    return snapshot.join(current.select("path"), "path", "left_anti")


def upserted(snapshot: DataFrame, scanned: DataFrame, findings: DataFrame, when: Column) -> DataFrame:
    """The snapshot after a scan of ``scanned`` (path, size, mtime, hash): an anti join and a union."""
    counts = findings.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("issues_found"))
    fresh = scanned.join(counts, "path", "left").select("path", "size", "mtime", "hash", when.alias("last_scan"), F.coalesce("issues_found", F.lit(0)).alias("issues_found"))
    return snapshot.join(scanned.select("path"), "path", "left_anti").select("path", "size", "mtime", "hash", "last_scan", "issues_found").unionByName(fresh)


def carried(findings: DataFrame, previous: DataFrame, changed: DataFrame) -> DataFrame:
    """New findings plus the previous ones of paths that did not change and still exist."""
    same = changed.where("not changed").select("path")
    return findings.unionByName(previous.join(same, "path", "left_semi"))


def history_row(findings: DataFrame, timestamp: Column) -> DataFrame:
    """(timestamp, security_score, risk_level, total_issues, severity_breakdown) of a scan."""
    from .report import security_score, severity_breakdown

    counts = severity_breakdown(findings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "findings")))).alias("severity_breakdown"))
    return security_score(findings).crossJoin(counts).select(timestamp.alias("timestamp"), "security_score", "risk_level", "total_issues", "severity_breakdown")


def last(history: DataFrame, n: int = 100) -> DataFrame:
    """The n newest rows of a history."""
    return history.orderBy(F.desc("timestamp")).limit(n)


def trend(history: DataFrame, order: str = "timestamp", by: list[str] | None = None) -> DataFrame:
    """The history with the score before and the change since."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(order)
    before = F.lag("security_score").over(w)
    return history.withColumn("previous_score", before).withColumn("score_change", F.round(F.col("security_score") - before, 2))


def daily_scores(events: DataFrame, ts: str, penalty: Column) -> DataFrame:
    """(day, total_issues, security_score, risk_level) of a stream of weighted events."""
    days = events.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("total_issues"), score_of(F.sum(penalty)).alias("security_score"))
    return days.withColumn("risk_level", risk_of(F.col("security_score")))

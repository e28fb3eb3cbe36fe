"""Scans of streams: new files or rows as they come, findings by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Family, evaluate
from ..plans.report import risk_of, score_of


def text_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files as they arrive; the checkpoint keeps which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stream_findings(docs: DataFrame, families: list[Family]) -> DataFrame:
    """Findings of a stream of docs (doc_id, path, content): stateless, so any output mode does."""
    return evaluate(docs, families)


def windowed_scores(events: DataFrame, ts: str, penalty, late: str = "10 minutes", width: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """(window_start, keys..., events, security_score, risk_level), late rows kept up to ``late``."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    out = grouped.agg(F.count(F.lit(1)).alias("events"), score_of(F.sum(penalty)).alias("security_score"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "events", "security_score", risk_of(F.col("security_score")).alias("risk_level"))


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what is there now to Parquet, exactly once each file, then stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

"""Spark-first rule-based security analytics over text, code and configuration."""

__version__ = "0.1.0"

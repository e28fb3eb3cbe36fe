"""Scans: docs to findings, with routing, snapshots and the plug-in registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ScanConfig
from .operators import deps, route, structured
from .operators.families.agents import AGENT_PLANNING, AGENT_REFLECTION, MULTI_AGENT, TOOL_CALLBACK
from .operators.families.code import LLMOPS, MODEL_ATTACK, OWASP_LLM, PROMPT_LEAKAGE, VECTOR_DB
from .operators.families.instructions import AI_CONTEXT
from .operators.families.servers import GARAK, LLM_GUARD, MCP_SERVER
from .operators.families.stores import AGENT_MEMORY, RAG
from .operators.rules import Family, evaluate
from .plans import snapshot as snapshots
from .sources import corpus

FAMILIES = (MCP_SERVER, AI_CONTEXT, AGENT_MEMORY, RAG, PROMPT_LEAKAGE, TOOL_CALLBACK, AGENT_REFLECTION, AGENT_PLANNING, MULTI_AGENT, OWASP_LLM, MODEL_ATTACK, LLMOPS, VECTOR_DB, GARAK, LLM_GUARD)
#: Families over structured texts: docs to findings.
STRUCTURED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "env": structured.env_findings,
    "json": structured.json_findings,
    "mcp_config": structured.client_config_findings,
    "a2a": structured.agent_card_findings,
    "docker_compose": structured.compose_findings,
    "deps": deps.dependency_findings,
}


@dataclass
class Registry:
    """What a scan knows; a caller may register families or functions of its own."""

    families: list[Family] = field(default_factory=lambda: list(FAMILIES))
    functions: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=lambda: dict(STRUCTURED))

    def register(self, family: Family) -> None:
        self.families = [f for f in self.families if f.name != family.name] + [family]

    def register_function(self, name: str, function: Callable[[DataFrame], DataFrame]) -> None:
        """A plug-in: docs (doc_id, path, name, ..., content) to findings."""
        self.functions[name] = function

    def names(self) -> list[str]:
        return [f.name for f in self.families] + list(self.functions)


def rules_catalog(spark: SparkSession, registry: Registry | None = None, ai_only: bool = False) -> DataFrame:
    """(family, rule_id, severity, label, pattern, mode, cwe_id) of every compiled rule."""
    rows = [(f.name, *r) for f in (registry or Registry()).families for r in f.rules()]
    df = spark.createDataFrame(rows, "family string, rule_id string, severity string, label string, pattern string, mode string, cwe_id int")
    return df.where(F.col("family").isin(*route.AI_SCANNERS)) if ai_only else df


def scan(docs: DataFrame, config: ScanConfig | None = None, registry: Registry | None = None, everywhere: bool = False) -> DataFrame:
    """Findings of docs.

    ``everywhere`` lets every family look at every row, for tables of texts that
    are no files; otherwise routing decides.
    """
    config, registry = config or ScanConfig(), registry or Registry()
    wanted = [f for f in registry.families if f.name not in config.disabled and (not config.enabled or f.name in config.enabled)]
    functions = {n: f for n, f in registry.functions.items() if n not in config.disabled and (not config.enabled or n in config.enabled)}
    if everywhere:
        parts = [evaluate(docs, wanted)] if wanted else []
        return _union(parts + [f(docs) for f in functions.values()])
    routed = route.route(docs, config.mode, config.overrides, None if config.available is None else tuple(config.available), tuple(config.enabled), tuple(config.disabled))
    parts = [evaluate(routed, wanted, F.col("scanners"))] if wanted else []
    parts += [f(routed.where(F.array_contains("scanners", n)).drop("scanners")) for n, f in functions.items()]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no family is left to scan with")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def scan_path(spark: SparkSession, root: str, config: ScanConfig | None = None, registry: Registry | None = None) -> DataFrame:
    """Findings of a folder or a file."""
    config = config or ScanConfig()
    docs = corpus.docs_from_files(spark, root, exclude_paths=tuple(config.exclude_paths), exclude_files=tuple(config.exclude_files), legacy_exclude=config.legacy_exclude)
    return scan(docs, config, registry)


def quick_scan(docs: DataFrame, snapshot: DataFrame, config: ScanConfig | None = None, previous: DataFrame | None = None, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, status) of the docs that changed since a snapshot.

    With ``carry_forward`` and the previous findings, those of unchanged docs stay.
    """
    config = config or ScanConfig()
    changed = snapshots.changes(snapshots.state(docs), snapshot)
    fresh = docs.join(changed.where("changed").select("path"), "path", "left_semi")
    findings = scan(fresh, config, registry)
    if config.carry_forward and previous is not None:
        findings = snapshots.carried(findings, previous, changed)
    status = changed.select("path", F.when(F.col("changed"), "scan").otherwise("cached").alias("scanner"), F.lit(0.0).alias("scan_time"), (~F.col("changed")).alias("cached"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error_message"))
    return findings, status

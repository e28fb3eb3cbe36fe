"""Routing: which scanner looks at which row.

``route`` mode keeps, for each row, the one scanner of highest confidence (the
first registered of equals); ``all`` mode keeps every scanner that applies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .structured import is_agent_card

#: File and folder names that settle what a file is.
CONTEXT_FILES = (".cursorrules", "cursorrules", "claude.md", ".claude.md", "agents.md", "copilot-instructions.md", "ai-instructions.md", "system-prompt.md", "system-prompt.txt", "prompt.md", "assistant.md", "rules.md", ".rules", "context.md")
CONTEXT_DIRS = (".claude", ".cursor", ".github", ".ai", ".prompts", "prompts")
MEMORY_FILES = ("memory.json", "memory.yaml", "memory.yml", "state.json", "state.yaml", "state.yml", "session.json", "sessions.json", "checkpoint.json", "checkpoints.json", "history.json", "conversation.json", "vectorstore.json", "vector_store.json", "embeddings.json", "cache.json", "persistence.json", "storage.json")
MEMORY_DIRS = (".memory", ".state", ".cache", ".checkpoints", ".sessions", "memory", "state", "checkpoints", "data", "persistence", ".data")
MEMORY_WORDS = ("memory", "state", "checkpoint", "session", "cache", "history", "vector", "embedding", "persistence")
RAG_FILES = ("rag.json", "rag.yaml", "rag.yml", "rag_config.json", "rag_config.yaml", "retrieval.json", "retrieval.yaml", "knowledge.json", "knowledge.yaml", "kb.json", "kb.yaml", "knowledgebase.json", "vectordb.json", "vector_db.json", "embeddings.json", "embedding.json", "langchain.json", "langchain.yaml", "llamaindex.json", "llama_index.json", "chunking.json", "indexer.json", "ingest.json", "ingestion.json")
RAG_DIRS = ("rag", "retrieval", "knowledge", "kb", "knowledgebase", "knowledge_base", "vectordb", "vector_db", "embeddings", "langchain", "llamaindex", "llama_index", ".rag", ".knowledge", ".embeddings")
RAG_WORDS = ("rag", "retrieval", "knowledge", "vectordb", "vector_db", "embedding", "langchain", "llamaindex", "chunking", "ingest")
CLIENT_FILES = ("mcp.json", "mcp-config.json", "mcp_config.json", "claude_desktop_config.json", ".mcp.json")
LOCK_FILES = ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml")
_SETTINGS = (".json", ".yaml", ".yml", ".toml")
_CODE = (".py", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")


@dataclass(frozen=True)
class Scanner:
    """One registered scanner: its place in the order, tool, extensions, whether built in."""

    name: str
    tool: str
    extensions: tuple[str, ...]
    built_in: bool


def _s(name: str, tool: str, *extensions: str, built_in: bool = False) -> Scanner:
    return Scanner(name, tool, extensions, built_in)


#: Scanners in order of registration, which decides ties.
SCANNERS = (
    _s("python", "bandit", ".py"), _s("bash", "shellcheck", ".sh", ".bash", ".ksh", ".zsh"), _s("bat", "blinter", ".bat", ".cmd"), _s("yaml", "yamllint", ".yml", ".yaml"),
    _s("docker", "hadolint"), _s("docker_compose", "docker-compose", ".yml", ".yaml", built_in=True), _s("markdown", "markdownlint", ".md", ".markdown"),
    _s("javascript", "eslint", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), _s("terraform", "tflint", ".tf", ".tfvars"), _s("go", "golangci-lint", ".go"),
    _s("json", "python", ".json", built_in=True), _s("ruby", "rubocop", ".rb", ".rake", ".gemspec"), _s("php", "phpstan", ".php"), _s("rust", "cargo-clippy", ".rs"),
    _s("sql", "sqlfluff", ".sql"), _s("css", "stylelint", ".css", ".scss", ".sass", ".less"), _s("html", "htmlhint", ".html", ".htm"), _s("kotlin", "ktlint", ".kt", ".kts"),
    _s("swift", "swiftlint", ".swift"), _s("cpp", "cppcheck", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp"), _s("java", "checkstyle", ".java"), _s("typescript", "tsc", ".ts", ".tsx"),
    _s("scala", "scalastyle", ".scala"), _s("perl", "perlcritic", ".pl", ".pm", ".t"), _s("powershell", "pwsh", ".ps1", ".psm1", ".psd1"), _s("r", "Rscript", ".R", ".r"),
    _s("ansible", "ansible-lint", ".yml", ".yaml"), _s("kubernetes", "kube-linter", ".yaml", ".yml"), _s("toml", "taplo", ".toml"), _s("xml", "xmllint", ".xml", ".xsd", ".xsl", ".xslt"),
    _s("protobuf", "buf", ".proto"), _s("graphql", "graphql-schema-linter", ".graphql", ".gql"), _s("solidity", "solhint", ".sol"), _s("lua", "luacheck", ".lua"),
    _s("elixir", "mix", ".ex", ".exs"), _s("haskell", "hlint", ".hs", ".lhs"), _s("clojure", "clj-kondo", ".clj", ".cljs", ".cljc", ".edn"), _s("dart", "dart", ".dart"),
    _s("groovy", "codenarc", ".groovy", ".gradle"), _s("vim", "vint", ".vim"), _s("cmake", "cmakelint", ".cmake"), _s("make", "checkmake"), _s("nginx", "gixy", ".conf"), _s("zig", "zig", ".zig"),
    _s("env", "python", ".env", built_in=True), _s("mcp_config", "python", ".json", built_in=True), _s("mcp_server", "python", ".ts", ".js", ".mjs", ".py", built_in=True),
    _s("ai_context", "python", ".md", ".txt", ".rules", "", built_in=True), _s("agent_memory", "python", *_SETTINGS, built_in=True), _s("rag", "python", *_SETTINGS, built_in=True),
    _s("a2a", "python", ".json", built_in=True), _s("prompt_leakage", "python", *_CODE, built_in=True), _s("tool_callback", "python", *_CODE, built_in=True),
    _s("agent_reflection", "python", *_CODE, built_in=True), _s("agent_planning", "python", *_CODE, built_in=True), _s("multi_agent", "python", *_CODE, built_in=True),
    _s("owasp_llm", "python", *_CODE, built_in=True), _s("model_attack", "python", *_CODE[:5], built_in=True), _s("llmops", "python", ".py", ".yaml", ".yml", ".json", ".toml", built_in=True),
    _s("vector_db", "python", ".py", ".js", ".ts", ".yaml", ".yml", ".json", ".toml", ".env", built_in=True),
    _s("modelscan", "modelscan", ".pkl", ".pickle", ".pt", ".pth", ".bin", ".h5", ".keras", ".pb", ".joblib", ".onnx", ".safetensors", ".npy", ".npz"),
    _s("probe_config", "garak", ".yaml", ".yml", ".json", ".toml", built_in=True), _s("llm_guard", "llm-guard", ".py", ".js", ".ts", ".jsx", ".tsx", ".yaml", ".json", built_in=True),
    _s("deps", "python", ".json", ".lock", ".yaml", built_in=True),
)
AI_SCANNERS = tuple(s.name for s in SCANNERS[44:])


def catalog(spark: SparkSession, available: tuple[str, ...] | None = None) -> DataFrame:
    """(scanner, ordinal, tool, extensions, built_in, available): the registry as a dimension."""
    rows = [(s.name, i, s.tool, list(s.extensions), s.built_in, s.built_in or s.tool in (available or ())) for i, s in enumerate(SCANNERS)]
    return spark.createDataFrame(rows, "scanner string, ordinal int, tool string, extensions array<string>, built_in boolean, available boolean")


def needed(docs: DataFrame) -> DataFrame:
    """Scanners with an extension that occurs in the corpus: a semi join of the registry with the census."""
    present = docs.select("suffix").distinct()
    scanners = catalog(docs.sparkSession).select("*", F.explode("extensions").alias("suffix"))
    return scanners.join(present, "suffix", "left_semi").drop("suffix").dropDuplicates(["scanner"]).orderBy("ordinal")


def missing_tools(spark: SparkSession, available: tuple[str, ...], known: tuple[str, ...] = ()) -> DataFrame:
    """Tools of the registry that are neither at hand nor known: an anti join."""
    have = spark.createDataFrame([(t,) for t in (*available, *known, "python")], "tool string").distinct()
    return catalog(spark).where("not built_in").select("tool").distinct().join(have, "tool", "left_anti").orderBy("tool")


def _any_word(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike("|".join(words))


def _pick(*cases: tuple[Column, int], otherwise: int = 0) -> Column:
    out = F.lit(otherwise)
    for cond, score in reversed(cases):
        out = F.when(cond, score).otherwise(out)
    return out


def _score(*parts: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for cond, points in parts:
        total = total + F.when(cond, points).otherwise(0)
    return F.least(F.lit(100), total)


def confidence(scanner: Scanner) -> Column:
    """Confidence 0 to 100 of a scanner for a row (name, parent, suffix, path, content); 0: does not apply."""
    low, parent, suffix = F.lower("name"), F.lower("parent"), F.col("suffix")
    head, content = F.substring("content", 1, 10_000), F.col("content")
    by_extension = suffix.isin(*scanner.extensions) if scanner.extensions else F.lit(False)
    n = scanner.name
    if n == "docker":
        return _pick((F.col("name").startswith("Dockerfile") | (low == "dockerfile"), 20))
    if n == "make":
        return _pick((low.isin("makefile", "gnumakefile"), 20))
    if n == "env":
        return _pick((low.rlike(r"^\.env(\..*)?$|\.env$"), 20))
    if n == "docker_compose":
        first = F.substring("content", 1, 1000)
        score = _score((F.contains(first, F.lit("services:")), 40), (first.rlike(r"version:\s*['\"]?[23]"), 20), (F.contains(first, F.lit("networks:")), 15), (F.contains(first, F.lit("volumes:")), 15), (low.contains("compose"), 10))
        return F.when(by_extension, score).otherwise(0)
    if n == "kubernetes":
        api, kind = F.contains(head, F.lit("apiVersion:")), F.contains(head, F.lit("kind:"))
        score = _score((api, 35), (kind, 35), (F.contains(head, F.lit("metadata:")), 15), (F.contains(head, F.lit("spec:")), 15))
        return F.when(by_extension, F.when(api & kind, score).otherwise(F.least(score, F.lit(30)))).otherwise(0)
    if n == "ansible":
        score = _score((F.contains(head, F.lit("hosts:")), 30), (F.contains(head, F.lit("tasks:")), 30), (F.contains(head, F.lit("roles:")), 20), (low.contains("playbook"), 10), (F.contains(head, F.lit("- name:")), 10))
        return F.when(by_extension, score).otherwise(0)
    if n == "mcp_config":
        return _pick((low.isin(*CLIENT_FILES) & (F.contains(content, F.lit('"mcpServers"')) | F.contains(content, F.lit('"servers"'))), 95), (low.isin(*CLIENT_FILES), 80))
    if n == "mcp_server":
        imports = head.rlike(r"@modelcontextprotocol|from\s+mcp\b|import\s+mcp\b|McpServer|[Ff]astmcp|FastMCP|mcp\.server")
        tools = head.rlike(r"server\.tool\s*\(|@(mcp|server)\.tool\b|registerTool\s*\(|addTool\s*\(")
        return _pick((by_extension & imports, 90), (by_extension & tools, 70), (by_extension & low.contains("mcp"), 60))
    if n == "ai_context":
        is_it = low.isin(*CONTEXT_FILES) | (parent.isin(*CONTEXT_DIRS) & (low.rlike(r"\.(md|txt)$") | low.isin("rules", "instructions", "prompt", "context"))) | (low.contains("claude") & (suffix == ".md")) | low.rlike("cursor-?rule") | (low.contains("copilot") & low.contains("instruction"))
        return F.when(is_it, _pick((low.isin(".cursorrules", "cursorrules") | (low == "claude.md") | ((parent == ".claude") & low.endswith(".md")) | low.contains("copilot-instructions"), 95), (low == "agents.md", 90), (parent.isin(*CONTEXT_DIRS), 80), (low.rlike("prompt|instruction"), 60), otherwise=50)).otherwise(0)
    if n in ("agent_memory", "rag"):
        files, dirs, words, strong, at = (MEMORY_FILES, MEMORY_DIRS, MEMORY_WORDS, ("memory", "checkpoint", "state"), 70) if n == "agent_memory" else (RAG_FILES, RAG_DIRS, RAG_WORDS, ("rag", "knowledge", "vectordb"), 75)
        in_dir = parent.isin(*dirs) & suffix.isin(*_SETTINGS)
        is_it = low.isin(*files) | in_dir | _any_word(low, words)
        return F.when(is_it, _pick((low.isin(*files), 90), (parent.isin(*dirs), 85), (_any_word(low, strong), at), otherwise=50)).otherwise(0)
    if n == "deps":
        named = content.rlike("\"(next|react|react-server-dom-(webpack|parcel|turbopack))\"")
        return _pick(((low == "package.json") & named, 95), (low == "package.json", 30), (low.isin(*LOCK_FILES), 85))
    return F.when(by_extension, 20).otherwise(0)


def scored(docs: DataFrame, scanners: tuple[Scanner, ...] = SCANNERS) -> DataFrame:
    """``docs`` with ``options``: array of (confidence, -ordinal, scanner) of scanners that apply."""
    options = [F.struct(confidence(s).alias("confidence"), F.lit(-i).alias("order"), F.lit(s.name).alias("scanner")) for i, s in enumerate(scanners)]
    return docs.withColumn("options", F.filter(F.array(*options), lambda o: o["confidence"] > 0))


def route(docs: DataFrame, mode: str = "route", overrides: dict[str, str] | None = None, available: tuple[str, ...] | None = None, enabled: tuple[str, ...] = (), disabled: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``scanners``: the names of the scanners that look at each row.

    ``overrides`` map a path (or its last folders and name) to a scanner, the first that fits
    winning over any confidence; ``available`` lists tools at hand (None: all).
    """
    use = [s for s in SCANNERS if (not enabled or s.name in enabled) and s.name not in disabled and (available is None or s.built_in or s.tool in available)]
    rows = scored(docs, tuple(use))
    if mode == "all":
        chosen = F.transform("options", lambda o: o["scanner"])
    elif mode == "route":
        chosen = F.when(F.size("options") > 0, F.array(F.array_max("options")["scanner"])).otherwise(F.array().cast("array<string>"))
    else:
        raise ValueError(f"mode is route or all, not {mode!r}")
    for key, name in reversed(list((overrides or {}).items())):
        chosen = F.when((F.col("path") == key) | F.col("path").endswith("/" + key.lstrip("/")), F.array(F.lit(name))).otherwise(chosen)
    return rows.withColumn("scanners", chosen).drop("options")


__all__ = ["SCANNERS", "AI_SCANNERS", "Scanner", "catalog", "confidence", "is_agent_card", "missing_tools", "needed", "route", "scored"]

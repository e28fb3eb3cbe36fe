"""Corpora as relations: files, tables, lines, key-value lines, JSON paths, manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex

#: Extensions that a corpus of files is made of, beside special names.
EXTENSIONS = (".py", ".sh", ".bash", ".bat", ".cmd", ".yml", ".yaml", ".md", ".js", ".jsx", ".ts", ".tsx", ".tf", ".go", ".json", ".env", ".toml", ".mjs", ".cjs", ".rules", ".txt")
#: Files taken whatever their extension.
SPECIAL_NAMES = ("mcp.json", "mcp-config.json", "mcp_config.json", "claude_desktop_config.json", ".mcp.json", ".cursorrules", "cursorrules", "claude.md", "agents.md", "copilot-instructions.md", "system-prompt.md", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "makefile")
#: Folders that are left out.
EXCLUDED_PATHS = (
    "node_modules/", "bower_components/", "venv/", ".venv/", "env/", ".env/", "*-env/", "*_env/", "virtualenv/", ".virtualenv/", "site-packages/", "dist-packages/",
    "lib/python*/", "lib64/python*/", "vendor/bundle/", ".bundle/", "vendor/", "target/", ".gradle/", ".m2/", "build/libs/", "packages/", "bin/Debug/", "bin/Release/",
    "obj/", ".git/", ".svn/", ".hg/", "__pycache__/", "*.egg-info/", "dist/", "build/", ".tox/", ".nox/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".cache/",
    ".coverage/", "htmlcov/", ".eggs/", ".idea/", ".vscode/", "*.xcworkspace/", "*.xcodeproj/", "tests/fixtures/", "test/fixtures/", "test-fixtures/", "__fixtures__/",
)
EXCLUDED_FILES = ("*.min.js", "*.min.css", "*.bundle.js", "*.map")


def with_names(rows: DataFrame) -> DataFrame:
    """``path`` taken apart: name, parent folder, suffix (with the dot, lower case kept)."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    parent = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    return rows.withColumns({"name": name, "parent": parent, "suffix": F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)})


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else Path(root).resolve().as_uri())


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files under a folder, hidden ones included, or of one file.

    Spark's own file sources leave out names that begin with a dot, which is
    what settings files are called.
    """
    system, base = _opened(root)
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    top = base.rpartition("/")[0] if info.type == fs.FileType.File else base
    rows = [(f.path[len(top) :].lstrip("/"), f.size, f.mtime) for f in found]
    return spark.createDataFrame(rows, "path string, size long, mtime timestamp")


def docs_from_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, exclude_paths: tuple[str, ...] = EXCLUDED_PATHS, exclude_files: tuple[str, ...] = EXCLUDED_FILES, legacy_exclude: bool = False, partitions: int | None = None) -> DataFrame:
    """Files under ``root`` (or one file) as docs.

    Names, exclusions and virtual environments are decided on the list; only
    what is left is opened, on the executors (bad bytes replaced, line ends made
    ``\\n``).
    """
    every = file_list(spark, root)
    rows = with_names(every).where(scannable(extensions)).where(~excluded(F.col("path"), exclude_paths, exclude_files, legacy_exclude))
    rows = without_virtualenvs(rows, every).select("path", "name", "parent", "suffix", "size", "mtime")
    _, base = _opened(root)
    one = _opened(root)[0].get_file_info(base).type == fs.FileType.File
    top = base.rpartition("/")[0] if one else base

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _opened(root)
        for batch in batches:
            texts = []
            for path in batch["path"]:
                with system.open_input_stream(f"{top}/{path}") as f:
                    texts.append(f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
            yield batch.assign(content=texts, doc_id=batch["path"])[["doc_id", "path", "name", "parent", "suffix", "size", "mtime", "content"]]

    dealt = rows.repartition(partitions or spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(read, "doc_id string, path string, name string, parent string, suffix string, size long, mtime timestamp, content string")


def docs_from_table(df: DataFrame, id_col: str, text_col: str, path: Column | None = None) -> DataFrame:
    """Any (id, text) relation as docs; ``path`` names its rows for routing (default: the id)."""
    key = F.col(id_col).cast("string")
    rows = df.select(key.alias("doc_id"), (path if path is not None else key).alias("path"), F.col(text_col).alias("content"))
    rows = with_names(rows).withColumns({"size": F.octet_length("content").cast("long"), "mtime": F.lit(None).cast("timestamp")})
    return rows.select("doc_id", "path", "name", "parent", "suffix", "size", "mtime", "content")


def scannable(extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a row (path, name, parent, suffix) belongs to a corpus of files."""
    low = F.lower("name")
    context = F.col("parent").isin(".claude", ".github", ".cursor") & (F.col("suffix") == ".md") & (F.size(F.split("path", "/")) == 2)
    return F.col("suffix").isin(*extensions) | F.col("name").startswith("Dockerfile") | low.rlike(r"^\.env(\..*)?$|\.env$") | low.isin(*SPECIAL_NAMES) | context


def excluded(path: Column, paths: tuple[str, ...] = EXCLUDED_PATHS, files: tuple[str, ...] = EXCLUDED_FILES, legacy: bool = False) -> Column:
    """Whether a relative path is left out.

    A pattern of one segment is held against each folder, one of several against
    each run of folders.  ``legacy`` also takes patterns as plain substrings.
    """
    parts = F.split(path, "/")
    folders = F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), F.lit("/"))
    inner = [glob_regex(p.rstrip("/"))[5:-1].replace(".*", "[^/]*") for p in paths]
    out = folders.rlike("/(" + "|".join(inner) + ")/") if inner else F.lit(False)
    if files:
        out = out | F.element_at(parts, -1).rlike("|".join(glob_regex(f) for f in files))
    if legacy:
        for p in paths:
            clean = p.rstrip("/")
            out = out | F.contains(path, F.lit(clean)) | path.rlike(glob_regex(f"*{clean}*"))
    return out


def without_virtualenvs(docs: DataFrame, all_paths: DataFrame) -> DataFrame:
    """Docs outside top-level folders that hold a Python environment, told by marker files of ``all_paths``."""
    marker = r"^[^/]+/(pyvenv\.cfg|bin/activate|Scripts/activate\.bat)$"
    roots = all_paths.where(F.col("path").rlike(marker)).select(F.element_at(F.split("path", "/"), 1).alias("root")).distinct()
    return docs.join(roots, F.element_at(F.split("path", "/"), 1) == F.col("root"), "left_anti")


def census(docs: DataFrame) -> DataFrame:
    """(suffix, files): hidden folders left out, names like ``.env.x`` counted as ``.env``."""
    parts = F.split("path", "/")
    hidden = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.startswith("."))
    kind = F.when(F.lower("name").rlike(r"^\.env(\..*)?$"), ".env").otherwise(F.col("suffix"))
    return docs.where(~hidden).groupBy(kind.alias("suffix")).agg(F.count(F.lit(1)).alias("files")).where("suffix <> ''")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, path, line_no from 1, line)."""
    return docs.select("doc_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).select("doc_id", "path", (F.col("n") + 1).alias("line_no"), "line")


def kv_lines(docs: DataFrame) -> DataFrame:
    """KEY=VALUE lines: (doc_id, path, line_no, key, value); comments and blanks left out, quotes taken off."""
    row = lines(docs).withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#') and contains(line, '=')")
    parts = F.split("line", "=", 2)
    value = F.trim(parts[1])
    quoted = (F.length(value) >= 2) & value.rlike(r"^(\".*\"|'.*')$")
    return row.select("doc_id", "path", "line_no", F.trim(parts[0]).alias("key"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))


def json_paths(docs: DataFrame) -> DataFrame:
    """Every key of JSON documents: (doc_id, path, key_path, key, value, value_type, error_line, error_column).

    Key paths read ``a.b[0].c``.  A text that is no JSON gives one row with the
    place of its error.  The depth of such documents has no bound, so the walk
    is an Arrow-batched function.
    """

    def walk(node, at: str, out: list) -> None:
        todo = [(node, at)]
        while todo:
            node, at = todo.pop()
            if isinstance(node, dict):
                for k, v in node.items():
                    here = f"{at}.{k}" if at else k
                    kind = "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "null" if v is None else "number"
                    out.append((here, k, v if isinstance(v, str) else None if isinstance(v, (dict, list)) else json.dumps(v), kind))
                    todo.append((v, here))
            elif isinstance(node, list):
                todo += [(v, f"{at}[{i}]") for i, v in enumerate(node)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key_path", "key", "value", "value_type", "error_line", "error_column"]
        for batch in batches:
            rows = []
            for doc, path, text in zip(batch["doc_id"], batch["path"], batch["content"]):
                found: list = []
                try:
                    walk(json.loads(text or ""), "", found)
                    rows += [(doc, path, *f, None, None) for f in found]
                except (ValueError, RecursionError) as e:
                    rows.append((doc, path, None, None, None, "error", getattr(e, "lineno", 1), getattr(e, "colno", 1)))
            yield pd.DataFrame(rows, columns=["doc_id", "path", *names]).astype({"error_line": "Int32", "error_column": "Int32"})

    return docs.select("doc_id", "path", "content").mapInPandas(run, "doc_id string, path string, key_path string, key string, value string, value_type string, error_line int, error_column int")

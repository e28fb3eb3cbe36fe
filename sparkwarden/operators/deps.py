"""Vulnerable dependencies: manifests and lock files against version ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import concrete_version, version_key
from ..model import issue, to_findings

#: Ranges of one framework's vulnerable versions, both ends included, and the fix.
RANGES = [
    ("next", "14.3.0-canary.77", "14.3.0-canary.87", "14.3.0-canary.88"), ("next", "15.0.0", "15.0.4", "15.0.5"), ("next", "15.1.0", "15.1.8", "15.1.9"),
    ("next", "15.2.0", "15.2.5", "15.2.6"), ("next", "15.3.0", "15.3.5", "15.3.6"), ("next", "15.4.0", "15.4.7", "15.4.8"), ("next", "15.5.0", "15.5.6", "15.5.7"),
    ("next", "16.0.0", "16.0.6", "16.0.7"),
]
#: Exact vulnerable versions and their fixes.
EXACT = [("19.0.0", "19.0.1"), ("19.1.0", "19.1.2"), ("19.1.1", "19.1.2"), ("19.2.0", "19.2.1")]
SERVER_PACKAGES = ("react-server-dom-webpack", "react-server-dom-parcel", "react-server-dom-turbopack")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
CVE = "CVE-2025-55182"
_NAMES = "(next|" + "|".join(SERVER_PACKAGES) + ")"


def vulnerable_ranges(spark: SparkSession) -> DataFrame:
    """(package, lo, hi, fixed): twenty rows; exact versions are ranges of one."""
    rows = [*RANGES, *[(p, v, v, f) for p in ("react", *SERVER_PACKAGES) for v, f in EXACT]]
    df = spark.createDataFrame(rows, "package string, lo string, hi string, fixed string")
    return df.withColumns({"lo": version_key(F.col("lo")), "hi": version_key(F.col("hi"))})


def dependencies(docs: DataFrame) -> DataFrame:
    """(doc_id, path, kind, package, version) of four kinds of manifests, told by file name."""
    name = F.lower("name")
    base = ["doc_id", "path"]
    sections = ", ".join(f"{s} map<string,string>" for s in SECTIONS)
    manifest = docs.where(name == "package.json").select(*base, F.from_json("content", sections).alias("m"))
    entries = F.flatten(F.array(*[F.map_entries(F.coalesce(F.col(f"m.{s}"), F.create_map().cast("map<string,string>"))) for s in SECTIONS]))
    plain = manifest.select(*base, F.explode(entries).alias("e")).select(*base, F.lit("").alias("kind"), F.col("e.key").alias("package"), concrete_version(F.col("e.value")).alias("version"))
    lock = docs.where(name == "package-lock.json").select(*base, F.from_json("content", "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>").alias("m"))
    lock = lock.select(*base, F.explode(F.when(F.coalesce(F.size("m.packages"), F.lit(0)) > 0, F.col("m.packages")).otherwise(F.col("m.dependencies"))).alias("p", "v"))
    locked = lock.select(*base, F.lit("-lock").alias("kind"), F.element_at(F.split("p", "node_modules/"), -1).alias("package"), F.col("v.version").alias("version"))
    yarn_pattern = rf'(?:^|[\s,"/]){_NAMES}@[^:]+:\s*\n\s*version\s+"([^"]+)"'
    yarn = docs.where(name == "yarn.lock").select(*base, F.explode(F.regexp_extract_all("content", F.lit(yarn_pattern), F.lit(0))).alias("m"))
    yarns = yarn.select(*base, F.lit("-yarn").alias("kind"), F.regexp_extract("m", yarn_pattern, 1).alias("package"), F.regexp_extract("m", yarn_pattern, 2).alias("version"))
    pnpm_pattern = rf"(?m)^\s*['\"]?/?{_NAMES}@([0-9][^:('\"\s]*)"
    pnpm = docs.where(name == "pnpm-lock.yaml").select(*base, F.explode(F.regexp_extract_all("content", F.lit(pnpm_pattern), F.lit(0))).alias("m"))
    pnpms = pnpm.select(*base, F.lit("-pnpm").alias("kind"), F.regexp_extract("m", pnpm_pattern, 1).alias("package"), F.regexp_extract("m", pnpm_pattern, 2).alias("version"))
    return plain.unionByName(locked).unionByName(yarns).unionByName(pnpms)


def match_ranges(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """``deps`` within a vulnerable range, with its fix: a range join against a broadcast dimension."""
    keyed = deps.withColumn("v", version_key(F.col("version"))).where("v is not null")
    return keyed.join(F.broadcast(ranges), ["package"]).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("v", "lo", "hi")


def dependency_findings(docs: DataFrame) -> DataFrame:
    """One finding for each vulnerable dependency (family ``deps``); lines are not told."""
    hit = match_ranges(dependencies(docs), vulnerable_ranges(docs.sparkSession)).where("not (package = 'react' and kind <> '')")
    what = F.when(F.col("package") == "next", "nextjs").when(F.col("package") == "react", "react").otherwise("rsc")
    message = F.format_string(f"{CVE}: %s@%s is vulnerable. Upgrade to %s", "package", "version", "fixed")
    rule = F.concat(F.lit("react2shell-"), what, F.col("kind"))
    return to_findings(hit.select("doc_id", "path", issue("deps", rule, "CRITICAL", message, None).alias("issue")))

"""Reports of static tools as finding rows: lint, secrets, advisories, manifests, and the
union of what could be read. Readers take a path of JSON; parsers take DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import severity
from riskloom.functions import text as t

COLUMNS = ["tool", "rule_id", "filepath", "start_line", "end_line", "severity", "message", "snippet", "details"]
LINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,line:int,endLine:int,severity:int,message:string>>>>"
SECRETS = "array<struct<RuleID:string,Description:string,File:string,StartLine:int,EndLine:int,Secret:string,Match:string>>"
VULN = "struct<id:string,aliases:array<string>,summary:string,severity:array<struct<type:string,score:string>>,database_specific:struct<severity:string>>"
ADVISORIES = f"struct<results:array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<{VULN}>>>>>>"
#: Lock files beside which a manifest's versions are not authoritative.
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "npm-shrinkwrap.json", "bun.lockb"]
#: Tool spellings.
TOOLS = {"eslint": "eslint", "gitleaks": "gitleaks", "osv": "osv-scanner", "osv_scanner": "osv-scanner", "osv-scanner": "osv-scanner", "supabase": "supabase"}


def tool_name(c: Column) -> Column:
    return F.element_at(t.map_of(TOOLS), F.regexp_replace(F.lower(t.trim(c)), "^static_", ""))


def _rows(df: DataFrame, tool: str, rule: Column, path: Column, start: Column, end: Column, level: Column, message: Column, snippet: Column, details: Column) -> DataFrame:
    return df.select(F.lit(tool).alias("tool"), rule.alias("rule_id"), path.alias("filepath"), start.cast("int").alias("start_line"), F.coalesce(end, start).cast("int").alias("end_line"), level.alias("severity"), message.alias("message"), F.left(snippet, F.lit(400)).alias("snippet"), details.cast("string").alias("details"))


NONE = F.lit


def lint(raw: DataFrame, column: str = "value") -> DataFrame:
    """Messages with a rule and a line."""
    each = raw.select(F.explode(F.from_json(column, LINT)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m")).where("m.ruleId IS NOT NULL AND m.line IS NOT NULL")
    return _rows(each, "eslint", F.col("m.ruleId"), F.col("filePath"), F.col("m.line"), F.col("m.endLine"), severity.of_tool(F.lit("eslint"), F.col("m.severity")), F.col("m.message"), F.lit(None).cast("string"), F.lit(None))


def secrets(raw: DataFrame, column: str = "value") -> DataFrame:
    """Leaked secrets; the secret itself is never carried on."""
    each = raw.select(F.explode(F.from_json(column, SECRETS)).alias("s"))
    return _rows(each, "gitleaks", F.col("s.RuleID"), F.col("s.File"), F.col("s.StartLine"), F.col("s.EndLine"), F.lit("high"), F.col("s.Description"), F.lit("[REDACTED]"), F.lit(None))


def advisories(raw: DataFrame, column: str = "value") -> DataFrame:
    """Vulnerabilities of packages, with the best-known id of each."""
    r = raw.select(F.explode(F.from_json(column, ADVISORIES)["results"]).alias("r")).select(F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    v = r.select("path", "p.package", F.explode("p.vulnerabilities").alias("v"))
    scores = F.filter("v.severity", lambda s: s["type"].isin("CVSS_V3", "CVSS_V2"))
    graded = F.get(F.filter(F.transform(scores, lambda s: severity.of_score(s["score"])), lambda x: x.isNotNull()), F.lit(0))
    level = severity.of_tool(F.lit("osv-scanner"), F.coalesce(graded, F.col("v.database_specific.severity")))
    detail = F.to_json(F.struct(F.col("package.name").alias("packageName"), F.col("package.version").alias("packageVersion"), F.col("package.ecosystem").alias("ecosystem"), F.array_distinct(F.concat(F.array("v.id"), F.coalesce("v.aliases", F.array().cast("array<string>")))).alias("aliases")))
    name = F.concat_ws("@", "package.name", "package.version")
    return _rows(v, "osv-scanner", t.advisory_id(F.col("v.id"), F.col("v.aliases")), F.col("path"), F.lit(1), F.lit(1), level, F.concat_ws(": ", name, F.coalesce("v.summary", "v.id")), F.lit(None).cast("string"), detail)


def pinned(version: Column) -> Column:
    """Whether a version names one release: no range, tag, link or wildcard."""
    return version.rlike(r"^v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$")


def manifest_packages(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, version): pinned packages of package.json files without a lock file in their folder."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    name = F.regexp_extract(path, "([^/]*)$", 1)
    locked = files.where(name.isin(*LOCKFILES)).select(folder.alias("folder")).distinct()
    maps = [F.coalesce(F.from_json(F.get_json_object(content, f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("dependencies", "devDependencies", "optionalDependencies")]
    own = files.where(name == "package.json").withColumn("folder", folder).join(locked, "folder", "left_anti")
    each = own.select(path, F.explode(F.flatten(F.array(*[F.map_entries(m) for m in maps]))).alias("e"))
    return each.select(F.col(path).alias("path"), F.col("e.key").alias("name"), F.col("e.value").alias("version")).where(pinned(F.col("version"))).distinct()


def known_vulnerable(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Packages that a table of advisories(name, version, id, severity, summary) lists: the lookup as a join."""
    return packages.join(known, ["name", "version"])


def gather(*readers: Callable[[], DataFrame]) -> DataFrame | None:
    """The union of what the readers give; a reader that fails gives nothing."""
    out = None
    for read in readers:
        try:
            got = read()
            got.schema  # a missing file shows here
        except Exception:
            continue
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def read_json(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return parse(spark.read.text(path, wholetext=True))


def existing_findings(raw: DataFrame, column: str = "value") -> DataFrame:
    """Findings given by a user: an array or {findings: [...]}, one row each as text records."""
    c = F.col(column)
    text = F.when(c.rlike(r"^\s*\["), c).otherwise(F.get_json_object(c, "$.findings"))
    rows = raw.select(F.posexplode(F.from_json(text, "array<string>")).alias("ord", "f"))
    field = lambda k: F.get_json_object("f", f"$.{k}")
    return rows.select(F.col("ord").cast("long").alias("ord"), *[field(k).alias(k) for k in ("type", "source", "severity", "category", "summary", "location", "details")])


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tool", "severity").agg(F.count("*").alias("n"), F.count_distinct("filepath").alias("n_files"))

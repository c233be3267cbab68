"""The logical attributes of findings, their categories and identity keys.

Findings carry two open records, `location` and `details`, as JSON text. Each
attribute has several spellings, kept here only. Two disciplines exist: the first
spelling that is not null must be text (`strict`), or the first with text counts
(`loose`). flatten() materialises them once as plain columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t

#: Spellings of each attribute, first wins.
PATH = ["filepath", "filePath", "path", "file"]
START, END = ["startLine", "start_line", "line", "start"], ["endLine", "end_line", "lineEnd", "end"]
CHUNK, REPO = ["chunkIndex", "chunk_index"], ["repoPath", "repo_path"]
RULE, KIND = ["ruleId", "rule_id", "ruleID"], ["findingType", "finding_type"]
CANDIDATE = ["candidateType", "candidate_type"]
SYMBOL = ["primarySymbol", "primary_symbol"]
ENTRY = ["entryPoint", "entry_point", "entryPointIdentifier", "entry_point_identifier", "entryPointId", "entry_point_id", *SYMBOL]
ANCHOR = ["anchorNodeId", "anchor_node_id", "anchorId", "anchor_id"]
OVERLAP = ["overlapGroupId", "overlap_group_id", "overlapId", "overlap_id"]
STORED = ["identityKey", "identity_key", "dedupeKey", "dedupe_key", "semanticKey", "semantic_key"]
CATEGORY = ["category", "findingCategory", "finding_category"]
REPO_NAME = ["repoFullName", "repositoryFullName"]

#: Other names of finding types.
TYPE_ALIASES = {
    "missing_rate_limiting": "rate_limiting", "missing_rate_limit": "rate_limiting", "frontend_login_rate_limit": "rate_limiting", "rate_limiting": "rate_limiting",
    "missing_audit_logging": "audit_logging", "missing_audit_log": "audit_logging", "audit_logging": "audit_logging", "missing_lockout": "lockout", "login_lockout_missing": "lockout",
    "missing_timeout": "timeout", "missing_timeouts": "timeout", "timeout": "timeout", "object_injection": "prototype_pollution", "prototype_pollution": "prototype_pollution",
    "idor": "idor", "sql_injection": "sql_injection", "command_injection": "command_injection", "unbounded_query": "unbounded_query", "permissive_cors": "permissive_cors",
}
#: Patterns over summary, rule and kind that name a dedupe category, first wins.
DEDUPE_PATTERNS = {
    "prototype_pollution": "prototype poll|object injection",
    "rate_limiting": "rate limit|ratelimit|throttl",
    "audit_logging": "audit log",
    "lockout": "lockout|account lock|brute[- ]?force|login attempts",
    "timeout": "timeout|time out",
    "idor": "idor|insecure direct object",
    "sql_injection": "sql injection",
    "command_injection": "command injection|shell injection",
    "permissive_cors": "cors|cross[- ]origin",
    "unbounded_query": "unbounded|missing limit|no pagination|missing pagination",
}
#: The report's categories and their other names.
CATEGORIES = ["injection", "access_control", "authentication", "secrets", "business_logic", "dependency_risks", "configuration", "supabase"]
CATEGORY_ALIASES = {
    "access_control": "accesscontrol accesscontrolbypass authorization authz idor rls tenant_isolation row_level_security broken_access_control a01_broken_access_control",
    "authentication": "auth authn authentication_failures auth_failures jwt session login cryptographic_failures a04_cryptographic_failures a06_authentication_failures",
    "secrets": "secret credentials credential api_key private_key plaintext_secrets data_exposure information_disclosure info_disclosure",
    "injection": "sql_injection command_injection xss a03_injection",
    "configuration": "misconfiguration security_misconfiguration verbose_errors error_disclosure audit_logging rate_limiting timeout dos logging_monitoring_failures logging_and_monitoring_failures"
    " software_data_integrity_failures software_and_data_integrity_failures unbounded_query cors security_headers a02_security_misconfiguration a07_software_data_integrity_failures"
    " a07_software_and_data_integrity_failures a08_logging_monitoring_failures a08_logging_and_monitoring_failures a09_dos_and_resilience",
    "business_logic": "insecure_design a05_insecure_design",
    "dependency_risks": "vulnerable_dependencies supply_chain a10_vulnerable_dependencies",
    "supabase": "supabase_security supabase_misconfiguration",
}
#: Patterns over normalised text that infer a category, first wins.
CATEGORY_PATTERNS = {
    "dependency_risks": r"dependency|dependencies|vulnerable dependenc|supply chain|\bcve-|\bghsa-|\bosv\b",
    "injection": r"injection|\bxss\b|cross[- ]?site scripting|\brce\b|code execution|\bexecute\b.*\bcode\b|unsafe sql|unsafe query|\beval\b|new function|prototype pollution",
    "access_control": r"access control|authorization|authorisation|\bauthz\b|unauthorized|\bidor\b|insecure direct object|\brls\b|row[- ]level|tenant|org[-_ ]id|ownership|role enforcement|\brole\b|\badmin\b|permission|privilege",
    "secrets": r"secret|credential|api key|api_key|apikey|anon key|anon_key|service role|service_role|supabase key|private key|plaintext|token exposure|token leak|expos\w+ token|data exposure|sensitive data|\bsensitive\b|\bpii\b|\bemail\b",
    "authentication": r"authentication|unauthenticated|authenticat|\bauthn\b|login|\bjwt\b|bearer|auth header|session|token|password|\bmfa\b|cryptograph",
    "configuration": r"misconfig|configuration|\bcors\b|\bcsp\b|\bhsts\b|security header|\bheader\b|verbose|error|debug|logging|monitor|audit log|rate limit|throttl|timeout|\bdos\b|denial of service|resilience|pagination|unbounded|integrity",
    "business_logic": "business logic|insecure design|logic flaw",
}
NOT_RULES = ["static", "repository", "repository_composite"]


def _json(record: str, key: str) -> Column:
    """A field of a record that flatten() has parsed to a map of texts."""
    return F.try_element_at(f"{record}__", F.lit(key))


def strict(record: str, keys: list[str]) -> Column:
    return F.coalesce(*[_json(record, k) for k in keys])


def loose(record: str, keys: list[str]) -> Column:
    return t.first_present(*[_json(record, k) for k in keys])


def by_patterns(text: Column, patterns: dict[str, str]) -> Column:
    out = F.lit("")
    for name, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def type_value(c: Column) -> Column:
    token = t.type_token(c)
    return F.coalesce(F.element_at(t.map_of(TYPE_ALIASES), token), token)


def category_mentions(c: Column) -> Column:
    text = t.category_text(c)
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(k.replace("_", " "))).cast("int") for k in CATEGORIES])


def category_value(c: Column) -> Column:
    """A category's name, another name of one, or what a text with one mention at most implies; else empty."""
    token, aliases = t.category_token(c), {k: k for k in CATEGORIES} | {a: k for k, v in CATEGORY_ALIASES.items() for a in v.split()}
    inferred = F.when(category_mentions(c) > 1, F.lit("")).otherwise(by_patterns(t.category_text(c), CATEGORY_PATTERNS))
    return F.when(F.coalesce(token, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(F.element_at(t.map_of(aliases), token), inferred))


def of_schema_tool(tool: Column) -> Column:
    """Whether a finding's tool may name the category of the schema scan."""
    return F.coalesce(F.lower(tool).isin("supabase", "static_supabase"), F.lit(False))


def flatten(findings: DataFrame, fallback_repo: str = "") -> DataFrame:
    """Adds the attributes of findings(ord, type, source, severity, category, summary, location, details)."""
    d, loc = "details", "location"
    findings = findings.withColumns({f"{c}__": F.from_json(c, "map<string,string>") for c in (d, loc)})
    text = lambda c: F.coalesce(t.trim(c), F.lit(""))
    raw_type = t.first_present(F.col("type"), *[_json(d, k) for k in [*KIND, "type", *RULE, *CANDIDATE]], F.col("category"), *[_json(d, k) for k in CATEGORY])
    repo = F.coalesce(t.repo_path(F.coalesce(strict(loc, REPO), strict(d, REPO), F.lit(fallback_repo))), F.lit(""))
    path = F.coalesce(t.file_path(F.coalesce(strict(loc, PATH), strict(d, PATH))), F.lit(""))
    start, end = t.line_number(strict(loc, START)), t.line_number(strict(loc, END))
    out = findings.withColumns({
        "repo_path": repo, "file_path": path, "start_line": F.coalesce(start, end), "end_line": F.coalesce(end, start), "chunk_index": t.non_negative(strict(loc, CHUNK)), "own_start": start,
        "rule_id": text(strict(d, RULE)), "merge_rule": text(strict(d, [*RULE, *KIND])), "kind": text(strict(d, [*KIND, "type"])), "candidate": text(strict(d, CANDIDATE)),
        "entry_point": text(loose(d, ENTRY)), "symbol": text(loose(d, SYMBOL)), "anchor_id": text(strict(d, ANCHOR)), "overlap_id": text(strict(d, OVERLAP)), "stored_key": text(strict(d, STORED)),
        "raw_type": text(raw_type), "repo_name": F.coalesce(loose(loc, REPO_NAME), loose(d, REPO_NAME), F.lit("")), "tool": text(F.coalesce(_json(d, "tool"), F.col("source"))),
        "package": F.concat_ws("@", *[t.present(_json(d, k)) for k in ("ecosystem", "packageName", "packageVersion")]), "raw_category": text(F.coalesce(strict(d, CATEGORY), F.col("category"))),
    })
    seen = F.concat_ws(" ", *[t.present(c) for c in (F.when(category_mentions(F.col("raw_category")) <= 1, F.col("raw_category")), F.col("summary"), F.col("merge_rule"), F.col("kind"), F.col("file_path"), F.col("repo_path"), _json(d, "rationale"), _json(d, "recommendation"), _json(d, "description"))])
    named = category_value(F.col("raw_category"))
    allowed = of_schema_tool(F.col("tool"))
    kind_token = t.type_token(F.when(F.col("kind") != "", F.col("kind")).otherwise(F.col("merge_rule")))
    words = F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), "merge_rule", "kind"))
    return out.withColumns({
        "identity_type": type_value(F.col("raw_type")),
        "canonical_path": t.canonical_path(F.coalesce(strict(loc, REPO), F.lit("")), F.coalesce(strict(loc, PATH), F.lit(""))),
        "category_name": F.when(named == "", by_patterns(t.category_text(seen), CATEGORY_PATTERNS)).when((named == "supabase") & ~allowed, F.lit("")).otherwise(named),
        "dedupe_category": F.coalesce(F.element_at(t.map_of(TYPE_ALIASES), kind_token), by_patterns(words, DEDUPE_PATTERNS)),
        "finding_text": words,
    }).withColumns({"identity_v1": identity_v1(), "identity_v2": identity_v2()}).drop(f"{d}__", f"{loc}__")


def _range(start: Column, end: Column) -> Column:
    return F.concat(F.lit("lines:"), start, F.lit("-"), F.greatest(start, end))


def identity_v1() -> Column:
    """repo|file|anchor|[entry]|[symbol:]|type|[raw:]|[rule:]|[candidate:]|[pkg:] over flattened columns; empty without a file or a type."""
    c = F.col
    inside = F.startswith(c("file_path"), F.concat(c("repo_path"), F.lit("/"))) & (c("repo_path") != "")
    file = F.when(inside, F.expr("substring(file_path, length(repo_path) + 2)")).otherwise(c("file_path"))
    anchor = (
        F.when(c("anchor_id") != "", F.concat(F.lit("anchor:"), c("anchor_id"))).when(c("overlap_id") != "", F.concat(F.lit("overlap:"), c("overlap_id")))
        .when(c("start_line").isNotNull(), _range(c("start_line"), c("end_line"))).when(c("chunk_index").isNotNull(), F.concat(F.lit("chunk:"), c("chunk_index"))).otherwise("lines:0-0")
    )
    summary = t.present(c("summary"))
    kind = F.coalesce(F.nullif(c("identity_type"), F.lit("")), F.concat(F.lit("summary:"), t.key_part(summary)))
    raw, token, candidate, rule = t.type_token(c("raw_type")), t.type_token(kind), t.type_token(c("candidate")), t.key_part(c("rule_id"))
    part = lambda cond, v: F.when(cond, v)
    parts = [
        t.key_part(c("repo_path")), t.key_part(file), t.key_part(anchor), part(c("entry_point") != "", t.key_part(c("entry_point"))), part(c("symbol") != "", F.concat(F.lit("symbol:"), t.key_part(c("symbol")))),
        t.key_part(kind), part((raw != "") & (raw != token), F.concat(F.lit("raw:"), raw)),
        part(token.isin("rate_limiting", "lockout") & (rule != "") & (rule != t.key_part(kind)) & (rule != raw), F.concat(F.lit("rule:"), rule)),
        part((candidate != "") & (candidate != token) & (candidate != raw), F.concat(F.lit("candidate:"), candidate)), part(c("package") != "", F.concat(F.lit("pkg:"), t.key_part(c("package")))),
    ]
    return F.when((file == "") | kind.isNull(), F.lit("")).otherwise(F.concat_ws("|", *parts))


def identity_v2() -> Column:
    """v2|path|rule|anchor over flattened columns; empty where one is unknown."""
    c = F.col
    outside = (c("repo_path") != "") & (c("file_path") != c("repo_path")) & ~F.startswith(c("file_path"), F.concat(c("repo_path"), F.lit("/")))
    path = F.when(outside, F.regexp_replace(F.concat_ws("/", "repo_path", "file_path"), "/+", "/")).otherwise(c("file_path"))
    own = t.trim(F.coalesce(c("type"), F.lit("")))
    rule = F.lower(F.when(c("rule_id") != "", c("rule_id")).when(own.isin(*NOT_RULES), F.lit("")).otherwise(own))
    start = F.greatest(c("start_line"), F.lit(0))
    anchor = F.when(c("anchor_id") != "", F.concat(F.lit("anchor:"), c("anchor_id"))).when(c("start_line").isNotNull(), _range(start, c("end_line"))).when(c("chunk_index").isNotNull(), F.concat(F.lit("chunk:"), c("chunk_index")))
    return F.when((c("file_path") == "") | (rule == "") | anchor.isNull(), F.lit("")).otherwise(F.concat_ws("|", F.lit("v2"), t.plain_part(path), t.plain_part(rule), t.plain_part(anchor)))


def chunk_key() -> Column:
    """repo|path|symbol|entry|first sink over chunk columns."""
    return F.concat_ws("|", *[t.key_part(F.coalesce(F.col(x), F.lit(""))) for x in ("repo_path", "filepath", "primary_symbol", "entry_point")], F.coalesce(t.key_part(F.get("sinks", F.lit(0))), F.lit("")))


def sha(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def keep_finding() -> Column:
    """The report's filter over flattened columns: findings about controls that a file of this kind or place cannot have are dropped."""
    path, c = F.lower("file_path"), F.col
    control, backend = ["rate_limiting", "audit_logging", "lockout", "timeout"], ["rate_limiting", "audit_logging", "lockout"]
    secret = (c("category_name") == "secrets") | F.contains(c("tool"), F.lit("gitleaks"))
    dependency = (c("category_name") == "dependency_risks") | F.contains(c("tool"), F.lit("osv")) | c("merge_rule").rlike("(?i)^CVE-|^GHSA-|^osv:")
    document = t.extension(path).isin(".json", ".lock", ".md", ".yaml", ".yml")
    destructive = path.rlike("delete|remove|destroy|revoke|disable|suspend") | c("finding_text").rlike(r"\b(delete|remove|destroy|revoke|disable|suspend)\b")
    first_line = (c("own_start") == 1) & c("dedupe_category").isin(*backend)
    saved = (path != "") & (c("dedupe_category") == "audit_logging") & destructive & ~frontend_only()
    return (
        F.when((path != "") & document & (secret | dependency), True).when((path != "") & document & c("dedupe_category").isin(*control), False)
        .when(first_line, saved).when((path != "") & c("dedupe_category").isin(*backend) & frontend_only(), False).otherwise(True)
    )


def frontend_only() -> Column:
    """Whether a flattened finding's file runs in the browser only."""
    path, entry = F.lower("file_path"), F.lower("entry_point")
    action = entry.rlike(r"server[. ]action|use server") | path.rlike(r"(^|/)app/actions(?:/|$|\.)") | path.rlike(r"(^|/)app/.*/actions(?:/|$|\.)")
    rooted = F.concat(F.lit("/"), F.regexp_replace(path, "^/", ""))
    server_part = rooted.rlike(r"(^|/)(src/)?app(/|$)") & ~rooted.rlike(r"(^|/)(src/)?app/api(/|$)") & rooted.rlike(r"(?:^|/)(page|layout|template|error|loading|not-found)\.[tj]sx?$")
    front = path.rlike("(^|/)(frontend|components|app|pages)(/|$)") | t.extension(path).isin(".tsx", ".jsx")
    return ~action & ~server_part & front & ~path.rlike("(^|/)(api|functions|server|backend)(/|$)")

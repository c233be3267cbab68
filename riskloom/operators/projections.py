"""Finding and rule records from one shape to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import severity
from riskloom.functions import text as t
from riskloom.functions.identity import sha, type_value
from riskloom.operators import dedupe
from riskloom.operators.intervals import attach_by_index, point_in_interval
from riskloom.sources.reports import tool_name

#: The report's category of each tool.
TOOL_CATEGORY = {"eslint": "injection", "gitleaks": "secrets", "osv-scanner": "dependency_risks", "supabase": "supabase"}
#: Words of a stack that point to an area.
FOCUS = {"next|remix|express|fastify|hono": "request handlers", "supabase|postgres|prisma|drizzle|knex": "data access rules", "stripe|paypal": "payments and webhooks", "auth|clerk|jwt|oauth": "sessions and tokens", "docker|terraform|kubernetes": "deployment settings", "react|vue|svelte": "browser rendering"}


def pruned(**fields: Column) -> Column:
    """A record as JSON text without its null fields."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "true"})


def location(path: Column, start: Column, end: Column, repo: Column | None = None) -> Column:
    """A location record: path below its repository folder, line 1 by default, no end before the start."""
    p = t.file_path(path)
    r = t.repo_path(repo) if repo is not None else F.lit("")
    full = F.when((r == "") | F.startswith(p, F.concat(r, F.lit("/"))), p).otherwise(F.concat_ws("/", r, p))
    first = F.coalesce(F.greatest(start, F.lit(1)), F.lit(1))
    return pruned(filepath=F.nullif(full, F.lit("")), startLine=first, endLine=F.greatest(first, F.coalesce(end, first)))


def filled(location_column: str, path: Column, start: Column, index: Column) -> DataFrame | Column:
    """A location with the sampled path in place of its own, and line or chunk where it has none."""
    has = lambda *ks: F.coalesce(*[F.get_json_object(location_column, f"$.{k}") for k in ks])
    return pruned(filepath=F.coalesce(path, has("filepath", "filePath", "path", "file")), startLine=F.coalesce(t.line_number(has("startLine", "start_line", "line", "start")), start), endLine=t.line_number(has("endLine", "end_line", "lineEnd", "end")), chunkIndex=F.coalesce(t.non_negative(has("chunkIndex", "chunk_index")), index))


def static_to_existing(static: DataFrame, repo_name: str | None = None) -> DataFrame:
    """Rows of tool reports as findings."""
    details = pruned(tool=F.col("tool"), ruleId=F.col("rule_id"), snippet=F.col("snippet"))
    return static.select(F.lit("static").alias("type"), F.concat(F.lit("static_"), F.regexp_replace("tool", "-scanner$", "")).alias("source"), "severity", F.col("message").alias("summary"), location(F.col("filepath"), F.col("start_line"), F.col("end_line")).alias("location"), details.alias("details"), F.lit(repo_name).cast("string").alias("repo_name"))


def existing_to_static(findings: DataFrame) -> DataFrame:
    """Findings that a known tool made, as rows of its report; others are left out."""
    d, loc = lambda k: F.get_json_object("details", f"$.{k}"), lambda k: F.get_json_object("location", f"$.{k}")
    rows = findings.withColumn("tool", tool_name(F.coalesce(d("tool"), F.col("source")))).where("tool IS NOT NULL")
    return rows.select("tool", F.coalesce(d("ruleId"), d("rule_id"), F.col("type")).alias("rule_id"), t.file_path(F.coalesce(loc("filepath"), loc("path"), loc("file"))).alias("filepath"), t.line_number(F.coalesce(loc("startLine"), loc("line"))).cast("int").alias("start_line"), t.line_number(loc("endLine")).cast("int").alias("end_line"), severity.normal(F.col("severity")).alias("severity"), F.col("summary").alias("message"), d("snippet").alias("snippet"))


def core_rows(static: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tool rows with id, type and the first chunk that holds their line; chunks(filepath, chunk_index, s, e, ord)."""
    rows = static.withColumn("id", sha("tool", "rule_id", "filepath", "start_line", "end_line", "message"))
    joined = point_in_interval(rows, chunks, ["filepath"], "start_line", "s", "e", "ord", ["chunk_index"], ["id"])
    return joined.select("id", F.lit("static").alias("type"), F.col("tool").alias("source"), "severity", F.col("message").alias("summary"), location(F.col("filepath"), F.col("start_line"), F.col("end_line")).alias("location"), "chunk_index")


def repository_rows(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings(id, filepath, chunk_index, start_line, ...) with their chunk's key: by index where they name one, else by line."""
    by_index = attach_by_index(findings, chunks.select("filepath", "chunk_index", "ord", F.col("chunk_uid").alias("uid_i")), ["filepath", "chunk_index"], "ord", ["uid_i"])
    by_line = point_in_interval(by_index, chunks.select("filepath", "s", "e", "ord", F.col("chunk_uid").alias("uid_l")), ["filepath"], "start_line", "s", "e", "ord", ["uid_l"], ["id"])
    return by_line.withColumn("chunk_uid", F.coalesce("uid_i", "uid_l")).drop("uid_i", "uid_l")


def report_rows(flat: DataFrame) -> DataFrame:
    """Flattened findings as report rows: id from title and place."""
    start = F.coalesce(F.greatest("start_line", F.lit(1)), F.lit(1))
    end = F.greatest(start, F.coalesce("end_line", start))
    place = F.concat_ws(":", F.coalesce(F.nullif("file_path", F.lit("")), F.lit("(repository)")), start, end)
    return flat.select("ord", F.sha2(F.concat_ws(":", "summary", place), 256).alias("id"), F.col("summary").alias("title"), severity.normal(F.col("severity")).alias("severity"), F.coalesce(F.nullif("category_name", F.lit("")), F.lit("configuration")).alias("category"), F.when(F.col("type") == "static", "static").otherwise("llm").alias("source"), place.alias("location"))


def with_keys(flat: DataFrame) -> DataFrame:
    """Findings with their keys: a stored key wins over a built one, the V2 key is always built."""
    return flat.withColumn("identity_key", F.coalesce(F.nullif("stored_key", F.lit("")), "identity_v1")).withColumn("identity_key_v2", F.col("identity_v2"))


def debug_rows(flat: DataFrame) -> DataFrame:
    """(ord, summary, severity, ..., place): what merging sees of each flattened finding; empty texts are null."""
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    path = F.coalesce(said("canonical_path"), said("file_path"))
    place = F.struct(path.alias("filepath"), "start_line", "end_line", "chunk_index", said("repo_path").alias("repo_path"))
    named = {"source": "tool", "type": "identity_type", "category": "category_name", "rule_id": "rule_id", "candidate_type": "candidate", "dedupe_key": "identity_key", "entry_point": "entry_point", "anchor_id": "anchor_id", "overlap_id": "overlap_id", "repo_name": "repo_name"}
    return with_keys(flat).select("ord", "summary", "severity", *[said(c).alias(name) for name, c in named.items()], place.alias("place"))


def sampling_chunks(stored: DataFrame) -> DataFrame:
    """Stored chunks as the samplers take them."""
    columns = {"filepath": "path", "chunk_index": "chunk_index", "start_line": "start_line", "end_line": "end_line", "content": "content", "chunk_format": "chunk_format", "overlap_group_id": "overlap_group_id"}
    return stored.select(*[(F.col(c) if c in stored.columns else F.lit(None).cast("string")).alias(name) for c, name in columns.items()])


def worst_known(flat: DataFrame, most: int, whole_details: bool = False) -> DataFrame:
    """The `most` worst of the findings already known, for a prompt: the first of each identity key,
    by falling severity and then order, with path and lines only and, unless whole_details, tool and
    rule only. The limit is the feature: 80 existing and 40 prior findings are shown by default."""
    loc, det = (F.from_json(c, "map<string,string>") for c in ("location", "details"))
    line = lambda *keys: t.line_number(F.coalesce(*[loc[k] for k in keys]))
    path = F.nullif(t.sampling_path(F.coalesce(*[loc[k] for k in ("filepath", "filePath", "path", "file")])), F.lit(""))
    place = F.struct(path.alias("filepath"), line("startLine", "start_line", "line").alias("startLine"), line("endLine", "end_line", "lineEnd", "end").alias("endLine"))
    tool = F.struct(*[F.nullif(det[k], F.lit("")).alias(k) for k in ("tool", "ruleId")])
    # findings without a key go after the aggregate: a filter before it would be pushed below flatten() and repeat what the key is made of
    shown_of = F.min_by(F.struct("ord", "type", "source", "severity", "summary", "location", "details"), "ord")
    first = with_keys(flat).groupBy("identity_key").agg(shown_of.alias("f"), F.max("identity_key").alias("key__")).where("key__ <> ''")
    top = first.select("f.*").orderBy(severity.rank(F.col("severity")).desc(), "ord").limit(most)
    shown = lambda s: F.nullif(F.to_json(s), F.lit("{}"))
    return top.select("ord", "type", "source", "severity", "summary", shown(place).alias("location"), (F.col("details") if whole_details else shown(tool)).alias("details"))


def only_of_rules(flat: DataFrame, rule_ids: DataFrame) -> DataFrame:
    """Findings of a rule pass whose type is one of the rules asked for (rule_id)."""
    asked = rule_ids.select(type_value(F.col("rule_id")).alias("identity_type")).distinct()
    return flat.join(F.broadcast(asked), "identity_type", "left_semi")  # no more than the catalogue has


def beyond_rules(flat: DataFrame, rule_ids: DataFrame, family: str) -> DataFrame:
    """Findings of an open scan that no rule covers, under the type open_scan_<family>."""
    known = rule_ids.select(type_value(F.col("rule_id")).alias("identity_type")).distinct()
    return flat.join(F.broadcast(known), "identity_type", "left_anti").withColumn("type", F.concat(F.lit("open_scan_"), F.coalesce(F.nullif("category_name", F.lit("")), F.lit(family))))


def is_summary() -> Column:
    """Whether a flattened finding is about the repository as a whole."""
    return F.lower("file_path").isin("", "(repository)")


def native_similar(a: str, b: str) -> Column:
    """dedupe.similar over columns of two aliases of merge_facts(), all native."""
    x, y = lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}")
    same, differ = lambda c: (x(c) != "") & (x(c) == y(c)), lambda c: (x(c) != "") & (y(c) != "") & (x(c) != y(c))
    blocked = differ("entry") | differ("cand") | differ("identity_type") | differ("repo_name")
    tied = same("cand") | same("identity_type") | same("entry")
    return ~blocked & (same("rule") | (tied & (same("dedupe_category") | same("kind_token") | (t.jaccard(x("words"), y("words")) >= dedupe.SIMILAR))))


def without_summaries(flat: DataFrame) -> DataFrame:
    """Findings without those about the whole repository that say what a finding in a
    file says. Every way to be similar needs an equal rule, candidate, type or entry
    point, so the pairs meet over these by equality."""
    facts = dedupe.merge_facts(flat)
    keys = F.array_compact(F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("rule", "cand", "identity_type", "entry")]))
    need = ["ord", "entry", "cand", "identity_type", "repo_name", "rule", "dedupe_category", "kind_token", "words"]
    whole = facts.where(is_summary()).select(*need, F.explode(keys).alias("tie")).alias("a")
    # facts that decide nothing further are sent once
    placed = facts.where(~is_summary()).select(*need, F.explode(keys).alias("tie")).dropDuplicates([*need[1:-1], "words", "tie"]).alias("b")
    hits = whole.join(placed, F.col("a.tie") == F.col("b.tie")).where(native_similar("a", "b")).select(F.col("a.ord").alias("ord")).distinct()
    return flat.join(hits, "ord", "left_anti")


def rule_card(questions: str = "questions") -> Column:
    """A rule's id, category and at most three questions, as lines of text."""
    lines = F.transform(F.slice(questions, 1, 3), lambda q: F.concat(F.lit("- "), t.trim(q)))
    return F.concat_ws("\n", F.concat(F.lit("rule: "), "rule_id"), F.concat(F.lit("category: "), "category"), F.array_join(lines, "\n"))


def stack_tags(metadata: str = "metadata") -> Column:
    """Tags of a repository's metadata: the first spelling of each, whatever its case."""
    lists = [F.from_json(F.get_json_object(metadata, f"$.{k}"), "array<string>") for k in ("stack", "frameworks", "languages", "tags")]
    every = t.ordered_unique(*lists)
    return F.filter(every, lambda x, i: F.array_position(F.transform(every, F.lower), F.lower(x)) == i + 1)


def focus_areas(tags: Column) -> Column:
    joined = F.lower(F.array_join(tags, " "))
    return F.array_compact(F.array(*[F.when(joined.rlike(p), F.lit(area)) for p, area in FOCUS.items()]))


def report_category(tool: Column) -> Column:
    return F.coalesce(F.element_at(t.map_of(TOOL_CATEGORY), tool), F.lit("configuration"))


"""Files to chunks: fixed line ranges, character windows, headers and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as t

#: Sink label -> pattern on a line.
SINKS = {
    "database_write": r"(?i)\.(insert|update|upsert|delete)\s*\(",
    "database_read": r"(?i)\.(select|find\w*|query)\s*\(",
    "raw_sql": r"(?i)\b(raw|queryRaw|executeRaw|unsafeSql)\b|\bSELECT\b.+\bFROM\b",
    "exec": r"(?i)\b(exec|execSync|spawn|spawnSync)\s*\(|\bDeno\.(Command|run)\b|child_process",
    "eval": r"(?i)\beval\s*\(|\bnew\s+Function\b",
    "file": r"(?i)\b(readFile|writeFile|createReadStream|createWriteStream)\w*\s*\(",
    "http": r"(?i)\b(fetch|axios|got|request)\s*\(|\bhttps?\.request\s*\(",
    "html": r"(?i)dangerouslySetInnerHTML|\.innerHTML\s*=",
    "log": r"(?i)\bconsole\.(log|info|warn|error)\s*\(|\blogger\.",
    "redirect": r"(?i)\bredirect\s*\(",
}


def lines_of(content: Column) -> Column:
    return F.split(content, "\r\n|\n")


def chunk_ranges(files: DataFrame, n_lines: str, size: int = 160, overlap: int = 40) -> DataFrame:
    """One row for each range of `size` lines with `overlap` shared lines: chunk_index, start_line, end_line, by arithmetic alone."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.col(n_lines) - size) / stride)).cast("int")
    k = files.where(F.col(n_lines) > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), last)))
    start = F.lit(1) + F.col("chunk_index") * stride
    return k.withColumn("start_line", start).withColumn("end_line", F.least(F.col(n_lines).cast("int"), start + size - 1))


def line_chunks(files: DataFrame, path: str = "path", content: str = "content", size: int = 160, overlap: int = 40, least: int = 50) -> DataFrame:
    """Chunks with their text and id; chunks of under `least` visible characters are left out."""
    lines = files.withColumn("lines__", lines_of(F.col(content))).withColumn("n_lines", F.size("lines__"))
    ranges = chunk_ranges(lines, "n_lines", size, overlap)
    body = F.array_join(F.expr("slice(lines__, start_line, end_line - start_line + 1)"), "\n")
    out = ranges.withColumn("chunk", body).drop("lines__").where(F.length(F.regexp_replace("chunk", r"\s", "")) >= least)
    digest = F.sha2("chunk", 256)
    return out.withColumn("content_hash", digest).withColumn("chunk_uid", F.sha2(F.concat_ws(":", path, "start_line", "end_line", digest), 256))


def char_windows(files: DataFrame, path: str = "path", content: str = "content", most: int = 1200, overlap: int = 200) -> DataFrame:
    """Line windows of at most `most` characters (a longer line stands alone) that
    share the last lines of up to `overlap` characters: where a window begins
    depends on the one before, so each file is walked in a task."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, text in zip(b["path"], b["content"]):
                lines, start, index = (text or "").split("\n"), 0, 0
                while start < len(lines) and text:
                    end, held = start, 0
                    while end < len(lines) and (end == start or held + len(lines[end]) + 1 <= most):
                        held += len(lines[end]) + 1
                        end += 1
                    rows.append((name, index, start + 1, end, "\n".join(lines[start:end])))
                    if end >= len(lines):
                        break
                    back, shared = end, 0
                    while back > start + 1 and shared + len(lines[back - 1]) + 1 <= overlap:
                        back -= 1
                        shared += len(lines[back]) + 1
                    start, index = back, index + 1
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "start_line", "end_line", "chunk"])

    plain = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return plain.mapInPandas(walk, "path string, chunk_index int, start_line int, end_line int, chunk string")


def sinks_of(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, label, lines): the lines on which each sink occurs."""
    each = files.select(key, F.posexplode(lines_of(F.col(content))).alias("k", "line"))
    labels = F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in SINKS.items()])
    hits = each.select(key, (F.col("k") + 1).alias("line_no"), F.explode(F.array_compact(labels)).alias("label"))
    return hits.groupBy(key, "label").agg(F.array_sort(F.collect_set("line_no")).alias("lines"))


def header_columns(chunks: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """What a header tells of a chunk: entry type, role, whether it checks who calls, where input comes from, what it holds."""
    c, p = F.col(content), F.lower(path)
    inputs = F.array(*[F.when(c.rlike(rx), F.lit(n)) for n, rx in {
        "request_body": r"(?i)\breq(uest)?\.body\b|\.json\s*\(\s*\)", "query": r"(?i)\breq(uest)?\.query\b|searchParams", "params": r"(?i)\breq(uest)?\.params\b", "headers": r"(?i)\.headers\b",
        "cookies": r"(?i)\bcookies?\b", "form": r"(?i)formData", "env": r"(?i)process\.env|Deno\.env|import\.meta\.env", "file": r"(?i)readFile",
    }.items()])
    sensitive = F.array(*[F.when(c.rlike(rx), F.lit(n)) for n, rx in {"credentials": r"(?i)password|secret|token|api_?key", "personal": r"(?i)\bemail\b|\bphone\b|\baddress\b|\bssn\b", "payment": r"(?i)\bcard\b|\bpayment\b|\binvoice\b"}.items()])
    entry = F.when(p.rlike("webhook"), "webhook").when(c.rlike(r"(?i)\bexport\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b|\b(?:router|app)\.(get|post|put|patch|delete)\s*\("), "http").when(p.rlike(r"(job|worker|cron)"), "job").otherwise("internal")
    return chunks.withColumns({
        "entry_type": entry, "execution_role": F.when(p.rlike(r"\.(tsx|jsx)$"), "frontend").otherwise("backend"),
        "authenticated": c.rlike(r"(?i)\b(auth|session|getUser|requireAuth|verifyToken|jwt)\b"), "authorized": c.rlike(r"(?i)\b(role|permission|isAdmin|canAccess|owner)\w*\b"),
        "input_sources": F.slice(F.array_compact(inputs), 1, 12), "data_sensitivity": F.array_compact(sensitive),
        "primary_symbol": F.regexp_extract(c, r"(?:function|class|const|let|var|def)\s+([A-Za-z_$][\w$]*)", 1),
    }).withColumn("trust_boundaries", F.array_compact(F.array(F.when(entry != "internal", F.lit("external_input")), F.when(F.array_contains("input_sources", "env"), F.lit("configuration")))))


def render_header(columns: list[str]) -> Column:
    """`name: value` lines of columns that are not null or empty, then the end of the header."""
    lines = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    return F.concat_ws("\n", *lines)


def split_header(content: Column) -> Column:
    """struct(header, body) around the first blank line; no header without `name: value` lines before it."""
    header = F.regexp_extract(content, r"^((?:[a-z_]+: [^\n]*\n)+)\n", 1)
    body = F.when(header == "", content).otherwise(F.substr(content, F.length(header) + 2))
    return F.struct(F.regexp_replace(header, "\n$", "").alias("header"), body.alias("body"))


def likely_minified(content: Column, longest: int = 2000) -> Column:
    return F.array_max(F.transform(lines_of(content), F.length)) > longest


def likely_binary(content: Column) -> Column:
    """More than a tenth of the first 1024 characters are control characters, or one is NUL."""
    head = F.left(content, F.lit(1024))
    controls = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F]", ""))
    return F.contains(head, F.lit("\x00")) | (controls > 0.1 * F.length(head))


def entry_points(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, label, line) of route handlers by file conventions and HTTP methods."""
    p = F.col(path)
    route = F.coalesce(*[F.nullif(F.regexp_extract(p, rx, 1), F.lit("")) for rx in (r"(?:^|/)app/(.*)/route\.[tj]sx?$", r"(?:^|/)pages/(api/.*)\.[tj]sx?$", r"(?:^|/)functions/([^/]+)/index\.[tj]s$", r"(?:^|/)app/(.*)/actions?\.[tj]sx?$")])
    lines = files.select(p.alias("path"), F.concat(F.lit("/"), route).alias("route"), F.posexplode(lines_of(F.col(content))).alias("k", "line"))
    method = F.upper(F.regexp_extract("line", r"(?i)\bexport\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\b", 1))
    routed = F.regexp_extract("line", r"""\b(?:router|app)\.(?:get|post|put|patch|delete|options|head)\s*\(\s*['"`]([^'"`]+)""", 1)
    verb = F.upper(F.regexp_extract("line", r"\b(?:router|app)\.(get|post|put|patch|delete|options|head)\s*\(", 1))
    hits = lines.select("path", (F.col("k") + 1).alias("line"), F.when((method != "") & F.col("route").isNotNull(), F.concat_ws(" ", method, "route")).when(routed != "", F.concat_ws(" ", verb, routed)).alias("label"))
    return hits.where("label IS NOT NULL")


def hint_ranges(hints: DataFrame, path: str = "path", start: str = "start_line", end: str = "end_line", around: int = 24) -> DataFrame:
    """Hints of tools, widened and merged into islands: (path, start_line, end_line)."""
    from riskloom.operators.intervals import merge_intervals

    wide = hints.select(F.col(path).alias("path"), F.greatest(F.lit(1), F.col(start) - around).alias("start_line"), (F.col(end) + around).alias("end_line"))
    return merge_intervals(wide, ["path"], "start_line", "end_line").drop("n_ranges")


def uncovered(ranges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ranges of a path that touch none of its anchors(path, start_line, end_line): an equality with a residual, then an anti join."""
    a = anchors.select("path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    hit = ranges.join(a, "path").where("s <= end_line AND start_line <= e").select(ranges["path"], ranges["start_line"], ranges["end_line"]).distinct()
    return ranges.join(hit, ["path", "start_line", "end_line"], "left_anti")


def public_env_anchors(files: DataFrame, path: str = "path", content: str = "content", around: int = 10) -> DataFrame:
    """Islands around lines that put a secret's name into a public variable."""
    from riskloom.functions.detectors import PUBLIC_ENV_SECRET

    lines = files.select(F.col(path).alias("path"), F.posexplode(lines_of(F.col(content))).alias("k", "line")).where(F.col("line").rlike(PUBLIC_ENV_SECRET))
    return hint_ranges(lines.select("path", (F.col("k") + 1).alias("start_line"), (F.col("k") + 1).alias("end_line")), around=around)


#: What a range is chosen for; base ranges are always taken, the others by this order up to a ceiling.
PRIORITY = {"sink": 3, "entry": 2, "hint": 1}


def choose_ranges(ranges: DataFrame, most: int = 6) -> DataFrame:
    """All base ranges of an anchor, then others by priority and start until it has `most`: ranges(path, anchor, start_line, end_line, reason)."""
    from pyspark.sql import Window as W

    weight = F.lit(0)
    for name, n in PRIORITY.items():
        weight = F.when(F.col("reason") == name, n).otherwise(weight)
    base = F.col("reason") == "base"
    rank = F.row_number().over(W.partitionBy("path", "anchor").orderBy(base.desc(), weight.desc(), "start_line"))
    return ranges.withColumn("rn__", rank).where(base | (F.col("rn__") <= most)).drop("rn__")


def anchor_chunks(files: DataFrame, anchors: DataFrame, size: int = 160, overlap: int = 40, least: int = 50) -> DataFrame:
    """Chunks of files(path, content) within anchors(path, anchor, start_line, end_line):
    header lines, a blank line and the code. An anchor's chunks share an overlap group;
    chunks are numbered in the file's order, and the id covers the header too."""
    from pyspark.sql import Window as W

    held = files.select("path", lines_of(F.col("content")).alias("lines__")).join(anchors.select("path", "anchor", F.col("start_line").alias("a__"), F.col("end_line").alias("z__")), "path")
    held = held.withColumn("z__", F.least("z__", F.size("lines__"))).withColumn("n__", F.col("z__") - F.col("a__") + 1).where("n__ > 0")
    cut = chunk_ranges(held, "n__", size, overlap).withColumns({"start_line": F.col("start_line") + F.col("a__") - 1, "end_line": F.col("end_line") + F.col("a__") - 1})
    code = F.array_join(F.expr("slice(lines__, start_line, end_line - start_line + 1)"), "\n")
    rows = header_columns(cut.withColumn("content", code), "path", "content").where(F.length(F.regexp_replace("content", r"\s", "")) >= least)
    rows = rows.withColumn("inputs", F.array_join("input_sources", ", ")).withColumn("holds", F.array_join("data_sensitivity", ", "))
    header = render_header(["entry_type", "execution_role", "authenticated", "authorized", "inputs", "holds"])
    whole = rows.withColumn("chunk", F.concat(header, F.lit("\n\n"), "content")).withColumn("overlap_group_id", F.sha2(F.concat_ws(":", "path", "a__", "z__"), 256))
    digest = F.sha2("chunk", 256)
    out = whole.withColumn("chunk_uid", F.sha2(F.concat_ws(":", "path", "start_line", "end_line", digest), 256)).withColumn("content_hash", digest)
    number = F.row_number().over(W.partitionBy("path").orderBy("start_line", "end_line", "anchor")) - 1
    return out.dropDuplicates(["chunk_uid"]).withColumn("chunk_index", number).select("path", "anchor", "chunk_index", "start_line", "end_line", "chunk", "content_hash", "chunk_uid", "overlap_group_id", "primary_symbol", "entry_type")

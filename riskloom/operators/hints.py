"""What the findings of tools say of code: kinds of hints, entry types, sinks, and the ranges to read around them.

Hints are one row for each range of a file. Their number in a file is bounded by `most`, a
setting of the feature, so joins of a file's ranges with its hints grow with the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import text as t
from riskloom.operators.intervals import merge_intervals

#: Entry type -> words of a finding that tell of it; the first type wins.
ENTRY_WORDS = {
    "webhook": ["webhook", "signature"],
    "job": ["cron", "job", "queue", "worker", "scheduler"],
    "cli": ["cli", "command[- ]?line"],
    "rpc": ["rpc", "graphql", "gql", "trpc"],
    "http": ["route", "router", "endpoint", "handler", "controller", "express", "fastify", "koa", "hapi"],
}
#: Sink -> words of a finding that tell of it.
SINK_WORDS = {
    "sql.query": ["sqli?", "sql[-_ ]?injection", "postgres", "mysql", "sqlite"],
    "db.write": ["insert", "update", "delete", "upsert", "create"],
    "db.query": ["select", "query", "find", "where", "prisma", "sequelize", "knex"],
    "exec": ["command", "exec", "shell", "rce", "code execution"],
    "template.render": ["xss", "cross[- ]site scripting", "template injection", "innerhtml"],
    "http.request": ["ssrf", "server[- ]side request", "request forgery", "http request"],
    "file.write": ["path traversal", "directory traversal", "zip slip", "file write"],
}
#: What a text holds -> patterns over its lower-case letters.
SENSITIVE = {
    "credentials": "password|passwd|credential|secret",
    "tokens": "token|jwt|api[-_ ]?key",
    "financial": "ssn|credit|card|iban|payment|billing",
    "PII": "email|phone|address|name|dob|birth|pii",
}
#: Kinds of hints, weakest first.
KINDS = ["generic", "sink", "entrypoint"]
#: Lines around a hint; hints of a file; ranges of an anchor.
AROUND, IN_FILE, IN_ANCHOR = 24, 12, 4


def tells(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text; letters beyond ASCII do not belong to words."""
    return text.rlike(f"(?<![a-z0-9_])(?:{'|'.join(words)})(?![a-z0-9_])")


def entry_type(text: Column) -> Column:
    """The first entry type that a lower-case text tells of, or null."""
    return F.coalesce(*[F.when(tells(text, words), name) for name, words in ENTRY_WORDS.items()])


def sinks(text: Column) -> Column:
    """All sinks that a lower-case text tells of."""
    return F.array_compact(F.array(*[F.when(tells(text, words), F.lit(name)) for name, words in SINK_WORDS.items()]))


def tool_hints(findings: DataFrame, most: int = IN_FILE) -> DataFrame:
    """(path, start_line, end_line, kind, entry_type, sinks): findings(ord, filepath, start_line,
    end_line, rule_id, message) of one range are one hint: the entry type of the first that has
    one, the sinks of all in order, the strongest kind. The first `most` ranges of a file count.

    Findings without a path or a line from 1 on are left out; a missing end is the start, and
    ends the wrong way round are exchanged. Plain minima only: what a range holds is summed up
    before rows move, however many findings fall on it."""
    start = F.col("start_line").cast("long")
    end = F.coalesce(F.when(F.col("end_line") >= 1, F.col("end_line").cast("long")), start)
    text = F.lower(F.concat_ws(" ", F.coalesce("rule_id", F.lit("")), F.coalesce("message", F.lit(""))))
    rows = findings.select("ord", t.file_path(F.col("filepath")).alias("path"), F.least(start, end).alias("start_line"), F.greatest(start, end).alias("end_line"), text.alias("text"), start.alias("at"))
    rows = rows.where("path <> '' AND at >= 1").withColumn("entry", entry_type(F.col("text")))
    first = {name: F.min(F.when(tells(F.col("text"), words), F.col("ord"))).alias(f"s{k}") for k, (name, words) in enumerate(SINK_WORDS.items())}
    ranges = rows.groupBy("path", "start_line", "end_line").agg(F.min_by("entry", F.when(F.col("entry").isNotNull(), F.col("ord"))).alias("entry_type"), *first.values())
    found = F.array_compact(F.array(*[F.when(F.col(f"s{k}").isNotNull(), F.struct(F.col(f"s{k}").alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, name in enumerate(first)]))
    kind = F.when(F.col("entry_type").isNotNull(), KINDS[2]).when(F.size("sinks") > 0, KINDS[1]).otherwise(KINDS[0])
    named = ranges.withColumn("sinks", F.transform(F.array_sort(found), lambda x: x["name"]))
    place = F.row_number().over(W.partitionBy("path").orderBy("start_line", "end_line"))
    return named.withColumn("rn__", place).where(F.col("rn__") <= most).select("path", "start_line", "end_line", kind.alias("kind"), "entry_type", "sinks")


def _meeting(ranges: DataFrame, hints: DataFrame, keep: list[str]) -> DataFrame:
    """ranges(path, ...) with the hints of their path whose lines they share."""
    h = hints.select("path", F.col("start_line").alias("hs"), F.col("end_line").alias("he"), *keep)
    return ranges.join(h, "path").where((F.col("start_line") <= F.col("he")) & (F.col("hs") <= F.col("end_line")))


def hints_of_anchors(anchors: DataFrame, hints: DataFrame, most: int = IN_ANCHOR) -> DataFrame:
    """(path, anchor, start_line, end_line): the lines around the first `most` hints that meet
    anchors(path, anchor, start_line, end_line), no further than the anchor goes."""
    met = _meeting(anchors.select("path", "anchor", "start_line", "end_line"), hints, [])
    place = F.row_number().over(W.partitionBy("path", "anchor").orderBy("hs", "he"))
    near = met.withColumn("rn__", place).where(F.col("rn__") <= most)
    return near.select("path", "anchor", F.greatest("start_line", F.col("hs") - AROUND).alias("start_line"), F.least("end_line", F.col("he") + AROUND).alias("end_line"))


def range_hints(ranges: DataFrame, hints: DataFrame, most_lines: int = IN_ANCHOR) -> DataFrame:
    """ranges(path, start_line, end_line, ...) with what the hints that meet them say: the entry
    type that ranks first, the sinks in the order of the hints, the first lines of those with sinks.
    Distinct ranges meet the hints, so repeated ones cost nothing; a range collects no more than
    a file's hints."""
    key = ["path", "start_line", "end_line"]
    rank = F.array_position(F.array(*map(F.lit, ENTRY_WORDS)), F.col("entry_type"))
    met = _meeting(ranges.select(*key).distinct(), hints, ["entry_type", "sinks"])
    told = met.groupBy(*key).agg(F.min_by("entry_type", rank).alias("entry_type_hint"), F.array_sort(F.collect_list(F.when(F.size("sinks") > 0, F.struct("hs", "he", "sinks")))).alias("held__"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("held__", lambda x: F.array(x["hs"], x["he"])))))
    said = told.select(*key, "entry_type_hint", F.array_distinct(F.flatten(F.transform("held__", lambda x: x["sinks"]))).alias("hint_sinks"), F.slice(lines, 1, most_lines).alias("sink_lines"))
    none = lambda kind: F.array().cast(kind)
    out = ranges.join(said, key, "left")
    return out.withColumns({"hint_sinks": F.coalesce("hint_sinks", none("array<string>")), "sink_lines": F.coalesce("sink_lines", none("array<bigint>"))})


def hint_anchors(hints: DataFrame, anchors: DataFrame, files: DataFrame, most: int = IN_FILE) -> DataFrame:
    """(path, start_line, end_line): islands around the hints that meet no anchor, within
    files(path, n_lines), the first `most` of a file. An anchor could only equal an island
    whose hint it covers, so none is made twice."""
    met = _meeting(anchors.select("path", "start_line", "end_line"), hints, []).select("path", F.col("hs").alias("start_line"), F.col("he").alias("end_line")).distinct()
    alone = hints.join(met, ["path", "start_line", "end_line"], "left_anti").join(files.select("path", "n_lines"), "path")
    wide = alone.select("path", F.greatest(F.lit(1), F.col("start_line") - AROUND).alias("start_line"), F.least("n_lines", F.col("end_line") + AROUND).alias("end_line")).where("start_line <= end_line")
    place = F.row_number().over(W.partitionBy("path").orderBy("start_line"))
    return merge_intervals(wide, ["path"], "start_line", "end_line").withColumn("rn__", place).where(F.col("rn__") <= most).select("path", "start_line", "end_line")


def auth_location(content: Column) -> Column:
    """The module that a text imports for authentication, sessions or tokens, or null."""
    named = r"""['"]([^'"]*(?:auth|session|jwt)[^'"]*)['"]"""
    pick = lambda p: F.nullif(F.regexp_extract(content, p, 1), F.lit(""))
    return F.coalesce(pick(rf"(?i)from\s+{named}"), pick(rf"(?i)require\(\s*{named}\s*\)"))


def data_sensitivity(content: Column, inputs: Column) -> Column:
    """What a text and the names of its inputs hold."""
    text = F.lower(F.concat_ws(" ", F.coalesce(content, F.lit("")), F.array_join(inputs, " ")))
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in SENSITIVE.items()]))


def trust_boundaries(entry: Column, sink_names: Column) -> Column:
    """The boundaries that code crosses from its entry and to its sinks; `Application -> Internal` without one."""
    some = lambda *prefixes: F.exists(sink_names, lambda s: s.rlike(f"^(?:{'|'.join(prefixes)})"))
    crossed = F.array_compact(F.array(
        F.when(entry.isin("http", "rpc", "webhook"), F.lit("Internet -> Application")), F.when(some("db", "sql"), F.lit("Application -> Database")),
        F.when(F.array_contains(sink_names, "http.request"), F.lit("Application -> External Service")), F.when(F.array_contains(sink_names, "exec") | F.array_contains(sink_names, "file.write"), F.lit("Application -> OS")),
    ))
    return F.when(F.size(crossed) > 0, crossed).otherwise(F.array(F.lit("Application -> Internal")))

"""Queries of tool hints, repository probes, and rows for reports and evaluations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import identity
from riskloom.operators import evals, hints, projections, report
from riskloom.plans.queries import IDENTITY_SQL, _docs, _findings, query
from riskloom.session import table
from riskloom.sources import repositories

#: What a tool says of a document, beside the document's own text.
SAID = ["webhook signature is not checked", "worker runs a shell command", "graphql query without limit", "route handler allows path traversal", "sql injection by insert", "looks odd", "ssrf in a cron job"]


def _tool_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("./src/f"), F.expr("doc_id div 30"), F.lit(".ts"))
    start = F.col("doc_id") * 7 % 83
    return d.select(F.col("doc_id").alias("ord"), path.alias("filepath"), start.alias("start_line"), (start + F.col("doc_id") % 5 - 2).alias("end_line"), F.col("lang").alias("rule_id"), F.concat_ws(" ", said, "text").alias("message"))


def _words_sql(words: list[str]) -> str:
    return f"regexp_matches(t, '\\b(?:{'|'.join(words)})\\b')"


HINTS_SQL = f"""x AS (SELECT doc_id AS ord, 'src/f' || (doc_id // 30) || '.ts' AS path, doc_id * 7 % 83 AS s0, CASE WHEN doc_id * 7 % 83 + doc_id % 5 - 2 >= 1 THEN doc_id * 7 % 83 + doc_id % 5 - 2 ELSE doc_id * 7 % 83 END AS e0,
             lower(lang || ' ' || concat_ws(' ', {SAID}[doc_id % 7 + 1], text)) AS t FROM documents WHERE doc_id * 7 % 83 >= 1),
          y AS (SELECT ord, path, least(s0, e0) AS s, greatest(s0, e0) AS e, CASE {' '.join(f"WHEN {_words_sql(w)} THEN '{n}'" for n, w in hints.ENTRY_WORDS.items())} END AS entry,
             list_filter([{', '.join(f"CASE WHEN {_words_sql(w)} THEN '{n}' END" for n, w in hints.SINK_WORDS.items())}], lambda v: v IS NOT NULL) AS sinks FROM x),
          u AS (SELECT path, s, e, sink, min((ord, k)) AS pos FROM (SELECT path, s, e, ord, unnest(sinks) AS sink, unnest(range(1, len(sinks) + 1)) AS k FROM y) GROUP BY ALL),
          us AS (SELECT path, s, e, list(sink ORDER BY pos) AS sinks FROM u GROUP BY ALL),
          g AS (SELECT path, s, e, arg_min(entry, ord) FILTER (entry IS NOT NULL) AS entry_type FROM y GROUP BY ALL),
          hs AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s, e) AS k FROM g LEFT JOIN us USING (path, s, e)),
          h AS (SELECT path, s, e, entry_type, coalesce(sinks, []) AS sinks FROM hs WHERE k <= 12)"""


@query(f"""WITH {HINTS_SQL} SELECT path, s AS start_line, e AS end_line, CASE WHEN entry_type IS NOT NULL THEN 'entrypoint' WHEN len(sinks) > 0 THEN 'sink' ELSE 'generic' END AS kind, entry_type, array_to_string(sinks, ',') AS sinks FROM h""")
def tool_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tools say of files, as hints."""
    return hints.tool_hints(_tool_findings(spark, sf_dir)).withColumn("sinks", F.array_join("sinks", ","))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the same files, one for each document of every second file."""
    d = _docs(spark, sf_dir)
    path = F.concat(F.lit("src/f"), F.expr("doc_id div 60 * 2"), F.lit(".ts"))
    start = F.col("doc_id") % 71 + 1
    return d.select(path.alias("path"), F.col("doc_id").alias("anchor"), start.alias("start_line"), (start + F.col("doc_id") % 9).alias("end_line"))


ANCHORS_SQL = "a AS (SELECT 'src/f' || (doc_id // 60 * 2) || '.ts' AS path, doc_id AS anchor, doc_id % 71 + 1 AS s, doc_id % 71 + 1 + doc_id % 9 AS e FROM documents)"


@query(f"""WITH {HINTS_SQL}, {ANCHORS_SQL}, m AS (SELECT a.path, anchor, a.s AS a_s, a.e AS a_e, h.s AS hs, h.e AS he, row_number() OVER (PARTITION BY a.path, anchor ORDER BY h.s, h.e) AS k FROM a JOIN h ON a.path = h.path AND a.s <= h.e AND h.s <= a.e)
          SELECT path, anchor, greatest(a_s, hs - 24) AS start_line, least(a_e, he + 24) AS end_line FROM m WHERE k <= 4""")
def anchor_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines to read of each anchor because of hints."""
    return hints.hints_of_anchors(_anchors(spark, sf_dir), hints.tool_hints(_tool_findings(spark, sf_dir)))


@query(f"""WITH {HINTS_SQL}, {ANCHORS_SQL}, m AS (SELECT anchor, h.* FROM a JOIN h ON a.path = h.path AND a.s <= h.e AND h.s <= a.e),
          n AS (SELECT anchor, arg_min(entry_type, list_position({list(hints.ENTRY_WORDS)}, entry_type)) AS entry_type_hint FROM m GROUP BY anchor),
          w AS (SELECT DISTINCT anchor, s AS line FROM m WHERE len(sinks) > 0 UNION SELECT anchor, e FROM m WHERE len(sinks) > 0), l AS (SELECT anchor, list(line ORDER BY line)[1:4] AS lines FROM w GROUP BY anchor),
          q AS (SELECT anchor, s, e, unnest(sinks) AS sink, unnest(range(1, len(sinks) + 1)) AS k FROM m), f AS (SELECT anchor, sink, min((s, e, k)) AS pos FROM q GROUP BY ALL), z AS (SELECT anchor, list(sink ORDER BY pos) AS sinks FROM f GROUP BY anchor)
          SELECT path, anchor, a.s AS start_line, a.e AS end_line, entry_type_hint, coalesce(array_to_string(sinks, ','), '') AS hint_sinks, coalesce(array_to_string(lines, ','), '') AS sink_lines FROM a LEFT JOIN n USING (anchor) LEFT JOIN l USING (anchor) LEFT JOIN z USING (anchor)""")
def range_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with the entry type and the sinks that hints name."""
    said = hints.range_hints(_anchors(spark, sf_dir), hints.tool_hints(_tool_findings(spark, sf_dir)))
    return said.select("path", "anchor", "start_line", "end_line", "entry_type_hint", F.array_join("hint_sinks", ",").alias("hint_sinks"), F.array_join(F.col("sink_lines").cast("array<string>"), ",").alias("sink_lines"))


@query(f"""WITH {HINTS_SQL}, {ANCHORS_SQL}, o AS (SELECT path, greatest(1, s - 24) AS s, least(90, e + 24) AS e FROM h WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = h.path AND a.s <= h.e AND h.s <= a.e)),
          r AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
          i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM r)
          SELECT path, min(s) AS start_line, max(e) AS end_line FROM i GROUP BY path, n HAVING n <= 12""")
def hint_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges made of hints that no anchor covers; every file has 90 lines."""
    found = hints.tool_hints(_tool_findings(spark, sf_dir))
    lines = _tool_findings(spark, sf_dir).select(F.regexp_replace("filepath", r"^\./", "").alias("path"), F.lit(90).cast("long").alias("n_lines")).distinct()
    return hints.hint_anchors(found, _anchors(spark, sf_dir), lines)


FOLDERS = ["", "apps/web", "apps/web/src", "apps/admin/src/api", "packages/ui", "services/core/server", "docs", "node_modules/x", "tools/app"]
NAMES = ["index.ts", "page.tsx", "package.json", "README.md", "tsconfig.json", "util.js", "main.py", ".env"]


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as files: a supplier's are a repository's, its number says which folders and names it has."""
    c = F.col
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    folder = pick(FOLDERS, c("l_partkey") % (c("l_suppkey") % 9 + 1))
    name = F.concat(F.when(c("l_linenumber") > 3, F.concat("l_linenumber", F.lit("_"))).otherwise(""), pick(NAMES, c("l_orderkey") % (c("l_suppkey") % 8 + 1)))
    return table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("repo"), F.concat_ws("/", F.nullif(folder, F.lit("")), name).alias("path"))


FILES_SQL = f"""f0 AS (SELECT l_suppkey AS repo, {FOLDERS}[l_partkey % (l_suppkey % 9 + 1) + 1] AS folder, CASE WHEN l_linenumber > 3 THEN l_linenumber || '_' ELSE '' END || {NAMES}[l_orderkey % (l_suppkey % 8 + 1) + 1] AS name FROM lineitem),
          fa AS (SELECT repo, folder, name, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS path FROM f0),
          f AS (SELECT *, regexp_matches(name, '\\.(ts|tsx|js|jsx)$') AS code, name IN ('package.json', 'tsconfig.json') AS conf FROM fa WHERE folder NOT LIKE 'node_modules%' AND name <> '.env')"""


@query(f"""WITH {FILES_SQL},
          m AS (SELECT repo, count(*) AS n_files, count(*) FILTER (folder <> '') AS nested, bool_or(path = 'package.json') AS root, count(*) FILTER (path LIKE '%/package.json') AS inner_m, bool_or(regexp_matches(folder, '^(apps|packages|services)')) AS cont, bool_or(folder = '' AND conf) AS root_conf,
                count(DISTINCT path) FILTER (folder <> '') AS n_paths FROM f GROUP BY repo),
          r AS (SELECT *, (inner_m >= 2 AND (cont OR root)) OR (root AND inner_m >= 1 AND cont) AS mono FROM m),
          tops AS (SELECT repo, split_part(folder, '/', 1) AS p, count(*) AS total, count(*) FILTER (code) AS code FROM f WHERE folder <> '' GROUP BY ALL),
          anc AS (SELECT DISTINCT repo, unnest([p, p || '/' || split_part(folder, '/', 2), p || '/' || split_part(folder, '/', 2) || '/' || split_part(folder, '/', 3), folder]) AS p FROM (SELECT repo, folder, split_part(folder, '/', 1) AS p FROM f WHERE folder <> '')),
          cov AS (SELECT anc.repo, anc.p, count(*) AS n FROM anc JOIN f ON f.repo = anc.repo AND starts_with(f.path, anc.p || '/') GROUP BY ALL),
          sh AS (SELECT r.repo, max_by(p, len(p)) AS shared FROM cov JOIN r USING (repo) WHERE n = nested AND n_paths > 1 AND nested >= 0.6 * n_files GROUP BY r.repo),
          cand AS (SELECT repo, folder AS p, count(*) AS conf FROM f WHERE conf AND folder <> '' GROUP BY ALL),
          st AS (SELECT c.repo, c.p, c.conf, count(*) AS total, count(*) FILTER (f.code) AS code, count(*) FILTER (regexp_matches(substr(f.path, len(c.p) + 1), '/(src|app|pages|server|api)/')) AS hints FROM cand c JOIN f ON f.repo = c.repo AND starts_with(f.path, c.p || '/') GROUP BY ALL),
          sc AS (SELECT *, 2 * code + total + 25 * conf + 2 * least(hints, 20) AS score FROM st),
          o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, code DESC, total DESC, p) AS k, lead(score) OVER w AS score2, lead(code) OVER w AS code2, count(*) OVER (PARTITION BY repo) AS n, sum(code) OVER (PARTITION BY repo) AS codes FROM sc WINDOW w AS (PARTITION BY repo ORDER BY score DESC, code DESC, total DESC, p)),
          b AS (SELECT o.*, mono, root_conf, n_files, score2 IS NULL OR score >= score2 * CASE WHEN mono AND root_conf THEN 1.25 WHEN mono THEN 1.15 WHEN root_conf THEN 1.4 ELSE 1.2 END AS led,
                CASE WHEN codes > 0 THEN code / codes ELSE total / n_files END AS share, CASE WHEN mono AND root_conf THEN 0.55 WHEN mono THEN 0.5 WHEN root_conf THEN 0.7 ELSE 0.55 END AS least_share FROM o JOIN r USING (repo) WHERE k = 1),
          cf AS (SELECT repo, p FROM b WHERE (n = 1 AND NOT root_conf) OR (led AND share >= least_share AND code >= 5) OR (led AND conf >= 2 AND code >= 10)
                 OR (mono AND conf >= 1 AND hints >= 2 AND code >= 8 AND total >= 12 AND (coalesce(score2, 0) = 0 OR score >= 1.1 * score2 OR coalesce(code2, 0) = 0 OR code >= 1.3 * code2))),
          d AS (SELECT *, row_number() OVER w AS k, lead(code) OVER w AS code2, count(*) OVER (PARTITION BY repo) AS n, sum(code) OVER (PARTITION BY repo) AS codes FROM tops WINDOW w AS (PARTITION BY repo ORDER BY code DESC, total DESC, p)),
          dm AS (SELECT d.repo, p FROM d JOIN r USING (repo) WHERE k = 1 AND (n = 1 OR (code > 0 AND ((code / codes >= CASE WHEN mono THEN 0.55 ELSE 0.7 END AND (coalesce(code2, 0) = 0 OR code >= code2 * CASE WHEN mono THEN 1.3 ELSE 1.5 END)) OR code / codes >= CASE WHEN mono THEN 0.65 ELSE 0.8 END)))),
          j AS (SELECT r.repo, mono, nested, shared, shared IN ('apps', 'packages', 'services') AS box, cf.p AS cp, dm.p AS dp FROM r LEFT JOIN sh USING (repo) LEFT JOIN cf USING (repo) LEFT JOIN dm USING (repo))
          SELECT repo, mono AS monorepo, CASE WHEN nested = 0 THEN NULL WHEN NOT box THEN shared ELSE coalesce(cp, dp, shared) END AS prefix, CASE WHEN nested = 0 THEN NULL WHEN NOT box THEN 'shared' WHEN cp IS NOT NULL THEN 'configured' WHEN dp IS NOT NULL THEN 'dominant' WHEN shared IS NOT NULL THEN 'container' END AS found_by FROM j""")
def project_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the main project of each supplier's repository lies."""
    return repositories.project_folders(_source_files(spark, sf_dir))


@query(f"""WITH {FILES_SQL.replace("FROM fa WHERE folder NOT LIKE 'node_modules%' AND name <> '.env'", "FROM fa")} SELECT repo, bool_or(path IN ('package.json', 'tsconfig.json') OR (code AND folder NOT LIKE 'node_modules%')) AS scripts FROM f GROUP BY repo""")
def script_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' repositories hold scripts."""
    return repositories.script_repositories(_source_files(spark, sf_dir))


@query(f"""WITH {IDENTITY_SQL} SELECT f.ord, rule || ' found' AS summary, CASE WHEN f.ord % 5 = 0 THEN 'high' ELSE 'low' END AS severity, 'llm' AS source, kind AS type, rule AS rule_id, 'handler ' || f.lang AS entry_point,
          '|' || path || '|lines:' || s || '-' || e || '|handler ' || f.lang || '|' || kind || CASE WHEN kind <> rule THEN '|raw:' || rule ELSE '' END AS dedupe_key, lower(path) AS filepath, s AS start_line, e AS end_line FROM f""")
def debug_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merging sees of each finding."""
    rows = projections.debug_rows(identity.flatten(_findings(spark, sf_dir)))
    return rows.select("ord", "summary", "severity", "source", "type", "rule_id", "entry_point", "dedupe_key", "place.filepath", "place.start_line", "place.end_line")


@query(f"""WITH {IDENTITY_SQL} SELECT ord, '|' || path || '|lines:' || s || '-' || e || '|handler ' || lang || '|' || kind || CASE WHEN kind <> rule THEN '|raw:' || rule ELSE '' END AS id FROM f""")
def eval_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their ids for evaluations."""
    return evals.finding_ids(identity.flatten(_findings(spark, sf_dir))).select("ord", "id")


@query(f"""WITH {IDENTITY_SQL}, p AS (SELECT DISTINCT rule, path, s FROM f) SELECT rule AS title, path AS filepath, s AS line, row_number() OVER (PARTITION BY rule ORDER BY path, s) AS place FROM p""")
def report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each rule's findings in a report's order; each rule holds a fourth of all."""
    flat = identity.flatten(_findings(spark, sf_dir))
    return report.group_places(flat.select(F.col("rule_id").alias("title"), F.col("file_path").alias("filepath"), F.col("start_line").alias("line")), ["title"])


@query(f"""WITH {IDENTITY_SQL}, r AS (SELECT source AS area, ord, CASE WHEN ord % 5 = 0 THEN 'high' ELSE 'low' END AS severity, CASE WHEN ord % 3 = 0 THEN 'static' ELSE 'llm' END AS src, rule || ' ' || lang AS title FROM f),
          h AS (SELECT area, arg_min((severity, src, title), (CASE severity WHEN 'high' THEN 0 ELSE 1 END, CASE src WHEN 'static' THEN 0 ELSE 1 END, ord)) AS h, count(*) AS n_findings FROM r GROUP BY area),
          n AS (SELECT area, count(*) AS n_titles, list(title ORDER BY title)[1:3] AS shown FROM (SELECT DISTINCT area, title FROM r) GROUP BY area)
          SELECT area, h[1] AS severity, h[2] AS source, h[3] AS title, n_findings, n_titles, CASE WHEN n_titles > 1 THEN array_to_string(shown, ', ') ELSE '' END AS shown_titles FROM h JOIN n USING (area)""")
def report_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for the findings of each source in a report."""
    rule = F.regexp_replace("summary", " found$", "")
    rows = _findings(spark, sf_dir).join(_docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("source").alias("area"), "lang"), "ord")
    rows = rows.select("area", "ord", "severity", F.when(F.col("ord") % 3 == 0, "static").otherwise("llm").alias("source"), F.concat_ws(" ", rule, "lang").alias("title"))
    return report.group_heads(rows, ["area"]).withColumn("shown_titles", F.array_join("shown_titles", ", "))

"""Queries over the bundled tables. Every operator that DuckDB can express has its SQL
beside it; queries run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import detectors, identity, routes, severity
from riskloom.functions import text as t
from riskloom.operators import catalog, chunking, dedupe, evals, graph, intervals, packing, projections, report, rules, sampling, store
from riskloom.session import table
from riskloom.sources import database, files, reports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# sources and text ---------------------------------------------------------------------------------------------


@query("""SELECT doc_id, lang FROM documents
          WHERE lang IN ('en', 'de') AND n_chars <= 20480 AND position(chr(0) IN substr(text, 1, 4000)) = 0""")
def discover_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("path", F.concat_ws(".", "doc_id", "lang"))
    return d.where(files.eligible(F.col("path"), F.col("n_chars"), F.col("text"), ["en", "de"], 20_480)).select("doc_id", "lang")


@query("""SELECT doc_id, lang FROM documents
          WHERE lang IN ('en', 'de') AND n_chars <= 204800 AND position(chr(0) IN substr(text, 1, 4000)) = 0""")
def discover_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter with the default size limit."""
    d = _docs(spark, sf_dir).withColumn("path", F.concat_ws(".", "doc_id", "lang"))
    return d.where(files.eligible(F.col("path"), F.col("n_chars"), F.col("text"), ["en", "de"])).select("doc_id", "lang")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '^\.?/*', ''), '/+', '/', 'g'), '/+$', '') AS path FROM pages)
          SELECT page_id, path, lower(regexp_extract(path, '(\.[^.]*)$', 1)) AS extension,
                 CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) <= 1 THEN '<root>'
                      ELSE list_filter(string_split(path, '/'), lambda x: x <> '')[1] END AS top_folder
          FROM p""")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", t.sampling_path(F.col("url")).alias("path"))
    return p.select("page_id", "path", t.extension(F.col("path")).alias("extension"), t.top_folder(F.col("path")).alias("top_folder"))


@query("""WITH e AS (SELECT event_type, CASE event_id % 6 WHEN 0 THEN 'P0' WHEN 1 THEN ' sev1' WHEN 2 THEN 'moderate' WHEN 3 THEN 'note' WHEN 4 THEN event_type ELSE 'Minor' END AS raw FROM events),
          n AS (SELECT event_type, CASE lower(trim(raw)) WHEN 'p0' THEN 'critical' WHEN 'sev1' THEN 'high' WHEN 'moderate' THEN 'medium' WHEN 'note' THEN 'info' WHEN 'minor' THEN 'low' ELSE 'medium' END AS level FROM e)
          SELECT event_type, level, CASE level WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank, count(*) AS n
          FROM n GROUP BY ALL""")
def severity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "P0").when(k == 1, " sev1").when(k == 2, "moderate").when(k == 3, "note").when(k == 4, F.col("event_type")).otherwise("Minor")
    e = table(spark, sf_dir, "events").select("event_type", severity.normal(raw).alias("level"))
    return e.groupBy("event_type", "level", severity.rank(F.col("level")).alias("rank")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, sha256(text) AS content_hash FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.tokens_estimate(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("content_hash"))


@query(r"""WITH b AS (SELECT item_id, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN
             ('a','an','the','of','for','to','on','in','with','without','and','or','no','not','missing','lack','lacking','is','are','be','as','by','via','from','into','this','that','these','those','should')))) AS words FROM benchmark)
          SELECT item_id, CAST(len(words) AS INTEGER) AS n_words, array_to_string(words, ' ') AS words FROM b""")
def summary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = t.summary_tokens(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("words"))


@query("""WITH RECURSIVE u AS (SELECT page_id, url, 1 AS k, CAST(5381 AS BIGINT) AS h FROM pages
            UNION ALL SELECT page_id, url, k + 1, xor((h * 33) & 4294967295, CAST(unicode(substr(url, k, 1)) AS BIGINT)) FROM u WHERE k <= length(url))
          SELECT page_id, h AS hash FROM u WHERE k = length(url) + 1""")
def hash_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.conv(t.hash32(F.col("url")), 36, 10).cast("long").alias("hash"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k_number FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), t.line_number(F.get_json_object("props", "$.k")).alias("k_number"))


# chunks -------------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
          k AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 16) / 12.0)) AS BIGINT) + 1)) AS i FROM f)
          SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(1 + i * 12 AS INTEGER) AS start_line, CAST(least(n, i * 12 + 16) AS INTEGER) AS end_line FROM k""")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _docs(spark, sf_dir).select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))
    return chunking.chunk_ranges(f, "n_lines", 16, 4).select("doc_id", "chunk_index", "start_line", "end_line")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), "doc_id", F.col("text").alias("content"))
    return chunking.line_chunks(d, size=16, overlap=4)


@query(r"""WITH f AS (SELECT concat_ws('/', source, lang, doc_id) AS path, doc_id, string_split(text, chr(10)) AS l FROM documents),
          k AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(l) - 16) / 12.0)) AS BIGINT) + 1)) AS i FROM f),
          c AS (SELECT path, doc_id, CAST(1 + i * 12 AS INTEGER) AS start_line, CAST(least(len(l), i * 12 + 16) AS INTEGER) AS end_line, array_to_string(l[1 + i * 12 : least(len(l), i * 12 + 16)], chr(10)) AS chunk FROM k)
          SELECT doc_id, start_line, end_line, sha256(concat_ws(':', path, start_line, end_line, sha256(chunk))) AS chunk_uid
          FROM c WHERE length(regexp_replace(chunk, '\s', '', 'g')) >= 50""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "start_line", "end_line", "chunk_uid")


@query()
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return chunking.char_windows(d).select("path", "chunk_index", "start_line", "end_line")


SECRET_SQL = r"""regexp_matches(text, '\bsk_(?:live|test)_[A-Za-z0-9]{8,}\b|\bxoxb-\d{8,}-\d{8,}-[A-Za-z0-9]{10,}\b|\bAIza[0-9A-Za-z_-]{20,}\b|\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b')
             OR regexp_matches(text, '(?i)\b([A-Z0-9_]*(SECRET|TOKEN|API_KEY|SERVICE_ROLE|PRIVATE_KEY)[A-Z0-9_]*)\b\s*[:=]\s*["''][^"''\\]{10,}["'']')"""


@query(f"""SELECT doc_id FROM documents WHERE {SECRET_SQL}""")
def signals_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(detectors.hardcoded_secret(F.col("text"))).select("doc_id")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_uid"), F.col("text").alias("content"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_uid"), F.col("html").alias("content"))
    return detectors.collect_signals(d.unionByName(p))


@query()
def signals_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query(f"""WITH x AS (SELECT 'd' || doc_id AS chunk_uid, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages),
          s AS (SELECT 'secrets_access' AS signal_id, chunk_uid FROM x WHERE {SECRET_SQL}
                UNION ALL SELECT 'public_storage_bucket', chunk_uid FROM x WHERE regexp_matches(text, '(?i)\\bpublic\\s*:\\s*true\\b') OR (regexp_matches(text, '(?i)bucket') AND regexp_matches(text, '(?i)["''`][^"''`]*public[^"''`]*["''`]'))
                UNION ALL SELECT 'raw_sql_sink', chunk_uid FROM x WHERE regexp_matches(text, '(?i)\\bsql\\s*:\\s*string\\b'))
          SELECT signal_id, count(*) AS n_chunks FROM s GROUP BY signal_id""")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _signals(spark, sf_dir).where(F.col("signal_id").isin("secrets_access", "public_storage_bucket", "raw_sql_sink"))
    return wanted.groupBy("signal_id").agg(F.count("*").alias("n_chunks"))


@query(r"""SELECT page_id, CAST(1 + (CASE WHEN regexp_matches(lower(url), '\.(ts|tsx|js|jsx)$') THEN 5 ELSE 0 END) + (CASE WHEN regexp_matches(lower(url), '/db/|schema\.sql$') THEN 6 ELSE 0 END)
               + (CASE WHEN regexp_matches(lower(url), '/src/|^src/|/service/|/ui/') THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(lower(url), '/functions|/api/|/edge/') THEN 3 ELSE 0 END)
               + (CASE WHEN contains(lower(url), 'webhook') THEN 3 ELSE 0 END) - (CASE WHEN regexp_matches(lower(url), 'package-lock|pnpm-lock|yarn\.lock') THEN 6 ELSE 0 END)
               - (CASE WHEN regexp_matches(lower(url), 'node_modules|\.next|dist/') THEN 10 ELSE 0 END)
               + (CASE WHEN regexp_matches(html, '(?i)\bwebhook\b') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(html, '(?i)\bauth\b|\bjwt\b|\btoken\b|\bsession\b') THEN 3 ELSE 0 END)
               + (CASE WHEN regexp_matches(html, '(?i)\.from\s*\(|\.select\s*\(|\.insert\s*\(|\.update\s*\(|\.delete\s*\(|\bsql\b|\bquery\b') THEN 3 ELSE 0 END)
               + (CASE WHEN regexp_matches(html, '(?i)\badmin\b|\brole\b|\bpermission\b|\bclaims\b') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(html, '(?i)\bconsole\.(log|info|warn|error)\s*\(|\blogger\.') THEN 1 ELSE 0 END)
               + (CASE WHEN regexp_matches(html, '(?i)\bdangerouslySetInnerHTML\b|\beval\s*\(|\bnew Function\b') THEN 2 ELSE 0 END) AS INTEGER) AS score
          FROM pages""")
def chunk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sampling.chunk_score(F.col("url"), F.col("html")).cast("int").alias("score"))


@query("""WITH r AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, length(html) AS n, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY length(html) DESC, page_id) AS k FROM pages)
          SELECT host, page_id, n AS score FROM r WHERE k = 1""")
def best_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "//([^/]+)", 1).alias("path"), F.col("page_id").alias("chunk_index"), F.length("html").cast("long").alias("score"))
    return sampling.best_per_file(p).select(F.col("path").alias("host"), F.col("chunk_index").alias("page_id"), "score")


# intervals ----------------------------------------------------------------------------------------------------


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's hours in steps of 40 h over 60 h: ranges that overlap."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.unix_timestamp(F.min("ts")) / 3600).alias("a"), F.floor(F.unix_timestamp(F.max("ts")) / 3600).alias("z"))
    k = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("z") - F.col("a")) / 40).cast("int"))))
    return k.select("user_id", F.col("k").cast("long").alias("k"), (F.col("a") + 40 * F.col("k")).alias("s"), (F.col("a") + 40 * F.col("k") + 59).alias("e"))


HOURS_SQL = """x AS (SELECT event_id, user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events),
          u AS (SELECT user_id, min(h) AS a, max(h) AS z FROM x GROUP BY user_id),
          i AS (SELECT user_id, k, a + 40 * k AS s, a + 40 * k + 59 AS e FROM (SELECT user_id, a, unnest(range(0, (z - a) // 40 + 1)) AS k FROM u))"""


@query(f"""WITH {HOURS_SQL} SELECT event_id, min(k) AS k FROM x JOIN i USING (user_id) WHERE h BETWEEN s AND e GROUP BY event_id""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    return intervals.point_in_interval(e, _hours(spark, sf_dir), ["user_id"], "h", "s", "e", "k", ["k"], ["event_id"]).select("event_id", "k")


@query("""WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) // 86400 AS d FROM orders),
          l AS (SELECT l_orderkey AS o_orderkey, l_linenumber, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) * 40 AS e FROM lineitem),
          c AS (SELECT o.o_orderkey, l_linenumber, e - s AS n, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY e - s, l_linenumber) AS k FROM o JOIN l USING (o_orderkey) WHERE s <= d + 200 AND e >= d + 210)
          SELECT o_orderkey, l_linenumber, n FROM c WHERE k = 1""")
def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    o = table(spark, sf_dir, "orders").select("o_orderkey", (d + 200).alias("a"), (d + 210).alias("b"))
    s = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    ranges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", s.alias("s"), (s + F.col("l_quantity").cast("long") * 40).alias("e")).withColumn("n", F.col("e") - F.col("s"))
    best = intervals.smallest_enclosing(o, ranges, ["o_orderkey"], ("a", "b"), ("s", "e"), [F.col("l_linenumber")], ["l_linenumber", "n"], ["o_orderkey"])
    return best.where("l_linenumber IS NOT NULL").select("o_orderkey", "l_linenumber", "n")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
          p AS (SELECT x.l_orderkey, x.l_linenumber, y.l_linenumber AS other, greatest(0, least(x.e, y.e) - greatest(x.s, y.s) + 1) AS shared FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber <> x.l_linenumber),
          r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY shared DESC, other) AS k FROM p)
          SELECT l_orderkey, l_linenumber, other, shared FROM r WHERE k = 1""")
def max_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    ranges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("a"), (s + F.col("l_quantity").cast("long")).alias("b"))
    right = ranges.select("l_orderkey", F.col("l_linenumber").alias("other"), F.col("a").alias("s"), F.col("b").alias("e"))
    best = intervals.best_overlap(ranges, right, ["l_orderkey"], ("a", "b"), ("s", "e"), "other", ["other"], ["l_orderkey", "l_linenumber"], F.col("other") != F.col("l_linenumber"))
    return best.select("l_orderkey", "l_linenumber", "other", "shared")


@query(f"""WITH {HOURS_SQL}, o AS (SELECT DISTINCT user_id, h AS s, h + 3 AS e FROM x),
          g AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS f FROM o),
          n AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM g)
          SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n_ranges FROM n GROUP BY user_id, k""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.floor(F.unix_timestamp("ts") / 3600)
    r = table(spark, sf_dir, "events").select("user_id", h.alias("s"), (h + 3).alias("e")).distinct()
    return intervals.merge_intervals(r, ["user_id"], "s", "e")


@query("""WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p, regexp_extract(url, '^[a-z]+') AS url_kind FROM pages),
          c AS (SELECT page_id, array_to_string(p[1:n], '/') AS prefix, n FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS n FROM u)),
          f AS (SELECT DISTINCT array_to_string(p[1:2], '/') AS prefix FROM u WHERE url_kind = 'http')
          SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM c JOIN f USING (prefix) GROUP BY page_id""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes known from plain http pages; pages without one are left out."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    known = p.where("url LIKE 'http://%'").select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix"))
    return intervals.longest_prefix(p, known, "path", "prefix", ["page_id"]).where("prefix IS NOT NULL").select("page_id", "prefix")


@query("""WITH u AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages),
          c AS (SELECT page_id, array_to_string(p[1:n], '/') AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS n FROM u)),
          f AS (SELECT DISTINCT array_to_string(p[1:2], '/') AS prefix FROM u),
          b AS (SELECT page_id, arg_max(prefix, length(prefix)) AS prefix FROM c JOIN f USING (prefix) GROUP BY page_id)
          SELECT u.page_id, b.prefix FROM u LEFT JOIN b USING (page_id)""")
def longest_prefix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes known from all pages, and every page in the result."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    known = p.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("prefix"))
    return intervals.longest_prefix(p, known, "path", "prefix", ["page_id"]).select("page_id", "prefix")


# sampling and packing -----------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS round FROM documents),
          o AS (SELECT doc_id, source, round, row_number() OVER (ORDER BY round, source) AS pick FROM r)
          SELECT doc_id, source, CAST(round AS INTEGER) AS round, CAST(pick AS INTEGER) AS pick FROM o WHERE pick <= 80""")
def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(_docs(spark, sf_dir), "source", [F.desc("n_chars"), F.asc("doc_id")], 80).select("doc_id", "source", "round", "pick")


@query("""WITH r AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations),
          m AS (SELECT conv_id, arg_min(turn, struct_pack(a := -n, b := turn)) AS seed FROM r GROUP BY conv_id),
          s AS (SELECT r.*, max(CASE WHEN turn = seed THEN pos END) OVER (PARTITION BY conv_id) AS sp FROM r JOIN m USING (conv_id)),
          w AS (SELECT *, greatest(0, least(greatest(0, sp - 1), c - 3)) AS start FROM s)
          SELECT conv_id, turn FROM w WHERE pos >= start AND pos < start + 3""")
def seed_window_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n")).dropDuplicates(["conv_id", "turn"])
    longest = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "turn")) == 1
    return sampling.seed_window(c.withColumn("seed", longest), ["conv_id"], "turn", "seed", 3).select("conv_id", "turn")


@query("""WITH g AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY o_custkey ORDER BY f LIMIT 80),
          r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders JOIN g USING (o_custkey))
          SELECT o_orderkey, o_custkey FROM r WHERE k <= 5""")
def cap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cap_groups(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 80, 5).select("o_orderkey", "o_custkey")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, 6300 + sum(CAST(l_quantity AS BIGINT)) OVER w AS prompt_tokens, row_number() OVER w AS position
                    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber ROWS UNBOUNDED PRECEDING))
          SELECT l_orderkey, l_linenumber, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, CAST(position AS INTEGER) AS position, prompt_tokens <= 6400 AND position <= 25 AS packed FROM p""")
def rule_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_quantity").cast("long").alias("tokens"))
    packed = packing.prefix_budget(rows, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], "tokens", 6300, 6400)
    return packed.select("l_orderkey", "l_linenumber", "prompt_tokens", "position", "packed")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
          b AS (SELECT conv_id, turn, k, 0 AS bin, 100 + n AS held, 1 AS c FROM r WHERE k = 1
                UNION ALL SELECT r.conv_id, r.turn, r.k, CASE WHEN held + n > 400 OR c >= 3 THEN bin + 1 ELSE bin END, CASE WHEN held + n > 400 OR c >= 3 THEN 100 + n ELSE held + n END, CASE WHEN held + n > 400 OR c >= 3 THEN 1 ELSE c + 1 END
                FROM b JOIN r ON r.conv_id = b.conv_id AND r.k = b.k + 1)
          SELECT conv_id, turn, CAST(bin AS INTEGER) AS bin FROM b""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.tokens_estimate(F.col("text")).alias("tokens"))
    return packing.sequential_bins(rows, ["conv_id"], "turn", "tokens", 100, 400, 3).select("conv_id", "turn", "bin")


#: Contents and, read off the rules by hand, their signals with evidence.
DETECTOR_SAMPLES = [
    ('<input type="password"/> onClick={signIn}', [("login_attempt_present", "password login attempt detected")]),
    ("export async function POST(request) {}", [("api_handler", "export async function POST(")]),
    ("router.patch('/items', save)", [("api_handler", "router.patch(")]),
    ("const t = env.T ?? '';\nsend({ auth: `Bearer ${t}` })", [("bearer_token_optional", "bearer token defaults to empty or optional value")]),
    ("const a = incoming.headers.get('authorization');\nif (a.startsWith('Bearer ')) go()", [("auth_header_present", "reads Authorization bearer token from request headers")]),
    ("  const claims = jwt.decode(raw)", [("jwt_decode_present", "const claims = jwt.decode(raw)")]),
    ("reply.setHeader('Access-Control-Allow-Origin', '*')", [("cors_permissive_or_unknown", "CORS allow-origin wildcard detected")]),
    ("res.json({ all: process.env })", [("logs_sensitive", "process.env")]),
    ("app.get('/debug/state', show)", [("api_handler", "app.get("), ("debug_endpoint", "app.get('/debug/state'")]),
    ("fetch(u, { headers: { Authorization: `Bearer ${anonKey}` } })", [("public_api_key_bearer", "Authorization: `Bearer ${anonKey}`"), ("public_api_key_usage", "Authorization: `Bearer ${anonKey}`")]),
    ("const k = cfg.MY_ANON_KEY\nheaders.set('authorization', `Bearer ${k}`)", [("public_api_key_bearer", "headers.set('authorization', `Bearer ${k}`)"), ("public_api_key_usage", "headers.set('authorization', `Bearer ${k}`)")]),
    ("createClient(url, PROJECT_ANON_KEY)", [("public_api_key_usage", "PROJECT_ANON_KEY")]),
    ("createBucket('pics', { public: true })", [("public_storage_bucket", "storage bucket marked as public")]),
    ("function runSql(sql: string) { db.query(sql) }", [("raw_sql_sink", "raw SQL execution helper accepts SQL string")]),
    ("const f = searchParams.get('f')\ntable.or(f)", [("orm_query_sink", "table.or(f)"), ("untrusted_input_present", "const f = searchParams.get('f')")]),
    ("const body = await request.json()\nconst f = `id.eq.${body.id}`\ntable.or(f)", [("orm_query_sink", "table.or(f)"), ("untrusted_input_present", "const f = `id.eq.${body.id}`")]),
    ("knex.whereRaw('a = ' + req.body.a)", [("orm_query_sink", "knex.whereRaw('a = ' + req.body.a)"), ("untrusted_input_present", "knex.whereRaw('a = ' + req.body.a)")]),
    ("table.where({ id: other })", []),
    ("table.or(`name.eq.${fixed}`)", []),
    ("knex.whereRaw('a = ?', [req.body.a])", []),
    ('const API_KEY = "0123456789abcdef"', [("secrets_access", "hardcoded secret token detected")]),
    ("const u = req.params.userId", [("id_in_path_or_query", "req.params.userId"), ("client_supplied_user_id", "req.params.userId"), ("client_supplied_identifier", "req.params.userId")]),
    ("const { teamId, page } = req.query", [("id_in_path_or_query", "const { teamId, page } = req.query"), ("client_supplied_org_id", "const { teamId, page } = req.query"), ("client_supplied_identifier", "const { teamId, page } = req.query")]),
    ("const s = searchParams.get('sort')", []),
    ("'use client'\nconst c = createClient(a)\nc.from('t').upsert(row)", [("client_db_write", "client code performs direct database write via supabase.from(...).insert/update")]),
]


def _sample_values() -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({k}, {text(signal)}, {text(evidence)})" for k, (_, hits) in enumerate(DETECTOR_SAMPLES) for signal, evidence in hits)


@query(f"""WITH m(k, signal_id, evidence) AS (VALUES {_sample_values()})
          SELECT doc_id, signal_id, evidence FROM documents JOIN m ON doc_id % {len(DETECTOR_SAMPLES)} = k""")
def detector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stands for one of the samples, in turn."""
    samples = F.array(*[F.lit(c) for c, _ in DETECTOR_SAMPLES])
    d = _docs(spark, sf_dir).select("doc_id", F.element_at(samples, (F.col("doc_id") % len(DETECTOR_SAMPLES) + 1).cast("int")).alias("content"))
    return detectors.collect_signals(d, "doc_id").select("doc_id", "signal_id", "evidence")


# rules --------------------------------------------------------------------------------------------------------


def _rule_values() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    return ",\n".join(f"('{r[0]}', '{r[1]}', {quoted(r[3])}, {quoted(r[4])}, {quoted(r[5])})" for r in rules.RULES)


SIGNALS_OF_EVENTS = ["public_entrypoint", "api_handler", "raw_sql_sink", "untrusted_input_present", "secrets_access", "webhook_handler", "authn_present", "frontend_dom_write", "exec_sink", "orm_query_sink"]

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _signal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a user: one for each of ten kinds of events, by value."""
    named = F.element_at(F.array(*map(F.lit, SIGNALS_OF_EVENTS)), (F.col("event_id") % 10 + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("chunk_uid")).agg(F.collect_set(named).alias("signals")).withColumn("exposure", F.when(F.col("chunk_uid") % 2 == 0, "public").otherwise("internal")).withColumn("role", F.when(F.col("chunk_uid") % 3 == 0, "api_handler").otherwise("job_worker"))


@query(f"""WITH c AS (SELECT user_id AS chunk_uid, list_distinct(list([{', '.join(f"'{s}'" for s in SIGNALS_OF_EVENTS)}][event_id % 10 + 1])) AS signals FROM events GROUP BY user_id),
          r(rule_id, category, needs_all, needs_any, optional) AS (VALUES {_rule_values()}),
          m AS (SELECT chunk_uid, rule_id, category, round(3 * len(list_intersect(needs_all, signals)) + CASE WHEN len(list_intersect(needs_any, signals)) > 0 THEN 2 ELSE 0 END + len(list_intersect(optional, signals))
                  + CASE WHEN chunk_uid % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN chunk_uid % 3 = 0 THEN 0.15 ELSE 0.1 END, 2) AS score
                FROM c, r WHERE list_has_all(signals, needs_all) AND (len(needs_any) = 0 OR list_has_any(needs_any, signals)))
          SELECT chunk_uid, rule_id, category, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY chunk_uid ORDER BY score DESC, rule_id) AS INTEGER) AS rank FROM m""")
def rule_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rules(_signal_chunks(spark, sf_dir), rules.catalogue(spark)).drop("prompt_tokens")


def _event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of a user over all events: each kind of event gives one signal, and another from a value of 150 on, so the sets differ between users."""
    kind = F.greatest(F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.coalesce("event_type", F.lit(""))), F.lit(1))
    named = F.element_at(F.array(*map(F.lit, SIGNALS_OF_EVENTS)), (2 * kind - F.when(F.col("value") >= 150, 0).otherwise(1)).cast("int"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("chunk_uid")).agg(F.collect_set(named).alias("signals"))
    return e.withColumn("exposure", F.when(F.col("chunk_uid") % 2 == 0, "public").otherwise("internal")).withColumn("role", F.when(F.col("chunk_uid") % 3 == 0, "api_handler").otherwise("job_worker"))


@query(f"""WITH n AS (SELECT user_id, [{', '.join(f"'{s}'" for s in SIGNALS_OF_EVENTS)}][2 * greatest(coalesce(list_position([{', '.join(f"'{s}'" for s in EVENT_TYPES)}], event_type), 0), 1) - CASE WHEN value >= 150 THEN 0 ELSE 1 END] AS signal FROM events),
          c AS (SELECT user_id AS chunk_uid, list_distinct(list(signal)) AS signals FROM n GROUP BY user_id),
          r(rule_id, category, needs_all, needs_any, optional) AS (VALUES {_rule_values()}),
          m AS (SELECT chunk_uid, rule_id, category, round(3 * len(list_intersect(needs_all, signals)) + CASE WHEN len(list_intersect(needs_any, signals)) > 0 THEN 2 ELSE 0 END + len(list_intersect(optional, signals))
                  + CASE WHEN chunk_uid % 2 = 0 THEN 0.25 ELSE 0 END + CASE WHEN chunk_uid % 3 = 0 THEN 0.15 ELSE 0.1 END, 2) AS score
                FROM c, r WHERE list_has_all(signals, needs_all) AND (len(needs_any) = 0 OR list_has_any(needs_any, signals)))
          SELECT chunk_uid, rule_id, category, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY chunk_uid ORDER BY score DESC, rule_id) AS INTEGER) AS rank FROM m""")
def rule_eligibility_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rules(_event_chunks(spark, sf_dir), rules.catalogue(spark)).drop("prompt_tokens")


@query()
def rule_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.select_rules(_event_chunks(spark, sf_dir), rules.catalogue(spark))


# identity, dedupe, merge --------------------------------------------------------------------------------------


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings carried by documents: open records with several spellings."""
    d = _docs(spark, sf_dir)
    loc = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("./"), "source", F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".ts")).alias("filepath"), (F.col("doc_id") % 40 + 1).alias("startLine"))))
    loc = F.coalesce(loc, F.to_json(F.struct(F.concat("source", F.lit("/f"), (F.col("doc_id") % 50).cast("string"), F.lit(".ts")).alias("file"), (F.col("doc_id") % 40 + 1).alias("start_line"), (F.col("doc_id") % 40 + 3).alias("end_line"))))
    rule = F.element_at(F.array(*map(F.lit, ["sql_injection", "missing_rate_limiting", "idor", "missing_timeout"])), (F.col("doc_id") % 4 + 1).cast("int"))
    details = F.to_json(F.struct(rule.alias("ruleId"), F.concat(F.lit("handler "), F.col("lang")).alias("entryPoint")))
    return d.select(F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("type"), F.lit("llm").alias("source"), F.when(F.col("doc_id") % 5 == 0, "high").otherwise("low").alias("severity"), F.lit(None).cast("string").alias("category"), F.concat_ws(" ", rule, F.lit("found")).alias("summary"), loc.alias("location"), details.alias("details"))


IDENTITY_SQL = """f AS (SELECT doc_id AS ord, source || '/f' || (doc_id % 50) || '.ts' AS path, doc_id % 40 + 1 AS s, CASE WHEN doc_id % 3 = 0 THEN doc_id % 40 + 1 ELSE doc_id % 40 + 3 END AS e,
             ['sql_injection', 'missing_rate_limiting', 'idor', 'missing_timeout'][doc_id % 4 + 1] AS rule, ['sql_injection', 'rate_limiting', 'idor', 'timeout'][doc_id % 4 + 1] AS kind, lang, source FROM documents)"""


@query(f"""WITH {IDENTITY_SQL} SELECT ord, '|' || path || '|lines:' || s || '-' || e || '|handler ' || lang || '|' || kind || CASE WHEN kind <> rule THEN '|raw:' || rule ELSE '' END AS identity_v1 FROM f""")
def identity_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.flatten(_findings(spark, sf_dir)).select("ord", "identity_v1")


@query(f"""WITH {IDENTITY_SQL} SELECT ord, 'v2|' || path || '|' || rule || '|lines:' || s || '-' || e AS identity_v2 FROM f""")
def identity_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.flatten(_findings(spark, sf_dir)).select("ord", "identity_v2")


@query(f"""WITH {IDENTITY_SQL}, k AS (SELECT ord, path || s || '-' || e || lang || kind || rule AS key FROM f)
          SELECT min(ord) AS ord, count(*) AS n_copies FROM k GROUP BY key""")
def exact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.exact_duplicates(identity.flatten(_findings(spark, sf_dir)).select("ord", "identity_v1"), ["identity_v1"], "ord").select("ord", "n_copies")


@query(f"""WITH {IDENTITY_SQL} SELECT ord, min(ord) OVER (PARTITION BY path, s, rule, lang) AS cluster FROM f""")
def greedy_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.greedy_clusters(identity.flatten(_findings(spark, sf_dir)))


@query()
def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = identity.flatten(_findings(spark, sf_dir))
    return dedupe.merged_findings(flat, dedupe.greedy_clusters(flat))


@query("""SELECT CASE WHEN doc_id % 4 = 1 AND doc_id % 40 + 1 = 1 THEN false ELSE true END AS keep, count(*) AS n FROM documents GROUP BY 1""")
def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.flatten(_findings(spark, sf_dir)).groupBy(identity.keep_finding().alias("keep")).agg(F.count("*").alias("n"))


@query("""SELECT category, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'injection' WHEN 1 THEN 'configuration' WHEN 2 THEN 'access_control' ELSE 'configuration' END AS category FROM documents) GROUP BY 1""")
def category_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.flatten(_findings(spark, sf_dir)).groupBy(F.col("category_name").alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT source, sum(n)::BIGINT AS n_findings, count(*) AS n_places, sum(n - 1)::BIGINT AS n_exact_duplicates FROM (SELECT source, text, count(*) AS n FROM documents GROUP BY source, text) GROUP BY source""")
def dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_report(_docs(spark, sf_dir).select("source", "text", F.lit("x").alias("s")), ["text"], "s", "source")


@query(r"""WITH d AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN
             ('a','an','the','of','for','to','on','in','with','without','and','or','no','not','missing','lack','lacking','is','are','be','as','by','via','from','into','this','that','these','those','should')))) AS w FROM pages)
          SELECT x.page_id AS a, y.page_id AS b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) AS score
          FROM d x JOIN d y ON x.lang = y.lang AND x.page_id < y.page_id
          WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.88""")
def near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole titles of pages of a language that nearly agree."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), t.summary_tokens(title).alias("words"))
    return dedupe.similar_pairs(d, ["lang"], "page_id", "words").withColumn("score", F.round("score", 6))


@query()
def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies by the words of the whole text: classes of equal word sets and pairs of classes."""
    d = _docs(spark, sf_dir).select("doc_id", "source", t.summary_tokens(F.col("text")).alias("words"))
    return dedupe.similar_classes(d, ["source"], "doc_id", "words").withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT event_id AS ord, user_id || ':' || event_type AS fp, CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS level, event_id % 5 AS r FROM events)
          SELECT fp, arg_min(ord, struct_pack(a := r, b := ord)) AS ord, arg_min(level, struct_pack(a := r, b := ord)) AS level, count(*) AS n_merged FROM e GROUP BY fp""")
def reduce_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ["critical", "high", "medium", "low", "info"])), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("fp"), F.col("event_id").alias("ord"), level.alias("level"), F.array("event_type").alias("evidence"), F.lit("").alias("rule"))
    return dedupe.reduce_by_fingerprint(e, "fp", "ord", "level", "evidence", ["rule"]).select("fp", "ord", "level", "n_merged")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate BETWEEN o.o_orderdate - INTERVAL 30 DAY AND o.o_orderdate + INTERVAL 30 DAY)""")
def anti_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    near = F.col("l_shipdate").between(F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS"), F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return dedupe.without_existing(o, items, ["o_orderkey"], near, "o_orderkey").select("o_orderkey")


# graph --------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call orders: two links for each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), "o_custkey")
    n = table(spark, sf_dir, "orders").count()
    return o.select("src", F.explode(F.array((F.col("src") * 7 + F.col("o_custkey")) % n + 1, (F.col("src") * 3 + 11) % n + 1)).alias("dst"))


EDGES_SQL = """e AS (SELECT o_orderkey AS src, unnest([(o_orderkey * 7 + o_custkey) % (SELECT count(*) FROM orders) + 1, (o_orderkey * 3 + 11) % (SELECT count(*) FROM orders) + 1]) AS dst FROM orders),
          v AS (SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT o_orderkey FROM orders))"""


@query(f"""WITH {EDGES_SQL} SELECT src, count(*) AS n_calls FROM v GROUP BY src""")
def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return graph.valid_edges(_edges(spark, sf_dir), nodes).groupBy("src").agg(F.count("*").alias("n_calls"))


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O'
             UNION SELECT v.dst, b.depth + 1 FROM b JOIN v ON b.node = v.src WHERE b.depth < 8)
          SELECT node, CAST(min(depth) AS INTEGER) AS min_depth FROM b GROUP BY node""")
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within the default depth of all open orders of low priority."""
    orders = table(spark, sf_dir, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("id"))
    starts = orders.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node"), F.concat(F.lit("entry "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderkey").alias("ord"))
    return graph.reachability(graph.valid_edges(_edges(spark, sf_dir), nodes), starts).select("node", "min_depth")


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
             UNION SELECT v.dst, b.depth + 1 FROM b JOIN v ON b.node = v.src WHERE b.depth < 8)
          SELECT node, CAST(min(depth) AS INTEGER) AS min_depth FROM b GROUP BY node""")
def bfs_reach_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within the default depth of all urgent orders of status F, entries that grow with the table."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    starts = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"), F.lit("urgent").alias("label"), F.col("o_orderkey").alias("ord"))
    return graph.reachability(graph.valid_edges(_edges(spark, sf_dir), nodes), starts).select("node", "min_depth")


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src, dst FROM v UNION SELECT dst, src FROM v), g AS (SELECT src, dst FROM b WHERE src % 10 = dst % 10),
          d AS (SELECT src AS node, dst AS other, 1 AS depth FROM g UNION ALL SELECT x.src, y.dst, 2 FROM g x JOIN g y ON x.dst = y.src),
          m AS (SELECT node, other, min(depth) AS depth FROM d WHERE node <> other GROUP BY node, other),
          r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, other) AS k FROM m)
          SELECT node, other, CAST(depth AS INTEGER) AS depth FROM r WHERE k <= 6""")
def neighbourhood2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10).alias("file"))
    return graph.neighbourhood(graph.valid_edges(_edges(spark, sf_dir), nodes), nodes)


# catalogue, store, report, evaluation -------------------------------------------------------------------------


@query("""WITH t AS (SELECT n_nationkey AS k, 'public.' || lower(replace(n_name, ' ', '_')) AS obj, n_regionkey AS r FROM nation)
          SELECT rule_id, object, severity FROM (
            SELECT 'rls_disabled' AS rule_id, obj AS object, CASE WHEN r = 0 THEN 'critical' WHEN r = 1 THEN 'high' ELSE 'high' END AS severity FROM t WHERE k % 2 = 0
            UNION ALL SELECT 'rls_no_policies', obj, 'low' FROM t WHERE k % 2 = 1 AND k % 3 <> 0
            UNION ALL SELECT 'client_write_access', obj, CASE WHEN r = 0 THEN 'high' WHEN r = 1 THEN 'high' ELSE 'medium' END FROM t WHERE k % 5 < 3
            UNION ALL SELECT 'column_acl_missing', obj, CASE WHEN r = 0 THEN 'critical' ELSE 'medium' END FROM t WHERE k % 5 < 3 AND k % 4 <> 0)""")
def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lit("public").alias("table_schema"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("table_name"), F.when(F.col("n_regionkey") == 0, "PUBLIC").when(F.col("n_regionkey") == 1, "anon").otherwise("authenticated").alias("grantee"))
    grants = n.withColumn("privilege_type", F.explode(F.when(F.col("k") % 5 < 3, F.array(F.lit("SELECT"), F.lit("INSERT"))).otherwise(F.array(F.lit("select")))))
    empty = lambda cols: spark.createDataFrame([], ", ".join(f"{c} string" for c in cols.split(", ")))
    sets = {
        "table_privileges": grants.drop("k"), "rls": n.select("table_schema", "table_name", (F.col("k") % 2 == 1).alias("rls_enabled")), "column_acl": n.select("table_schema", "table_name", (F.col("k") % 4 == 0).alias("has_column_acl")),
        "column_privileges": empty(database.ROW_SETS["columnPrivileges"]), "policies": n.where("k % 3 = 0").select(F.col("table_schema").alias("schemaname"), F.col("table_name").alias("tablename"), F.lit("{public}").alias("roles"), F.lit("p").alias("policyname"), F.lit("ALL").alias("cmd")),
        "routine_privileges": empty(database.ROW_SETS["routinePrivileges"]), "storage_buckets": empty(database.ROW_SETS["storageBuckets"]),
    }
    return catalog.catalog_findings(sets).select("rule_id", "object", "severity")


@query("""WITH n AS (SELECT n_nationkey AS k, lower(replace(n_name, ' ', '_')) AS name, n_regionkey AS r FROM nation)
          SELECT 'function_public_exec' AS rule_id, 'api.' || name || '.' || name || '_1' AS object, CASE r WHEN 0 THEN 'public' WHEN 1 THEN 'anon' ELSE 'authenticated' END AS roles,
                 CASE WHEN r < 2 THEN 'high' ELSE 'medium' END AS severity FROM n WHERE r < 3
          UNION ALL SELECT 'public_bucket', name, 'public', 'high' FROM n WHERE k % 2 = 0
          UNION ALL SELECT 'storage_objects_public_policy', 'storage.objects', CASE r WHEN 0 THEN 'public' ELSE 'anon,authenticated' END, 'high' FROM n WHERE r < 2""")
def catalog_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, buckets and storage policies that are open to clients, one of each for a nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("name"), F.col("n_regionkey").alias("r"))
    grantee = F.when(F.col("r") == 0, "PUBLIC").when(F.col("r") == 1, "anon").when(F.col("r") == 2, "Authenticated").otherwise("service_role")
    roles = F.when(F.col("r") == 0, "{public}").when(F.col("r") == 1, "{authenticated,anon}").otherwise("{service_role}")
    sets = {name: spark.createDataFrame([], ", ".join(f"{c} string" for c in database.ROW_SETS[raw].split(", "))) for name, raw in (("table_privileges", "tablePrivileges"), ("rls", "rls"), ("column_acl", "columnAcl"), ("column_privileges", "columnPrivileges"))}
    sets["policies"] = n.select(F.lit("storage").alias("schemaname"), F.lit("objects").alias("tablename"), roles.alias("roles"), F.lit("p").alias("policyname"), F.lit("SELECT").alias("cmd"))
    sets["routine_privileges"] = n.select(F.lit("api").alias("routine_schema"), F.col("name").alias("routine_name"), F.concat("name", F.lit("_1")).alias("specific_name"), grantee.alias("grantee"))
    sets["storage_buckets"] = n.select(F.col("name").alias("id"), F.when(F.col("k") % 3 > 0, F.col("name")).otherwise("").alias("name"), (F.col("k") % 2 == 0).alias("public"))
    return catalog.catalog_findings(sets).where("rule_id IN ('function_public_exec', 'public_bucket', 'storage_objects_public_policy')").select("rule_id", "object", "roles", "severity")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 7 <> 0")
    stored = d.where("doc_id % 5 <> 0").withColumn("hash", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("hash")))
    extra = d.where("doc_id % 5 = 0 AND doc_id % 7 <> 0")
    return store.diff(new.where("doc_id % 5 <> 0").unionByName(extra), stored, "doc_id", ["hash"])


@query("""SELECT source, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id || ':' || sha256(text)) || chr(10)) AS hash, count(*) AS n_files FROM documents GROUP BY source""")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.snapshot_text(_docs(spark, sf_dir).select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest")), ["source"], "path", "digest")


@query()
def snapshot_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of a source by hashed folders: no row or task holds all its lines."""
    return store.snapshot(_docs(spark, sf_dir).select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("digest")), ["source"], "path", "digest")


@query("""WITH l AS (SELECT event_id AS line_no, CASE event_id % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'rule' ELSE 'other' END AS kind, CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS payload FROM events WHERE event_id % 11 <> 0)
          SELECT kind, key, arg_max(payload, line_no) AS payload FROM l WHERE kind <> 'other' GROUP BY kind, key""")
def resume_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "map").when(F.col("event_id") % 3 == 1, "rule").otherwise("other")
    whole = F.to_json(F.struct(kind.alias("kind"), F.col("user_id").cast("string").alias("taskKey"), F.col("event_id").alias("findings")))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 11 == 0, F.expr("left('{broken', 7)")).otherwise(whole).alias("value"))
    return store.read_log(lines)


@query("""SELECT event_type AS title_key, CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n_findings, count(DISTINCT user_id) AS n_locations, min(event_id) AS first_ord FROM events GROUP BY 1, 2""")
def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("user_id") % 3 == 0, "high").when(F.col("user_id") % 3 == 1, "medium").otherwise("low")
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), level.alias("severity"), F.lit("static").alias("source"), F.concat(F.upper("event_type"), F.lit("!")).alias("title"), F.col("user_id").alias("location"))
    return report.static_groups(f).select("title_key", "severity", "n_findings", "n_locations", "first_ord")


@query("""WITH g AS (SELECT DISTINCT event_type, user_id % 3 AS k FROM events),
          t AS (SELECT CASE WHEN event_type LIKE '%error%' THEN 'Verbose errors / debug exposure' ELSE 'Configuration' END AS theme, CASE k WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS r FROM g),
          s AS (SELECT theme, count(*) AS n_groups, max(r) AS r FROM t GROUP BY theme)
          SELECT theme, n_groups, CASE r WHEN 4 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS worst, CAST(row_number() OVER (ORDER BY r * 1000 + n_groups DESC, theme) AS INTEGER) AS position FROM s""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.theme_summary(report_groups(spark, sf_dir), "title_key")


@query("""WITH p AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS prefix, lower(url) AS u FROM pages),
          s AS (SELECT prefix, count(*) AS total, count(*) FILTER (regexp_matches(u, '\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rb|java|cs|php|rs|kt|sql)$')) AS code, CAST(0 AS BIGINT) AS config, count(*) FILTER (regexp_matches(u, '(^|/)(src|app|api|server|backend|frontend|functions|pages)/')) AS hints FROM p GROUP BY prefix)
          SELECT *, 2 * code + total + 25 * config + 2 * least(hints, 20) AS score FROM s""")
def prefix_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.prefix_statistics(table(spark, sf_dir, "pages"), F.col("url"), F.regexp_extract("url", "//([^/]+)", 1))


@query("""WITH l AS (SELECT doc_id, quality FROM labels), d AS (SELECT doc_id, source FROM documents)
          SELECT source AS group_id, count(l.doc_id) AS n_expected, count(*) AS n_actual, count(CASE WHEN quality = 1 THEN 1 END) AS n_matched, count(l.doc_id) - count(CASE WHEN quality = 1 THEN 1 END) AS n_missing,
                 count(*) - count(CASE WHEN quality = 1 THEN 1 END) AS n_unexpected, count(l.doc_id) = count(CASE WHEN quality = 1 THEN 1 END) AS pass
          FROM d LEFT JOIN l USING (doc_id) GROUP BY source""")
def eval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("group_id"))
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".ts"))
    actual = d.select("group_id", F.col("doc_id").cast("string").alias("id"), path.alias("filepath"), F.lit("").alias("identity_key"), F.array(F.lit("missing_timeout")).alias("rules"), F.lit(None).cast("string").alias("package_name"), F.lit(None).cast("string").alias("package_version"))
    labels = table(spark, sf_dir, "labels").join(d, "doc_id")
    expected = labels.select("group_id", F.col("doc_id").alias("ord"), F.lit("").alias("id"), path.alias("filepath"), F.lit("").alias("expectation"), F.lit("").alias("identity_key"), F.when(F.col("quality") == 1, "timeout").otherwise("idor").alias("rule_id"))
    return evals.evaluate(expected, actual, d.select("group_id").distinct().withColumn("allow_unexpected", F.lit(True)))


@query("""WITH a AS (SELECT s_suppkey % 7 AS k, s_suppkey FROM supplier) SELECT 'pkg' || k AS name, '1.' || k || '.0' AS version, count(*) AS n FROM a WHERE k <> 3 GROUP BY ALL""")
def manifest_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_suppkey") % 7).cast("string")
    version = F.when(k == "3", F.lit("^1.0.0")).otherwise(F.concat(F.lit("1."), k, F.lit(".0")))
    content = F.to_json(F.struct(F.create_map(F.concat(F.lit("pkg"), k), version).alias("dependencies")))
    f = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("path"), content.alias("content"))
    return reports.manifest_packages(f).groupBy("name", "version").agg(F.count("*").alias("n"))


# routes, known findings, reasons ------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '^\.?/*', ''), '/+', '/', 'g'), '/+$', '') AS n FROM pages)
          SELECT page_id, '/' || n AS route, CASE WHEN starts_with(n, 'en/') THEN substr(n, 4) WHEN instr(n, '/en/') > 0 THEN substr(n, instr(n, '/en/') + 4) END AS after_en FROM p""")
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", routes.route_path(F.col("url")).alias("route"), routes.after_segment(F.col("url"), "en").alias("after_en"))


@query("""SELECT page_id, array_to_string(list_concat(['a.b'], list_filter(list_transform(string_split(url, '.'), lambda x: trim(x)), lambda x: x <> '')), '|') AS parts FROM pages""")
def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("|", routes.identifier_parts(F.concat(F.lit('"a.b".'), "url"))).alias("parts"))


@query("""SELECT CASE event_type WHEN 'error' THEN 'GET' ELSE 'POST' END AS method, CASE event_type WHEN 'error' THEN 2 ELSE 3 END AS line, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL""")
def method_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("event_type") == "error", "export  async function GET(r) {\n}").when(F.col("event_type") == "signup", "export function GETS() {}\nexport const POST = f").otherwise("export const handler = GET")
    found = table(spark, sf_dir, "events").select(F.explode(routes.exported_methods(F.concat(F.lit("// "), "event_type", F.lit("\n"), body))).alias("m"))
    return found.groupBy("m.method", "m.line").agg(F.count("*").alias("n"))


KNOWN_SQL = IDENTITY_SQL + """, k AS (SELECT min(ord) AS ord FROM f GROUP BY path, s, e, lang, kind, rule),
             g AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN 'high' ELSE 'low' END AS severity, rule || ' found' AS summary,
                          '{"filepath":"' || path || '","startLine":' || s || CASE WHEN ord % 3 = 0 THEN '' ELSE ',"endLine":' || e END || '}' AS location, '{"ruleId":"' || rule || '"' AS head, lang FROM f SEMI JOIN k USING (ord))"""


@query(f"""WITH {KNOWN_SQL} SELECT ord, severity, summary, location, head || '}}' AS details FROM g ORDER BY severity, ord LIMIT 80""")
def existing_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 80 worst existing findings; the limit is the feature."""
    return projections.worst_known(identity.flatten(_findings(spark, sf_dir)), 80).drop("type", "source")


@query(f"""WITH {KNOWN_SQL} SELECT ord, severity, summary, location, head || ',"entryPoint":"handler ' || lang || '"}}' AS details FROM g ORDER BY severity, ord LIMIT 40""")
def prior_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 worst prior findings, with their details; the limit is the feature."""
    return projections.worst_known(identity.flatten(_findings(spark, sf_dir)), 40, whole_details=True).drop("type", "source")


@query(f"""WITH {IDENTITY_SQL} SELECT CASE WHEN x.rule <> y.rule THEN 'rule_id_mismatch' WHEN x.lang <> y.lang THEN 'entry_point_mismatch' END AS reason, count(*) AS n
          FROM f x JOIN f y ON y.ord = x.ord + 1 OR y.ord = x.ord + 4 GROUP BY 1""")
def merge_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = dedupe.merge_facts(identity.flatten(_findings(spark, sf_dir)))
    pairs = facts.select(F.col("ord").alias("a"), F.explode(F.array(F.col("ord") + 1, F.col("ord") + 4)).alias("b"))
    return dedupe.block_reasons(facts, pairs).groupBy("reason").agg(F.count("*").alias("n"))


# flagship -----------------------------------------------------------------------------------------------------


def top_findings_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages to chunks, signals, findings with an identity, one row for each distinct finding, worst first."""
    texts = docs.select(F.concat_ws("/", F.lit("documents"), "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    texts = texts.unionByName(pages.select(F.concat_ws("/", F.lit("pages"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content")))
    chunks = chunking.line_chunks(texts, size=40, overlap=10).select("path", "start_line", "end_line", "content_hash", "chunk")
    # one expression for each pattern; all in one pass over the chunks
    checks = {
        "secret": ("critical", detectors.hardcoded_secret(F.col("chunk"))), "email": ("medium", F.col("chunk").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")), "ip_address": ("low", F.col("chunk").rlike(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")),
        "inline_script": ("high", F.col("chunk").rlike("(?i)<script")), "html_comment": ("info", F.contains("chunk", F.lit("<!--"))),
    }
    hits = F.array(*[F.when(cond, F.struct(F.lit(name).alias("rule_id"), F.lit(level).alias("severity"))) for name, (level, cond) in checks.items()])
    found = chunks.select("path", "start_line", "end_line", "content_hash", F.explode(F.array_compact(hits)).alias("h")).select("path", "start_line", "end_line", "content_hash", "h.*")
    first = found.groupBy("rule_id", "severity", "content_hash").agg(F.min(F.struct("path", "start_line", "end_line")).alias("p"), F.count("*").alias("n_places"))
    key = F.concat_ws("|", F.lit("v2"), "p.path", "rule_id", F.concat(F.lit("lines:"), F.col("p.start_line").cast("string"), F.lit("-"), F.col("p.end_line").cast("string")))
    return first.select(key.alias("identity_key"), "rule_id", "severity", severity.rank(F.col("severity")).alias("rank"), "n_places").orderBy(F.desc("rank"), "identity_key")


@query(r"""WITH x AS (SELECT concat_ws('/', 'documents', source, doc_id) AS path, text AS content FROM documents UNION ALL SELECT concat_ws('/', 'pages', page_id), html FROM pages),
          f AS (SELECT path, string_split_regex(content, '\r\n|\n') AS l FROM x WHERE content IS NOT NULL),
          k AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(l) - 40) / 30.0)) AS BIGINT) + 1)) AS i FROM f),
          c AS (SELECT path, 1 + i * 30 AS s, least(len(l), i * 30 + 40) AS e, array_to_string(l[1 + i * 30 : least(len(l), i * 30 + 40)], chr(10)) AS text FROM k),
          g AS (SELECT * FROM c WHERE length(regexp_replace(text, '\s', '', 'g')) >= 50),
          h AS (SELECT path, s, e, text, 'secret' AS rule_id, 'critical' AS severity, 4 AS rank FROM g WHERE """ + SECRET_SQL + r"""
                UNION ALL SELECT path, s, e, text, 'email', 'medium', 2 FROM g WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}')
                UNION ALL SELECT path, s, e, text, 'ip_address', 'low', 1 FROM g WHERE regexp_matches(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')
                UNION ALL SELECT path, s, e, text, 'inline_script', 'high', 3 FROM g WHERE regexp_matches(text, '(?i)<script')
                UNION ALL SELECT path, s, e, text, 'html_comment', 'info', 0 FROM g WHERE contains(text, '<!--')),
          d AS (SELECT rule_id, severity, rank, sha256(text) AS hash, min(struct_pack(path := path, s := s, e := e)) AS p, count(*) AS n_places FROM h GROUP BY ALL)
          SELECT 'v2|' || p.path || '|' || rule_id || '|lines:' || p.s || '-' || p.e AS identity_key, rule_id, severity, CAST(rank AS INTEGER) AS rank, n_places FROM d""")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_findings_of(_docs(spark, sf_dir), table(spark, sf_dir, "pages"))

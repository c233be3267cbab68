"""Queries of the operators that work in rounds of joins or by streaming sweeps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import identity
from riskloom.functions import text as t
from riskloom.operators import dedupe, evals, evidence, graph, intervals, merging, report
from riskloom.plans.queries import EDGES_SQL, IDENTITY_SQL, QUERIES, _docs, _edges, _findings, query
from riskloom.session import table

__all__ = ["QUERIES"]


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT o_orderkey AS node, o_orderkey AS ord, 0 AS depth FROM orders WHERE o_orderstatus = 'P'
             UNION SELECT v.dst, b.ord, b.depth + 1 FROM b JOIN v ON b.node = v.src WHERE b.depth < 5),
          m AS (SELECT node, ord, min(depth) AS depth FROM b GROUP BY node, ord),
          r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, ord) AS k FROM m)
          SELECT node, string_agg('entry ' || ord, ', ' ORDER BY k) AS labels, CAST(min(depth) AS INTEGER) AS min_depth FROM r WHERE k <= 3 GROUP BY node""")
def reach_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of all partly shipped orders for each node within five calls."""
    orders = table(spark, sf_dir, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("id"))
    starts = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"), F.concat(F.lit("entry "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderkey").alias("ord"))
    reached = graph.reachability(graph.valid_edges(_edges(spark, sf_dir), nodes), starts, max_depth=5)
    return reached.select("node", F.array_join("labels", ", ").alias("labels"), "min_depth")


@query(f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT o_orderkey AS node, o_orderkey AS ord, 0 AS depth FROM orders WHERE o_orderstatus = 'P'
             UNION SELECT v.dst, b.ord, b.depth + 1 FROM b JOIN v ON b.node = v.src WHERE b.depth < 3),
          m AS (SELECT node, ord, min(depth) AS depth FROM b GROUP BY node, ord),
          r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY depth, ord) AS k FROM m),
          n AS (SELECT node, min(depth) AS depth FROM r WHERE k <= 3 GROUP BY node),
          g AS (SELECT node % 100 AS anchor, ord, min(node * 10 + k) AS place FROM r WHERE k <= 3 GROUP BY ALL),
          f AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY place) AS k FROM g)
          SELECT 'a' || anchor AS anchor_id, string_agg('entry ' || ord, ', ' ORDER BY k) AS labels, (SELECT CAST(min(depth) AS INTEGER) FROM n WHERE n.node % 100 = f.anchor) AS min_depth FROM f WHERE k <= 3 GROUP BY anchor""")
def reach_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability of anchors that stand for many nodes each."""
    orders = table(spark, sf_dir, "orders")
    nodes = orders.select(F.col("o_orderkey").alias("id"))
    starts = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"), F.concat(F.lit("entry "), F.col("o_orderkey").cast("string")).alias("label"), F.col("o_orderkey").alias("ord"))
    reached = graph.reachability(graph.valid_edges(_edges(spark, sf_dir), nodes), starts, max_depth=3)
    anchors = nodes.select(F.col("id").alias("node"), F.concat(F.lit("a"), (F.col("id") % 100).cast("string")).alias("anchor_id"), F.col("id").alias("ord"))
    return graph.reachable_anchors(reached, anchors).select("anchor_id", F.array_join("labels", ", ").alias("labels"), "min_depth")


TRACE_SQL = f"""WITH {IDENTITY_SQL}, p AS (SELECT x.ord AS a, y.ord AS b, x.path = y.path AND x.s = y.s AND x.e = y.e AND x.rule = y.rule AND x.lang = y.lang AS same_key, x.rule <> y.rule AS rules, x.lang <> y.lang AS entries,
               x.path = y.path AND greatest(1, x.s - 2) <= y.e + 2 AND greatest(1, y.s - 2) <= x.e + 2 AS near, x.path = y.path AND x.s = y.s AND x.e = y.e AS same_lines, x.rule = 'missing_rate_limiting' AND y.rule = 'missing_rate_limiting' AS limits
               FROM f x JOIN f y ON y.ord - x.ord IN (1, 4, 100, 120, 200, 400))"""


@query(TRACE_SQL + """
          SELECT a, b, NOT limits AND (same_key OR (NOT rules AND NOT entries AND near)) OR (limits AND NOT entries AND (same_key OR near)) AS merges,
                 CASE WHEN limits AND entries THEN 'limits_of_other_entry' WHEN same_key THEN 'identity_key' WHEN rules THEN 'rule_differs' WHEN entries THEN 'entry_differs' WHEN same_lines THEN 'same_lines' ELSE 'near_and_alike' END AS decided_by,
                 near AS location_overlap, same_lines AS location_exact FROM p""")
def merge_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pairs of findings merge or do not."""
    facts = merging.decision_facts(identity.flatten(_findings(spark, sf_dir)))
    pairs = facts.select(F.col("ord").alias("a"), F.explode(F.array(*[F.col("ord") + k for k in (1, 4, 100, 120, 200, 400)])).alias("b"))
    traced = merging.merge_trace(facts, pairs)
    return traced.select("a", "b", "merges", "decided_by", "places.location_overlap", "places.location_exact")


@query("""WITH e AS (SELECT o_orderkey % 5 AS g, o_custkey % 40 AS p, o_orderkey AS ord, row_number() OVER (PARTITION BY o_orderkey % 5, o_custkey % 40 ORDER BY o_orderkey) AS k FROM orders),
          a AS (SELECT l_orderkey % 5 AS g, l_partkey % 40 AS p, id, row_number() OVER (PARTITION BY l_orderkey % 5, l_partkey % 40 ORDER BY id) AS k FROM (SELECT l_orderkey, l_partkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id FROM lineitem WHERE l_returnflag = 'R'))
          SELECT 'g' || e.g AS group_id, e.ord AS e_ord, a.id AS a_id FROM e JOIN a USING (g, p, k)""")
def match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders expect a finding in one of forty files a group, returned lines are what was found: large groups of like expectations compete."""
    file = lambda c: F.concat(F.lit("src/"), (F.col(c) % 40).cast("string"), F.lit(".ts"))
    group = lambda c: F.concat(F.lit("g"), (F.col(c) % 5).cast("string"))
    expected = table(spark, sf_dir, "orders").select(group("o_orderkey").alias("group_id"), F.col("o_orderkey").alias("ord"), F.lit("").alias("id"), file("o_custkey").alias("filepath"), F.lit("").alias("expectation"), F.lit("").alias("identity_key"), F.lit("timeout").alias("rule_id"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    actual = lines.select(group("l_orderkey").alias("group_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("id"), file("l_partkey").alias("filepath"), F.lit("").alias("identity_key"), F.array(F.lit("missing_timeout")).alias("rules"), F.lit(None).cast("string").alias("package_name"), F.lit(None).cast("string").alias("package_version"))
    return evals.match_classes(evals.expectation_classes(expected), evals.class_choices(expected, actual))


@query("""WITH n AS (SELECT n_nationkey AS k, 'r' || n_regionkey AS g FROM nation), a AS (SELECT g, k, c_custkey % 4 AS m FROM customer JOIN n ON c_nationkey = k),
          h AS (SELECT g, count(*) AS n_actual, count(DISTINCT CASE WHEN m = k % 2 THEN k END) AS n_matched FROM a GROUP BY g), e AS (SELECT g, count(*) AS n_expected FROM n GROUP BY g)
          SELECT g AS group_id, n_expected, n_actual, n_matched, n_expected - n_matched AS n_missing, n_actual - n_matched AS n_unexpected, n_expected = n_matched AS pass FROM e JOIN h USING (g)""")
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are tables whose row security is expected to be in one of two states; each customer is a finding that says something of it."""
    table_of = F.concat(F.lit("public."), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("group_id"), table_of.alias("object"))
    names = [r["object"].split(".")[1] for r in n.select("object").collect()]  # a specification's tables
    wanted = F.when(F.col("n_nationkey") % 2 == 0, "rls_disabled").otherwise("rls_no_policies")
    expected = n.select("group_id", F.col("n_nationkey").alias("ord"), F.lit("").alias("id"), F.lit("data/*/schema.json").alias("filepath"), F.concat("object", F.lit(": as expected")).alias("expectation"), F.lit("").alias("identity_key"), wanted.alias("rule_id"))
    said = F.element_at(F.array(*map(F.lit, [": RLS disabled", ": RLS enabled, no policies", ": RLS enabled, 3 policies", " is slow"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    actual = c.select("group_id", F.col("c_custkey").cast("string").alias("id"), F.lit("data/x/schema.json").alias("filepath"), F.lit("").alias("identity_key"), F.concat("object", said).alias("summary"), F.lit("llm").alias("source"), F.lit(None).cast("string").alias("type"), F.lit("{}").alias("details"))
    return evals.evaluate(expected, actual, n.select("group_id").distinct().withColumn("allow_unexpected", F.lit(True)), evidence.by_evidence(names))


RANGES_SQL = """r AS (SELECT l_suppkey AS k, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id, CAST(epoch(l_shipdate) AS BIGINT) // 86400 AS s, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + CAST(l_quantity AS BIGINT) AS e, l_linenumber AS span FROM lineitem),
          o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, e DESC, span, id) AS n FROM r)"""


@query(f"""WITH {RANGES_SQL}, h AS (SELECT x.id, y.id AS inside, row_number() OVER (PARTITION BY x.id ORDER BY y.e - y.s, y.span, y.n) AS k FROM o x JOIN o y ON x.k = y.k AND y.n < x.n AND y.s <= x.s AND y.e >= x.e)
          SELECT id, inside FROM r LEFT JOIN (SELECT id, inside FROM h WHERE k = 1) USING (id)""")
def nested_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of a supplier's lines that holds another for its whole time."""
    ranges = _shipping(spark, sf_dir)
    return intervals.nested_ranges(ranges, ranges.limit(0), ["k"], kinds=(0,)).select("id", "inside")


@query(f"""WITH {RANGES_SQL}, p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS id, l_suppkey AS k, CAST(epoch(l_shipdate) AS BIGINT) // 86400 + 7 AS a FROM lineitem),
          h AS (SELECT p.id, y.id AS inside, row_number() OVER (PARTITION BY p.id ORDER BY y.e - y.s, y.span, y.n) AS k FROM p JOIN o y ON p.k = y.k AND y.s <= a AND y.e >= a + 3)
          SELECT id, inside FROM p LEFT JOIN (SELECT id, inside FROM h WHERE k = 1) USING (id)""")
def innermost_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost of a supplier's lines that holds the days a week after a shipment."""
    day = F.floor(F.unix_timestamp("l_shipdate") / 86400) + 7
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("id"), day.alias("start"), (day + 3).alias("end"))
    return intervals.nested_ranges(_shipping(spark, sf_dir), points, ["k"], kinds=(1,)).select("id", "inside")


def _shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.floor(F.unix_timestamp("l_shipdate") / 86400)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("id"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").cast("long").alias("span"))


@query()
def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages, grouped as a report does: order decides, so the tests compare with a walk."""
    lang = F.regexp_extract("html", '<html lang="([a-z]*)"', 1)
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.lit("low").alias("severity"), lang.alias("source"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return report.fuzzy_groups(titles)


@query(r"""WITH d AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN
             ('a','an','the','of','for','to','on','in','with','without','and','or','no','not','missing','lack','lacking','is','are','be','as','by','via','from','into','this','that','these','those','should')))) AS w FROM pages),
          c AS (SELECT lang, w, min(page_id) AS head FROM d WHERE len(w) > 0 GROUP BY lang, w)
          SELECT 'same' AS kind, head AS a, page_id AS b, 1.0::DOUBLE AS score FROM d JOIN c USING (lang, w) WHERE page_id <> head
          UNION ALL SELECT 'near', least(x.head, y.head), greatest(x.head, y.head), round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) FROM c x JOIN c y ON x.lang = y.lang AND x.head < y.head
          WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))) >= 0.88""")
def near_title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole titles that nearly agree: classes of equal word sets and pairs of classes, so n equal titles give n rows."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    d = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), t.summary_tokens(title).alias("words"))
    return dedupe.similar_classes(d, ["lang"], "page_id", "words").withColumn("score", F.round("score", 6))


@query("""SELECT source, text AS title, count(*) AS n_copies, min(doc_id) AS doc_id FROM documents GROUP BY source, text""")
def exact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each source's equal texts, with how many there are."""
    rows = _docs(spark, sf_dir).select("doc_id", "source", F.col("text").alias("title"))
    return dedupe.exact_duplicates(rows, ["source", "title"], "doc_id").select("source", "title", "n_copies", "doc_id")

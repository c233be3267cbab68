"""Operators that work in rounds of joins, against walks in order and brute force."""

import json
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F
from test_operators import FINDING
from walks import Finding, clusters_of, matches_of, mergeable

from riskloom.functions import identity
from riskloom.operators import dedupe, evals, graph, intervals, merging, ranking, report


@pytest.mark.parametrize("seed", [0, 1])
def test_reachability_on_cyclic_graphs(spark, seed):
    """Three labels a node at most travel on, and still all labels and depths are those of the whole queue."""
    rng, n = random.Random(seed), 60
    edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(150)})
    starts = [(rng.randrange(n), f"l{rng.randrange(8)}", k) for k in range(14)]
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)

    def walk(max_depth, most):
        queue, seen, found = deque((s, label, 0) for s, label, _ in starts), set(), {}
        while queue:
            f, label, d = queue.popleft()
            if (f, label) in seen:
                continue
            seen.add((f, label))
            labels, depth = found.setdefault(f, ([], d))
            if label not in labels and len(labels) < most:
                labels.append(label)
            if d < max_depth:
                queue.extend((c, label, d + 1) for c in out[f])
        return {k: (tuple(v[0]), v[1]) for k, v in found.items()}

    e, s = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(starts, "node long, label string, ord long")
    for max_depth, most in ((8, 3), (3, 1)):
        reached = graph.reachability(e, s, max_depth, most)
        assert {r.node: (tuple(r.labels), r.min_depth) for r in reached.collect()} == walk(max_depth, most)
    assert graph.reachability(e, s.limit(0)).count() == 0 and graph.reachability(e.limit(0), s).count() == len({x[0] for x in starts})


def test_anchors_take_the_labels_of_their_nodes_in_turn(spark):
    reached = spark.createDataFrame([(1, ["a", "b"], 2), (2, ["b", "c", "d"], 0), (3, ["x"], 5)], "node long, labels array<string>, min_depth int")
    anchors = spark.createDataFrame([(1, "A", 0), (2, "A", 1), (3, "B", 2), (9, "C", 3)], "node long, anchor_id string, ord long")
    assert {tuple(map(str, r)) for r in graph.reachable_anchors(reached, anchors).collect()} == {("A", "['a', 'b', 'c']", "0"), ("B", "['x']", "5")}


def test_neighbourhoods_through_hubs(spark):
    rng, n = random.Random(4), 50
    edges = list({(rng.randrange(n), rng.randrange(n)) for _ in range(90)}) + [(0, k) for k in range(2, n, 2)]  # 0 is a hub
    both = defaultdict(set)
    for a, b in edges:
        if a != b and a % 2 == b % 2:
            both[a].add(b), both[b].add(a)
    nodes = spark.createDataFrame([(k, k % 2) for k in range(n)], "id long, file long")
    for max_depth, most in ((2, 6), (3, 2)):
        expect = set()
        for x in range(n):
            far, queue = {x: 0}, deque([x])
            while queue:
                u = queue.popleft()
                for v in both[u] if far[u] < max_depth else ():
                    if v not in far:
                        far[v] = far[u] + 1
                        queue.append(v)
            expect |= {(x, y, d) for d, y in sorted((d, y) for y, d in far.items() if y != x)[:most]}
        got = graph.neighbourhood(spark.createDataFrame(edges, "src long, dst long"), nodes, max_depth=max_depth, most=most)
        assert {tuple(r) for r in got.collect()} == expect


def test_numbers_within_keys_of_any_size(spark):
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.7 else rng.randrange(40), rng.randrange(50), k) for k in range(600)]
    got = {r.k: r.rn for r in ranking.numbered(spark.createDataFrame(rows, "g long, o long, k long").repartition(6), ["g"], ["o", "k"]).collect()}
    by = defaultdict(list)
    for g, o, k in sorted(rows):
        by[g].append(k)
    assert got == {k: n + 1 for ks in by.values() for n, k in enumerate(ks)}
    assert ranking.numbered(spark.createDataFrame([], "g long, o long"), ["g"], ["o"]).count() == 0


def findings(rng, n, files):
    """Findings that often touch; some without a file that get one, and lines, from others."""
    rows = []
    for k in range(n):
        loc = {"filepath": f"f{rng.randrange(files)}.ts"} if rng.random() < 0.85 else {}
        if rng.random() < 0.75:
            loc["startLine"] = rng.randint(1, 30)
            if rng.random() < 0.5:
                loc["endLine"] = loc["startLine"] + rng.randint(0, 80)
        else:
            loc["chunkIndex"] = rng.randrange(3)
        det = {c: v for c, share, v in (("ruleId", 0.6, rng.choice(["idor", "missing_rate_limiting"])), ("entryPoint", 0.7, rng.choice(["GET /a", "get /a/", "POST /b"])), ("anchorNodeId", 0.3, f"n{rng.randrange(4)}"), ("overlapGroupId", 0.3, f"g{rng.randrange(4)}")) if rng.random() < share}
        rows.append((k, rng.choice([None, "idor", "sql_injection"]), "llm", "low", None, rng.choice(["Missing rate limit on login", "SQL injection in query", "users can read others"]), json.dumps(loc), json.dumps(det)))
    return rows


@pytest.fixture(scope="module")
def facts(spark):
    flat = identity.flatten(spark.createDataFrame(findings(random.Random(3), 160, 3), FINDING))
    return flat, [Finding(*[r[c] for c in Finding._fields]) for r in merging.decision_facts(flat).orderBy("ord").collect()]


def test_clusters_equal_one_walk(spark, facts):
    flat, local = facts
    got, expect = {r.ord: r.cluster for r in dedupe.greedy_clusters(flat).collect()}, clusters_of(local)
    assert got == expect and 20 < len(set(expect.values())) < 110
    assert dedupe.greedy_clusters(flat.limit(0)).count() == 0


def test_a_group_of_copies_is_one_cluster(spark):
    rows = [(k, "idor", "llm", "low", None, "x", '{"filepath":"a.ts","startLine":3}', "{}") for k in range(300)]
    assert [tuple(r) for r in dedupe.greedy_clusters(identity.flatten(spark.createDataFrame(rows, FINDING))).groupBy("cluster").count().collect()] == [(0, 300)]


def test_trace_says_what_the_walk_decides(spark, facts):
    flat, local = facts
    some = [(a.ord, b.ord) for a in local[:60] for b in local[:60] if a.ord < b.ord]
    traced = merging.merge_trace(merging.decision_facts(flat), spark.createDataFrame(some, "a long, b long")).collect()
    assert {(r.a, r.b): r.merges for r in traced} == {(a, b): mergeable(local[a], local[b]) for a, b in some}
    names = {r.decided_by for r in traced}
    assert {"limits_of_other_entry", "rule_differs", "entry_differs", "anchor", "overlap_group", "near_of_other_type", "same_lines", "near_and_alike"} <= names
    for r in traced:
        x, y = local[r.a], local[r.b]
        assert (r.operands.rule.a or "", r.operands.rule.b or "") == (x.rule, y.rule) and r.operands.entry.match == (x.entry == y.entry != "")
        assert r.decided_by != "anchor" or r.operands.anchor_id.match


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_by_classes_equal_a_walk(spark, seed):
    rng, members, choices = random.Random(seed), [], []
    for g in "gh":
        for c in range(4):
            choices += [(g, f"c{c}", f"a{i:02}", f"k{i % 3}", float(i % 2)) for i in rng.sample(range(20), rng.randint(0, 12))]
        members += [(g, f"c{rng.randrange(5)}", k) for k in range(16)]
    got = evals.match_classes(spark.createDataFrame(members, "group_id string, cls string, e_ord long"), spark.createDataFrame(choices, "group_id string, cls string, a_id string, a_key string, score double"))
    assert {tuple(r) for r in got.collect()} == matches_of(members, choices)


def test_one_large_class_takes_one_round(spark, monkeypatch):
    rounds, numbered = [], evals.numbered
    monkeypatch.setattr(evals, "numbered", lambda *a: (rounds.append(1), numbered(*a))[1])
    members = spark.range(3000).select(F.lit("g").alias("group_id"), F.lit("c").alias("cls"), F.col("id").alias("e_ord"))
    choices = spark.range(2000).select(F.lit("g").alias("group_id"), F.lit("c").alias("cls"), F.format_string("%05d", "id").alias("a_id"), F.lit("").alias("a_key"))
    got = {r.e_ord: r.a_id for r in evals.match_classes(members, choices).collect()}
    assert got == {k: f"{k:05}" for k in range(2000)} and len(rounds) == 2  # expectations and choices, once each


def test_titles_grouped_in_order(spark):
    for seed in (1, 3):
        rng = random.Random(seed)
        words = ["token", "user", "login", "table", "query", "cache", "page", "mail", "role", "file", "the", "of", "server"]
        rows = [(k, rng.choice(["high", "low"]), rng.choice(["llm", "x"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for k in range(120)]
        df = spark.createDataFrame(rows, "ord long, severity string, source string, title string")
        known = {r.ord: (r.b, set(r.w)) for r in df.select("ord", report.title_bucket(df.title).alias("b"), report.title_tokens(df.title).alias("w")).collect()}
        groups, expect = [], {}
        for k, level, source, _ in rows:
            bucket, mine = known[k]
            home = next((g for g in groups if g[1:4] == (level, source, bucket)), None)
            if home is None:
                scored = [(len(mine & g[4]) / len(mine | g[4]) if mine | g[4] else 1.0, -n, g) for n, g in enumerate(groups) if g[1:3] == (level, source)]
                score, _, best = max(scored, key=lambda x: x[:2]) if scored else (-1, 0, None)
                if best and score >= (0.55 if min(len(mine), len(best[4])) <= 3 else 0.68):
                    home = best
                else:
                    groups.append(home := (k, level, source, bucket, mine))
            expect[k] = home[0]
        assert {r.ord: r.group_ord for r in report.fuzzy_groups(df).collect()} == expect


@pytest.mark.parametrize("files", [1, 3])
def test_nested_and_crossing_ranges(spark, files):
    rng = random.Random(files)
    ranges = [(f"f{rng.randrange(files)}", k, s, s + rng.randint(0, 30), rng.randint(0, 3), rng.random() < 0.3) for k, s in ((k, rng.randint(1, 200)) for k in range(250))]
    points = [(f"f{rng.randrange(files + 1)}", k, s, s + rng.randint(0, 8)) for k, s in ((k, rng.randint(1, 230)) for k in range(250))]
    place = {r[1]: n for n, r in enumerate(sorted(ranges, key=lambda r: (r[0], r[2], -r[3], r[4], str(r[1]))))}

    def innermost(file, lo, hi, before):
        held = [(r[3] - r[2], r[4], r[5], place[r[1]], r[1]) for r in ranges if r[0] == file and r[2] <= lo and r[3] >= hi and place[r[1]] < before]
        return str(min(held)[-1]) if held else None

    expect = {(1, p[1]): innermost(*[p[k] for k in (0, 2, 3)], 10**9) for p in points} | {(0, r[1]): innermost(r[0], r[2], r[3], place[r[1]]) for r in ranges}
    a, b = spark.createDataFrame(ranges, "file string, id long, start long, end long, span long, module boolean"), spark.createDataFrame(points, "file string, id long, start long, end long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a file over several tasks
    try:
        assert {(r.kind, int(r.id)): r.inside for r in intervals.nested_ranges(a, b, ["file"]).collect()} == expect
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = intervals.smallest_enclosing(b.withColumnsRenamed({"start": "a", "end": "b", "id": "pid"}), a, ["file"], ("a", "b"), ("start", "end"), [F.col("span"), F.col("module"), F.col("id")], ["id"], ["pid"])
    lengths = {r[1]: r[3] - r[2] for r in ranges}
    assert all((r.id is None) == (expect[1, r.pid] is None) and (r.id is None or lengths[r.id] == lengths[int(expect[1, r.pid])]) for r in plain.collect())


def test_nested_ranges_in_tasks_of_bounded_size(spark):
    """More rows are more tasks, not larger ones, and each part is a task of its own."""
    rng = random.Random(7)
    rows = [("f", k, s, s + rng.randint(0, 30)) for k, s in ((k, rng.randint(1, 900)) for k in range(1000))]
    df = spark.createDataFrame(rows, "file string, id long, start long, end long")
    whole, parts = intervals.nested_ranges(df, df.limit(0), ["file"]), intervals.nested_ranges(df, df.limit(0), ["file"], rows_a_task=100)
    sizes = [len(x) for x in parts.rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) < 200
    assert {(r.id, r.inside) for r in parts.collect()} == {(r.id, r.inside) for r in whole.collect()}
    points = intervals.nested_ranges(df, df, ["file"], kinds=(1,))  # only what is asked for leaves a task
    assert {r.kind for r in points.collect()} == {1} and points.count() == 1000


def test_first_of_equal_rows(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, "b", 3), (5, None, 4), (4, None, 5)], "ord long, key string, n_copies_ int")
    assert {tuple(r) for r in dedupe.exact_duplicates(df, ["key"], "ord").collect()} == {(1, "a", 2, 2), (2, "b", 3, 1), (4, None, 5, 2)}

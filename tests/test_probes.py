"""Tool hints, repository probes and rows of reports, against plain Python."""

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from riskloom.functions import identity
from riskloom.operators import evals, hints, projections, report, store
from riskloom.sources import repositories

HINT = "path string, start_line long, end_line long, kind string, entry_type string, sinks array<string>"


def _tool_rows(spark, rows):
    return spark.createDataFrame(rows, "ord long, filepath string, start_line double, end_line double, rule_id string, message string")


def test_hints_of_one_range_are_one(spark):
    rows = [
        (0, "./a.ts", 5.7, None, None, None), (1, "a.ts", 5.0, 0.0, "xss", "SQLi"), (2, "a.ts", 5.0, 5.0, "cron", "Route"), (3, "a.ts", 5.0, 5.0, "webhook", "xss"),
        (4, "a.ts", 9.0, 7.0, "", "subquery_job prequery"), (5, "a.ts", 0.0, 4.0, "xss", ""), (6, None, 1.0, 1.0, "xss", ""), (7, "b.ts", 1.0, 2.0, "zip slip", "éjob"),
    ]
    got = {(r.path, r.start_line, r.end_line): (r.kind, r.entry_type, r.sinks) for r in hints.tool_hints(_tool_rows(spark, rows)).collect()}
    assert got == {("a.ts", 5, 5): ("entrypoint", "job", ["sql.query", "template.render"]), ("a.ts", 7, 9): ("generic", None, []), ("b.ts", 1, 2): ("entrypoint", "job", ["file.write"])}
    many = _tool_rows(spark, [(k, "c.ts", float(100 - k), None, "x", "y") for k in range(50)])
    assert sorted(r.start_line for r in hints.tool_hints(many).collect()) == list(range(51, 63))
    assert hints.tool_hints(many.limit(0)).count() == 0


def test_hints_meet_ranges(spark):
    rng = random.Random(5)
    kinds = [(None, []), ("http", ["exec"]), ("job", []), (None, ["db.write", "exec"]), ("webhook", ["sql.query"])]
    h = sorted({(p, s, s + rng.randrange(4)): rng.choice(kinds) for p in "ab" for s in rng.sample(range(1, 80), 8)}.items())
    frame = spark.createDataFrame([(*k, "", e, s) for k, (e, s) in h], HINT)
    ranges = [(rng.choice("abc"), k, s, s + rng.randrange(30)) for k, s in enumerate(rng.choices(range(1, 80), k=40))] + [("a", 99, 1, 90)] * 2
    anchors = spark.createDataFrame(ranges, "path string, anchor long, start_line long, end_line long")
    near, said = [], []
    for p, k, s, e in ranges:
        met = [(x, y) for x, y in h if x[0] == p and s <= x[2] and x[1] <= e]
        entries = [y[0] for _, y in met if y[0]]
        sunk = [n for _, y in met for n in y[1]]
        lines = sorted({n for x, y in met if y[1] for n in x[1:]})[:4]
        said.append((p, k, s, e, min(entries, key=list(hints.ENTRY_WORDS).index, default=None), list(dict.fromkeys(sunk)), lines))
        near += [(p, k, max(s, x[1] - 24), min(e, x[2] + 24)) for x, _ in met[:4]] if k != 99 else []
    got = hints.range_hints(anchors, frame).select("path", "anchor", "start_line", "end_line", "entry_type_hint", "hint_sinks", "sink_lines").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(said, key=repr)
    assert sorted(map(tuple, hints.hints_of_anchors(anchors.where("anchor <> 99"), frame).collect())) == sorted(near)


def test_islands_of_hints_outside_anchors(spark):
    frame = spark.createDataFrame([("a", 5, 5, "", None, []), ("a", 54, 55, "", None, []), ("a", 150, 150, "", None, []), ("b", 300, 300, "", None, [])], HINT)
    anchors = spark.createDataFrame([("a", 145, 155)], "path string, start_line long, end_line long")
    files = spark.createDataFrame([("a", 60), ("b", 100)], "path string, n_lines long")
    assert [tuple(r) for r in hints.hint_anchors(frame, anchors, files).collect()] == [("a", 1, 60)]


def test_what_code_tells(spark):
    rows = [('import { a } from "../lib/Session.js"', ["req.body.email"], "http", ["db.query", "exec"]), ("const x = require( 'jwt-simple' )\npassword", [], "job", []), ("plain", [], "rpc", ["http.request"]), (None, [], None, [])]
    df = spark.createDataFrame(rows, "c string, i array<string>, e string, s array<string>")
    got = [tuple(r) for r in df.select(hints.auth_location(F.col("c")), hints.data_sensitivity(F.col("c"), F.col("i")), hints.trust_boundaries(F.col("e"), F.col("s"))).collect()]
    assert got == [
        ("../lib/Session.js", ["PII"], ["Internet -> Application", "Application -> Database", "Application -> OS"]), ("jwt-simple", ["credentials", "tokens"], ["Application -> Internal"]),
        (None, [], ["Internet -> Application", "Application -> External Service"]), (None, [], ["Application -> Internal"]),
    ]


def _paths(spark, trees):
    return spark.createDataFrame([(repo, p, c) for repo, tree in trees.items() for p, c in (x if isinstance(x, tuple) else (x, None) for x in tree)], "repo string, path string, content string")


def test_monorepos(spark):
    trees = {
        "marked": ["nx.json", "a.ts"], "nested-marker": ["x/nx.json", "a.ts"], "two": ["apps/a/package.json", "apps/b/package.json"], "two-plain": ["a/package.json", "b/package.json"],
        "two-root": ["package.json", "a/package.json", "b/package.json"], "one": ["package.json", "Libs/a/package.json"], "text": [("package.json", "{'workspaces'")], "key": [("package.json", '{"turbo": {"a": 1}}')],
        "off": [("package.json", '{"nx": false, "turbo": 0, "lerna": "", "pnpm": null}')], "bad": [("package.json", "{nx")], "below": [("a/package.json", '{"workspaces": []}')], "skipped": ["node_modules/a/package.json", ".env", "x.ts"],
    }
    got = {r.repo: r.monorepo for r in repositories.project_folders(_paths(spark, trees)).collect()}
    assert {k for k, v in got.items() if v} == {"marked", "two", "two-root", "one", "text", "key"} and set(got) == set(trees)


def test_project_folders(spark):
    code = lambda at, n: [f"{at}/f{k}.ts" for k in range(n)]
    trees = {
        "shared": [*code("./web\\src", 3), "README.md"], "few": [*code("web/src", 1), "README.md", "b.md"], "alone": ["web/a.ts"], "flat": ["a.ts"], "gone": ["dist/a.ts"],
        "container": [*code("apps/x", 3), *code("apps/y", 3)], "configured": [*code("apps/x/src", 6), "apps/x/package.json", *code("y", 2)], "root": ["package.json", *code("x", 6), "x/tsconfig.json", *code("y", 4), "y/package.json", "y/vite.config.ts"],
        "dominant": [*code("x", 8), *code("y", 2), "z/a.md"], "even": [*code("x", 5), *code("y", 5)], "no-code": ["x/a.md", "y/b.md"],
    }
    got = {r.repo: (r.prefix, r.found_by) for r in repositories.project_folders(_paths(spark, trees)).collect()}
    assert got == {
        "shared": ("web/src", "shared"), "few": ("web", "dominant"), "alone": ("web", "dominant"), "flat": (None, None), "container": ("apps", "dominant"), "configured": ("apps/x", "configured"),
        "root": (None, None), "dominant": ("x", "dominant"), "even": (None, None), "no-code": (None, None),
    }
    assert repositories.project_folders(_paths(spark, trees).limit(0)).count() == 0


def test_factors_hold_exactly(spark):
    """A project that leads by just 1.1 in a monorepo: 77 to 70, where 1.1 * 70 is more than 77 in doubles."""
    code = lambda at, n: [f"{at}/f{k}.ts" for k in range(n)]
    texts = lambda at, n: [f"{at}/t{k}.md" for k in range(n)]
    a = ["apps/a/package.json", *code("apps/a/src", 8), *texts("apps/a", 11)]  # 25 + 2 * 8 + 20 + 2 * 8 = 77
    b = ["apps/b/package.json", *code("apps/b", 10), *texts("apps/b", 14)]  # 25 + 2 * 10 + 25 = 70
    files = _paths(spark, {"r": ["nx.json", *a, *b]})
    top = {r.prefix: r.score for r in repositories.project_candidates(repositories.folder_facts(files)).collect()}
    assert top == {"apps/a": 77, "apps/b": 70}
    assert [(r.prefix, r.found_by) for r in repositories.project_folders(files).collect()] == [("apps/a", "configured")]


def test_scripts_and_snapshots(spark):
    deep = "/".join("abcdefgh")
    trees = {"config": ["jsconfig.json"], "nested": ["x/jsconfig.json"], "deep": [f"{deep}/x.MJS"], "deeper": [f"{deep}/i/x.mjs"], "built": ["x/out/a.js"], "hidden": [".js"], "none": [None]}
    files = _paths(spark, trees)
    assert {r.repo for r in repositories.script_repositories(files).where("scripts").collect()} == {"config", "deep"}
    snaps = {"a": ["supabase/schema.json", "datastores/supabase/schema.json"], "b": ["x/y/datastores/supabase/p/schema.json"], "c": ["x/supabase/schema.json"], "d": [".x/datastores/supabase/p/schema.json"]}
    assert {tuple(r) for r in repositories.schema_snapshots(_paths(spark, snaps)).collect()} == {("a", "datastores/supabase/schema.json"), ("b", "x/y/datastores/supabase/p/schema.json")}


def test_report_heads_and_places(spark):
    rows = [(0, "low", "llm", " b "), (1, "high", "llm", "a"), (2, "high", "static", "c"), (3, "high", "static", "d"), (4, None, "x", None)]
    df = spark.createDataFrame([(k % 4 // 4, *r) for k, r in enumerate(rows)], "g int, ord long, severity string, source string, title string")
    assert tuple(report.group_heads(df, ["g"]).first()) == (0, "high", "static", "c", 5, 4, ["a", "b", "c"])
    one = report.group_heads(df.where("ord = 1"), ["g"]).first()
    assert (one.n_titles, one.shown_titles) == (1, [])
    places = spark.createDataFrame([(1, "b", 2), (1, "a", 10), (1, "a", 9), (1, "a", 9), (2, None, None)], "g int, filepath string, line long")
    assert sorted(map(tuple, report.group_places(places, ["g"]).collect())) == [(1, "a", 9, 1), (1, "a", 10, 2), (1, "b", 2, 3), (2, "", 0, 1)]


def test_anchor_report_meta_and_specs(spark):
    runs = spark.createDataFrame([("a", True, False, True, "", "", 5), ("b", False, False, None, None, None, None), ("c", True, True, False, None, "x", None), ("d", True, False, False, "no scripts", None, None), ("e", True, False, True, None, None, 1)], "repo string, enabled boolean, skipped boolean, ran boolean, reason string, error string, duration_ms long")
    anchors = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "repo string, path string")
    got = {r.repo: tuple(r)[3:8] for r in report.anchor_report(runs, anchors).collect()}
    assert got == {"a": (True, 3, 2, None, None), "b": (False, None, None, "disabled", None), "c": (False, None, None, "skipped", "x"), "d": (False, None, None, "no scripts", None), "e": (True, 0, 0, None, None)}
    meta = store.with_meta(store.with_meta(spark.createDataFrame([("v", "1"), ("w", "2")], "key string, value string"), "v", "3"), "x", "4")
    assert {tuple(r) for r in meta.collect()} == {("v", "3"), ("w", "2"), ("x", "4")}
    held = spark.createDataFrame([(" a ", ["x"]), (" ", None)], "s string, l array<string>")
    assert [tuple(r) for r in held.select(store.optional_json(F.col("s"), True), store.optional_json(F.col("l"))).collect()] == [("a", '["x"]'), (None, None)]
    specs = spark.createDataFrame([("s1", "o/r1", "g1"), ("s1", "o/r1", "g2"), ("s2", "o/r2", "g1")], "spec_id string, repo_name string, group_id string")
    n = lambda *a: evals.chosen(specs, *a).count()
    assert [n(), n(" all ", ""), n("s1"), n("o/r2"), n("s1", "g2"), n(None, "g1"), n("x")] == [3, 3, 2, 1, 1, 2, 0]


def test_ids_and_debug_rows(spark):
    rows = [(0, None, "llm", "low", None, "no place", "{}", "{}"), (1, None, "llm", "low", None, "x", '{"file": "./A.ts"}', '{"identity_key": "k"}'), (2, None, None, None, None, None, None, None), (3, "idor", "llm", "high", None, "y", '{"file": "a.ts", "line": 4}', '{"identityKey": ""}')]
    flat = identity.flatten(spark.createDataFrame(rows, "ord long, type string, source string, severity string, category string, summary string, location string, details string"))
    ids = {r.ord: r.id for r in evals.finding_ids(flat).collect()}
    assert ids[1] == "k" and ids[3] == "|a.ts|lines:4-4|idor" and ids[0].startswith("auto:") and ids[0].endswith(":0") and ids[2].startswith("auto:") and ids[2].endswith(":2")
    seen = {r.ord: r for r in projections.debug_rows(flat).collect()}
    assert (seen[3].place.filepath, seen[3].place.start_line, seen[3].type, seen[3].dedupe_key) == ("a.ts", 4, "idor", "|a.ts|lines:4-4|idor") and seen[2].summary is None and seen[2].place.filepath is None
    chunks = projections.sampling_chunks(spark.createDataFrame([("a", 0, 1, 2, "x")], "filepath string, chunk_index int, start_line int, end_line int, content string"))
    assert tuple(chunks.first()) == ("a", 0, 1, 2, "x", None, None)


def test_plans_of_the_probes(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("tool_hints", "anchor_hints", "range_hints", "project_folders"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan, name

"""Record shapes and anchor-scoped chunks."""

import json

from pyspark.sql import functions as F

import walks
from riskloom.functions import identity, routes
from riskloom.operators import chunking, dedupe, projections

FINDING = "ord long, type string, source string, severity string, category string, summary string, location string, details string"


def test_locations(spark):
    df = spark.createDataFrame([("./a.ts", 0, None, "pkg/"), ("pkg/a.ts", 5, 2, "pkg"), ("", None, None, None)], "p string, s int, e int, r string")
    got = [json.loads(r.j) for r in df.select(projections.location(F.col("p"), F.col("s"), F.col("e"), F.coalesce("r", F.lit(""))).alias("j")).collect()]
    assert got == [{"filepath": "pkg/a.ts", "startLine": 1, "endLine": 1}, {"filepath": "pkg/a.ts", "startLine": 5, "endLine": 5}, {"startLine": 1, "endLine": 1}]


def test_static_round_trip(spark):
    static = spark.createDataFrame([("eslint", "r", "a.ts", 3, 4, "low", "m", "s", None), ("osv-scanner", "CVE-1", "p", 1, 1, "high", "n", None, None)], "tool string, rule_id string, filepath string, start_line int, end_line int, severity string, message string, snippet string, details string")
    back = projections.existing_to_static(projections.static_to_existing(static)).collect()
    assert {(r.tool, r.rule_id, r.filepath, r.start_line, r.end_line, r.severity, r.message) for r in back} == {("eslint", "r", "a.ts", 3, 4, "low", "m"), ("osv-scanner", "CVE-1", "p", 1, 1, "high", "n")}
    chunks = spark.createDataFrame([("a.ts", 0, 1, 5, 0), ("a.ts", 1, 3, 9, 1)], "filepath string, chunk_index int, s int, e int, ord long")
    assert {r.source: r.chunk_index for r in projections.core_rows(static, chunks).collect()} == {"eslint": 0, "osv-scanner": None}


def test_chunk_lookup_by_index_then_line(spark):
    f = spark.createDataFrame([("1", "a", 7, 2), ("2", "a", None, 2), ("3", "b", None, 1)], "id string, filepath string, chunk_index int, start_line int")
    c = spark.createDataFrame([("a", 7, 90, 99, 0, "u7"), ("a", 0, 1, 5, 1, "u0")], "filepath string, chunk_index int, s int, e int, ord long, chunk_uid string")
    assert {r.id: r.chunk_uid for r in projections.repository_rows(f, c).collect()} == {"1": "u7", "2": "u0", "3": None}


def test_summaries_that_repeat_a_file_finding_go(spark):
    rows = [
        (0, "idor", "llm", "low", None, "users can read others", '{"file":"a.ts","line":3}', '{"ruleId":"idor"}'), (1, "idor", "llm", "low", None, "no owner check anywhere", None, '{"ruleId":"idor"}'),
        (2, "xss", "llm", "low", None, "scripts run", '{"path":"(repository)"}', "{}"), (3, "idor", "llm", "low", None, "x", None, '{"ruleId":"idor","repoFullName":"other"}'),
    ]
    flat = identity.flatten(spark.createDataFrame([*rows, (4, "sql_injection", "llm", "low", None, "q", '{"file":"b.ts"}', '{"repoFullName":"mine"}')], FINDING))
    assert sorted(r.ord for r in projections.without_summaries(flat).collect()) == [0, 2, 4]
    facts = dedupe.merge_facts(flat)
    got = {(r.a, r.b): r.s for r in facts.alias("a").join(facts.alias("b"), F.col("a.ord") < F.col("b.ord")).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), projections.native_similar("a", "b").alias("s")).collect()}
    local = {r.ord: r for r in facts.collect()}
    assert got == {(a, b): walks.similar(local[a], local[b]) and not walks._differ(local[a].repo_name, local[b].repo_name) for a, b in got}


def test_rule_scope(spark):
    flat = identity.flatten(spark.createDataFrame([(0, "missing_rate_limit", "llm", "low", None, "x", None, "{}"), (1, "odd", "llm", "low", "injection", "x", None, "{}")], FINDING))
    asked = spark.createDataFrame([("missing_rate_limiting",)], "rule_id string")
    assert [r.ord for r in projections.only_of_rules(flat, asked).collect()] == [0]
    assert [(r.ord, r.type) for r in projections.beyond_rules(flat, asked, "logic_issues").collect()] == [(1, "open_scan_injection")]


def test_report_rows_and_cards(spark):
    flat = identity.flatten(spark.createDataFrame([(0, "idor", "llm", "P1", None, "t", '{"file":"a.ts","line":3}', "{}"), (1, "static", None, None, None, "t", None, None)], FINDING))
    got = {r.ord: r for r in projections.report_rows(flat).collect()}
    assert (got[0].location, got[0].severity, got[0].category, got[0].source) == ("a.ts:3:3", "high", "configuration", "llm") and got[1].location == "(repository):1:1"
    card = spark.createDataFrame([("r", "c", [" a ", "b", "c", "d"])], "rule_id string, category string, questions array<string>").select(projections.rule_card().alias("c")).first().c
    assert card == "rule: r\ncategory: c\n- a\n- b\n- c"
    tags = spark.createDataFrame([('{"stack":["Next","React"],"languages":["next","Go"]}',)], "metadata string").select(projections.stack_tags().alias("t")).select("t", projections.focus_areas(F.col("t")).alias("f")).first()
    assert tags.t == ["Next", "React", "Go"] and tags.f == ["request handlers", "browser rendering"]


def test_anchor_chunks(spark):
    body = "\n".join(f"const v{k} = req.body.value{k} // some text here" for k in range(1, 31))
    files = spark.createDataFrame([("src/api/x.ts", body), ("y.ts", "tiny")], "path string, content string")
    anchors = spark.createDataFrame([("src/api/x.ts", "f", 3, 14), ("src/api/x.ts", "g", 20, 99), ("y.ts", "h", 1, 1)], "path string, anchor string, start_line int, end_line int")
    rows = chunking.anchor_chunks(files, anchors, size=8, overlap=2).orderBy("chunk_index").collect()
    assert [(r.anchor, r.chunk_index, r.start_line, r.end_line) for r in rows] == [("f", 0, 3, 10), ("f", 1, 9, 14), ("g", 2, 20, 27), ("g", 3, 26, 30)]
    assert rows[0].overlap_group_id == rows[1].overlap_group_id != rows[2].overlap_group_id
    assert rows[0].chunk.startswith("entry_type: internal\nexecution_role: backend\n") and "\n\nconst v3 " in rows[0].chunk and "inputs: request_body" in rows[0].chunk


def test_hints_outside_anchors(spark):
    hints = spark.createDataFrame([("a", 5, 5), ("a", 30, 30), ("a", 200, 201), ("b", 1, 1)], "path string, start_line int, end_line int")
    anchors = spark.createDataFrame([("a", 190, 195)], "path string, start_line int, end_line int")
    islands = chunking.hint_ranges(hints)
    assert {tuple(r) for r in islands.collect()} == {("a", 1, 54), ("a", 176, 225), ("b", 1, 25)}
    assert {(r.path, r.start_line) for r in chunking.uncovered(islands, anchors).collect()} == {("a", 1), ("b", 1)}
    env = spark.createDataFrame([("e.ts", "\n" * 30 + "NEXT_PUBLIC_API_SECRET\n")], "path string, content string")
    assert [tuple(r) for r in chunking.public_env_anchors(env).collect()] == [("e.ts", 21, 41)]
    ranges = spark.createDataFrame([("a", "f", k, k + 1, r) for k, r in enumerate(["base"] * 4 + ["hint", "sink", "entry", "hint"])], "path string, anchor string, start_line int, end_line int, reason string")
    assert [r.start_line for r in chunking.choose_ranges(ranges).orderBy("start_line").collect()] == [0, 1, 2, 3, 5, 6]


def test_routes_methods_and_identifiers(spark):
    paths = spark.createDataFrame([("src/app/users/",), ("app/x",), ("./webapp/y",), ("",)], "p string")
    got = paths.select(routes.after_segment(F.col("p"), "app").alias("a"), routes.route_path(F.col("p")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("users", "/src/app/users"), ("x", "/app/x"), (None, "/webapp/y"), (None, "/")]
    names = spark.createDataFrame([('public."a.b". c ',), ('"open.end',), ("..x..",), ('""',), (None,)], "n string")
    assert [r[0] for r in names.select(routes.identifier_parts(F.col("n"))).collect()] == [["public", "a.b", "c"], ["open.end"], ["x"], [], None]
    code = spark.createDataFrame([("export const GET = 1\n export async function POST() {}\nexport function GETS() {}\nimport { PUT }",)], "c string")
    assert [tuple(m) for m in code.select(routes.exported_methods(F.col("c"))).first()[0]] == [("GET", 1), ("POST", 2)]
    assert [r[0] for r in names.select(routes.redacted(F.col("n"))).collect()] == ["[REDACTED]"] * 4 + [None]


def test_worst_known_findings(spark):
    rows = [
        (0, "idor", "llm", "low", None, "first", '{"file":"./a.ts","line":3}', '{"ruleId":"idor","note":"x"}'), (1, "idor", "llm", "critical", None, "copy", '{"file":"a.ts","line":3}', '{"ruleId":"idor"}'),
        (2, "xss", "llm", "HIGH", None, "second", '{"path":"b.ts"}', None), (3, "xss", "llm", "odd", None, "third", '{"path":"c.ts","lineEnd":4}', "{}"), (4, None, "llm", "high", None, None, None, None),
    ]
    flat = identity.flatten(spark.createDataFrame(rows, FINDING))
    got = projections.worst_known(flat, 5).collect()
    assert [(r.summary, r.location, r.details) for r in got] == [("second", '{"filepath":"b.ts"}', None), ("first", '{"filepath":"a.ts","startLine":3}', '{"ruleId":"idor"}'), ("third", '{"filepath":"c.ts","endLine":4}', None)]
    assert [r.details for r in projections.worst_known(flat, 2, whole_details=True).collect()] == [None, '{"ruleId":"idor","note":"x"}']
    assert projections.worst_known(flat.limit(0), 5).count() == 0


def test_reasons_that_keep_findings_apart(spark):
    row = lambda k, rule, cand, entry: (k, "t", "llm", "low", None, "s", '{"file":"a.ts"}', json.dumps({"ruleId": rule, "candidateType": cand, "entryPoint": entry}))
    rows = [row(0, "idor", "x", "GET /a"), row(1, "xss", "x", "GET /a"), row(2, "idor", "y", "GET /a"), row(3, "idor", "x", "GET /b"), row(4, "idor", "x", None), row(5, "idor", None, "GET /a")]
    facts = dedupe.merge_facts(identity.flatten(spark.createDataFrame(rows, FINDING)))
    pairs = spark.createDataFrame([(0, k) for k in range(1, 6)], "a long, b long")
    assert {r.b: r.reason for r in dedupe.block_reasons(facts, pairs).collect()} == {1: "rule_id_mismatch", 2: "candidate_type_mismatch", 3: "entry_point_mismatch", 4: "entry_point_missing", 5: None}

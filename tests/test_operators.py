"""Operators against plain Python, and the shapes that SQL checks do not reach."""

import hashlib
import json
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.functions import identity
from riskloom.functions import text as t
from riskloom.operators import catalog, chunking, dedupe, enrich, evals, graph, intervals, packing, report, rules, sampling, store
from riskloom.plans import queries as plans
from riskloom.sources import database, files, reports


def test_chunk_ranges_equal_the_walk(spark):
    def walk(n, size, overlap):
        out, at = [], 1
        while n:
            end = min(n, at + size - 1)
            out.append((at, end))
            if end >= n:
                break
            at = end - overlap + 1
        return out

    for size, overlap in ((160, 40), (16, 4), (5, 0)):
        rows = chunking.chunk_ranges(spark.range(0, 700).withColumn("n", F.col("id").cast("int")), "n", size, overlap).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.chunk_index):
            got.setdefault(r.n, []).append((r.start_line, r.end_line))
        assert all(got.get(n, []) == walk(n, size, overlap) for n in range(700))


def test_char_windows_cover_all_lines(spark):
    rng = random.Random(1)
    texts = [(str(k), "\n".join("x" * rng.choice([0, 5, 40, 300]) for _ in range(rng.randint(1, 60)))) for k in range(20)] + [("n", None), ("e", "")]
    got = {}
    for r in chunking.char_windows(spark.createDataFrame(texts, "path string, content string"), most=200, overlap=50).collect():
        got.setdefault(r.path, []).append(r)
        assert len(r.chunk) <= 200 or r.start_line == r.end_line
    for p, text in texts:
        lines = {k for r in got.get(p, []) for k in range(r.start_line, r.end_line + 1)}
        assert lines == (set(range(1, len(text.split("\n")) + 1)) if text else set())


def test_headers_round_trip(spark):
    df = spark.createDataFrame([("http", "POST /x", None, "code\n\nmore"), (None, None, None, "only code")], "entry_type string, route string, empty string, body string")
    whole = df.select("body", F.concat_ws("\n\n", F.nullif(chunking.render_header(["entry_type", "route", "empty"]), F.lit("")), "body").alias("c"))
    rows = whole.select("body", chunking.split_header(F.col("c")).alias("s")).collect()
    assert [(r.s.header, r.s.body == r.body) for r in rows] == [("entry_type: http\nroute: POST /x", True), ("", True)]


def test_entry_points_and_sinks(spark):
    f = spark.createDataFrame([("src/app/users/route.ts", "import x\nexport async function GET() {}\nexport const POST = 1"), ("api.js", "app.post('/login', h)\neval(x)")], "path string, content string")
    assert {(r.path, r.label, r.line) for r in chunking.entry_points(f).collect()} == {("src/app/users/route.ts", "GET /users", 2), ("src/app/users/route.ts", "POST /users", 3), ("api.js", "POST /login", 1)}
    assert {(r.path, r.label): r.lines for r in chunking.sinks_of(f, "path").collect()}[("api.js", "eval")] == [2]


def test_sequential_bins_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(2)
    rows = [(g, k, rng.randint(1, 50)) for g in range(5) for k in range(40)]
    got = {(r.g, r.k): r.bin for r in packing.sequential_bins(spark.createDataFrame(rows, "g long, k long, n long"), ["g"], "k", "n", 10, 100, 4).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(5):
        number, held, count = 0, 10, 0
        for _, k, n in (r for r in rows if r[0] == g):
            if count and (held + n > 100 or count >= 4):
                number, held, count = number + 1, 10, 0
            held, count = held + n, count + 1
            assert got[g, k] == number


def test_round_robin_and_caps(spark):
    rows = [(g, k) for g, n in (("a", 1), ("b", 3), ("c", 2)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long")
    picks = sampling.round_robin(df, "g", [F.asc("k")], 5).orderBy("pick").collect()
    assert [(r.g, r.k) for r in picks] == [("a", 0), ("b", 0), ("c", 0), ("b", 1), ("c", 1)]
    assert sampling.cap_groups(df.withColumn("o", F.monotonically_increasing_id()), "g", "o", 2, 2).count() == 3


@pytest.mark.parametrize("seed, expect", [(0, [0, 1, 2]), (3, [2, 3, 4]), (6, [4, 5, 6])])
def test_seed_window(spark, seed, expect):
    df = spark.createDataFrame([(1, k, k == seed) for k in range(7)], "g long, k long, s boolean")
    assert sorted(r.k for r in sampling.seed_window(df, ["g"], "k", "s", 3).collect()) == expect


def test_rule_routes(spark):
    c = spark.createDataFrame([("a", ["raw_sql_sink", "untrusted_input_present"], "public", "api_handler"), ("b", [], "internal", "config"), ("c", None, None, None), ("d", ["webhook_handler", "exec_sink", "authn_present"], "", "odd")], "chunk_uid string, signals array<string>, exposure string, role string")
    got = {}
    for r in rules.select_rules(c, rules.catalogue(spark)).orderBy("chunk_uid", "position").collect():
        got.setdefault(r.chunk_uid, []).append(r)
    assert len(rules.RULES) == 57
    assert got["a"][0].rule_id == "sql_injection" and got["a"][0].strategy == "signals_primary"
    assert [r.rule_id for r in got["b"]] == ["permissive_cors", "public_storage_bucket", "missing_security_headers"] and got["b"][0].strategy == "role_fallback"
    assert [r.rule_id for r in got["c"]] == rules.BASELINE
    assert "webhook_code_execution" in [r.rule_id for r in got["d"]]
    risky = c.select("chunk_uid", rules.high_risk(F.coalesce("signals", F.array().cast("array<string>")), F.col("exposure")).alias("h")).collect()
    assert {r.chunk_uid: bool(r.h) for r in risky} == {"a": True, "b": False, "c": False, "d": True}


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _sql_rows(sql, tables):
    con = duckdb.connect()
    for name, folder in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet{'' if folder.startswith('/root') else '/*.parquet'}'")
    return sorted(con.sql(sql).fetchall())


def test_rules_see_all_events_and_prefixes_all_pages(spark, tmp_path):
    # no event_id is a multiple of 7, no page_id one of 3
    spark.createDataFrame([(1, 5, "error", 1.0), (2, 5, "error", 200.0), (3, 6, "click", 1.0), (4, 6, "click", None), (5, 8, "odd", 1.0)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "http://a.org/x/1"), (2, "http://b.org/y/2")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    names = plans.SIGNALS_OF_EVENTS
    assert {r.chunk_uid: sorted(r.signals) for r in plans._event_chunks(spark, str(tmp_path)).collect()} == {5: sorted(names[2:4]), 6: [names[0]], 8: [names[0]]}
    assert {r.chunk_uid for r in plans.rule_selection(spark, str(tmp_path)).select("chunk_uid").collect()} == {5, 6, 8}
    assert _rows(plans.longest_prefix_all(spark, str(tmp_path))) == [(1, "a.org/x"), (2, "b.org/y")]
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        for name in ("rule_eligibility_all", "longest_prefix_all"):
            got = _rows(plans.QUERIES[name](spark, folder))
            assert got == _sql_rows(plans.ORACLE[name], {"events": folder, "pages": folder}), name
    assert len({tuple(sorted(r.signals)) for r in plans._event_chunks(spark, "/root/testdata/sf0.01").collect()}) > 10


def test_open_scan_reasons(spark):
    r = spark.createDataFrame([(["exec_sink"], 1, "signals_primary", 0), ([], 9, "role_fallback", 0), (["api_handler"], 9, "signals_primary", 0)], "s array<string>, n int, t string, f int")
    got = [x.r for x in r.select(rules.open_scan_reasons(F.col("s"), F.col("n"), F.col("t"), F.col("f")).alias("r")).collect()]
    assert got == [["low_rule_coverage", "high_risk_no_findings"], ["role_fallback", "signals_missing"], []]


def test_derived_signals(spark):
    u = spark.createDataFrame([("a", "Public", "api_handler", ["exec", "raw_sql"], ["untrusted"]), ("b", None, None, None, None)], "chunk_uid string, exposure string, role string, sink_types array<string>, input_trusts array<string>")
    got = rules.derived_signals(u).collect()
    assert {r.signal_id for r in got} == {"public_entrypoint", "api_handler", "exec_sink", "raw_sql_sink", "untrusted_input_present"}


FINDING = "ord long, type string, source string, severity string, category string, summary string, location string, details string"


def findings(rng, n):
    rows = []
    for k in range(n):
        loc = {"filepath": f"f{rng.randrange(6)}.ts"}
        if rng.random() < 0.8:
            loc["startLine"] = rng.randint(1, 20)
            if rng.random() < 0.5:
                loc["endLine"] = loc["startLine"] + rng.randint(0, 4)
        else:
            loc["chunkIndex"] = rng.randrange(3)
        det = {}
        if rng.random() < 0.7:
            det["ruleId"] = rng.choice(["idor", "sql_injection", "missing_rate_limiting", "missing_timeout"])
        if rng.random() < 0.6:
            det["entryPoint"] = rng.choice(["GET /a", "get /a/", "POST /b"])
        if rng.random() < 0.2:
            det["anchorNodeId"] = f"n{rng.randrange(3)}"
        if rng.random() < 0.2:
            det["overlapGroupId"] = f"g{rng.randrange(3)}"
        rows.append((k, rng.choice([None, "idor", "sql_injection"]), "llm", rng.choice(["low", "high"]), None, rng.choice(["Missing rate limit on login", "SQL injection in query", "users can read others"]), json.dumps(loc), json.dumps(det)))
    return rows


def test_merged_findings(spark):
    rows = [(0, "idor", "llm", "low", None, "a b", '{"file":"x.ts","line":3}', "{}"), (1, "idor", "llm", "high", None, "a b c", '{"file":"x.ts","line":3}', '{"tool":"t2"}')]
    flat = identity.flatten(spark.createDataFrame(rows, FINDING))
    r = dedupe.merged_findings(flat, dedupe.greedy_clusters(flat)).collect()
    assert len(r) == 1 and (r[0].severity, r[0].summary, r[0].detected_by, r[0].n_findings) == ("high", "a b c", ["llm", "t2"], 2)


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(k, k % 2, sorted({f"w{rng.randrange(12)}" for _ in range(rng.randint(1, 9))})) for k in range(80)]
    for share in (0.5, 0.88, 1.0):
        got = {(r.a, r.b) for r in dedupe.similar_pairs(spark.createDataFrame(rows, "id long, g long, w array<string>"), ["g"], "id", "w", share).collect()}
        sets = {k: (g, set(w)) for k, g, w in rows}
        assert got == {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= share * len(sets[a][1] | sets[b][1]) - 1e-12}


def test_similar_pairs_of_large_classes(spark, monkeypatch):
    """Equal sets are compared once, and a class of many rows is dealt to several tasks."""
    monkeypatch.setattr(dedupe, "DEALT", 7)
    compared, plain = [], dedupe._unlike_pairs
    monkeypatch.setattr(dedupe, "_unlike_pairs", lambda named, *more: compared.append(named.count()) or plain(named, *more))
    common = [f"w{k}" for k in range(10)]
    rows = [(k, 0, common if k % 3 else [*common, "x"]) for k in range(60)] + [(60, 1, common), (61, None, common), (62, None, common), (63, 0, [])]
    got = dedupe.similar_pairs(spark.createDataFrame(rows, "id long, g long, w array<string>"), ["g"], "id", "w").collect()
    assert {(r.a, r.b): round(r.score, 6) for r in got} == {(a, b): 1.0 if (a % 3 > 0) == (b % 3 > 0) else round(10 / 11, 6) for a in range(60) for b in range(a + 1, 60)}
    assert len(got) == 60 * 59 // 2 and compared == [4]


def test_similar_sets_meet_over_equal_parts(spark, monkeypatch):
    """Near sets of all sizes are found, in parts of a few rows too, and those that only share a rare word never meet."""
    monkeypatch.setattr(dedupe, "DEALT", 5)
    written, plain = {}, dedupe.materialise
    monkeypatch.setattr(dedupe, "materialise", lambda df, name: written.setdefault(name, plain(df, name)))
    rng, sets = random.Random(6), {}
    for n in [1, 7, 8, 9, 10, 15, 22, 25, 30, 60, 113, 114, 250] * 3:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for changed in (0, 0, 1, 2, n // 20, n // 9, n // 8, n // 7):
            less = rng.sample(base, n - rng.randint(0, min(changed, n - 1)))
            sets[len(sets)] = (len(sets) % 2, frozenset(less + [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(0, changed))]))
    near = lambda share: {(a, b): len(x & y) / len(x | y) for a, (g, x) in sets.items() for b, (h, y) in sets.items() if a < b and g == h and x != y and len(x & y) / len(x | y) >= share}
    for share in (0.8, 0.88, 0.95):
        classes = {}
        for k, s in sets.items():
            classes.setdefault(s, k)
        rows = [(k, g, sorted(x)) for (g, x), k in classes.items()]
        got = dedupe._unlike_pairs(spark.createDataFrame(rows, "id__ long, g long, words__ array<string>"), ["g"], share).collect()
        assert len(got) > 20 and {(r.a, r.b): r.score for r in got} == {p: v for p, v in near(share).items() if {*p} <= {*classes.values()}} and len({(r.a, r.b) for r in got}) == len(got)
        written.clear()
    rows = [(k, "g", [f"rare{k // 40}", *(f"u{k}x{j}" for j in range(20))]) for k in range(200)]
    assert dedupe.similar_classes(spark.createDataFrame(rows, "id long, g string, w array<string>"), ["g"], "id", "w").count() == 0
    assert written["part-members"].count() <= 20 and written["part-partners"].isEmpty()


def _whole_word_sets(rows):
    sets = {}
    for k, source, text in rows:
        w = {x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x} - set(t.STOP_WORDS)
        if w:
            sets.setdefault((source, frozenset(w)), []).append(k)
    same = {("same", min(ids), k) for ids in sets.values() for k in ids if k != min(ids)}
    reps = sorted((source, min(ids), w) for (source, w), ids in sets.items())
    near = {("near", *sorted((a, b))) for k, (s, a, x) in enumerate(reps) for s2, b, y in reps[k + 1 :] if s == s2 and len(x & y) >= 0.88 * len(x | y) - 1e-12}
    return same | near


def test_near_texts_read_whole_texts(spark, tmp_path):
    head = " ".join(f"head{k}" for k in range(30))
    body = [" ".join(f"w{g}x{k}" for k in range(60)) for g in range(4)]
    rows = [(1, "s", f"{head} {body[0]}"), (2, "s", f"{head} {body[1]}"), (3, "s", f"other opening {body[2]}"), (4, "s", f"changed start {body[2]}"), (5, "t", body[3]), (6, "s", None), (7, "s", "the a")]
    rows += [(k, "t", body[3]) for k in range(100, 150)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.near_texts(spark, str(tmp_path)).collect()
    assert {(r.kind, r.a, r.b) for r in got} == _whole_word_sets(rows) == {("near", 3, 4)} | {("same", 5, k) for k in range(100, 150)} and len(got) == 51
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    assert {(r.kind, r.a, r.b) for r in plans.near_texts(spark, sf).collect()} == _whole_word_sets(docs)


def test_reduce_passes_odd_rows_through(spark):
    rows = [("k", 1, "low", ["a"], "r1"), ("k", 2, "high", ["b"], "r1"), ("k", 3, "high", ["c"], "r2"), ("", 4, "low", ["d"], "r1"), (None, 5, "low", [], None)]
    got = dedupe.reduce_by_fingerprint(spark.createDataFrame(rows, "fp string, ord long, level string, evidence array<string>, rule string"), "fp", "ord", "level", "evidence", ["rule"]).collect()
    assert sorted((r.ord, r.n_merged, tuple(r.evidence)) for r in got) == [(2, 2, ("a", "b")), (3, 1, ("c",)), (4, 1, ("d",)), (5, 1, ())]


def test_call_graph_decoding(spark):
    raw = spark.createDataFrame([('[["a","b"],["c","d"]]',), ('[{"caller":"e","callee":"f"},{"from":"g","to":"h"}]',), ('{"i":["j","k"]}',), ('{"l":{"calls":["m"]}}',), ("[]",)], "edges string")
    assert {(r.src, r.dst) for r in graph.decode_edges(raw).collect()} == {("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j"), ("i", "k"), ("l", "m")}
    g = spark.createDataFrame([(["x.ts"], {"1": "0:1:0:9:1", "2": "0:?:0:9:1", "3": "5:1:0:2:0"})], "files array<string>, functions map<string,string>")
    assert [(r.id, r.file, r.start_line, r.end_line) for r in graph.decode_functions(g).collect()] == [("1", "x.ts", 1, 9)]


def test_reachability_caps_labels_not_paths(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    starts = spark.createDataFrame([(n, n.upper(), k) for k, n in enumerate("dcba")], "node string, label string, ord long")
    got = {r.node: (r.labels, r.min_depth) for r in graph.reachability(edges, starts).collect()}
    assert got["x"] == (["D", "C", "B"], 1) and got["z"] == (["D", "C", "B"], 3) and got["a"] == (["A"], 0)
    assert graph.reachability(edges, starts, max_depth=1).where("node = 'y'").count() == 0


SNAPSHOT = {
    "rls": [{"table_schema": "public", "table_name": "test_no_rls", "rls_enabled": False}, {"table_schema": "public", "table_name": "test_rls_no_policy", "rls_enabled": True}, {"table_schema": "public", "table_name": "projects", "rls_enabled": True}],
    "tablePrivileges": [{"table_schema": "public", "table_name": t, "grantee": g, "privilege_type": p} for t, g, p in [("test_no_rls", "anon", "SELECT"), ("test_rls_no_policy", "authenticated", "SELECT"), ("projects", "anon", "INSERT"), ("projects", "anon", "UPDATE")]],
    "policies": [{"schemaname": "public", "tablename": "projects", "policyname": "p", "roles": "{anon}", "cmd": "ALL"}, {"schemaname": "storage", "tablename": "objects", "policyname": "q", "roles": "public", "cmd": "SELECT"}],
    "routinePrivileges": [{"routine_schema": "public", "routine_name": "add_credits", "specific_name": "add_credits_1", "grantee": "PUBLIC"}],
    "storageBuckets": [{"id": "avatars", "name": "avatars", "public": True}, {"id": "x", "name": "x", "public": False}],
}
EXPECTED = {
    ("rls_disabled", "public.test_no_rls", "high"), ("rls_no_policies", "public.test_rls_no_policy", "low"), ("client_write_access", "public.projects", "high"), ("column_acl_missing", "public.projects", "medium"),
    ("function_public_exec", "public.add_credits.add_credits_1", "high"), ("public_bucket", "avatars", "high"), ("storage_objects_public_policy", "storage.objects", "high"),
}


def test_entries_reach_eight_calls(spark, tmp_path):
    # with n rows, order k calls k + 1 (7 k + customer) and 3 k + 12: a customer of -6 k makes a line of the first
    n = 1000
    rows = [(k, -6 * k, "F" if k == 1 else "O", "1-URGENT") for k in range(1, n + 1)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    reached, now = {1: 0}, {1}
    for depth in range(1, 9):
        now = {x for k in now for x in (k % n + 1, (3 * k + 11) % n + 1)} - set(reached)
        reached |= dict.fromkeys(now, depth)
    got = dict(_rows(plans.bfs_reach_entries(spark, str(tmp_path))))
    assert got == reached and max(got.values()) == 8
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        assert _rows(plans.bfs_reach_entries(spark, folder)) == _sql_rows(plans.ORACLE["bfs_reach_entries"], {"orders": folder})


def test_catalog_rules_on_a_snapshot(spark):
    sets = database.snapshot(spark.createDataFrame([(json.dumps(SNAPSHOT),)], "value string"))
    assert {(r.rule_id, r.object, r.severity) for r in catalog.catalog_findings(sets).collect()} == EXPECTED


DUMP = """
CREATE TABLE public."test_no_rls" (id int);
CREATE TABLE IF NOT EXISTS test_rls_no_policy (id int);
CREATE TABLE public.projects (id int);
ALTER TABLE public.test_rls_no_policy ENABLE ROW LEVEL SECURITY;
ALTER TABLE ONLY public.projects ENABLE ROW LEVEL SECURITY;
CREATE POLICY "p" ON public.projects FOR ALL TO anon USING (true);
CREATE POLICY q ON storage.objects FOR SELECT USING (bucket_id = 'avatars');
GRANT SELECT ON public.test_no_rls TO anon;
GRANT SELECT ON TABLE test_rls_no_policy TO "authenticated";
GRANT INSERT, UPDATE ON TABLE public.projects TO anon;
GRANT EXECUTE ON FUNCTION public.add_credits(int, text) TO PUBLIC;
INSERT INTO storage.buckets (id, name, public) VALUES ('avatars', 'avatars', true), ('it''s, x', 'y', false);
"""


def test_catalog_rules_on_a_dump(spark):
    sets = database.dump(spark.createDataFrame([(DUMP,)], "value string"))
    got = {(r.rule_id, r.object, r.severity) for r in catalog.catalog_findings(sets).collect()}
    assert {(a, b.replace("add_credits.add_credits_1", "add_credits.add_credits"), c) for a, b, c in EXPECTED} == {g for g in got}
    assert database.split_values("'a, b', 2, f(1, 2), NULL") == ["'a, b'", "2", "f(1, 2)", "NULL"]
    assert [database.literal(x) for x in ("NULL", "TRUE", "'it''s'", "5")] == [None, True, "it's", "5"]


def test_store(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, h string, o long")
    old, new = df([("a", "1", 0), ("b", "1", 0), ("c", "1", 0)]), df([("b", "2", 1), ("c", "1", 1), ("d", "1", 1), ("d", "9", 2)])
    assert {(r.k, r.status) for r in store.diff(new.dropDuplicates(["k"]), old, "k", ["h"]).collect()} == {("a", "deleted"), ("b", "changed"), ("c", "unchanged"), ("d", "new")}
    assert {(r.k, r.h) for r in store.insert_or_ignore(old, new, ["k"], "o").collect()} == {("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")}
    assert store.upsert(old, new.where("k = 'b'"), ["k"]).where("h = '2'").count() == 1
    assert store.remaining(new.select(F.col("k").alias("task_key")), old.select(F.col("k").alias("task_key"))).count() == 2
    one = store.snapshot(old, [], "k", "h").first()
    assert one.n_files == 3 and one.hash == store.snapshot(old.orderBy(F.desc("k")).repartition(3), [], "k", "h").first().hash


def test_incremental_rechunk(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, hash string, chunk_format string")
    stored = spark.createDataFrame([("a", 0), ("b", 0), ("gone", 0)], "path string, chunk_index int")
    out = store.rechunk(f([("a", "1", "s"), ("b", "2", "s"), ("c", "1", "s")]), f([("a", "1", "s"), ("b", "1", "s"), ("gone", "1", "s")]), stored, lambda d: d.select("path", F.lit(7).alias("chunk_index")))
    assert {(r.path, r.chunk_index) for r in out.collect()} == {("a", 0), ("b", 7), ("c", 7)}


def test_enrichment_survives_failures(spark):
    def fragile(rows):
        if any(r["k"] % 10 == 3 for r in rows):
            raise RuntimeError("no")
        return [f"ok {r['k']}" for r in rows]

    df = spark.createDataFrame([(k, k // 8, k) for k in range(40)], "k long, batch long, ord long")
    got = {r.k: (r.answer, r.failed) for r in enrich.enrich(df, fragile).collect()}
    assert all(got[k] == (f"ok {k}", False) for k in range(40) if k % 10 != 3) and all(got[k][1] for k in (3, 13, 23, 33))
    assert enrich.dead_letters(enrich.enrich(df, fragile), "k").count() == 4


@pytest.mark.parametrize(
    "text, value",
    [
        ('x ```json\n{"findings": [{"type": "a"}]}\n``` y', [{"type": "a"}]),
        ('{"findings": [{"type": "a"}, {"type": "b"}, {"ty', [{"type": "a"}, {"type": "b"}]),
        ('// c\n[{"type": "a" /* d */}]', [{"type": "a"}]),
        ('noise {"type": "http://x"} tail', [{"type": "http://x"}]),
        ("nothing", []),
        (None, []),
    ],
)
def test_json_recovery(text, value):
    assert enrich.records_of(enrich.json_of(text)) == value


def test_parse_findings(spark):
    df = spark.createDataFrame([(1, '[{"type":"idor","summary":"s","location":{"file":"x"}}]'), (2, "broken"), (3, None)], "k long, answer string")
    got = enrich.parse_findings(df, "k").collect()
    assert [(r.k, r.n, r.type, r.location) for r in got] == [(1, 0, "idor", '{"file": "x"}')]
    s = spark.createDataFrame([('{"signals":[{"id":" API_handler","evidence":"e","confidence":"1.7"},{"id":"odd","evidence":"e"},{"id":"api_handler","evidence":" "}]}',)], "answer string")
    assert [(r.signal_id, r.confidence) for r in enrich.parse_signals(s, ["api_handler"]).collect()] == [("api_handler", 1.0)]


def test_evaluation(spark):
    e = spark.createDataFrame([
        ("g", 1, "", "src/*.ts", "", "", "throttling", None, None), ("g", 2, "", "src/a.ts", "", "", "missing_rate_limit", None, None), ("g", 3, "", "x.ts", "", "v2|x.ts|idor|lines:1-1", "idor", None, None),
        ("g", 4, "", "p.json", "lodash@4.1.0 CVE-2020-12345", "", None, None, None), ("h", 1, "", "q.ts", "", "", "idor", None, None),
    ], "group_id string, ord long, id string, filepath string, expectation string, identity_key string, rule_id string, start_line int, end_line int")
    a = spark.createDataFrame([
        ("g", "1", "src/a.ts", "", ["missing_rate_limiting"], None, None), ("g", "2", "src/b.ts", "", ["rate_limiting"], None, None), ("g", "3", "x.ts", "v2|x.ts|other|lines:1-1", ["idor"], None, None),
        ("g", "4", "p.json", "", ["CVE-2020-12345"], "Lodash", "4.1.0"), ("h", "5", "q.ts", "", ["idor"], None, None),
    ], "group_id string, id string, filepath string, identity_key string, rules array<string>, package_name string, package_version string")
    groups = spark.createDataFrame([("g", True), ("h", False)], "group_id string, allow_unexpected boolean")
    got = {r.group_id: r for r in evals.evaluate(e, a, groups).collect()}
    assert (got["g"].n_matched, got["g"].n_missing, got["g"].n_unexpected, got["g"]["pass"]) == (2, 2, 2, False) and got["h"]["pass"]
    ids = [r.id for r in evals.stable_ids(e).orderBy("group_id", "ord").collect()]
    assert all(i.startswith("auto:") for i in ids) and len(set(ids)) == 5
    assert "| h | pass |" in evals.markdown(evals.spec_status(evals.evaluate(e, a, groups), "group_id"), "group_id")


def test_matches_meet_by_path_and_equal_a_walk(spark):
    rng = random.Random(11)
    e = [(f"g{k % 2}", k, rng.choice([f"src/{rng.randrange(30)}.ts", "src/*.ts", f"src/{rng.randrange(3)}*.ts"]), rng.choice(["idor", "timeout"])) for k in range(16)]
    a = [(f"g{k % 2}", str(k), f"src/{rng.randrange(30)}.ts", [rng.choice(["idor", "missing_timeout"])]) for k in range(24)]
    expected = spark.createDataFrame([(g, k, "", p, "", "", r) for g, k, p, r in e], "group_id string, ord long, id string, filepath string, expectation string, identity_key string, rule_id string")
    actual = spark.createDataFrame([(g, k, p, "", r, None, None) for g, k, p, r in a], "group_id string, id string, filepath string, identity_key string, rules array<string>, package_name string, package_version string")
    pairs = evals.candidate_pairs(expected, actual)
    wild = lambda p, path: re.fullmatch("[^/]*".join(map(re.escape, p.split("*"))), path)
    alike = lambda r, x: r == x[0].removeprefix("missing_")
    want = {(g, k, j) for g, k, p, r in e for h, j, path, x in a if g == h and alike(r, x) and wild(p, path)}
    assert {(r.group_id, r.e_ord, r.a_id) for r in pairs.collect()} == want
    taken, matched = set(), set()
    for g, k, _, _ in e:
        free = sorted(j for h, n, j in want if (h, n) == (g, k) and (g, j) not in taken)
        if free:
            taken.add((g, free[0]))
            matched.add((g, k, free[0]))
    assert {tuple(r) for r in evals.greedy_match(pairs).collect()} == matched
    assert re.search(r"Join \[group_id#\d+, rule#\d+, pattern#\d+\]", pairs._jdf.queryExecution().executedPlan().toString())


def test_snapshot_folders_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text").collect()
    lines, sha = {}, lambda s: hashlib.sha256(s.encode()).hexdigest()
    d = spark.createDataFrame([(f"{r.doc_id}:{sha(r.text)}", r.source) for r in docs], "line string, source string")
    for r in d.select("source", "line", F.pmod(F.xxhash64("line"), F.lit(4096)).alias("part")).collect():
        lines.setdefault(r.source, {}).setdefault(r.part, []).append(r.line)
    want = sorted((s, sha("\n".join(sha("\n".join(sorted(v))) for _, v in sorted(parts.items()))), sum(map(len, parts.values()))) for s, parts in lines.items())
    assert _rows(plans.snapshot_folders(spark, "/root/testdata/sf0.001")) == want


def test_aggregates_collect_distinct_rows_only(spark):
    same = spark.createDataFrame([("k", n, "low" if n else "high", ["a", "b"], "r") for n in range(500)] + [("k", 500, "low", ["c"], "r")], "fp string, ord long, level string, evidence array<string>, rule string")
    df = dedupe.reduce_by_fingerprint(same, "fp", "ord", "level", "evidence", ["rule"])
    assert [(r.ord, r.level, r.n_merged, r.evidence) for r in df.collect()] == [(0, "high", 501, ["a", "b", "c"])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[fp#\d+, evidence#\d+\]", plan)


def test_tool_reports(spark, tmp_path):
    raw = lambda v: spark.createDataFrame([(json.dumps(v),)], "value string")
    lint = reports.lint(raw([{"filePath": "a.ts", "messages": [{"ruleId": "no-eval", "line": 3, "severity": 2, "message": "m"}, {"ruleId": None, "line": 1, "severity": 1, "message": "x"}]}]))
    secret = reports.secrets(raw([{"RuleID": "key", "Description": "d", "File": "b.ts", "StartLine": 1, "EndLine": 2, "Secret": "s3cret"}]))
    vuln = {"id": "GO-1", "aliases": ["CVE-1-1", "GHSA-x"], "summary": "s", "severity": [{"type": "CVSS_V3", "score": "9.8"}]}
    adv = reports.advisories(raw({"results": [{"source": {"path": "p.lock"}, "packages": [{"package": {"name": "n", "version": "1", "ecosystem": "npm"}, "vulnerabilities": [vuln]}]}]}))
    rows = {r.tool: r for r in reports.gather(lambda: lint, lambda: secret, lambda: adv, lambda: reports.read_json(spark, str(tmp_path / "none"), reports.lint)).collect()}
    assert (rows["eslint"].severity, rows["eslint"].start_line) == ("high", 3)
    assert rows["gitleaks"].snippet == "[REDACTED]" and "s3cret" not in str(rows["gitleaks"])
    assert (rows["osv-scanner"].rule_id, rows["osv-scanner"].severity) == ("GHSA-x", "critical")
    assert reports.existing_findings(raw({"findings": [{"type": "idor", "location": {"file": "x"}}]})).first().location == '{"file":"x"}'


def test_file_tree(spark, tmp_path):
    for name, data in {"a.ts": b"x", "__tests__/t.ts": b"y", ".env.ts": b"z", "node_modules/m.ts": b"n", "bin.ts": b"\x00", "big.ts": b"b" * 300_000, "skip/s.ts": b"s", "note.txt": b"t", "d/deep/e.py": b"e"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / ".gitignore").write_text("# c\n\nskip/\n")
    got = files.read_files(spark, str(tmp_path)).collect()
    assert sorted(r.path for r in got) == [".env.ts", "__tests__/t.ts", "a.ts", "d/deep/e.py"]


def test_size_limit_is_the_default(spark, tmp_path):
    sizes = [20_480, 20_481, files.MAX_BYTES, files.MAX_BYTES + 1]
    spark.createDataFrame([(n, "a" * n, "en", n) for n in sizes], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert _rows(plans.discover_eligible(spark, str(tmp_path))) == [(n, "en") for n in sizes[:3]] == _sql_rows(plans.ORACLE["discover_eligible"], {"documents": str(tmp_path)})


def test_prefixes(spark):
    p = spark.createDataFrame([("web/src/a.ts",), ("web/src/b.ts",), ("web/package.json",), ("docs/x.md",)], "path string")
    stats = files.prefix_statistics(p, F.col("path"), F.split("path", "/")[0])
    assert files.dominant_prefix(stats).first().prefix == "web"
    assert files.common_prefix(p.where("path LIKE 'web/src%'"), "path").first().prefix == "web/src" and files.common_prefix(p, "path").first().prefix == ""


def test_fuzzy_report_groups(spark):
    titles = ["Missing rate limit on login", "No rate limiting for API", "Users table readable", "users table is readable by all", "Debug endpoint exposed", "Webhook replay possible"]
    df = spark.createDataFrame([(k, "high", "llm", x, "p") for k, x in enumerate(titles)], "ord long, severity string, source string, title string, location string")
    got = {r.ord: r.group_ord for r in report.fuzzy_groups(df).collect()}
    assert got[1] == 0 and got[3] == 2 and got[4] == 4 and got[5] == 5
    text = report.render_text(df)
    assert text.count("[HIGH]") == 6 and report.render_text(df.limit(0)) == "No findings."
    assert report.severity_pivot(df).first().high == 6 and json.loads(report.to_json_lines(df).first().value)["ord"] in range(6)


def test_bucketed_points_equal_plain(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(k, rng.randrange(500)) for k in range(200)], "id long, x long")
    iv = spark.createDataFrame([(k, s, s + rng.randrange(60)) for k, s in ((k, rng.randrange(480)) for k in range(60))], "o long, s long, e long")
    a = intervals.point_in_interval(pts.withColumn("g", F.lit(1)), iv.withColumn("g", F.lit(1)), ["g"], "x", "s", "e", "o", ["o"], ["id"])
    b = intervals.bucketed_point_in_interval(pts, iv, "x", "s", "e", "o", ["o"], ["id"], 25)
    assert {(r.id, r.o) for r in a.collect()} == {(r.id, r.o) for r in b.collect()}

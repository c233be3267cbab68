"""Normal forms, identities and detectors on literal rows."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import detectors, identity, severity
from riskloom.functions import text as t


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, path", [(" ./src//a.ts ", "src/a.ts"), ("\\x\\y\\", "x/y"), (".env", "env"), ("/a/b//", "a/b"), ("", ""), (None, None)])
def test_sampling_path(spark, raw, path):
    assert one(spark, raw, t.sampling_path) == path


@pytest.mark.parametrize("raw, repo, file", [("../a/b/", "a/b", "./a/b/"), ("./x", "x", "x"), (".github/w", "github/w", "github/w")])
def test_two_path_forms(spark, raw, repo, file):
    assert one(spark, raw, t.repo_path) == repo and one(spark, raw, t.file_path) == file


@pytest.mark.parametrize("raw, number", [("12", 12), (" 7.9", 7), ("-3.5", -3), ("", 0), ("0x10", 16), ("1e2", 100), ("abc", None), (None, None), ("NaN", None), ("12px", None)])
def test_line_number(spark, raw, number):
    assert one(spark, raw, t.line_number) == number


def test_trim_takes_all_white_space(spark):
    assert one(spark, " \n x　﻿", t.trim) == "x" and one(spark, "  ", t.present) is None


def test_key_parts(spark):
    assert one(spark, " A  b|C\n", t.key_part) == "a b/c"
    assert one(spark, "SQL-Injection!", t.type_token) == "sql_injection"
    assert one(spark, " /API\\v1/ x ", t.entry_point_token) == "api/v1/ x"
    assert one(spark, "Missing the Rate-limit on login", t.summary_tokens) == ["limit", "login", "rate"]


def test_hash32(spark):
    def plain(s):
        h = 5381
        for c in s:
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(c)
        out = ""
        while h:
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out
            h //= 36
        return out or "0"

    for s in ("", "a", "src/a.ts|1|2|text", "é"):
        assert one(spark, s, t.hash32) == plain(s)


@pytest.mark.parametrize("raw, ms", [("250ms", 250), ("1h2m3.5s", 3_723_500), ("6s", 6000), ("x", None), ("", None)])
def test_duration(spark, raw, ms):
    assert one(spark, raw, t.duration_ms) == ms


@pytest.mark.parametrize("pattern, path, yes", [("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/b/a.ts", False), ("src/**/a.ts", "src/b/c/a.ts", True), ("a+b.ts", "a+b.ts", True), ("a.ts", "abts", False)])
def test_glob(spark, pattern, path, yes):
    row = spark.createDataFrame([(pattern, path)], "p string, f string").select(F.regexp_like("f", t.glob_pattern(F.col("p"))).alias("r")).first()
    assert row["r"] is yes


@pytest.mark.parametrize("raw, level", [("P0", "critical"), ("sev1", "high"), (" Moderate", "medium"), ("minor", "low"), ("note", "info"), ("?", "medium"), (None, "medium")])
def test_severity(spark, raw, level):
    assert one(spark, raw, severity.normal) == level


def test_severity_scales(spark):
    rows = spark.createDataFrame([("critical",), ("info",), ("x",), (None,)], "s string").select(severity.rank(F.col("s")).alias("a"), severity.rank(F.col("s"), 1, 0).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(4, 5), (0, 1), (-1, 0), (-1, 0)]
    assert one(spark, "CVSS 7.5", severity.of_score) == "high" and one(spark, "CVSS:3.1/AV:N", severity.of_score) is None


@pytest.mark.parametrize("roles, base, level", [(["public"], "medium", "high"), (["public"], "low", "critical"), (["anon"], "low", "medium"), (["anon"], "high", "high"), (["authenticated"], "medium", "medium"), (["authenticated"], "low", "medium"), ([], "low", "low")])
def test_client_roles(spark, roles, base, level):
    assert one(spark, roles, lambda c: severity.for_roles(c, base), "array<string>") == level


@pytest.mark.parametrize("raw, name", [("A03:Injection", "injection"), ("broken-access control", "access_control"), ("supabase", "supabase"), ("injection and secrets", ""), ("weak jwt check", "authentication"), ("", ""), ("something", "")])
def test_category(spark, raw, name):
    assert one(spark, raw, identity.category_value) == name


FINDING = "ord long, type string, source string, severity string, category string, summary string, location string, details string"


def flat(spark, rows, **how):
    return identity.flatten(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], FINDING), **how).orderBy("ord").collect()


def test_identity_keys(spark):
    rows = flat(spark, [
        (None, "llm", "high", None, "x", '{"repoPath":"pkg","filepath":"pkg/src/A.ts","startLine":"10","endLine":3}', '{"ruleId":"missing_rate_limiting","entryPoint":"POST /Login"}'),
        ("static", "eslint", "low", None, "Some | text", '{"file":"./a.ts","chunk_index":2}', "{}"),
        ("idor", None, "low", None, "x", None, '{"path":"a.ts","anchorNodeId":" n1 ","packageName":"p","packageVersion":"1"}'),
        (None, None, None, None, None, None, None),
        (None, None, None, None, None, "broken", "[1]"),
        ("repository", None, "low", None, "S", '{"path":"b.ts"}', '{"overlapGroupId":"g","rule_id":"R1","ruleID":"R2","candidateType":"C t"}'),
    ])
    assert rows[0].identity_v1 == "pkg|src/a.ts|lines:10-10|post /login|rate_limiting|raw:missing_rate_limiting"
    assert rows[0].identity_v2 == "v2|pkg/src/A.ts|missing_rate_limiting|lines:10-10"
    assert rows[1].identity_v1 == "|a.ts|chunk:2|static" and rows[1].identity_v2 == ""
    assert rows[2].identity_v1 == "|a.ts|anchor:n1|idor|pkg:p@1" and rows[2].identity_v2 == "v2|a.ts|idor|anchor:n1"
    assert [r.identity_v1 for r in rows[3:5]] == ["", ""] and [r.identity_v2 for r in rows[3:5]] == ["", ""]
    assert rows[5].identity_v1 == "|b.ts|overlap:g|repository|candidate:c_t" and rows[5].identity_v2 == ""


def test_keep_rule(spark):
    def kept(path, line, rule, summary="x", **more):
        row = (None, "llm", "high", None, summary, f'{{"filepath":"{path}","startLine":{line}}}', f'{{"ruleId":"{rule}"' + "".join(f',"{k}":"{v}"' for k, v in more.items()) + "}")
        return identity.flatten(spark.createDataFrame([(0, *row)], FINDING)).select(identity.keep_finding().alias("k")).first()["k"]

    assert not kept("a/readme.md", 5, "missing_timeout") and kept("a/x.json", 5, "plain", "leaked secret")
    assert not kept("src/a.ts", 1, "missing_rate_limiting") and kept("src/a.ts", 2, "missing_rate_limiting")
    assert kept("src/delete.ts", 1, "missing_audit_logging") and not kept("components/delete.tsx", 1, "missing_audit_logging")
    assert not kept("components/form.tsx", 9, "missing_lockout") and kept("app/api/form.tsx", 9, "missing_lockout") and kept("app/users/page.tsx", 9, "missing_lockout")
    assert kept("components/form.tsx", 9, "missing_lockout", entryPoint="use server") and kept("components/x.tsx", 9, "idor")


SIGNALS = [
    ('<input type="password"> signIn()', {"login_attempt_present"}),
    ("export async function POST(req) {}", {"api_handler"}),
    ("const t = x ?? '';\nfetch(u, {h: `Bearer ${ t }`})", {"bearer_token_optional"}),
    ("fetch(u, {h: `Bearer ${x ?? ''}`})", {"bearer_token_optional"}),
    ("const t = x; `Bearer ${t}`", set()),
    ("const a = req2.headers.get('Authorization'); a.replace('Bearer ', '')", {"auth_header_present"}),
    ("const p = jwt.decode(token)", {"jwt_decode_present"}),
    ("res2.setHeader('Access-Control-Allow-Origin', '*')", {"cors_permissive_or_unknown"}),
    ("res.json({ h: req.headers })", {"logs_sensitive"}),
    ("res.json({ debug: true, e: process.env })", {"logs_sensitive", "debug_endpoint"}),
    ("app.get('/debug/x', h)", {"api_handler", "debug_endpoint"}),
    ("const c = createClient(url, SUPABASE_ANON_KEY)", {"public_api_key_usage"}),
    ("authorization: `Bearer ${anonKey}`", {"public_api_key_bearer", "public_api_key_usage"}),
    ("const k = env.MY_ANON_KEY;\nfetch(u, { Authorization: `Bearer ${k}` })", {"public_api_key_bearer", "public_api_key_usage"}),
    ("createBucket('x', { public: true })", {"public_storage_bucket"}),
    ("async function runQuery(sql: string) {}", {"raw_sql_sink"}),
    ('const API_KEY = "abcdefghijkl"', {"secrets_access"}),
    ("sk_live_abcdefgh1", {"secrets_access"}),
    ("NEXT_PUBLIC_STRIPE_SECRET", {"secrets_access"}),
    ("const id = req.params.userId", {"id_in_path_or_query", "client_supplied_user_id", "client_supplied_identifier"}),
    ("const { orgId: o = 1, page } = req.query", {"id_in_path_or_query", "client_supplied_org_id", "client_supplied_identifier"}),
    ("searchParams.get('page')", set()),
    ("'use client'; createClient(a); db.from('t').insert(x)", {"client_db_write"}),
    ("const f = searchParams.get('f');\nq.or(f)", {"orm_query_sink", "untrusted_input_present"}),
    ("const b = await req2.json();\nconst f = `id.eq.${b.id}`;\nq.or(f)", {"orm_query_sink", "untrusted_input_present"}),
    ("q.where({ id: req9.query })", set()),
    ("q.or(`name.eq.${constant}`)", set()),
    ("q.whereRaw('a = ?', [req.query.a])", set()),
    ("Sequelize.literal(req.query.order)", {"orm_query_sink", "untrusted_input_present"}),
    ("", set()),
    (None, set()),
]


def test_signals(spark):
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(SIGNALS)], "chunk_uid long, content string")
    got = {k: set() for k in range(len(SIGNALS))}
    for r in detectors.collect_signals(rows).collect():
        got[r.chunk_uid].add(r.signal_id)
        assert 0 < r.confidence < 1 and r.evidence
    assert {c: got[k] for k, (c, _) in enumerate(SIGNALS)} == {c: s for c, s in SIGNALS}


@pytest.mark.parametrize("args, first", [("a, b", "a"), ("f(a, b), c", "f(a, b)"), ("`x,${y}`, z", "`x,${y}`"), ("'a\\',b', c", "'a\\',b'"), ("[1, 2]", "[1, 2]"), ("{a: 1, b: (2)}, c", "{a: 1, b: (2)}"), (")", ")")])
def test_first_argument(spark, args, first):
    assert one(spark, args, detectors.first_argument) == first


FOLLOWED = [
    ("  q.or(req.query.a, 1) // x", "q.or(req.query.a, 1) // x", "q.or(req.query.a, 1) // x"),
    ("let f$ = req.body.x;\nq\n  .whereRaw(f$, [1])", ".whereRaw(f$, [1])", ".whereRaw(f$, [1])"),  # no word ends after a $
    ("const v = searchParams.get('v')\nq.orderByRaw('a ' + v + ' desc')", "q.orderByRaw('a ' + v + ' desc')", "const v = searchParams.get('v')"),
    ("const v = req.query.v\nq.where({a: v})\nq.andWhere(`a = ${v}`)", "q.andWhere(`a = ${v}`)", "const v = req.query.v"),
    ("q.or(`a.${x}`)\nconst y = req.query.y\nq.or(`b.${ y }`)", "q.or(`b.${ y }`)", "const y = req.query.y"),
    ("const x = 1\nq.or(x)", None, None),
    ("const b = await r.json()\nconst z = b['k']\nsequelize.literal(z)", "sequelize.literal(z)", "const z = b['k']"),
    ("q.or('" + "a" * 300 + "')", None, None),
    ("y" * 200 + " q.or(req.query.a)", "y" * 179 + "…", "y" * 179 + "…"),
]


def test_queries_followed_to_their_input(spark):
    rows = spark.createDataFrame([(k, c) for k, (c, *_) in enumerate(FOLLOWED)], "k int, c string").select("k", detectors.unsafe_query(F.col("c")).alias("u")).orderBy("k").collect()
    assert [(r.u.query, r.u.input) if r.u else (None, None) for r in rows] == [tuple(x[1:]) for x in FOLLOWED]
    long = spark.createDataFrame([("x.where " * 40_000 + "q.or(req.query.a)",)], "c string").select(detectors.unsafe_query(F.col("c"))["query"].alias("q")).first()
    assert len(long.q) == 180

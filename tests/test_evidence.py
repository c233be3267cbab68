"""The comparator by object names and evidence phrases against one written as a walk."""

import json
import random
import re
from itertools import count

from riskloom.operators import evals, evidence

NAMES = ["test_no_rls", "test_rls_no_policy"]
EXPECTED = "group_id string, ord long, id string, filepath string, expectation string, identity_key string, rule_id string, start_line int, end_line int"
ACTUAL = "group_id string, id string, filepath string, identity_key string, rules array<string>, package_name string, package_version string, summary string, source string, type string, details string"


def plain(s):
    return re.sub(r"[^a-z0-9_]+", " ", (s or "").strip().lower()).strip()


def ref(s):
    s = re.sub("^(table|policy):", "", (s or "").replace('"', "").strip().lower()).split("/")[0]
    parts = [p for p in s.split(".") if p][:2]
    return ".".join(parts) or None


def table_of(details, summary):
    d = json.loads(details or "{}")
    for direct in (d.get("table_ref"), d.get("object_key"), f"{d['object_schema']}.{d['object_name']}" if "object_schema" in d and "object_name" in d else None):
        if direct and ref(direct):
            return ref(direct)
    if m := re.search(r'"([^"]+)"\."([^"]+)"', summary or ""):
        return ref(f"{m[1]}.{m[2]}")
    if m := re.search(r"(?i)\b([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)\b", summary or ""):
        return ref(f"{m[1]}.{m[2]}")
    return next((f"public.{n}" for n in NAMES if n in plain(summary)), None)


def matches(expectation, wanted, row):
    _, _, _, _, _, _, _, summary, _, _, details = row
    table, theirs, text = table_of("{}", expectation), table_of(details, summary), plain(summary)
    if not table or not theirs or table.split(".")[-1] not in NAMES or table.split(".")[-1] != theirs.split(".")[-1]:
        return False
    rule = (json.loads(details or "{}").get("ruleId") or "").strip().lower().removeprefix("supabase_")
    on = "rls" in text and "enabled" in text or "row level security enabled" in text or "relrowsecurity true" in text
    off = "rls" in text and "disabled" in text or "row level security disabled" in text or "relrowsecurity false" in text
    m = re.search(r"\bpolic(?:y|ies)\s*(?:count\s*)?(\d+)\b", text) or re.search(r"\b(\d+)\s+polic(?:y|ies)\b", text)
    n = int(m[1]) if m else None
    none = any(p in text for p in ("no policies", "no policy", "zero policies", "0 policies", "pg policies count 0", "pg policies 0")) or n == 0
    some = any(p in text for p in ("has policies", "policies exist", "policy exists", "has policy")) or (n or 0) > 0
    if wanted == "rls_disabled":
        return not on and rule in ("", wanted) and (rule == wanted or off)
    return not off and not some and rule in ("", wanted) and (rule == wanted or none and on)


def rows(rng, n):
    ids, out = count(), []
    for _ in range(n):
        table = rng.choice(["public.test_no_rls", '"public"."test_rls_no_policy"', "test_no_rls", "public.other", "Test_RLS_no_policy"])
        said = rng.choice(["RLS disabled", "RLS is enabled, no policies", "row level security disabled", "RLS enabled; policies: 0", "rls enabled with 2 policies", "relrowsecurity=false", "fine", "has policy, RLS enabled"])
        details = {}
        if rng.random() < 0.5:
            details["ruleId"] = rng.choice(["rls_disabled", "supabase_rls_no_policies", "idor"])
        if rng.random() < 0.4:
            details |= rng.choice([{"table_ref": f"table:{table}"}, {"object_key": f"policy:{table}/p"}, {"object_schema": "public", "object_name": "test_no_rls"}])
        out.append((rng.choice("gh"), f"a{next(ids):03}", rng.choice(["datastores/x/schema.json", "src/a.ts"]), "", [], None, None, f"{table}: {said}", rng.choice(["llm", "datastore_rls"]), None, json.dumps(details)))
    return out


def test_choices_equal_a_comparator(spark):
    expected = [(g, k, "", "datastores/*/schema.json", f"{t}: x", "", r, None, None) for g in "gh" for k, (t, r) in enumerate([("public.test_no_rls", "rls_disabled"), ('"public"."test_rls_no_policy"', "supabase_rls_no_policies"), ("test_no_rls", "rls_no_policies"), ("public.other", "rls_disabled"), ("nothing", "rls_disabled")])]
    actual = rows(random.Random(1), 300)
    e, a = spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(actual, ACTUAL)
    members, choices = evidence.by_evidence(NAMES)(e, a)
    got = choices.join(members, ["group_id", "cls"])
    want = {(g, k, r[1]) for g, k, _, _, text, _, rule, _, _ in expected for r in actual if r[0] == g and r[2].startswith("datastores/") and matches(text, rule.removeprefix("supabase_"), r)}
    assert {(r.group_id, r.e_ord, r.a_id) for r in got.collect()} == want and len(want) > 30


def test_in_an_evaluation(spark):
    e = spark.createDataFrame([("g", 1, "", "datastores/*/schema.json", "public.test_no_rls: RLS disabled.", "", "rls_disabled", None, None), ("g", 2, "", "datastores/*/schema.json", "public.test_rls_no_policy: RLS enabled but no policies.", "", "rls_no_policies", None, None)], EXPECTED)
    found = [("public.test_no_rls: RLS disabled", "{}"), ("public.test_rls_no_policy has RLS enabled, no policies", "{}"), ("public.users: RLS disabled", "{}"), ("slow query", "{}")]
    a = spark.createDataFrame([("g", str(k), "datastores/d/schema.json", "", [], None, None, s, "llm", None, d) for k, (s, d) in enumerate(found)], ACTUAL)
    groups = spark.createDataFrame([("g", False)], "group_id string, allow_unexpected boolean")
    r = evals.evaluate(e, a, groups, evidence.by_evidence(NAMES), lambda df: evidence.keep_rls(df, NAMES)).first()
    assert (r.n_expected, r.n_actual, r.n_matched, r["pass"]) == (2, 2, 2, True)
    assert not evals.evaluate(e, a, groups, evidence.by_evidence(NAMES)).first()["pass"]  # without the filter two are unexpected

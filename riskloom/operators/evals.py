"""Expected against actual findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as t
from riskloom.operators.ranking import numbered
from riskloom.shared import connected_components, materialise

#: (expected, actual) -> members(group_id, cls, e_ord) and choices(group_id, cls, a_id, a_key[, score]).
Comparator = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
#: Other names of rules in expectations.
RULE_ALIASES = {
    "rate_limiting": "missing_rate_limiting missing_rate_limit frontend_login_rate_limit throttling login_throttling request_throttling", "audit_logging": "missing_audit_logging missing_audit_log",
    "lockout": "missing_lockout login_lockout_missing brute_force_defense brute_force_defenses bruteforce_defense credential_stuffing", "timeout": "missing_timeout missing_timeouts", "prototype_pollution": "object_injection",
    "webhook_signature": "missing_webhook_signature", "webhook_config_integrity": "missing_webhook_config_integrity config_integrity config_url_integrity webhook_config",
}


def rule_alias(c: Column) -> Column:
    names = t.map_of({a: k for k, v in RULE_ALIASES.items() for a in v.split()})
    low = F.lower(t.trim(c))
    return F.coalesce(F.element_at(names, low), low)


def path_matches(pattern: Column, path: Column) -> Column:
    return (pattern == path) | (F.contains(pattern, F.lit("*")) & F.regexp_like(path, t.glob_pattern(pattern)))


def stable_ids(expected: DataFrame) -> DataFrame:
    """expected(ord, id, filepath, expectation, start_line, end_line) with an id made from its place and words where it has none."""
    place = F.concat_ws("|", "filepath", F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.coalesce(F.col("end_line").cast("string"), F.lit("")), t.comparable_text(F.col("expectation")))
    made = F.concat_ws(":", F.lit("auto"), "filepath", t.hash32(place), F.col("ord").cast("string"))
    return expected.withColumn("id", F.coalesce(t.present(F.col("id")), made))


def _on_path(e: DataFrame, a: DataFrame, keys: list[str]) -> DataFrame:
    """e and a of the same keys whose pattern matches the path: a plain pattern is a join key itself, one with a '*' is compared."""
    starred = F.contains("pattern", F.lit("*"))
    plain = e.where(~starred).join(a.withColumn("pattern", F.col("path")), [*keys, "pattern"])
    return plain.unionByName(e.where(starred).join(a, keys).where(path_matches(F.col("pattern"), F.col("path"))).select(plain.columns))


def _expectations(expected: DataFrame) -> DataFrame:
    """expected with what decides its candidates, and `cls`, which names that: expectations of one class have the same candidates."""
    e = expected.select("group_id", F.col("ord").alias("e_ord"), F.col("filepath").alias("pattern"), F.coalesce("identity_key", F.lit("")).alias("key"), rule_alias(F.col("rule_id")).alias("rule"), F.array_sort(t.alias_tokens(F.concat_ws(" ", "expectation", "rule_id"))).alias("aliases"), F.lower(t.package_spec(F.col("expectation"))).alias("spec"))
    return e.withColumn("cls", F.sha2(F.to_json(F.struct("pattern", "key", "rule", "aliases", "spec")), 256))


def expectation_classes(expected: DataFrame) -> DataFrame:
    """(group_id, cls, e_ord)."""
    return _expectations(expected).select("group_id", "cls", "e_ord")


def class_choices(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(group_id, cls, a_id, a_key): for each class of expectations the actual findings that may
    match: those of its V2 key where it has one, else of the path pattern and an advisory of
    the same package or the same rule. Every branch joins by equality on the group, a key or
    rule, and the path where it is no pattern."""
    e = _expectations(expected).drop("e_ord").dropDuplicates(["group_id", "cls"])
    a = actual.select("group_id", F.col("id").alias("a_id"), F.col("filepath").alias("path"), F.coalesce("identity_key", F.lit("")).alias("key"), F.explode_outer("rules").alias("r"), F.lower(F.concat_ws("@", "package_name", "package_version")).alias("spec")).withColumn("rule", rule_alias(F.col("r")))
    found = lambda rows: rows.select("group_id", "cls", "a_id", F.col("key").alias("a_key"))
    by_key = found(_on_path(e.where("key <> ''").drop("rule", "aliases", "spec"), a.drop("rule", "spec"), ["group_id", "key"]))
    loose = e.where("key = ''").drop("key")
    by_rule = found(_on_path(loose.drop("spec"), a.where("rule <> ''").drop("spec"), ["group_id", "rule"]))
    by_spec = found(_on_path(loose.drop("rule"), a.where("spec <> ''").drop("rule"), ["group_id", "spec"]).where(F.arrays_overlap("aliases", t.alias_tokens(F.col("r")))))
    return by_key.union(by_rule).union(by_spec).distinct()


def candidate_pairs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(group_id, e_ord, a_id, a_key): class_choices() for each expectation; as many rows as there are pairs."""
    return class_choices(expected, actual).join(expectation_classes(expected), ["group_id", "cls"]).select("group_id", "e_ord", "a_id", "a_key")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """match_classes() for pairs(group_id, e_ord, a_id, a_key): each expectation is a class of its own."""
    named = pairs.withColumn("cls", F.col("e_ord").cast("string"))
    return match_classes(named.select("group_id", "cls", "e_ord").distinct(), named)


def match_classes(members: DataFrame, choices: DataFrame) -> DataFrame:
    """(group_id, e_ord, a_id): in order, each expectation of members(group_id, cls, e_ord)
    takes the first of its class's choices(group_id, cls, a_id, a_key[, score]) that is still
    free, by descending score, then a_key and a_id.

    Rounds of joins instead of a walk. In a round the k-th open expectation of a class
    proposes to the k-th open choice of the class. Up to the first expectation of a block that
    proposes to what an earlier one proposes to as well, proposals are what the walk gives:
    the choices before have been taken by the class's own earlier members. Behind it, the
    members of a class up to the first that proposes to what another class, which begins before
    it, could take are settled as well. These are fixed, the rest goes on without what they
    took. So a group of like expectations takes one round, whatever its size, and rows are
    numbered over as many tasks as they fill. A block is a group at first, then what is
    connected by shared choices."""
    worth = -F.col("score") if "score" in choices.columns else F.lit(0.0)
    ranked = choices.groupBy("group_id", "cls", "a_id").agg(F.min(F.struct(worth.alias("worth"), "a_key")).alias("w")).select("group_id", F.col("group_id").alias("block"), "cls", "a_id", "w.worth", "w.a_key")
    choices = materialise(ranked, "choices")
    members = materialise(members.join(choices.select("group_id", "cls").distinct(), ["group_id", "cls"], "left_semi").withColumn("block", F.col("group_id")), "expectations")
    matched, first_round = None, True
    while True:
        e = numbered(members, ["block", "cls"], ["e_ord"], "k")
        a = numbered(choices, ["block", "cls"], ["worth", "a_key", "a_id"], "k").select("block", "cls", "k", "a_id")
        proposed = materialise(e.join(a, ["block", "cls", "k"], "left").select("group_id", "block", "cls", "e_ord", "a_id"), "proposals")
        asked = proposed.where("a_id IS NOT NULL")
        first = asked.groupBy("block", "a_id").agg(F.min("e_ord").alias("first"))
        rivals = materialise(asked.join(first, ["block", "a_id"]).where("e_ord > first").groupBy("block").agg(F.min("e_ord").alias("stop")), "rivals")
        if rivals.isEmpty():
            now = asked.select("group_id", "e_ord", "a_id")
            return now if matched is None else matched.union(now)
        begins = members.join(rivals.select("block"), "block", "left_semi").groupBy("block", "cls").agg(F.min("e_ord").alias("begin"))
        wanted = choices.join(begins, ["block", "cls"]).select("block", "a_id", "cls", "begin")
        one = wanted.groupBy("block", "a_id").agg(F.min(F.struct("begin", "cls")).alias("one"))
        other = wanted.join(one, ["block", "a_id"]).where("cls <> one.cls").groupBy("block", "a_id").agg(F.min("begin").alias("other"))
        seen = asked.join(one, ["block", "a_id"]).join(other, ["block", "a_id"], "left")
        risky = seen.where(F.col("e_ord") >= F.when(F.col("one.cls") == F.col("cls"), F.col("other")).otherwise(F.col("one.begin")))
        halts = risky.groupBy("block", "cls").agg(F.min("e_ord").alias("halt"))
        sure = F.col("stop").isNull() | (F.col("e_ord") < F.col("stop")) | F.col("halt").isNull() | (F.col("e_ord") < F.col("halt"))
        decided = materialise(proposed.join(rivals, "block", "left").join(halts, ["block", "cls"], "left").withColumn("fixed", sure), "proposals")
        now = decided.where("fixed AND a_id IS NOT NULL").select("group_id", "e_ord", "a_id")
        matched = now if matched is None else matched.union(now)
        members = decided.where("NOT fixed").select("group_id", "block", "cls", "e_ord")
        if members.isEmpty():
            return matched
        choices = choices.join(now, ["group_id", "a_id"], "left_anti").join(members.select("block", "cls").distinct(), ["block", "cls"], "left_semi")
        members, choices = materialise(members, "expectations"), materialise(choices, "choices")
        if first_round:
            name = F.concat_ws("\x1f", "group_id", "cls")
            by_actual = choices.groupBy("group_id", "a_id").agg(F.min(name).alias("b"))
            links = choices.join(by_actual, ["group_id", "a_id"]).select(name.alias("a"), "b")
            block = materialise(connected_components(links, "rivals"), "rivals").withColumnRenamed("component", "c")
            into = lambda rows: materialise(rows.withColumn("node", name).join(block, "node", "left").withColumn("block", F.coalesce("c", "node")).drop("node", "c"), "blocks")
            members, choices, first_round = into(members), into(choices), False


def evaluate(expected: DataFrame, actual: DataFrame, groups: DataFrame, choose: Comparator | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group_id, n_expected, n_actual, n_matched, n_missing, n_unexpected, pass) for groups(group_id, allow_unexpected).
    `choose` is the comparator: it names the class of each expectation and gives the choices of each class; `keep` filters what counts as found."""
    actual = keep(actual) if keep else actual
    members, choices = choose(expected, actual) if choose else (expectation_classes(expected), class_choices(expected, actual))
    matched = match_classes(members, choices).groupBy("group_id").agg(F.count("*").alias("n_matched"))
    n = lambda df, name: df.groupBy("group_id").agg(F.count("*").alias(name))
    out = groups.join(n(expected, "n_expected"), "group_id", "left").join(n(actual, "n_actual"), "group_id", "left").join(matched, "group_id", "left").fillna(0)
    out = out.withColumns({"n_missing": F.col("n_expected") - F.col("n_matched"), "n_unexpected": F.col("n_actual") - F.col("n_matched")})
    return out.withColumn("pass", (F.col("n_missing") == 0) & (F.col("allow_unexpected") | (F.col("n_unexpected") == 0))).drop("allow_unexpected")


def chosen(specs: DataFrame, spec: str | None = None, group: str | None = None) -> DataFrame:
    """specs(spec_id, repo_name, group_id, ...) that a run asks for: by id or repository name, and by group; blank and `all` ask for every one."""
    wanted, part = (spec or "").strip(), (group or "").strip()
    by_spec = F.lit(True) if wanted in ("", "all") else (F.col("spec_id") == wanted) | (F.col("repo_name") == wanted)
    return specs.where(by_spec & (F.lit(True) if part in ("", "all") else F.col("group_id") == part))


def finding_ids(flat: DataFrame) -> DataFrame:
    """Flattened findings with an id for evaluations: the key that their details carry, else the
    one built from them, else one made of summary, place and order."""
    details = F.from_json("details", "map<string,string>")
    made = F.concat_ws(":", F.lit("auto"), t.hash32(F.concat_ws("|", F.coalesce("summary", F.lit("")), F.coalesce("location", F.lit("{}")))), F.col("ord").cast("string"))
    return flat.withColumn("id", F.coalesce(F.nullif(F.coalesce(details["identityKey"], details["identity_key"]), F.lit("")), F.nullif("identity_v1", F.lit("")), made))


def spec_status(groups: DataFrame, spec: str) -> DataFrame:
    """(spec, status, counts): fail if a group fails, skipped without groups that expect anything."""
    status = F.when(F.sum("n_expected") == 0, "skipped").when(F.bool_and("pass"), "pass").otherwise("fail")
    return groups.groupBy(spec).agg(status.alias("status"), *[F.sum(c).alias(c) for c in ("n_expected", "n_matched", "n_missing", "n_unexpected")])


def markdown(specs: DataFrame, spec: str) -> str:
    """One table row for each spec; a run has a few dozen."""
    rows = specs.orderBy(spec).collect()
    head = [f"| {spec} | status | expected | matched | missing | unexpected |", "|-|-|-|-|-|-|"]
    return "\n".join([*head, *[f"| {r[spec]} | {r['status']} | {r['n_expected']} | {r['n_matched']} | {r['n_missing']} | {r['n_unexpected']} |" for r in rows]])

"""A comparator for findings on database objects: object names and evidence phrases decide.

Rules over phrases are data; both sides become columns and meet by equality on the group
and the object's name, so nothing is compared that cannot match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.evals import Comparator, path_matches

#: What a summary says, by phrases of which one is enough, and by words that must all occur.
PHRASES = {
    "rls_disabled": ["rls disabled", "row level security disabled", "relrowsecurity false"],
    "rls_enabled": ["rls enabled", "row level security enabled", "relrowsecurity true"],
    "no_policies": ["no policies", "no policy", "zero policies", "0 policies", "pg policies count 0", "pg policies 0"],
    "has_policies": ["has policies", "policies exist", "policy exists", "has policy"],
}
TOGETHER = {"rls_disabled": ["rls", "disabled"], "rls_enabled": ["rls", "enabled"]}
#: Rule -> what contradicts it, and what together supports it where a finding names no rule.
STATES = {"rls_disabled": (["rls_enabled"], ["rls_disabled"]), "rls_no_policies": (["rls_disabled", "has_policies"], ["no_policies", "rls_enabled"])}
PREFIX = "supabase_"


def plain_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9_]+", " "))


def object_ref(c: Column) -> Column:
    """`schema.name` or `name` of an object key: quotes, kind and what follows a slash go; null without a name."""
    clean = F.lower(F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    clean = F.substring_index(F.regexp_replace(clean, "^(table|policy):", ""), "/", 1)
    parts = F.slice(F.filter(F.split(clean, r"\."), lambda x: x != ""), 1, 2)
    return F.when(F.size(parts) > 0, F.array_join(parts, "."))


def ref_in_text(c: Column, names: list[str]) -> Column:
    """The object that a text names: quoted, plain with its schema, or one of the known names."""
    text = F.coalesce(c, F.lit(""))
    quoted, dotted = r'"([^"]+)"\."([^"]+)"', r"(?i)\b([a-z_][a-z0-9_]*)\.([a-z_][a-z0-9_]*)\b"
    both = lambda p: F.concat_ws(".", F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2))
    known = F.lit(None).cast("string")
    for n in reversed(names):
        known = F.when(F.contains(plain_words(c), F.lit(n)), f"public.{n}").otherwise(known)
    return F.when(text.rlike(quoted), object_ref(both(quoted))).when(text.rlike(dotted), object_ref(both(dotted))).otherwise(known)


def signals(c: Column) -> Column:
    """The array of PHRASES' names that a summary supports."""
    words = plain_words(c)
    count = F.coalesce(F.nullif(F.regexp_extract(words, r"\bpolic(?:y|ies)\s*(?:count\s*)?(\d+)\b", 1), F.lit("")), F.nullif(F.regexp_extract(words, r"\b(\d+)\s+polic(?:y|ies)\b", 1), F.lit(""))).try_cast("long")
    counted = {"no_policies": count == 0, "has_policies": count > 0}
    said = []
    for name, phrases in PHRASES.items():
        hit = reduce(lambda a, b: a | b, [F.contains(words, F.lit(p)) for p in phrases])
        if name in TOGETHER:
            hit = hit | reduce(lambda a, b: a & b, [F.contains(words, F.lit(w)) for w in TOGETHER[name]])
        said.append(F.when(hit | F.coalesce(counted.get(name, F.lit(False)), F.lit(False)), name))
    return F.array_compact(F.array(*said))


def rule_of(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), f"^{PREFIX}", "")


def about_objects(actual: DataFrame, names: list[str]) -> DataFrame:
    """actual(..., id, summary, source, type, details) with `object`, `rule` and `said`: the object's
    name from the details, else from the summary. `names` are the objects of a specification."""
    d = lambda *keys: F.coalesce(*[F.get_json_object("details", f"$.{k}") for k in keys])
    parts = F.when(d("object_schema", "objectSchema").isNotNull() & d("object_name", "objectName").isNotNull(), F.concat_ws(".", d("object_schema", "objectSchema"), d("object_name", "objectName")))
    ref = F.coalesce(object_ref(d("table_ref", "tableRef")), object_ref(d("object_key", "objectKey")), object_ref(parts), ref_in_text(F.col("summary"), names))
    return actual.withColumns({"object": F.element_at(F.split(ref, r"\."), -1), "rule": rule_of(d("ruleId", "rule_id", "ruleID")), "said": signals(F.col("summary"))})


def keep_rls(actual: DataFrame, names: list[str]) -> DataFrame:
    """The findings on the named objects that are of row-level security by rule, tool, source, type or summary: a group's filter."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    by_kind = F.startswith("rule", F.lit("rls_")) | (low(F.get_json_object("details", "$.tool")) == "datastore_rls") | F.contains(low(F.col("source")), F.lit("datastore_rls")) | (low(F.col("type")) == "datastore_schema")
    by_text = F.contains(plain_words(F.col("summary")), F.lit("rls")) | F.contains(plain_words(F.col("summary")), F.lit("row level security"))
    return about_objects(actual, names).where(F.col("object").isin(names) & (by_kind | by_text)).select(actual.columns)


def by_evidence(names: list[str]) -> Comparator:
    """A comparator for evals.evaluate() on the named objects: expectations of one path pattern, rule and object are a class."""

    def choose(expected: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
        e = expected.select("group_id", F.col("ord").alias("e_ord"), F.col("filepath").alias("pattern"), rule_of(F.col("rule_id")).alias("wanted"), F.element_at(F.split(ref_in_text(F.col("expectation"), names), r"\."), -1).alias("object"))
        e = e.withColumn("cls", F.sha2(F.to_json(F.struct("pattern", "wanted", "object")), 256))
        a = about_objects(actual, names).select("group_id", F.col("id").alias("a_id"), F.col("filepath").alias("path"), F.coalesce("identity_key", F.lit("")).alias("a_key"), "object", "rule", "said")
        met = e.drop("e_ord").distinct().where(F.col("object").isin(names)).join(a, ["group_id", "object"]).where(path_matches(F.col("pattern"), F.col("path")) & _verdict())
        return e.select("group_id", "cls", "e_ord"), met.select("group_id", "cls", "a_id", "a_key", F.lit(1.0).alias("score"))

    return choose


def _verdict() -> Column:
    """Whether a finding meets the rule that is wanted of its object."""
    words = lambda xs: F.array(*map(F.lit, xs))
    out = F.lit(False)
    for rule, (against, support) in STATES.items():
        free = ~F.arrays_overlap("said", words(against)) & F.col("rule").isin("", rule)
        out = F.when(F.col("wanted") == rule, free & ((F.col("rule") == rule) | (F.size(F.array_except(words(support), F.col("said"))) == 0))).otherwise(out)
    return out


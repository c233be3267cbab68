"""Findings over a database catalogue: privileges, row security, policies, routines and buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import severity

WRITES = ["INSERT", "UPDATE", "DELETE", "TRUNCATE"]
CLIENTS = ["public", "anon", "authenticated"]
#: Schemas of the system itself.
SYSTEM_SCHEMAS = ["pg_catalog", "information_schema", "pg_toast"]


def not_system(schema: Column) -> Column:
    return ~schema.isin(*SYSTEM_SCHEMAS) & ~schema.like("pg_temp%") & ~schema.like("pg_toast%")


def role_list(c: Column) -> Column:
    """Roles from {a,b}, "a, b" or the text of an array: lower case, without quotes."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"[{}\[\]\"]", ""), ","), lambda r: F.lower(F.trim(r))), lambda r: r != "")


def privilege_list(c: Column) -> Column:
    """Privileges of a grant; ALL stands for the five of a table."""
    names = F.filter(F.transform(F.split(c, ","), lambda p: F.upper(F.trim(p))), lambda p: p != "")
    whole = F.exists(names, lambda p: p.rlike("^ALL( PRIVILEGES)?$"))
    return F.when(whole, F.array(*map(F.lit, ["SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE"]))).otherwise(names)


def truthy(c: Column) -> Column:
    """Whether a value counts as set: anything but null, false, 0 and the empty text."""
    return F.coalesce(~F.lower(c.cast("string")).isin("false", "0", ""), F.lit(False))


def _finding(rows: DataFrame, rule: str, level: Column, target: Column, roles: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule_id"), target.alias("object"), F.array_join(F.array_sort(roles), ",").alias("roles"), level.alias("severity"), message.alias("message"))


def catalog_findings(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule_id, object, roles, severity, message) of seven rules over the row sets
    rls, table_privileges, column_privileges, column_acl, policies, routine_privileges
    and storage_buckets. Tables without privileges of a client role are not looked at."""
    table = lambda s, n: F.concat_ws(".", s, n)
    granted = tables["table_privileges"].where("coalesce(grantee, '') <> '' AND coalesce(privilege_type, '') <> ''").select(
        table("table_schema", "table_name").alias("t"), F.lower("grantee").alias("role"), F.upper("privilege_type").alias("p")
    )
    per_role = granted.groupBy("t", "role").agg(F.collect_set("p").alias("privs"))
    access = per_role.groupBy("t").agg(
        F.collect_set("role").alias("roles"), F.collect_set(F.when(F.arrays_overlap("privs", F.array(*map(F.lit, WRITES))), F.col("role"))).alias("writers")
    )
    rls = tables["rls"].groupBy(table("table_schema", "table_name").alias("t")).agg(F.bool_or(truthy(F.col("rls_enabled"))).alias("enabled"))
    acl = tables["column_acl"].groupBy(table("table_schema", "table_name").alias("t")).agg(F.bool_or(truthy(F.col("has_column_acl"))).alias("has_acl"))
    narrowed = tables["column_privileges"].where(F.upper("privilege_type").isin("INSERT", "UPDATE")).groupBy(table("table_schema", "table_name").alias("t")).agg(F.collect_set(F.lower("grantee")).alias("narrowed"))
    policies = tables["policies"].groupBy(table("schemaname", "tablename").alias("t")).agg(F.count("*").alias("n_policies"))
    facts = access.join(rls, "t", "left").join(acl, "t", "left").join(narrowed, "t", "left").join(policies, "t", "left")
    open_columns = ~F.coalesce("has_acl", F.lit(False)) & (F.size(F.array_except("writers", F.coalesce("narrowed", F.array().cast("array<string>")))) > 0)
    t, roles, writers = F.col("t"), F.col("roles"), F.col("writers")
    listed = lambda r: F.array_join(F.array_sort(r), ", ")
    found = [
        _finding(facts.where(~F.col("enabled")), "rls_disabled", severity.for_roles(roles, "high"), t, roles, F.format_string("RLS disabled on %s while client roles have access (%s).", t, listed(roles))),
        _finding(facts.where(F.size("writers") > 0), "client_write_access", severity.for_roles(writers, "medium"), t, writers, F.format_string("Table %s is writable by client roles (%s).", t, listed(writers))),
        _finding(facts.where((F.size("writers") > 0) & open_columns), "column_acl_missing", severity.for_roles(writers, "low"), t, writers, F.format_string("Table %s is writable by client roles without column-level ACLs.", t)),
        _finding(facts.where(F.col("enabled") & (F.coalesce("n_policies", F.lit(0)) == 0)), "rls_no_policies", F.lit("low"), t, roles, F.format_string("RLS enabled on %s but no policies are defined.", t)),
    ]
    routine = tables["routine_privileges"].where("coalesce(grantee, '') <> ''").select(F.concat_ws(".", "routine_schema", "routine_name", F.nullif("specific_name", F.lit(""))).alias("t"), F.lower("grantee").alias("role"))
    callers = routine.where(F.col("role").isin(*CLIENTS)).groupBy("t").agg(F.collect_set("role").alias("roles"))
    found.append(_finding(callers, "function_public_exec", severity.for_roles(roles, "medium"), t, roles, F.format_string("Function %s is executable by %s.", t, listed(roles))))
    buckets = tables["storage_buckets"].where(truthy(F.col("public"))).select(F.coalesce(F.nullif("name", F.lit("")), F.nullif("id", F.lit("")), F.lit("(unknown)")).alias("t"), F.array(F.lit("public")).alias("roles"))
    found.append(_finding(buckets, "public_bucket", F.lit("high"), t, roles, F.format_string("Storage bucket %s is public.", t)))
    stored = tables["policies"].where("schemaname = 'storage' AND tablename = 'objects'").withColumn("roles", role_list(F.col("roles"))).withColumn("t", table("schemaname", "tablename"))
    stored = stored.where(F.arrays_overlap("roles", F.array(F.lit("public"), F.lit("anon"))))
    found.append(_finding(stored, "storage_objects_public_policy", F.lit("high"), t, roles, F.format_string("storage.objects policy allows %s access.", listed(roles))))
    return reduce(DataFrame.unionByName, found)

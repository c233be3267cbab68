"""Database catalogues: snapshots, live servers over JDBC, and SQL dumps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The row sets of a snapshot and their columns.
ROW_SETS = {
    "tables": "table_schema, table_name, table_type", "columns": "table_schema, table_name, column_name, data_type, is_nullable, column_default", "indexes": "schemaname, tablename, indexname, indexdef",
    "constraints": "table_schema, table_name, constraint_name, constraint_type, constraint_def", "policies": "schemaname, tablename, policyname, permissive, roles, cmd, qual, with_check",
    "rls": "table_schema, table_name, rls_enabled, rls_forced", "tablePrivileges": "table_schema, table_name, grantee, privilege_type", "columnAcl": "table_schema, table_name, has_column_acl",
    "columnPrivileges": "table_schema, table_name, column_name, grantee, privilege_type", "routines": "routine_schema, routine_name, specific_name, routine_type, data_type, security_type",
    "routinePrivileges": "routine_schema, routine_name, specific_name, grantee", "storageBuckets": "id, name, public", "errors": "stage, message",
}


def snake(name: str) -> str:
    return re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name)


def snapshot(raw: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """The row sets of a snapshot's JSON text; a missing or odd one is empty. All columns are text."""
    out = {}
    for name, columns in ROW_SETS.items():
        rows = raw.select(F.explode(F.from_json(F.get_json_object(column, f"$.{name}"), "array<string>")).alias("r"))
        out[snake(name)] = rows.select(*[F.get_json_object("r", f"$.{c}").alias(c) for c in columns.split(", ")])
    return out


#: Catalogue queries for a live server, one for each row set that the rules read.
QUERIES = {
    "rls": "SELECT n.nspname AS table_schema, c.relname AS table_name, c.relrowsecurity AS rls_enabled, c.relforcerowsecurity AS rls_forced FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p')",
    "table_privileges": "SELECT table_schema, table_name, grantee, privilege_type FROM information_schema.table_privileges WHERE lower(grantee) IN ('public', 'anon', 'authenticated')",
    "column_privileges": "SELECT table_schema, table_name, column_name, grantee, privilege_type FROM information_schema.column_privileges WHERE lower(grantee) IN ('public', 'anon', 'authenticated')",
    "column_acl": "SELECT n.nspname AS table_schema, c.relname AS table_name, bool_or(a.attacl IS NOT NULL) AS has_column_acl FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind IN ('r', 'p') AND a.attnum > 0 GROUP BY 1, 2",
    "policies": "SELECT schemaname, tablename, policyname, permissive, array_to_string(roles, ',') AS roles, cmd, qual, with_check FROM pg_policies",
    "routine_privileges": "SELECT routine_schema, routine_name, specific_name, grantee FROM information_schema.routine_privileges",
    "storage_buckets": "SELECT id, name, public FROM storage.buckets",
}


def live(spark: SparkSession, url: str, seconds: int = 30, **options: str) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Row sets of a server, and (row set, message) of queries that failed."""
    out, errors = {}, []
    for name, query in QUERIES.items():
        try:
            out[name] = spark.read.format("jdbc").options(url=url, query=query, queryTimeout=str(seconds), **options).load()
        except Exception as e:
            errors.append((name, str(e).splitlines()[0]))
            columns = ROW_SETS[next(k for k in ROW_SETS if snake(k) == name)].split(", ")
            out[name] = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return out, errors


def split_values(text: str) -> list[str]:
    """Comma-separated SQL values; commas in quotes and parentheses do not separate."""
    return [m[0].strip() for m in re.finditer(r"(?:'(?:''|[^'])*'|\((?:'(?:''|[^'])*'|[^()'])*\)|[^,'(])+", text)]


def literal(text: str) -> str | bool | None:
    if text.upper() == "NULL":
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return text[1:-1].replace("''", "'") if text[:1] == "'" else text


def qualified(name: str) -> tuple[str, str]:
    parts = [p.strip('"') for p in re.findall(r'"(?:""|[^"])+"|[^."\s]+', name.strip())]
    return (parts[-2], parts[-1]) if len(parts) > 1 else ("public", parts[0] if parts else "")


_NAME = r'((?:"[^"]+"|\w+)(?:\.(?:"[^"]+"|\w+))?)'
_PRIVILEGES = ["SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE"]


def dump_rows(sql: str) -> Iterator[tuple[str, dict]]:
    """(row set, row) of the statements of a dump that the rules read."""
    enabled = {qualified(m[1]) for m in re.finditer(rf"(?is)ALTER TABLE (?:ONLY )?{_NAME}\s+ENABLE ROW LEVEL SECURITY", sql)}
    forced = {qualified(m[1]) for m in re.finditer(rf"(?is)ALTER TABLE (?:ONLY )?{_NAME}\s+FORCE ROW LEVEL SECURITY", sql)}
    for m in re.finditer(rf"(?is)CREATE TABLE (?:IF NOT EXISTS )?{_NAME}\s*\(", sql):
        s, n = qualified(m[1])
        yield "tables", {"table_schema": s, "table_name": n, "table_type": "BASE TABLE"}
        yield "rls", {"table_schema": s, "table_name": n, "rls_enabled": str((s, n) in enabled).lower(), "rls_forced": str((s, n) in forced).lower()}
    for m in re.finditer(rf'(?is)CREATE POLICY ("[^"]+"|\w+) ON {_NAME}([^;]*);', sql):
        s, n = qualified(m[2])
        to, cmd = re.search(r"(?is)\bTO\s+([\w\", ]+?)(?:\s+USING|\s+WITH|\s*$)", m[3]), re.search(r"(?i)\bFOR\s+(\w+)", m[3])
        yield "policies", {"schemaname": s, "tablename": n, "policyname": m[1].strip('"'), "roles": to[1].replace('"', "") if to else "public", "cmd": cmd[1].upper() if cmd else "ALL"}
    for m in re.finditer(rf"(?is)GRANT\s+([\w ,]+?)\s+ON\s+(?:TABLE\s+)?{_NAME}\s+TO\s+([^;]+);", sql):
        if re.match(r"(?i)(FUNCTION|SCHEMA|SEQUENCE)\b", m[2]):
            continue
        s, n = qualified(m[2])
        names = [p.strip().upper() for p in m[1].split(",")]
        for role in m[3].replace('"', "").split(","):
            for p in _PRIVILEGES if any(x.startswith("ALL") for x in names) else names:
                yield "table_privileges", {"table_schema": s, "table_name": n, "grantee": role.strip().lower(), "privilege_type": p}
    for m in re.finditer(rf"(?is)GRANT\s+(?:ALL|EXECUTE)[\w ]*\s+ON\s+FUNCTION\s+{_NAME}\s*\([^)]*\)\s+TO\s+([^;]+);", sql):
        s, n = qualified(m[1])
        for role in m[2].replace('"', "").split(","):
            yield "routine_privileges", {"routine_schema": s, "routine_name": n, "specific_name": n, "grantee": role.strip().lower()}
    for m in re.finditer(r"(?is)INSERT INTO (?:\"?storage\"?\.)?\"?buckets\"?\s*\(([^)]*)\)\s*VALUES\s*(.*?);", sql):
        columns = [c.strip().strip('"') for c in m[1].split(",")]
        for group in re.finditer(r"\(((?:'(?:''|[^'])*'|[^()'])*)\)", m[2]):
            row = dict(zip(columns, map(literal, split_values(group[1]))))
            yield "storage_buckets", {k: None if row.get(k) is None else str(row[k]).lower() if isinstance(row[k], bool) else row[k] for k in ("id", "name", "public")}
    for m in re.finditer(r"(?is)COPY (?:\"?storage\"?\.)?\"?buckets\"?\s*\(([^)]*)\)\s+FROM stdin;\n(.*?)\n\\\.", sql):
        columns = [c.strip().strip('"') for c in m[1].split(",")]
        for line in m[2].split("\n"):
            row = dict(zip(columns, line.split("\t")))
            yield "storage_buckets", {k: None if row.get(k) in (None, "\\N") else row[k] for k in ("id", "name", "public")}


def dump(raw: DataFrame, column: str = "value") -> dict[str, DataFrame]:
    """The row sets of SQL dumps, one text a row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(name, {k: v for k, v in row.items() if v is not None}) for text in b["sql"] for name, row in dump_rows(text or "")]
            yield pd.DataFrame({"row_set": [r[0] for r in rows], "row": [r[1] for r in rows]})

    parsed = raw.select(F.col(column).alias("sql")).mapInPandas(parse, "row_set string, row map<string,string>")
    return {snake(name): parsed.where(F.col("row_set") == snake(name)).select(*[F.try_element_at("row", F.lit(c)).alias(c) for c in columns.split(", ")]) for name, columns in ROW_SETS.items()}

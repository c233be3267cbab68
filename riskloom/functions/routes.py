"""Routes, handler methods, SQL identifiers and redaction as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sampling_path, trim

#: Methods that a route file may export.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]


def after_segment(path: Column, segment: str) -> Column:
    """What follows the first folder named `segment`; null where there is none."""
    p = F.concat(F.lit("/"), sampling_path(path))
    at = F.instr(p, f"/{segment}/")
    return F.when(at > 0, F.substring(p, at + len(segment) + 2, F.length(p)))


def route_path(path: Column) -> Column:
    """The normal form with one leading slash; the empty path is a slash alone."""
    return F.concat(F.lit("/"), F.regexp_replace(sampling_path(path), "^/+", ""))


def exported_methods(content: Column) -> Column:
    """array<struct<method, line>> of the lines, from 1, that export a handler; one a line, functions before constants."""
    names = "|".join(METHODS)
    kinds = [rf"\bexport\s+(?:async\s+)?function\s+({names})\b", rf"\bexport\s+(?:const|let|var)\s+({names})\b"]
    found = lambda line: F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in kinds])
    lines = F.transform(F.split(content, "\n"), lambda line, k: F.struct(found(line).alias("method"), (k + 1).alias("line")))
    return F.filter(lines, lambda x: x["method"].isNotNull())


def identifier_parts(name: Column) -> Column:
    """Parts of a dotted SQL identifier; dots between double quotes (to the end, where unclosed) do not part."""
    parts = F.regexp_extract_all(name, F.lit(r'((?:[^".]++|"[^"]*+(?:"|$))++)'), F.lit(1))
    return F.filter(F.transform(parts, lambda p: trim(F.replace(p, F.lit('"'), F.lit("")))), lambda p: p != "")


def redacted(snippet: Column) -> Column:
    """A fixed word for any text; null for none."""
    return F.when(snippet != "", "[REDACTED]")

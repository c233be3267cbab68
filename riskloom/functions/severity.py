"""Severity names, ranks and the mappings of tools and roles to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import map_of, trim

#: In ascending order.
LEVELS = ["info", "low", "medium", "high", "critical"]
#: Other names of levels.
SYNONYMS = {
    "sev0": "critical", "p0": "critical", "sev1": "high", "p1": "high", "moderate": "medium", "sev2": "medium", "p2": "medium",
    "sev3": "low", "p3": "low", "minor": "low", "informational": "info", "note": "info",
}


def normal(c: Column, default: str | None = "medium") -> Column:
    s = F.lower(trim(c.cast("string")))
    known = map_of({x: x for x in LEVELS} | SYNONYMS)
    return F.coalesce(F.element_at(known, s), F.lit(default))


def rank(c: Column, lowest: int = 0, unknown: int = -1) -> Column:
    """lowest for info, and so on upwards; unknown for anything else."""
    s, out = F.lower(trim(c)), F.lit(unknown)
    for k, level in enumerate(LEVELS):
        out = F.when(s == level, F.lit(lowest + k)).otherwise(out)
    return out


def by_rank(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), (c + 1).cast("int"))


def higher(a: Column, b: Column) -> Column:
    return F.when(rank(b) > rank(a), F.lower(trim(b))).otherwise(F.lower(trim(a)))


def of_tool(tool: Column, raw: Column) -> Column:
    """Lint: 2 is high, 1 medium, else info; advisories by their word, other words low; other tools high."""
    word = F.lower(trim(raw.cast("string")))
    advisory = F.when(word.isin("critical", "high", "medium"), word).otherwise("low")
    lint = F.when(word == "2", "high").when(word == "1", "medium").otherwise("info")
    return F.when(tool == "eslint", lint).when(tool == "osv-scanner", advisory).otherwise("high")


def of_score(c: Column) -> Column:
    """The number that ends a score text: from 9 critical, 7 high, 4 medium, else low; null without one."""
    n = F.regexp_extract(c, r"(\d+\.?\d*)\s*$", 1).try_cast("double")
    return F.when(n >= 9, "critical").when(n >= 7, "high").when(n >= 4, "medium").when(n.isNotNull(), "low")


def for_roles(roles: Column, base: str) -> Column:
    """Raises a base level by the most open client role."""
    public = "high" if base == "medium" else "critical"
    anon = "medium" if base == "low" else "high"
    signed_in = "medium" if base == "low" else base
    return F.when(F.array_contains(roles, "public"), public).when(F.array_contains(roles, "anon"), anon).when(F.array_contains(roles, "authenticated"), signed_in).otherwise(base)

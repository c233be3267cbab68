"""Choosing chunks under fixed budgets: scores, round robin, windows and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import text as t

#: Fixed values: (weight, pattern) on the lower-cased path.
PATH_WEIGHTS = [
    (5, r"\.(ts|tsx|js|jsx)$"), (6, r"/db/|schema\.sql$"), (4, r"/src/|^src/|/service/|/ui/"), (3, r"/functions|/api/|/edge/"), (3, "webhook"),
    (-6, r"package-lock|pnpm-lock|yarn\.lock"), (-10, r"node_modules|\.next|dist/"),
]
ENDPOINT = r"""(?i)\bDeno\.serve\b|\brouter\.(get|post|put|patch|delete)\b|\bapp\.(get|post|put|patch|delete)\b|\bexport\s+async\s+function\s+(GET|POST|PUT|PATCH|DELETE)\b|\breq\.method\b|\baddEventListener\s*\(\s*['"]fetch['"]\s*\)"""
EXTERNAL = r"(?i)\bfetch\s*\(|\baxios\b|\bgot\s*\(|\brequest\s*\(|\bhttps?\.request\s*\("
WEBHOOK_CONFIG = (
    r"""(?i)\bconfigUrl\w*\b|\bconfig_url\w*\b|\bconfigUri\w*\b|\bconfig_uri\w*\b|\bconfigEndpoint\b|\bwebhookConfig\w*\b|\bconfig\s*(?:\?\.|\.)\s*(url|uri|endpoint|link)\b|\bconfig\s*\[\s*['"](url|uri|endpoint|link)['"]\s*\]"""
    r"""|\b(payload|body|event\.payload|event\.data|req\.body|request\.body)\s*(?:\?\.|\.)\s*config\w*\b"""
)
#: Fixed values: (weight, pattern) on the content.
CONTENT_WEIGHTS = [
    (4, ENDPOINT), (2, r"(?i)\bwebhook\b"), (3, r"(?i)\bauth\b|\bjwt\b|\btoken\b|\bsession\b"), (3, r"(?i)\.from\s*\(|\.select\s*\(|\.insert\s*\(|\.update\s*\(|\.delete\s*\(|\bsql\b|\bquery\b"),
    (4, r"(?i)\bexecSync\s*\(|\bexec\s*\(|\bspawnSync\s*\(|\bspawn\s*\(|\bDeno\.Command\b|\bDeno\.run\b|\bchild_process\b|\bBun\.spawn\b"), (2, r"(?i)\badmin\b|\brole\b|\bpermission\b|\bclaims\b"),
    (1, r"(?i)\bconsole\.(log|info|warn|error)\s*\(|\blogger\."), (2, r"(?i)\bvulnEnabled\s*\("), (2, r"(?i)\bdangerouslySetInnerHTML\b|\beval\s*\(|\bnew Function\b"), (5, WEBHOOK_CONFIG),
]
HIGH_RISK = 12


def chunk_score(path: Column, content: Column) -> Column:
    p, score = F.lower(path), F.lit(1)  # every path has a top folder
    for weight, pattern in PATH_WEIGHTS:
        score = score + F.when(p.rlike(pattern), weight).otherwise(0)
    c = F.coalesce(content, F.lit(""))
    for weight, pattern in CONTENT_WEIGHTS:
        score = score + F.when(c.rlike(pattern), weight).otherwise(0)
    return score + F.when(c.rlike(WEBHOOK_CONFIG) & c.rlike(EXTERNAL), 6).otherwise(0)


def ignored_path(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\\", "/"))
    return F.contains(p, F.lit("/vulnerabilities/")) | p.rlike(r"(^|/)expected_findings\.json$")


def webhook_config(path: Column, content: Column) -> Column:
    c = F.coalesce(content, F.lit(""))
    return c.rlike(WEBHOOK_CONFIG) | (F.contains(F.lower(path), F.lit("webhook")) & c.rlike(EXTERNAL))


def first_by_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key: exact dedupe, first wins."""
    return rows.withColumn("rn__", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("rn__ = 1").drop("rn__")


def best_per_file(chunks: DataFrame, path: str = "path", score: str = "score", index: str = "chunk_index") -> DataFrame:
    """The best chunk of each file: largest score, then smallest index, by one partial aggregate."""
    best = F.max_by(F.struct(*chunks.columns), F.struct(F.col(score), (-F.col(index)).alias("i")))
    return chunks.groupBy(path).agg(best.alias("b__")).select("b__.*")


def prefer_format(chunks: DataFrame, path: str = "path", fmt: str = "chunk_format", wanted: str = "security_semantic") -> DataFrame:
    """Where a file has chunks of the wanted format, only those."""
    has = F.max((F.col(fmt) == wanted).cast("int")).over(W.partitionBy(path))
    return chunks.withColumn("has__", has).where((F.col("has__") == 0) | (F.col(fmt) == wanted)).drop("has__")


def round_robin(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """One row of each group in turn, groups in ascending order, until `most`: pick 1, 2, ..."""
    rn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    # no group can give more than `most`, so the global order is over few rows
    ranked = rows.withColumn("round", rn).where(F.col("round") <= most).orderBy("round", group).limit(most)
    return ranked.withColumn("pick", F.row_number().over(W.orderBy("round", group)))


def seed_window(rows: DataFrame, key: list[str], index: str, seed: str, size: int) -> DataFrame:
    """A window of `size` rows around the seed row of each key, moved to fit."""
    by = W.partitionBy(*key)
    placed = rows.withColumns({"pos__": F.row_number().over(by.orderBy(index)) - 1, "n__": F.count("*").over(by)})
    placed = placed.withColumn("seed__", F.min(F.when(F.col(seed), F.col("pos__"))).over(by))
    start = F.greatest(F.lit(0), F.col("seed__") - (size - 1) // 2)
    start = F.greatest(F.lit(0), F.least(start, F.col("n__") - size))
    return placed.where((F.col("pos__") >= start) & (F.col("pos__") < start + size)).drop("pos__", "n__", "seed__")


def cap_groups(rows: DataFrame, group: str, order: str, most_groups: int, most_rows: int) -> DataFrame:
    """At most `most_rows` rows of each of the first `most_groups` groups, in order of first appearance."""
    first = rows.groupBy(group).agg(F.min(order).alias("first__")).orderBy("first__").limit(most_groups)
    inside = rows.join(F.broadcast(first), group)  # at most `most_groups` rows
    return inside.withColumn("rn__", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("rn__") <= most_rows).drop("rn__", "first__")


def extra_high_risk(chunks: DataFrame, chosen: DataFrame, key: list[str], path: str, score: str, index: str, max_files: int) -> DataFrame:
    """Further chunks of files whose best score is high: min(25, max(8, 35 % of max_files)) at most."""
    most = min(25, max(8, int(0.35 * max_files)))
    risky = chunks.groupBy(path).agg(F.max(score).alias("top__")).where(F.col("top__") >= HIGH_RISK)
    rest = chunks.join(risky, path).join(chosen.select(*key).distinct(), key, "left_anti")
    return rest.orderBy(F.desc("top__"), path, F.desc(score), index).limit(most).drop("top__")


def must_include(chunks: DataFrame, path: str, content: str, index: str, order: str, path_pattern: str, content_pattern: str, most: int = 80) -> DataFrame:
    """The first two chunks of files with a telling path, else the first chunk with telling content; `most` overall."""
    by = W.partitionBy(path)
    rows = chunks.withColumn("named__", F.col(path).rlike(path_pattern)).withColumn("hit__", F.col(content).rlike(content_pattern))
    rows = rows.withColumn("pos__", F.row_number().over(by.orderBy(index))).withColumn("nth__", F.sum(F.col("hit__").cast("int")).over(by.orderBy(index).rowsBetween(W.unboundedPreceding, 0)))
    keep = (F.col("named__") & (F.col("pos__") <= 2)) | (~F.col("named__") & F.col("hit__") & (F.col("nth__") == 1))
    return rows.where(keep).orderBy(order).limit(most).drop("named__", "hit__", "pos__", "nth__")

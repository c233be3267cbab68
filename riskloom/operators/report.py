"""Reports: groups of findings, themes, summaries and their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import severity
from riskloom.functions import text as t
from riskloom.operators import dedupe
from riskloom.operators.ranking import numbered
from riskloom.shared import materialise

#: Patterns over a normal title that name a bucket, first wins.
TITLE_BUCKETS = {
    "missing_security_headers": r"\bmissing\b.*\bsecurity\b.*\bheader\b",
    "missing_headers": r"\bmissing\b.*\bheader\b",
    "verbose_error_messages": r"\bverbose\b.*\berror\b|\bexpos\w+\b.*\berror\b",
    "debug_endpoint_exposed": r"\bdebug\b.*\bendpoint\b|\bdebug\b.*\benabled\b",
    "missing_rate_limiting": r"\bno\b.*\brate\b[-\s]?limit|\bmissing\b.*\brate\b[-\s]?limit",
    "idor": r"\bidor\b|\binsecure\b.*\bdirect\b.*\bobject\b",
    "missing_server_side_authorization": r"\bauthori[sz]ation\b.*\bmissing\b|\blacks?\b.*\bauthori[sz]ation\b",
    "frontend_only_authorization": r"\bfrontend\b[-\s]?only\b.*\bauthori[sz]ation",
    "mass_assignment": r"\bmass\b.*\bassignment\b",
    "insecure_token_generation": r"\btoken\b.*\bgenerat\w+\b.*\b(insecure|weak|predictable)|\binsecure\b.*\btoken\b.*\bgenerat\w+\b",
    "weak_jwt_handling": r"\bweak\b.*\bjwt\b|\bjwt\b.*\bweak\b|\bjwt\b.*\bfallback\b|\bfallback\b.*\bjwt\b",
    "webhook_missing_authentication": r"\bwebhook\b.*\b(auth|authn|authz)\b.*\black|\bwebhook\b.*\blacks?\b.*\bauth|\bwebhook\b.*\bunauthenticated\b",
    "webhook_missing_signature_verification": r"\bwebhook\b.*\b(signature|hmac)\b.*\b(verify|verification)\b.*\bmissing|\bwebhook\b.*\bdoes\b.*\bnot\b.*\bverify\b.*\bsignature\b",
    "webhook_missing_replay_protection": r"\bwebhook\b.*\breplay\b",
    "command_injection": r"\bcommand\b.*\binjection\b|\bshell\b.*\binjection\b",
    "sensitive_data_exposure": r"\bexpos\w+\b.*\bsensitive\b.*\b(data|token|user)\b|\bexcessive\b.*\bdata\b.*\bexposure\b",
}
#: What a bucket's or title's words say of its theme, first wins.
THEMES = {
    "authorization|idor|auth": "Auth/AuthZ gaps", "command_injection": "Command execution surface", "webhook": "Webhook trust issues", "token|jwt": "Token/session weaknesses", "error|debug": "Verbose errors / debug exposure",
    "missing_headers|security_header": "Missing security headers", "exposure": "Excessive data exposure", "rate|throttle|lockout": "Missing rate limiting / lockout", "mass_assignment": "Mass assignment",
}
#: Words that say nothing about a title.
TITLE_STOPS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were with"
    " api http https endpoint endpoints request requests response responses handler handlers server route routes function functions"
).split()


def normal_title(c: Column) -> Column:
    return t.squeeze(F.regexp_replace(F.lower(t.trim(c)), "[.!?]+$", ""))


def title_bucket(c: Column) -> Column:
    title = normal_title(c)
    out = F.concat(F.lit("title:"), title)
    for name, pattern in reversed(TITLE_BUCKETS.items()):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def title_token(w: Column) -> Column:
    w = F.regexp_replace(w, "[^a-z0-9_-]", "")
    stem = (
        F.when(w.rlike("ies$") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y")).when(w.rlike("es$") & (F.length(w) > 4), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
    )
    return F.when(w.isin("absent", "missing", "unset"), "missing").when(w.isin("header", "headers"), "header").when(w.isin("auth", "authentication"), "authentication").when(w == "authorisation", "authorization").otherwise(stem)


def title_tokens(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(title_bucket(c), "^title:", ""), r"[^a-z0-9\s_-]", " ")
    words = F.transform(F.filter(F.split(base, r"\s+"), lambda w: w != ""), title_token)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*TITLE_STOPS))))


def theme(c: Column) -> Column:
    base = F.regexp_replace(title_bucket(c), "^title:", "")
    out = F.lit("Configuration")
    for pattern, name in reversed(THEMES.items()):
        out = F.when(base.rlike(pattern), name).otherwise(out)
    return out


def static_groups(findings: DataFrame) -> DataFrame:
    """(severity, source, title_key) groups of findings(ord, severity, source, title, location): how many, at how many places, under how many titles, the first ord."""
    keyed = findings.withColumn("title_key", normal_title(F.col("title")))
    return keyed.groupBy("severity", "source", "title_key").agg(F.count("*").alias("n_findings"), F.count_distinct("location").alias("n_locations"), F.count_distinct("title").alias("n_titles"), F.min("ord").alias("first_ord"))


#: A title joins a group from this share of common words on: with three words or fewer on one side, and with more.
SHORT_SHARE, LONG_SHARE = 0.55, 0.68


def title_pairs(buckets: DataFrame) -> DataFrame:
    """(severity, source, bucket, other, score, passes): for each of buckets(severity, source,
    bucket, words, first) the others that it could join. They meet over their rarest words
    alone; those without words are all alike and can only join the first of them."""
    block = ["severity", "source"]
    named = buckets.withColumn("name", F.to_json(F.struct(*block, "bucket")))
    some = dedupe.similar_pairs(named.where(F.size("words") > 0), block, "name", "words", SHORT_SHARE)
    both = some.select("a", "b", "score").unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    blank = named.where(F.size("words") == 0).select(*block, F.col("name").alias("a"), "first")
    alike = blank.join(blank.groupBy(*block).agg(F.min_by("a", "first").alias("b")), block).where("a <> b")
    both = both.unionByName(alike.select("a", "b", F.lit(1.0).alias("score")))
    side = lambda x, *more: named.select(F.col("name").alias(x), *more)
    rows = both.join(side("a", *block, "bucket", F.size("words").alias("n")), "a").join(side("b", F.col("bucket").alias("other"), F.size("words").alias("m")), "b")
    return rows.select(*block, "bucket", "other", "score", (F.col("score") >= F.when(F.least("n", "m") <= 3, SHORT_SHARE).otherwise(LONG_SHARE)).alias("passes"))


def fuzzy_groups(findings: DataFrame) -> DataFrame:
    """(ord, group_ord): in order, each finding joins the group that its own bucket opened,
    else the most similar earlier group of its severity and source (the first of equals) if
    that is similar enough, else it opens one.

    Only distinct buckets are compared, through an inverted index, once. What is then open is
    which finding of a bucket opens a group, if any; that depends on earlier groups alone, so
    guesses are made better in rounds of joins until none changes: the first guess has every
    bucket open a group with its first finding."""
    by = ["severity", "source", "bucket"]
    rows = materialise(findings.select("ord", F.coalesce("severity", F.lit("")).alias("severity"), F.coalesce("source", F.lit("")).alias("source"), title_bucket(F.coalesce("title", F.lit(""))).alias("bucket"), title_tokens(F.coalesce("title", F.lit(""))).alias("words")), "titles")
    places = rows.select(*by, "ord")
    pairs = materialise(title_pairs(rows.groupBy(*by).agg(F.first("words").alias("words"), F.min("ord").alias("first"))), "title-pairs")
    opened = materialise(places.groupBy(*by).agg(F.min("ord").alias("opened")), "groups")
    first = opened.withColumnRenamed("opened", "first")
    while True:
        # a bucket's most similar group as time goes on: the steps at which a better one opens
        late = pairs.join(opened.select("severity", "source", F.col("bucket").alias("other"), F.col("opened").alias("since")), ["severity", "source", "other"])
        along = W.partitionBy(*by).orderBy("since")
        better = F.col("score") > F.coalesce(F.max("score").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1.0))
        steps = late.withColumn("better", better).where("better").withColumn("until", F.lead("since").over(along))
        steps = materialise(steps.select(*by, "since", "until", "passes"), "title-steps")
        after = places.join(steps.where("NOT passes"), by).where((F.col("ord") > F.col("since")) & (F.col("until").isNull() | (F.col("ord") < F.col("until")))).groupBy(*by).agg(F.min("ord").alias("alone"))
        before = first.join(steps.groupBy(*by).agg(F.min("since").alias("since")), by, "left").where("since IS NULL OR first < since").select(*by, F.col("first").alias("alone"))
        now = materialise(after.union(before).groupBy(*by).agg(F.min("alone").alias("opened")), "groups")
        if now.exceptAll(opened).isEmpty() and opened.exceptAll(now).isEmpty():
            break
        opened = now
    own = places.join(opened, by, "left")
    joined = own.where("opened IS NULL OR ord < opened").select(*by, "ord")
    home = joined.join(steps.where("passes"), by).where((F.col("ord") > F.col("since")) & (F.col("until").isNull() | (F.col("ord") < F.col("until"))))
    return own.where("ord >= opened").select("ord", F.col("opened").alias("group_ord")).union(home.select("ord", F.col("since").alias("group_ord")))


def theme_summary(groups: DataFrame, title: str = "title") -> DataFrame:
    """(theme, n_groups, worst, position): themes by worst severity, then count, then name."""
    r = F.max(severity.rank(F.col("severity"), lowest=1, unknown=1))
    per = groups.groupBy(theme(F.col(title)).alias("theme")).agg(F.count("*").alias("n_groups"), r.alias("r"))
    place = F.row_number().over(W.orderBy((F.col("r") * 1000 + F.col("n_groups")).desc(), "theme"))  # as many rows as there are themes
    return per.select("theme", "n_groups", severity.by_rank(F.col("r") - 1).alias("worst"), place.alias("position"))


def source_rank(source: Column) -> Column:
    """Findings of tools come before those of models."""
    return F.when(source == "static", 0).otherwise(1)


def group_heads(findings: DataFrame, group: list[str], titles: int = 3) -> DataFrame:
    """(group, severity, source, title, n_findings, n_titles, shown_titles) of findings(ord, severity,
    source, title): the worst finding stands for its group, of equals one of a tool, then the
    first; the first `titles` other spellings by name are shown where there are several."""
    worth = F.struct((-severity.rank(F.col("severity"), lowest=1, unknown=1)).alias("s"), source_rank(F.col("source")).alias("o"), F.col("ord").alias("n"))
    heads = findings.groupBy(*group).agg(F.min_by(F.struct("severity", "source", "title"), worth).alias("h"), F.count("*").alias("n_findings"))
    spelled = findings.select(*group, t.trim(F.col("title")).alias("title")).where("title <> ''").distinct()
    counted = spelled.groupBy(*group).agg(F.count("*").alias("n_titles"))
    shown = spelled.withColumn("rn__", F.row_number().over(W.partitionBy(*group).orderBy("title"))).where(F.col("rn__") <= titles)
    some = shown.groupBy(*group).agg(F.array_sort(F.collect_list("title")).alias("shown_titles"))
    out = heads.join(counted, group, "left").join(some, group, "left").withColumn("n_titles", F.coalesce("n_titles", F.lit(0)))
    return out.select(*group, "h.*", "n_findings", "n_titles", F.when(F.col("n_titles") > 1, F.col("shown_titles")).otherwise(F.array().cast("array<string>")).alias("shown_titles"))


def group_places(findings: DataFrame, group: list[str]) -> DataFrame:
    """(group, filepath, line, place): a group's distinct places in the order of a report, numbered
    from 1. One row a place, so a group may hold most findings; nulls count as empty and 0."""
    places = findings.select(*group, F.coalesce("filepath", F.lit("")).alias("filepath"), F.coalesce("line", F.lit(0)).alias("line")).distinct()
    return numbered(places, group, ["filepath", "line"], "place")


def anchor_report(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """runs(repo, enabled, skipped, ran, reason, error, duration_ms) with the anchors(repo, path, ...)
    of those that ran, and why the others did not: a reason of their own, else `disabled` or `skipped`."""
    counts = anchors.groupBy("repo").agg(F.count("*").alias("anchor_count"), F.count_distinct("path").alias("file_count"))
    why = F.coalesce(F.nullif("reason", F.lit("")), F.when(~F.col("enabled"), "disabled").when(F.col("skipped"), "skipped"))
    ran = F.coalesce("ran", F.lit(False))
    held = lambda c: F.when(ran, F.coalesce(c, F.lit(0)))
    return runs.join(counts, "repo", "left").select("repo", "enabled", "skipped", ran.alias("ran"), held("anchor_count").alias("anchor_count"), held("file_count").alias("file_count"), why.alias("reason"), F.nullif("error", F.lit("")).alias("error"), "duration_ms")


def severity_pivot(groups: DataFrame, by: str = "source") -> DataFrame:
    return groups.groupBy(by).pivot("severity", severity.LEVELS).count().fillna(0)


def render_text(findings: DataFrame, most: int = 200) -> str:
    """A text report of the first `most` findings by severity (a report's page, not a filter)."""
    rows = findings.orderBy(severity.rank(F.col("severity")).desc(), (F.col("source") != "static").cast("int"), "title").limit(most).collect()
    return "\n".join(f"[{r['severity'].upper()}] {r['title']} ({r['source']}) {r['location']}" for r in rows) or "No findings."


def to_json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def count_map(rows: DataFrame, by: str) -> DataFrame:
    """Counts by value, largest first, then by name."""
    return rows.groupBy(by).count().orderBy(F.desc("count"), by)

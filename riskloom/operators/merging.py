"""Merge decisions as named native predicates, and order-dependent clustering by rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as t
from riskloom.functions.identity import type_value
from riskloom.shared import materialise

Side = Callable[[str], Column]
#: Two summaries say the same from this share of common words on.
SIMILAR = 0.88
SLACK = 2
#: Lines of a bucket in which ranges meet.
BUCKET = 64
TEXTS = ["key", "rule", "cand", "entry", "sym", "anchor_id", "overlap_id", "repo_name", "identity_type", "dedupe_category", "canonical_path", "kind_token"]
LINES = {"lo": "start_line", "hi": "end_line", "chunk": "chunk_index"}


def merge_facts(flat: DataFrame) -> DataFrame:
    """Flattened findings with what decides merges: rule and candidate under their usual names, keys, words."""
    return flat.withColumns({
        "key": F.coalesce(F.nullif("stored_key", F.lit("")), F.col("identity_v1")), "rule": type_value(F.col("merge_rule")), "cand": type_value(F.col("candidate")), "entry": t.entry_point_token(F.col("entry_point")),
        "sym": t.entry_point_token(F.col("symbol")), "kind_token": t.type_token(F.col("kind")), "words": t.summary_tokens(F.col("finding_text")),
    })


def same(a: Side, b: Side, name: str) -> Column:
    return (a(name) != "") & (a(name) == b(name))


def differ(a: Side, b: Side, name: str) -> Column:
    return (a(name) != "") & (b(name) != "") & (a(name) != b(name))


def near_lines(a: Side, b: Side, slack: int = SLACK) -> Column:
    """Whether two findings of one file touch, by lines or by chunk."""
    low = lambda x: F.greatest(F.lit(1), x("lo") - slack)
    lines = (low(a) <= b("hi") + slack) & (low(b) <= a("hi") + slack)
    touch = F.when((a("lo") > 0) & (b("lo") > 0), lines).otherwise((a("chunk") >= 0) & (a("chunk") == b("chunk")))
    return ~differ(a, b, "repo_name") & same(a, b, "canonical_path") & touch


def same_lines(a: Side, b: Side) -> Column:
    equal = F.when((a("lo") >= 0) & (b("lo") >= 0), (a("lo") == b("lo")) & (a("hi") == b("hi"))).otherwise((a("chunk") >= 0) & (a("chunk") == b("chunk")))
    return ~differ(a, b, "repo_name") & same(a, b, "canonical_path") & equal


def similarity(a: Side, b: Side) -> Column:
    both, either = F.size(F.array_intersect(a("words"), b("words"))), F.size(F.array_union(a("words"), b("words")))
    return F.when(either == 0, 1.0).otherwise(both / either)


def says_the_same(a: Side, b: Side) -> Column:
    """One rule, or a common type, candidate or entry point with one category, kind or nearly one summary."""
    apart = differ(a, b, "entry") | differ(a, b, "cand") | differ(a, b, "identity_type")
    tied = same(a, b, "cand") | same(a, b, "identity_type") | same(a, b, "entry")
    alike = same(a, b, "dedupe_category") | same(a, b, "kind_token") | (similarity(a, b) >= SIMILAR)
    return ~apart & (same(a, b, "rule") | (tied & alike))


def decisions(a: Side, b: Side) -> list[tuple[str, Column, Column]]:
    """(name, whether it decides, the verdict), from the strongest evidence to the weakest; the first that decides counts."""
    limited = (a("dedupe_category") == b("dedupe_category")) & a("dedupe_category").isin("rate_limiting", "lockout")
    one_repo, one_type = ~differ(a, b, "repo_name"), same(a, b, "identity_type")
    no, yes = F.lit(False), F.lit(True)
    return [
        ("limits_of_other_entry", limited & ~same(a, b, "entry"), no),
        ("identity_key", same(a, b, "key"), yes),
        ("rule_differs", differ(a, b, "rule"), no),
        ("candidate_differs", differ(a, b, "cand"), no),
        ("entry_differs", differ(a, b, "entry"), no),
        ("anchor", same(a, b, "anchor_id"), one_repo),
        ("overlap_group", same(a, b, "overlap_id"), one_repo & (a("entry") == b("entry")) & (a("sym") == b("sym")) & one_type),
        ("near_of_other_type", near_lines(a, b) & ~(same(a, b, "rule") | one_type), no),
        ("same_lines", same_lines(a, b), one_type | same(a, b, "dedupe_category")),
        ("near_and_alike", yes, near_lines(a, b) & same(a, b, "entry") & says_the_same(a, b)),
    ]


def mergeable(a: Side, b: Side) -> Column:
    out = F.lit(False)
    for _, decides, verdict in reversed(decisions(a, b)):
        out = F.when(decides, verdict).otherwise(out)
    return out


def deciding(a: Side, b: Side) -> Column:
    out = F.lit(None).cast("string")
    for name, decides, _ in reversed(decisions(a, b)):
        out = F.when(decides, name).otherwise(out)
    return out


def decision_facts(flat: DataFrame) -> DataFrame:
    """What decides merges, one row a finding, no nulls: texts are empty and numbers -1 where unknown."""
    facts = merge_facts(flat)
    return facts.select("ord", *[F.coalesce(c, F.lit("")).alias(c) for c in TEXTS], F.coalesce("words", F.array().cast("array<string>")).alias("words"), *[F.coalesce(v, F.lit(-1)).cast("long").alias(k) for k, v in LINES.items()])


def merge_trace(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of ords with `merges`, the deciding predicate's name, and of every operand
    both values and whether they agree: what a reader needs to see why two findings merged."""
    every = ["ord", *TEXTS, "words", *LINES]
    side = lambda x: facts.select(F.col("ord").alias(x), F.struct(*every).alias(f"of_{x}"))
    a, b = (lambda c: F.col(f"of_a.{c}")), (lambda c: F.col(f"of_b.{c}"))
    operands = F.struct(*[F.struct(F.nullif(a(c), F.lit("")).alias("a"), F.nullif(b(c), F.lit("")).alias("b"), same(a, b, c).alias("match")).alias(c) for c in TEXTS])
    places = F.struct(same_lines(a, b).alias("location_exact"), near_lines(a, b).alias("location_overlap"), F.round(similarity(a, b), 6).alias("summary_similarity"), says_the_same(a, b).alias("says_the_same"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", mergeable(a, b).alias("merges"), deciding(a, b).alias("decided_by"), operands.alias("operands"), places.alias("places"))


def _tokens(x: Side, at: Side) -> Column:
    """What two findings must share one of to merge, each with the ord from which it holds:
    key, anchor, overlap group, equal lines or chunk of a file, an entry point near in a file."""
    text = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *[p.cast("string") for p in parts])
    token = lambda when, value, since: F.when(when, F.array(F.struct(value.alias("token"), since.alias("since")))).otherwise(F.array().cast("array<struct<token:string,since:bigint>>"))
    placed, in_file = F.greatest(at("path"), at("lines")), x("canonical_path") != ""
    edges = [F.greatest(F.lit(1), x("lo") - SLACK), x("hi") + SLACK]
    buckets = F.sequence(F.floor(F.least(*edges) / BUCKET), F.floor(F.greatest(*edges) / BUCKET))
    near = F.when(in_file & (x("entry") != "") & (x("lo") > 0), F.transform(buckets, lambda n: F.struct(text("near", x("canonical_path"), x("entry"), n).alias("token"), placed.alias("since"))))
    return F.concat(
        token(x("key") != "", text("key", x("key")), x("ord")), token(x("anchor_id") != "", text("anchor", x("anchor_id")), at("anchor")),
        token((x("overlap_id") != "") & (x("identity_type") != ""), text("group", x("overlap_id"), x("entry"), x("sym"), x("identity_type")), at("overlap")),
        token(in_file & (x("lo") >= 0), text("lines", x("canonical_path"), x("lo"), x("hi")), placed), token(in_file & (x("chunk") >= 0), text("chunk", x("canonical_path"), x("chunk")), at("path")),
        F.coalesce(near, F.array().cast("array<struct<token:string,since:bigint>>")),
    )


FILLED = {"anchor": "anchor_id", "overlap": "overlap_id", "path": "canonical_path"}


def cluster_states(facts: DataFrame, assigned: DataFrame) -> DataFrame:
    """A row for each cluster of assigned(ord, cluster): its first finding's facts, what it
    lacked from the first member that has it, and the ord from which each of these holds."""
    rows = facts.join(assigned, "ord")
    heads = rows.where("ord = cluster").drop("cluster", "words")
    own = lambda c: F.min(F.when(F.col(c) != "", F.struct("ord", F.col(c).alias("v"))))
    lines = F.min(F.when(F.col("lo") >= 0, F.struct("ord", "lo", "hi")))
    fills = rows.where("ord <> cluster").groupBy(F.col("cluster").alias("ord")).agg(*[own(c).alias(f"f_{k}") for k, c in FILLED.items()], lines.alias("f_lines"))
    both = heads.join(fills, "ord", "left")
    late = {f"{k}_from": F.when((F.col(c) == "") & F.col(f"f_{k}").isNotNull(), F.col(f"f_{k}.ord")).otherwise(F.col("ord")) for k, c in FILLED.items()}
    whole = {c: F.when(F.col(c) == "", F.coalesce(F.col(f"f_{k}.v"), F.lit(""))).otherwise(F.col(c)) for k, c in FILLED.items()}
    # lines come from members only until the file is known, the one that brings it included
    open_ = (F.col("lo") < 0) & (F.col("canonical_path") == "") & F.col("f_lines").isNotNull() & (F.col("f_path").isNull() | (F.col("f_lines.ord") <= F.col("f_path.ord")))
    filled = {"lo": F.when(open_, F.col("f_lines.lo")).otherwise(F.col("lo")), "hi": F.when(open_, F.col("f_lines.hi")).otherwise(F.col("hi")), "lines_from": F.when(open_, F.col("f_lines.ord")).otherwise(F.col("ord"))}
    return both.withColumns(late | whole | filled).select("ord", *TEXTS, *LINES, *late, "lines_from")


def greedy_clusters(flat: DataFrame) -> DataFrame:
    """(ord, cluster): in order, each finding joins the first earlier cluster it may merge
    with, else it opens one; a cluster is named by its first ord, and fills up with the
    anchor, overlap group, file and lines that it lacks.

    Rounds of joins instead of a walk: given all findings' clusters so far, each finding looks
    for the first cluster it may join as that cluster stood before it. Findings meet clusters
    by what they must share to merge, and only findings that share something with a cluster
    that has changed are looked at again. If nothing changes, every finding agrees with all
    earlier ones, so the result is that of the walk; each round settles at least one more
    finding of the order, and all that depend on no open ones. The first guess puts findings
    of one key together, so a group of copies has one cluster from the start."""
    facts = materialise(decision_facts(flat), "merge-facts")
    plain = lambda c: F.col(c)
    of_rows = materialise(facts.select("ord", F.explode(_tokens(plain, lambda c: F.col("ord"))).alias("t")).select("ord", "t.token").distinct(), "merge-tokens")
    first = facts.where("key <> ''").groupBy("key").agg(F.min("ord").alias("cluster"))
    assigned = materialise(facts.select("ord", "key").join(first, "key", "left").select("ord", F.coalesce("cluster", "ord").alias("cluster")), "clusters")
    before, todo = None, of_rows
    of_states = lambda s: s.select(F.col("ord").alias("cluster"), F.explode(_tokens(plain, lambda c: F.col(f"{c}_from"))).alias("t")).select("cluster", "t.*")
    while True:
        states = materialise(cluster_states(facts, assigned), "cluster-states")
        if before is not None:
            changed = states.exceptAll(before).unionByName(before.exceptAll(states))
            touched = of_rows.join(of_states(changed).select("token").distinct(), "token", "left_semi").select("ord").distinct()
            todo = of_rows.join(touched, "ord", "left_semi")
        todo = materialise(todo, "merge-open")
        met = todo.join(of_states(states), "token").where((F.col("cluster") < F.col("ord")) & (F.col("since") < F.col("ord"))).select("ord", "cluster").distinct()
        words = facts.select(F.col("ord").alias("cluster"), F.col("words").alias("c_words"))
        held = states.select(F.col("ord").alias("cluster"), *[F.col(c).alias(f"c_{c}") for c in states.columns if c != "ord"]).join(words, "cluster")
        wide = met.join(held, "cluster").join(facts, "ord")
        since = {c: k for k, c in FILLED.items()}

        def then(c: str) -> Column:
            """A cluster's fact as it stood before the finding came."""
            if c in since:
                return F.when(F.col(f"c_{since[c]}_from") < F.col("ord"), F.col(f"c_{c}")).otherwise("")
            if c == "lo":
                return F.when(F.col("c_lines_from") < F.col("ord"), F.col("c_lo")).otherwise(F.lit(-1))
            return F.col(f"c_{c}")

        best = wide.where(mergeable(then, plain)).groupBy("ord").agg(F.min("cluster").alias("best"))
        again = todo.select("ord").distinct().join(best, "ord", "left").select("ord", F.coalesce("best", "ord").alias("now"))
        moved = materialise(assigned.join(again, "ord", "left").select("ord", F.coalesce("now", "cluster").alias("cluster"), (F.col("now") != F.col("cluster")).alias("moved")), "clusters")
        assigned, before = moved.select("ord", "cluster"), states
        if moved.where("moved").isEmpty():
            return assigned

"""Round B of near-dedup: what a region moves grows with its rows and outsiders, not with pairs."""

import random

from pyspark.sql import functions as F

from riskloom.llm import op2_minhash as op

ROWS = "tree int, key long, sig binary, marks binary, rep long, n long, common long, rare array<long>, component long, m long"


def test_one_large_component_and_one_outsider(spark):
    n = 50_000
    rows = spark.range(n + 1).select(
        F.lit(0).alias("tree"), F.lit(5).cast("long").alias("key"), F.lit(b"s").alias("sig"), F.lit(b"m").alias("marks"), F.col("id").alias("rep"), F.lit(9).cast("long").alias("n"), F.lit(9).cast("long").alias("common"),
        F.array().cast("array<long>").alias("rare"), F.when(F.col("id") == n, n).otherwise(0).cast("long").alias("component"), F.lit(n + 1).cast("long").alias("m"),
    )
    moved = op.dealt(rows)
    assert moved.count() == n + 1 + -(-n // op.BLOCK)  # the inner rows once, the outsider once a block and once beside other outsiders
    assert moved.groupBy("x", "y").count().agg(F.max("count")).first()[0] <= 1.5 * op.BLOCK
    assert op.dealt(rows.where("component = 0")).count() == 0


def test_all_pairs_across_components_meet_once_or_more(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 7)
    rng = random.Random(3)
    local = [(t, k, b"", b"", rep, 5, 5, [], 0 if rng.random() < 0.6 else rng.randrange(1, 12), 90) for t in range(2) for k in range(3) for rep in rng.sample(range(200), 60)]
    met = op.dealt(spark.createDataFrame(local, ROWS)).select("tree", "key", "x", "y", "rep", "component", "block").collect()
    groups = {}
    for r in met:
        groups.setdefault((r.tree, r.key, r.x, r.y), []).append(r)
    got = {(g[0], g[1], a.rep, b.rep) for g, rs in groups.items() for a in rs for b in rs if a.rep < b.rep and a.component != b.component and (g[2] == g[3] or a.block != b.block)}
    want = {(a[0], a[1], a[4], b[4]) for a in local for b in local if a[:2] == b[:2] and a[4] < b[4] and a[8] != b[8]}
    assert got == want

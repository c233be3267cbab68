"""The pipeline's stages over odd rows and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from riskloom.llm import common

SF = "/root/testdata/sf0.001"
#: Names that stages use for themselves, in other letters too.
CLASHES = ["LOG_RATIO", "log_ratio_", "kept_id", "Kept_Set", "DIGEST", "points", "place", "Set_Key", "hub", "rep", "salt", "component", "kept_digest", "kept", "KEY", "count", "Code", "part", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(13)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).collect()]
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n))
    base = [text(80) for _ in range(6)]
    near = base[0].split()
    near[40] = "changed"
    rows = [(1, None), (2, ""), (3, " \n"), (4, base[0]), (5, base[0]), (5, base[0]), (6, base[0].replace(" ", "\n")), (7, " ".join(near)), (8, base[1]), (8, base[2]), (None, base[3]), (None, base[3]), (None, None)]
    rows += [(9, base[4] + " " + items[0]), (10, text(30_000)), (11, "x" * 200_000), (12, base[5]), (13, base[5])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return d.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]).repartition(3)


def test_every_stage_takes_clashing_names_and_odd_rows(spark, docs):
    now, ids = docs, []
    for name, stage in p.STAGES[:-1]:
        out = common.materialise(stage(spark, now, SF), f"t-{name}")
        assert out.columns == docs.columns, name
        assert out.select(*CLASHES).distinct().collect() in ([], [tuple(range(len(CLASHES)))]), name
        ids.append(sorted((r.doc_id, r.text or "") for r in out.where("doc_id IS NOT NULL").collect()))
        now = out
    packed = p.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_each_stage_on_the_same_odd_rows(spark, docs):
    """Every stage on all rows, not only on what its predecessor leaves."""
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = [(r.doc_id, r.text) for r in common.materialise(p.exact(spark, docs, SF), "t").collect()]
    assert len(exact) == len({("".join((t or "").split())) for _, t in exact})  # one of each text
    assert {d for d, _ in exact} >= {4, 7, 8, 9, 10, 11, 12} and not {5, 6, 13} & {d for d, _ in exact} and sorted(d for d, _ in exact if d == 8) == [8, 8]
    near = [r.doc_id for r in common.materialise(p.near(spark, docs, SF), "t").collect()]
    assert not {5, 6, 7, 13} & set(near) and {1, 2, 3, 4, 8, 9, 10, 11, 12} <= set(near) and near.count(None) >= 2
    clean = [r.doc_id for r in common.materialise(p.decontaminate(spark, docs, SF), "t").collect()]
    assert 9 not in clean and len(clean) == docs.count() - 1
    quality = common.materialise(p.quality(spark, docs, SF), "t")
    assert quality.where("doc_id = 5").count() in (0, 2) and texts


def test_empty_table(spark, docs):
    now = docs.limit(0)
    for name, stage in p.STAGES:
        now = common.materialise(stage(spark, now, SF), f"t-{name}")
        assert now.count() == 0, name


def test_what_keeps_less_does_not_change_names(spark, docs):
    assert common.free_name(docs, "log_ratio") == "log_ratio__" and common.free_name(docs, "digest") == "digest_"

"""Layers of settings, and that each setting changes a result."""

import json

import pytest

from riskloom import config
from riskloom.config import Settings
from riskloom.functions import identity
from riskloom.operators import rules
from test_operators import FINDING


def test_layers_win_value_by_value(tmp_path):
    (tmp_path / ".riskloomrc.json").write_text(json.dumps({"sampling": {"maxFiles": 9, "maxChunksPerFile": "x"}, "chunking": {"exclude": []}, "unknown": 1, "stages": {"catalog": "yes"}}))
    s = Settings.load(str(tmp_path), given={"rules": {"hard": 7}}, environment={"RISKLOOM_SAMPLING_MAX_FILES": "11", "RISKLOOM_RULES_HARD": "5", "RISKLOOM_RULES_SOFT": "-2", "RISKLOOM_STAGES_STATIC": "off", "RISKLOOM_CHUNKING_INCLUDE_EXTENSIONS": "ts, .py", "RISKLOOM_FINDINGS_PRIOR": " "})
    assert s["sampling"] == {"max_files": 11, "max_chunks_per_file": 5} and s["rules"]["hard"] == 7 and s["rules"]["soft"] == 15
    assert s["chunking"]["exclude"] == [] and s["chunking"]["include_extensions"] == ["ts", ".py"] and s["stages"] == {"static": False, "rules": True, "composites": True, "catalog": True} and s["findings"]["prior"] == 40
    (tmp_path / "riskloom.config.json").write_text('{"sampling": {"max_files": 3}}')  # the first name is read
    assert Settings.load(str(tmp_path), environment={})["sampling"]["max_files"] == 3
    assert Settings.load(str(tmp_path), "none.json", environment={}).values == config.DEFAULTS == Settings().values


@pytest.mark.parametrize("value, default, want", [("5", 1, 5), (0, 1, None), (True, 1, None), ("no", True, False), ("maybe", True, None), (3, True, None), ("a,,b", [], ["a", "b"]), (4, [], None), (float("inf"), 1, None), (["x", 1], [], ["x", "1"])])
def test_values_need_the_type_of_the_default(value, default, want):
    assert config.typed(value, default) == want


def test_every_setting_changes_a_result(spark):
    table = spark.createDataFrame([("src/a.ts", 10, "x" * 300), ("src/b.lua", 10, "y"), ("dist/c.ts", 10, "z"), ("src/d.ts", 300_000, "w")], "path string, size long, content string")
    names = lambda s: sorted(r.path for r in s.eligible(table, "path", "size", "content").collect())
    assert names(Settings()) == ["src/a.ts"]
    assert names(Settings({"chunking": {"max_file_size_bytes": 400_000}})) == ["src/a.ts", "src/d.ts"]
    assert names(Settings({"chunking": {"includeExtensions": ["lua"]}})) == ["src/b.lua"]
    assert names(Settings({"chunking": {"exclude": ["src/**"]}})) == ["dist/c.ts"]
    long = spark.createDataFrame([("a", "\n".join("line of some words" for _ in range(200)))], "path string, content string")
    counts = [Settings({"chunking": c}).windows(long).count() for c in ({}, {"max_chars": 600}, {"overlap_chars": 600})]
    assert counts[0] < counts[1] and counts[0] < counts[2]
    chunks = spark.createDataFrame([(f"f{k // 6:03}", k) for k in range(600)], "path string, k long")
    sizes = [Settings({"sampling": c}).sample(chunks, "path", "k").count() for c in ({}, {"max_files": 7}, {"max_chunks_per_file": 2})]
    assert sizes == [400, 35, 160]
    rows = spark.createDataFrame([("a", k, 500) for k in range(40)], "key string, k long, tokens int")
    bins = [Settings({"understanding": c}).batches(rows, ["key"], "k", "tokens", 0).agg({"bin": "max"}).first()[0] + 1 for c in ({}, {"max_prompt_tokens": 1000}, {"max_batch_chunks": 4}, {"min_batch_chunks": 10})]
    assert bins == [5, 20, 10, 4]
    packed = [Settings({"rules": c}).pack(rows, ["key"], ["k"], "tokens", 0).where("packed").count() for c in ({}, {"max_prompt_tokens": 1000}, {"max_prompt_tokens": 10**6}, {"max_prompt_tokens": 10**6, "hard": 30}, {"max_prompt_tokens": 10**6, "hard": 3, "soft": 20})]
    assert packed == [13, 2, 25, 30, 20]
    quiet = spark.createDataFrame([("c", ["exec_sink"], "public", "api_handler")], "chunk_uid string, signals array<string>, exposure string, role string")
    chosen = [Settings({"rules": {"min_per_chunk": n}}).choose(quiet, rules.catalogue(spark)).count() for n in (1, 3, 5)]
    assert chosen[0] <= chosen[1] < 6 and chosen[2] >= chosen[1]
    flat = identity.flatten(spark.createDataFrame([(k, "idor", "llm", "low", None, f"s{k}", json.dumps({"filepath": f"f{k}.ts", "startLine": k + 1}), "{}") for k in range(100)], FINDING))
    assert [Settings(c).existing(flat).count() for c in ({}, {"findings": {"existing": 3}})] == [80, 3] and [Settings(c).prior(flat).count() for c in ({}, {"findings": {"prior": 4}})] == [40, 4]
    found = spark.createDataFrame([("a.ts",), ("dist/b.js",), ("c.py",)], "filepath string")
    assert [Settings({"static": c}).static(found).count() for c in ({}, {"extensions": ["py"]}, {"ignore": []})] == [1, 1, 2]
    parts = {"static": found, "rules": found, "catalog": found}
    assert [Settings({"stages": c}).together(parts).count() for c in ({}, {"catalog": True}, {"static": "no"})] == [6, 9, 3] and Settings({"stages": {"rules": False}}).together({"rules": found}) is None

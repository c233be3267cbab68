"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["identity_key", "rule_id", "severity", "rank", "n_places"] and df.count() > 0


def test_plans_push_down_and_avoid_products(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("point_in_interval", "smallest_enclosing", "max_overlap", "anti_existing", "near_titles", "rule_eligibility"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    plan = entry.queries()["token_estimate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = entry.queries()["discover_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(n_chars,20480)" in plan


def test_works_without_the_training_data_package(tmp_path):
    """The entry imports and lists its queries when the package and the pipeline are gone."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((ROOT / name).read_text())
    for f in (ROOT / "riskloom").rglob("*.py"):
        rel = f.relative_to(ROOT)
        if "llm" not in rel.parts:
            (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / rel).write_text(f.read_text())
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'top_findings' in e.queries() and not any(k.startswith('op') for k in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

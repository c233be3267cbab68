"""Known findings: what their key is made of is computed once a row."""

from riskloom.functions import identity
from riskloom.operators import projections


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_findings_build_their_key_once(spark):
    cols = "ord long, type string, source string, severity string, category string, summary string, location string, details string"
    rows = [(1, "idor", "llm", "high", None, "s", '{"file":"a.ts","line":3}', "{}"), (2, None, "llm", "high", None, "", "{}", "{}")]
    for whole in (False, True):
        shown = projections.worst_known(identity.flatten(spark.createDataFrame(rows, cols)), 5, whole_details=whole)
        assert not [x for x in _plan(shown).splitlines() if "Filter" in x and "from_json" in x]
        assert [r.ord for r in shown.collect()] == [1]

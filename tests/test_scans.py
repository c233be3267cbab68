"""Scan state kept by a stream: restarts, repeated rows and changed snapshots."""

import pytest

from riskloom.streaming import scans, signals

ROWS = "scope string, version long, hash string, task string, payload string, seq long"


@pytest.fixture
def stateful(spark):
    for k, v in scans.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k in scans.PROVIDER:
        spark.conf.unset(k)


def test_restart_repeats_and_a_changed_snapshot(stateful, tmp_path):
    spark, folder = stateful, str(tmp_path / "in")

    def batch(rows):
        """Adds rows and runs the stream for them, from its checkpoint."""
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ROWS).parquet(folder)
        out = str(tmp_path / "out")
        before = set() if not (tmp_path / "out").exists() else {tuple(r) for r in spark.read.parquet(out).collect()}
        signals.to_table(scans.scan_state(stream, 2), out, str(tmp_path / "cp")).awaitTermination(120)
        return {tuple(r) for r in spark.read.parquet(out).collect()} - before

    first = batch([("a", 1, "h1", "t1", "p1", 0), ("a", 1, "h1", "t2", "p2", 1), ("a", 1, "h1", "t1", "late", 2), ("b", 1, "x", "t1", "q1", 3)])
    assert first == {("a", "h1", "t1", "new", "p1"), ("a", "h1", "t2", "new", "p2"), ("a", "h1", "t1", "repeated", "p1"), ("b", "x", "t1", "new", "q1")}
    # after a restart: what was recorded is known, also under a later version of the same hash
    assert batch([("a", 2, "h1", "t1", "again", 4), ("a", 2, "h1", "t3", "p3", 5)]) == {("a", "h1", "t3", "new", "p3")} | {("a", "h1", "t1", "repeated", "p1")} - first
    # another hash clears the scope in every bucket, and only that scope; its older rows are stale
    rows = scans.announce(spark.createDataFrame([("a", 3, "h2")], "scope string, version long, hash string")).collect()
    got = batch([tuple(r) for r in rows] + [("a", 3, "h2", "t1", "n1", 6), ("a", 2, "h1", "t9", "old", 7), ("b", 1, "x", "t1", "q2", 8)])
    assert got == {("a", "h2", None, "cleared", None), ("a", "h2", "t1", "new", "n1"), ("a", "h1", "t9", "stale", None), ("b", "x", "t1", "repeated", "q1")}
    assert batch([("a", 3, "h2", "t2", "n2", 9), ("a", 3, "h2", "t1", "n3", 10)]) == {("a", "h2", "t2", "new", "n2"), ("a", "h2", "t1", "repeated", "n1")}

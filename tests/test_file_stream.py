"""Files as a stream: what is new, changed or deleted comes once."""

import os

from riskloom.sources import files
from riskloom.streaming import signals


def test_new_changed_and_deleted_files_once_each(spark, tmp_path):
    root, out = tmp_path / "tree", str(tmp_path / "out")
    (root / "src" / "deep").mkdir(parents=True)
    (root / "node_modules").mkdir()
    seen = set()

    def batch():
        """A run from the checkpoint; the rows that it added."""
        nonlocal seen
        signals.to_table(files.stream_files(spark, str(root), str(tmp_path / "state")), out, str(tmp_path / "cp")).awaitTermination(120)
        rows = {(r.path, r.status, r.content) for r in spark.read.parquet(out).collect()}
        fresh, seen = rows - seen, rows
        return fresh

    (root / "src" / "a.ts").write_text("one")
    (root / "src" / "deep" / "b.py").write_text("two")
    (root / "src" / "c.bin").write_text("no extension of ours")
    (root / "node_modules" / "d.ts").write_text("excluded")
    (root / "src" / "e.ts").write_bytes(b"\x00binary")
    assert batch() == {("src/a.ts", "new", "one"), ("src/deep/b.py", "new", "two")}
    assert batch() == set()
    (root / "src" / "a.ts").write_text("one more")
    os.remove(root / "src" / "deep" / "b.py")
    (root / "f.ts").write_text("three")
    assert batch() == {("src/a.ts", "changed", "one more"), ("src/deep/b.py", "deleted", None), ("f.ts", "new", "three")}
    (root / "src" / "deep" / "b.py").write_text("back")
    assert batch() == {("src/deep/b.py", "new", "back")}
    assert len([n for n in os.listdir(tmp_path / "state") if n.endswith(".json")]) <= 2  # older listings are gone


def test_one_large_folder_over_many_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"f{k:02}.ts").write_text("x" * 10_000)
    df = files.read_files(spark, str(tmp_path), taskBytes="50000")
    assert df.count() == 60 and df.rdd.getNumPartitions() >= 12
    assert files.read_files(spark, str(tmp_path), extensions="py").count() == 0


def test_a_batch_is_the_same_after_a_restart(tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.ts").write_text("1")
    options = {"path": str(tmp_path / "tree"), "state": str(tmp_path / "state")}
    reader = files._StreamReader(options)
    end = reader.latestOffset()
    (tmp_path / "tree" / "b.ts").write_text("2")  # comes after the offset was given
    again = files._StreamReader(options)
    assert [p.files for p in again.partitions({"listing": 0}, end)] == [[("a.ts", "new")]]
    later = again.latestOffset()
    assert later != end and [p.files for p in again.partitions(end, later)] == [[("b.ts", "new")]]
    again.commit(later)
    assert files._StreamReader(options).latestOffset() == later

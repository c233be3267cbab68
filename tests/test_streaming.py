"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from riskloom.functions import detectors
from riskloom.operators import chunking
from riskloom.streaming import signals

SCHEMA = "path string, content string"


def _write(spark, folder):
    rows = [(f"f{k}.ts", "\n".join(["const API_KEY = 'abcdefghijklmnop'", "app.get('/debug/x', h)"] * (k + 1))) for k in range(6)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder))


def test_stream_equals_batch(spark, tmp_path):
    _write(spark, tmp_path / "in")
    stream = signals.stream_signals(signals.read_texts(spark, str(tmp_path / "in"), SCHEMA, 1), size=4, overlap=1)
    signals.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    chunks = chunking.line_chunks(spark.read.parquet(str(tmp_path / "in")), size=4, overlap=1).withColumnRenamed("chunk", "c")
    batch = detectors.collect_signals(chunks, "chunk_uid", "c")
    key = lambda df: sorted((r.chunk_uid, r.signal_id) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(batch) and batch.count() > 0


def test_new_only_and_upserts(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    signals.upsert_to(signals.new_only(stream, ["k"], "ts"), lambda df, n: seen.extend(r.k for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == ["a", "b"]


def test_token_bucket(spark, tmp_path):
    rows = [("p", f"2024-01-01 00:00:0{k}") for k in range(5)] + [("q", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "provider string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("provider string, ts timestamp").parquet(str(tmp_path / "in"))
    signals.to_table(signals.budget_state(stream, 2, 2000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = [r.allowed for r in spark.read.parquet(str(tmp_path / "out")).where("provider = 'p'").orderBy("ts").collect()]
    assert got == [True, True, True, False, True]

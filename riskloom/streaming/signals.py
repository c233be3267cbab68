"""A stream of texts to signals, to findings that are new, to a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions import detectors
from riskloom.operators import chunking
from riskloom.shared import fresh_path


def read_texts(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def stream_signals(texts: DataFrame, path: str = "path", content: str = "content", size: int = 160, overlap: int = 40) -> DataFrame:
    """The signals of a stream's chunks; the same functions as in batch."""
    chunks = chunking.line_chunks(texts, path, content, size, overlap)
    return detectors.collect_signals(chunks.withColumnRenamed("chunk", "chunk_text"), "chunk_uid", "chunk_text")


def new_only(rows: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; state for older keys is dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def upsert_to(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Runs merge(batch, number) once for what there is; a batch that is repeated after a failure has the same number."""
    where = checkpoint or fresh_path(stream.sparkSession, "stream")
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", where).trigger(availableNow=True).start()


def to_table(stream: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Appends to Parquet files, exactly once by the sink's log."""
    where = checkpoint or fresh_path(stream.sparkSession, "stream")
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", where).trigger(availableNow=True).start()


def rate_limited(requests: DataFrame, limit: int, window: str = "1 minute") -> DataFrame:
    """(window, provider, n, over): how a stream of requests(ts, provider) stands to a limit of each window."""
    counts = requests.withWatermark("ts", "5 minutes").groupBy(F.window("ts", window), "provider").agg(F.count("*").alias("n"))
    return counts.select("window.start", "provider", "n", (F.col("n") > limit).alias("over"))


def budget_state(requests: DataFrame, capacity: int, refill_ms: int) -> DataFrame:
    """(provider, ts, allowed): a token bucket for each provider, kept as state between batches: full at first, one token back every refill_ms."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), 0)
        rows = []
        for ts in pd.concat([b["ts"] for b in batches]).sort_values():  # a group's times of one batch, however they come
            now = int(ts.timestamp() * 1000)
            tokens = min(float(capacity), tokens + max(0, now - last) / refill_ms) if last else tokens
            allowed = tokens >= 1
            tokens, last = tokens - allowed, max(last, now)
            rows.append((key[0], ts, allowed))
        state.update((float(tokens), last))
        yield pd.DataFrame(rows, columns=["provider", "ts", "allowed"])

    return requests.groupBy("provider").applyInPandasWithState(step, "provider string, ts timestamp, allowed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)

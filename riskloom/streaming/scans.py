"""The state of scans as keyed stream state: which tasks of a scope's current snapshot are done.

Rows name a scope, the version and hash of its snapshot, and a task with its result. A scope
keeps the results of its current snapshot; a later version with another hash clears them, one
with the same hash keeps them. A scope's tasks are dealt over `spread` buckets, each with a
map of its own, so that one large scope fills many tasks; a row without a task announces a
snapshot and goes to every bucket."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps maps; set it in the session of the query.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "scope string, hash string, task string, status string, payload string"
SPREAD = 16


class ScanState(StatefulProcessor):
    """Gives a row for each task: `new` (recorded now), `repeated` (recorded before; with what was
    recorded), `stale` (of a snapshot that is no longer current). A cleared bucket gives a row
    `cleared` without a task."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "version long, hash string")
        self.done = handle.getMapState("done", "task string", "payload string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        scope, batch = key[0], pd.concat(list(rows))  # a batch's rows of one bucket
        batch = batch.sort_values(["version", "seq"], kind="stable")
        version, name = self.current.get() if self.current.exists() else (None, None)
        out, top = [], batch.iloc[-1]
        if version is None or int(top["version"]) > version:
            if name is not None and top["hash"] != name:
                self.done.clear()
                out.append((scope, top["hash"], None, "cleared", None))
            version, name = int(top["version"]), top["hash"]
            self.current.update((version, name))
        for task, payload, hash_ in zip(batch["task"], batch["payload"], batch["hash"]):
            if task is None:
                continue
            if hash_ != name:
                out.append((scope, hash_, task, "stale", None))
            elif self.done.containsKey((task,)):
                out.append((scope, name, task, "repeated", self.done.getValue((task,))[0]))
            else:
                self.done.updateValue((task,), (payload,))
                out.append((scope, name, task, "new", payload))
        yield pd.DataFrame(out, columns=["scope", "hash", "task", "status", "payload"])

    def close(self) -> None:
        pass


def scan_state(results: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(scope, hash, task, status, payload) of a stream of results(scope, version, hash, task,
    payload, seq). The first of a task's results counts; rows of one batch come in order of
    version and seq, and a snapshot is current as soon as a row names it, with or without a task."""
    every = F.sequence(F.lit(0), F.lit(spread - 1))
    own = F.array(F.pmod(F.xxhash64("task"), F.lit(spread)).cast("int"))
    dealt = results.select("scope", "version", "hash", "task", F.coalesce("payload", F.lit("")).alias("payload"), "seq", F.explode(F.when(F.col("task").isNull(), every).otherwise(own)).alias("bucket"))
    return dealt.groupBy("scope", "bucket").transformWithStateInPandas(statefulProcessor=ScanState(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def announce(snapshots: DataFrame) -> DataFrame:
    """Rows of scan_state() that only name snapshots(scope, version, hash); a hash that no snapshot has forgets a scope."""
    none = F.lit(None).cast("string")
    return snapshots.select("scope", "version", "hash", none.alias("task"), none.alias("payload"), F.lit(-1).cast("long").alias("seq"))

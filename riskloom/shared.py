"""Tables written to the folder that the whole cluster shares, and what is iterated over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary
    folder, and only with a local master: other machines could not see it."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local_root = _local_root or tempfile.mkdtemp(prefix="riskloom-")
    return _local_root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/riskloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs, and tasks
    repeated after a lost executor, start from the files."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest
    node reachable. Each round hooks every root to its smallest neighbouring
    root, follows the hooks to the end and keeps only edges between different
    roots, so the graph shrinks geometrically. Rounds are cut by written tables;
    no edge comes to the driver."""
    links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    label = None
    while not links.isEmpty():
        hooks = materialise(links.groupBy("a").agg(F.min("b").alias("p")).withColumnRenamed("a", "r"), f"{name}-hooks")
        while True:  # pointer jumping
            up = hooks.select(F.col("r").alias("p"), F.col("p").alias("pp"))
            jumped = materialise(hooks.join(up, "p", "left").select("r", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), f"{name}-jump")
            done = jumped.where("moved").isEmpty()
            hooks = jumped.select("r", "p")
            if done:
                break
        roots = hooks.select(F.col("r").alias("x"), F.col("p").alias("root"))
        step = (
            links.join(roots.withColumnRenamed("x", "a"), "a", "left").select("b", F.coalesce("root", "a").alias("a"))
            .join(roots.withColumnRenamed("x", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
            .where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        links = materialise(step, f"{name}-links")
        if label is None:
            current = roots
        else:
            moved = label.join(roots.withColumnRenamed("x", "l"), "l", "left").select("x", F.coalesce("root", "l").alias("root"))
            current = moved.union(roots.join(label.select("x"), "x", "left_anti"))
        label = materialise(current.select("x", F.col("root").alias("l")), f"{name}-labels")
    if label is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(label.withColumnRenamed("x", "node"), "node", "left").select("node", F.coalesce("l", "node").alias("component"))

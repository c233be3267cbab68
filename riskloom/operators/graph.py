"""Call-graph operators: decoding, valid edges, reachability and neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.shared import connected_components, materialise

__all__ = ["components", "decode_functions", "decode_edges", "valid_edges", "reachability", "reachable_anchors", "neighbourhood", "call_names"]

components = connected_components


def decode_functions(graph: DataFrame) -> DataFrame:
    """(id, file, start_line, start_col, end_line, end_col) of a call graph with
    files ARRAY and functions MAP<id, "file:line:col:line:col">; "?" is unknown."""
    each = graph.select("files", F.explode("functions").alias("id", "spec"))
    parts = F.split("spec", ":")
    number = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    out = each.select("id", F.get("files", number(1)).alias("file"), number(2).alias("start_line"), number(3).alias("start_col"), number(4).alias("end_line"), number(5).alias("end_col"))
    return out.where("file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")


#: Spellings of an edge's ends.
FROM, TO = ["from", "source", "caller", "src"], ["to", "target", "callee", "dst"]


def decode_edges(raw: DataFrame, column: str = "edges") -> DataFrame:
    """(src, dst) from JSON text in four shapes: [[a, b]], [{from, to}], {a: [b]} and {a: {calls: [b]}}."""
    c = F.col(column)
    pairs = F.from_json(c, "array<array<string>>")
    objects = F.from_json(c, "array<map<string,string>>")
    lists = F.from_json(c, "map<string,array<string>>")
    calls = F.from_json(c, "map<string,struct<calls:array<string>>>")
    named = lambda keys: F.coalesce(*[F.try_element_at("o", F.lit(k)) for k in keys])
    shape = F.when(c.rlike(r"^\s*\[\s*\["), "pairs").when(c.rlike(r"^\s*\["), "objects").when(c.rlike(r"^\s*\{\s*\"[^\"]*\"\s*:\s*\["), "lists").otherwise("calls")
    rows = raw.withColumn("shape", shape)
    return reduce(DataFrame.unionByName, [
        rows.where("shape = 'pairs'").select(F.explode(pairs).alias("p")).select(F.get("p", F.lit(0)).alias("src"), F.get("p", F.lit(1)).alias("dst")),
        rows.where("shape = 'objects'").select(F.explode(objects).alias("o")).select(named(FROM).alias("src"), named(TO).alias("dst")),
        rows.where("shape = 'lists'").select(F.explode(lists).alias("src", "l")).select("src", F.explode("l").alias("dst")),
        rows.where("shape = 'calls'").select(F.explode(calls).alias("src", "s")).select("src", F.explode("s.calls").alias("dst")),
    ]).where("src IS NOT NULL AND dst IS NOT NULL")


def valid_edges(edges: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Distinct edges whose ends both exist."""
    known = nodes.select(node).distinct()
    src, dst = known.withColumnRenamed(node, "src"), known.withColumnRenamed(node, "dst")
    return edges.select("src", "dst").distinct().join(src, "src", "left_semi").join(dst, "dst", "left_semi")


def reachability(edges: DataFrame, starts: DataFrame, max_depth: int = 8, max_labels: int = 3) -> DataFrame:
    """(node, labels, min_depth): breadth-first from starts(node, label, ord) along
    edges(src, dst). A node keeps its `max_labels` nearest labels, of equally near ones the
    first by ord, and passes on these alone: a label that a node does not keep comes behind
    the kept ones at every node reached through it as well. So each node is expanded for
    max_labels labels at most, however many starts there are. A depth costs one join with the
    edges, one aggregate and one ranking; lineage is cut by a written table at each depth."""
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    nearest = lambda rows: rows.withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy("depth", "ord", "label"))).where(F.col("rn") <= max_labels).drop("rn")
    seen = frontier = materialise(nearest(starts.groupBy("node", "label").agg(F.min("ord").alias("ord")).withColumn("depth", F.lit(0))).select("node", "label", "ord", "depth"), "reach")
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src"), "label", "ord").join(edges, "src").select(F.col("dst").alias("node"), "label", "ord", F.lit(depth).alias("depth"))
        # what a node holds has smaller depths and so keeps its places; only what is left goes to new labels
        each = seen.unionByName(step).groupBy("node", "label").agg(F.min("ord").alias("ord"), F.min("depth").alias("depth"))
        frontier = materialise(nearest(each).where(F.col("depth") == depth).select("node", "label", "ord", "depth"), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    labels = F.array_sort(F.collect_list(F.struct("depth", "ord", "label")))  # max_labels at most
    return seen.groupBy("node").agg(F.transform(labels, lambda x: x["label"]).alias("labels"), F.min("depth").alias("min_depth"))


def reachable_anchors(reached: DataFrame, anchors: DataFrame, max_labels: int = 3) -> DataFrame:
    """(anchor_id, labels, min_depth) of reachability() rows and anchors(node, anchor_id, ord):
    nodes of one anchor give their labels in turn, the first max_labels different ones stay."""
    rows = anchors.join(reached, "node").select("anchor_id", "ord", "min_depth", F.posexplode("labels").alias("pos", "label"))
    each = rows.groupBy("anchor_id", "label").agg(F.min(F.struct("ord", "pos")).alias("at"), F.min("min_depth").alias("min_depth"))
    depth = rows.groupBy("anchor_id").agg(F.min("min_depth").alias("min_depth"))
    kept = each.withColumn("rn", F.row_number().over(W.partitionBy("anchor_id").orderBy("at"))).where(F.col("rn") <= max_labels)
    listed = kept.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]).alias("labels"))
    return listed.join(depth, "anchor_id").select("anchor_id", "labels", "min_depth")


def neighbourhood(edges: DataFrame, nodes: DataFrame, node: str = "id", group: str = "file", max_depth: int = 2, most: int = 6) -> DataFrame:
    """(node, other, depth): other nodes of the same group within max_depth calls in either
    direction, nearest first, `most` for each node. A node passes on its most + 1 nearest
    alone: what comes behind these at the node comes behind as many at every neighbour. Only
    nodes that still have room take part in the next hop, so a hub costs its edges and no
    pairs of them."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    home = nodes.select(F.col(node).alias("n"), F.col(group).alias("g"))
    inside = both.join(home.withColumnsRenamed({"n": "src", "g": "g1"}), "src").join(home.withColumnsRenamed({"n": "dst", "g": "g2"}), "dst")
    inside = materialise(inside.where("g1 = g2 AND src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("via")), "neighbours")
    nearest = lambda rows, n: rows.withColumn("rn", F.row_number().over(W.partitionBy("node").orderBy("depth", "other"))).where(F.col("rn") <= n).drop("rn")
    known = materialise(nearest(inside.select("node", F.col("via").alias("other"), F.lit(1).alias("depth")), most + 1), "near")
    for _ in range(2, max_depth + 1):
        full = known.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > most)
        hop = inside.join(full, "node", "left_anti").join(known.withColumnRenamed("node", "via"), "via").where("node <> other").select("node", "other", (F.col("depth") + 1).alias("depth"))
        known = materialise(nearest(known.unionByName(hop).groupBy("node", "other").agg(F.min("depth").alias("depth")), most + 1), "near")
    return nearest(known, most)


def call_names(functions: DataFrame, key: str, content: str, symbols: DataFrame, symbol: str = "symbol", most: int = 6) -> DataFrame:
    """(key, symbol): the first known symbols that a text calls."""
    calls = functions.select(key, F.posexplode(F.array_distinct(F.regexp_extract_all(content, F.lit(r"\b([A-Za-z_$][\w$]*)\s*\("), 1))).alias("pos", symbol))
    known = calls.join(symbols.select(symbol).distinct(), symbol)
    return known.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("pos"))).where(F.col("rn") <= most).select(key, symbol, "pos")

"""MinHash near-dedup with an LSH forest.

A document's set holds its distinct word shingles. Sets of equal content are one
class, compared once. A signature of minima is read in several orders (rotations
by `depth` values); in each order it is a path of a tree, and sorting by the path
brings the longest common prefixes together. A region is what shares the first
`depth` values; there are so many trees that a pair at the threshold shares no
region with probability `miss` at most.

Round A: in each sorted order a row and its neighbour of the longer common prefix are
candidates, and so are the rows of a region and its most central one. A region with
more than STRETCH rows is read deeper: it is cut where neighbours share the fewest
values, again and again, each part to the depth that it needs, and every part's
central row is a candidate with the others of the part. Candidate pairs whose
signatures agree too little are put aside (again with `miss`), the others are verified
on full sets. Verified links give components.
Round B makes the result exact across components: every region that still holds two
of them gives the pairs across them that can still be links, each in the first region
that both share. In large regions an exact bound keeps their number down: a pair
shares no more than the lesser number of common shingles plus the rare ones that both
have (rare: RARE sets of large regions at most have it). So only rows whose common
shingles alone could suffice meet there, the rows outside of the region's largest component all
others, those within it only these, dealt in blocks; the rest can
only be linked by a rare shingle, and meet in a bucket of such shingles, RARE rows
for each, whatever the size of the region. Pairs are verified too. So no link is lost
to the choice of candidates in round A, and copies are never expanded into all pairs.

Words stand between white space, A-Z lower-cased; a text of fewer words than a
shingle has its whole sequence as one.

Cases: null or empty texts have an empty set and stay alone; very long texts are read
whole, and their sets compared whole; a null doc_id is linked with nothing; rows that
share a doc_id are one document when their sets are equal, and rows of their own
otherwise; the smallest doc_id stands for a component, ties there being copies; an
empty table gives no rows; further columns are ignored, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, connected_components, free_name, materialise, shingle_hashes, space_words

DEPTH, MISS = 4, 1e-6
STRETCH, BLOCK, PER_SALT, LARGE, RARE = 64, 1024, 128, 64, 32
TOKENS = 1 << 20  # stands for a tree where rows meet by a rare shingle
_hash = WordHash()


def trees_for(share: float, depth: int = DEPTH, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - share**depth))


def least_agreeing(n: int, share: float, miss: float = MISS) -> int:
    """The largest m with P(Binomial(n, share) < m) <= miss."""
    total, m = 0.0, 0
    while (total := total + math.comb(n, m) * share**m * (1 - share) ** (n - m)) <= miss:
        m += 1
    return m


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(_hash.of(space_words(text)), size))


def factors(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"minhash %d" % k) | 1 for k in range(n)], np.uint64)[:, None]


def signature(shingles: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the minima of h * factor."""
    out = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[None, k : k + 2048] * factor).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, size: int, n_trees: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, keys): set_key names the whole set, keys
    the first `DEPTH` values in each order, sig has a byte of each value."""
    factor = factors(n_trees * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sizes, names, sigs, keys = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_set(text, size)
                    sizes.append(len(s))
                    if not len(s):
                        names.append(None), sigs.append(None), keys.append(None)
                        continue
                    v = signature(s, factor)
                    names.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sigs.append(v.astype(np.uint8).tobytes())
                    keys.append(np.array([xxhash.xxh3_64_intdigest(v[j : j + DEPTH].tobytes()) for j in range(0, len(v), DEPTH)], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig", "keys"]
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(plain.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, keys array<long>"), "minhash")


def _runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal (tree, key), the batch's first columns."""
    tree, key = b.column(0).to_numpy(), b.column(1).to_numpy()
    first = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1])])
    return first, np.r_[first[1:], len(tree)]


def _bytes(column: pa.Array) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)


def prefix_lengths(path: np.ndarray) -> np.ndarray:
    """For each row of the sorted paths, the values it shares with the row before from the left (0 for the first)."""
    if len(path) < 2:
        return np.zeros(len(path), np.int64)
    differs = path[1:] != path[:-1]
    return np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), path.shape[1])]


def subtrees(lcp: np.ndarray, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """The stretches of rows lo..hi-1, as deep in the tree as it takes for at most `most`
    rows each: a larger one is cut where neighbours share the least. Rows with equal paths
    cannot be told apart by depth and are cut by number."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= most:
            out.append((lo, hi))
            continue
        inner = lcp[lo + 1 : hi]
        least = inner.min()
        cuts = lo + 1 + np.flatnonzero(inner == least) if least < inner.max() else np.arange(lo + most, hi, most)
        todo += zip([lo, *cuts.tolist()], [*cuts.tolist(), hi])
    return sorted(out)


def forest_edges(rows: DataFrame, least: int, share: int) -> DataFrame:
    """Round A: candidate pairs (hub, rep) of rows(tree, key, path, rep, n) in path order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path, rep, n = _bytes(b.column(2)), b.column(3).to_numpy(), b.column(4).to_numpy()
            lcp, hubs, others = prefix_lengths(path), [], []
            for lo, hi in zip(*_runs(b)):
                if hi - lo < 2:
                    continue
                # each row and its neighbour of the longer common prefix
                ahead, behind = np.r_[lcp[lo + 1 : hi], -1], np.r_[-1, lcp[lo + 1 : hi]]
                i = np.arange(lo, hi)
                near = np.where(ahead > behind, i + 1, i - 1)
                hubs.append(np.minimum(i, near)), others.append(np.maximum(i, near))
                if hi - lo > 2:
                    probe = path[np.linspace(lo, hi - 1, min(16, hi - lo)).astype(int)]
                    agree = np.concatenate([(path[a : min(hi, a + 512), None, :] == probe[None]).sum(axis=(1, 2)) for a in range(lo, hi, 512)])
                    top = lo + int(np.argmax(agree))
                    leaves = subtrees(lcp, lo, hi, STRETCH)
                    hubs.append(np.full(hi - lo, top)), others.append(i)
                    for a, z in leaves if len(leaves) > 1 else ():
                        hubs.append(np.full(z - a, a + int(np.argmax(agree[a - lo : z - lo])))), others.append(np.arange(a, z))
            if not hubs:
                continue
            i, j = np.concatenate(hubs), np.concatenate(others)
            ok = (rep[i] != rep[j]) & (np.minimum(n[i], n[j]) * 100 >= share * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            ok = (path[i] == path[j]).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([pa.array(rep[i[ok]]), pa.array(rep[j[ok]])], ["hub", "rep"])

    ordered = rows.select("tree", "key", "path", "rep", "n").repartitionByRange("tree", "key", "path", "rep").sortWithinPartitions("tree", "key", "path", "rep")
    pairs = ordered.mapInArrow(run, "hub long, rep long")
    # a pair found from both ends is verified once
    return pairs.groupBy(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).agg(F.min("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("rep"))


MET = ["tree", "key", "x", "y", "sig", "marks", "rep", "n", "common", "rare", "component", "block"]


def dealt(able: DataFrame) -> DataFrame:
    """Rows of the regions that hold several components, in groups (x, y) of two blocks. A
    region's largest component is within; its rows meet the outsiders alone, and these meet
    all. So a region of n rows with o outsiders moves n * ceil(o / BLOCK) + o * ceil(n / BLOCK)
    rows, however large its one component is."""
    per = able.groupBy("tree", "key", "component").agg(F.count("*").alias("rows"))
    open_ = per.groupBy("tree", "key").agg(F.sum("rows").alias("rows"), F.max(F.struct("rows", "component")).alias("most")).where("rows > most.rows")
    out, within = F.ceil((F.col("rows") - F.col("most.rows")) / BLOCK).cast("int"), F.ceil(F.col("most.rows") / BLOCK).cast("int")
    open_ = open_.select("tree", "key", F.col("most.component").alias("main"), out.alias("out"), within.alias("within"))
    at = F.xxhash64("rep")
    inner = F.col("component") == F.col("main")
    home = F.when(inner, F.col("out") + F.pmod(at, F.col("within"))).otherwise(F.pmod(at, F.col("out"))).cast("int")
    others = F.when(inner, F.sequence(F.lit(0), F.col("out") - 1)).otherwise(F.sequence(F.lit(0), F.col("out") + F.col("within") - 1))
    met = able.join(open_, ["tree", "key"]).withColumn("block", home).withColumn("other", F.explode(others))
    return met.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).withColumn("rare", F.lit(None).cast("array<long>")).select(*MET)


def cross_pairs(rows: DataFrame, least: int, share: int) -> DataFrame:
    """Round B: pairs (hub, rep) across components that can be links; rows(tree, key, sig,
    marks, rep, n, common, rare, component, m): marks holds the key in each order, common
    the number of shingles that are not rare, m the region's size. A row of a large region
    that has too few common shingles for any partner can only be linked by rare ones."""
    by_common = dealt(rows.where((F.col("m") <= LARGE) | (F.col("common") * 100 >= F.col("n") * share)))
    few = materialise(rows.where("size(rare) > 0").drop("tree", "key", "m").dropDuplicates(["rep"]), "minhash-rare")
    buckets = max(1, (few.agg(F.sum(F.size("rare")).alias("n")).first()["n"] or 0) // BLOCK)
    met = few.withColumn("key", F.explode(F.array_distinct(F.transform("rare", lambda t: F.pmod(t, F.lit(buckets))))))
    by_rare = met.withColumn("tree", F.lit(TOKENS)).withColumn("x", F.lit(buckets)).withColumn("y", F.lit(0)).withColumn("block", F.lit(0)).select(*MET)

    def close(i: np.ndarray, j: np.ndarray, sig: np.ndarray) -> np.ndarray:
        return np.concatenate([(sig[i[k : k + 65536]] == sig[j[k : k + 65536]]).sum(axis=1) >= least for k in range(0, len(i), 65536)] or [np.empty(0, bool)])

    def by_common_shingles(table: pa.Table, tree: int, two_blocks: bool) -> pa.RecordBatch:
        n, common, component, block, rep = (table.column(c).to_numpy() for c in ("n", "common", "component", "block", "rep"))
        order = np.argsort(n, kind="stable")
        n, common, component, block, rep = n[order], common[order], component[order], block[order], rep[order]
        # n_j is at most what keeps the common shingles of i above t/(1+t) of both sizes, and at most n_i/t
        ends, left, right = np.searchsorted(n, np.minimum(common * (100 + share) // share - n, n * 100 // share), side="right"), [], []
        for i in np.flatnonzero(ends > np.arange(len(n)) + 1):
            j = np.arange(i + 1, ends[i])
            j = j[(component[j] != component[i]) & (common[j] * (100 + share) >= share * (n[i] + n[j]))]
            j = j[block[j] != block[i]] if two_blocks else j
            left.append(np.full(len(j), i)), right.append(j)
        i, j = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), "<i8").reshape(len(n), -1)[order]
        first = np.concatenate([~(marks[i[k : k + 65536], :tree] == marks[j[k : k + 65536], :tree]).any(axis=1) for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
        ok = first & close(i, j, _bytes(table.column("sig"))[order])
        return pa.RecordBatch.from_arrays([pa.array(rep[i[ok]]), pa.array(rep[j[ok]])], ["hub", "rep"])

    def by_rare_shingles(table: pa.Table, bucket: int, buckets: int) -> pa.RecordBatch:
        n, common, component, rep = (table.column(c).to_numpy() for c in ("n", "common", "component", "rep"))
        lists, at = [set(t) for t in table.column("rare").to_pylist()], {}
        for k, tokens in enumerate(lists):
            for t in tokens:
                if t % buckets == bucket:
                    at.setdefault(t, []).append(k)
        pairs = {(a, b) for ks in at.values() for a, b in combinations(ks, 2) if component[a] != component[b]}  # RARE sets a token at most
        i, j = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        both = np.array([len(lists[a] & lists[b]) for a, b in zip(i, j)], np.int64)
        ok = (np.minimum(n[i], n[j]) * 100 >= share * np.maximum(n[i], n[j])) & ((np.minimum(common[i], common[j]) + both) * (100 + share) >= share * (n[i] + n[j]))
        i, j = i[ok], j[ok]
        ok = close(i, j, _bytes(table.column("sig")))
        return pa.RecordBatch.from_arrays([pa.array(rep[i[ok]]), pa.array(rep[j[ok]])], ["hub", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of (tree, key, x, y) may go on in the next batch; one holds two blocks, or a bucket of tokens, at most."""
        name, held = None, []

        def pairs() -> pa.RecordBatch:
            tree, key, x, y = name
            table = pa.concat_tables(held)
            return by_rare_shingles(table, key, x) if tree == TOKENS else by_common_shingles(table, tree, x != y)

        for b in batches:
            if not b.num_rows:
                continue
            table, cols = pa.Table.from_batches([b]), [b.column(c).to_numpy() for c in range(4)]
            first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            for lo, hi in zip(first, np.r_[first[1:], b.num_rows]):
                now = tuple(int(c[lo]) for c in cols)
                if now != name and held:
                    yield pairs()
                    held = []
                name = now
                held.append(table.slice(lo, hi - lo))
        if held:
            yield pairs()

    group = ["tree", "key", "x", "y"]
    placed = by_common.union(by_rare).repartition(*group).sortWithinPartitions(*group)
    return placed.mapInArrow(run, "hub long, rep long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """(a, b) of pairs(hub, rep) with 100 * intersection >= share * union, on full
    sets: hubs lie in front of the texts they are compared with, large hubs in
    several places."""
    pairs = materialise(pairs, "minhash-pairs")
    degree = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    ends = pairs.join(degree, "hub").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")).drop("salts").join(texts, "rep").select("hub", "salt", F.lit(1).alias("kind"), "rep", "text")
    fronts = degree.join(texts.withColumnRenamed("rep", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("hub").alias("rep"), "text")
    placed = ends.union(fronts).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = None
        for b in batches:
            hub, kind, rep, text = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            a, z = [], []
            for k in range(len(hub)):
                s = shingle_set(text[k].as_py(), size)
                if kind[k] == 0:
                    front = s
                    continue
                both = len(np.intersect1d(front, s, assume_unique=True))
                if 100 * both >= share * (len(front) + len(s) - both):
                    a.append(hub[k]), z.append(rep[k])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return materialise(placed.mapInArrow(run, "a long, b long"), "minhash-links")


def rare_shingles(texts: DataFrame, size: int) -> DataFrame:
    """(rep, n_rare, rare): a set's shingles that RARE sets of texts have at most: how many, and those that more than one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])

    tokens = materialise(texts.select("rep", "text").mapInArrow(run, "rep long, shingle long"), "minhash-tokens")
    counted = materialise(tokens.groupBy("shingle").agg(F.count("*").alias("df"), F.min("rep").alias("rep")).where(F.col("df") <= RARE), "minhash-shingles")
    # a shingle that one set has names it already; only the others are looked for
    few = tokens.join(counted.where("df > 1").select("shingle"), "shingle").select("rep", "shingle").union(counted.where("df = 1").select("rep", F.lit(None).cast("long")))
    return few.groupBy("rep").agg(F.count("*").alias("n_rare"), F.collect_list("shingle").alias("rare"))


def near_dedup(docs: DataFrame, size: int = 3, share: int = 85, depth: int = DEPTH) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links of at least share/100 similarity), kept."""
    return near_sets(docs, size, share, depth).drop("set_key")


def near_sets(docs: DataFrame, size: int, share: int, depth: int = DEPTH) -> DataFrame:
    """near_dedup with the key of each row's set."""
    n_trees = trees_for(share / 100, depth)
    least = least_agreeing(n_trees * depth, share / 100)
    sigs = signatures(docs, size, n_trees)
    named = sigs.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = materialise(named.join(classes, ["set_key"]).where("doc_id = rep").dropDuplicates(["set_key"]).select("rep", F.col("n_shingles").alias("n"), "set_key", "sig", "keys"), "minhash-reps")
    light = reps.select("rep", F.posexplode("keys").alias("tree", "key"))
    regions = materialise(light.groupBy("tree", "key").agg(F.count("*").alias("m")).where("m > 1"), "minhash-regions")
    members = materialise(light.join(regions, ["tree", "key"]), "minhash-members")
    near = members.select("rep").distinct()
    text_of = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    # rows that share a doc_id: the text whose set stands for the class cannot be told by doc_id alone
    texts = materialise(_texts(text_of.join(near, "rep", "left_semi"), reps, size), "minhash-texts")

    path = lambda: F.concat(F.expr(f"substring(sig, tree * {depth} + 1)"), F.expr(f"substring(sig, 1, tree * {depth})"))
    signed = members.join(reps.select("rep", "n", "sig"), "rep").withColumn("path", path()).drop("sig")
    links = verify(forest_edges(signed, least, share), texts, size, share)

    component = materialise(connected_components(links, "minhash-a"), "minhash-components").select(F.col("node").alias("rep"), "component")
    placed = members.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("tree", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("tree", "key")
    left = materialise(placed.join(open_, ["tree", "key"], "left_semi"), "minhash-open")
    large = left.groupBy("rep").agg(F.max("m").alias("m")).where(F.col("m") > LARGE).select("rep")
    rare = rare_shingles(texts.join(large, "rep", "left_semi"), size)
    marks = F.expr("unhex(array_join(transform(keys, k -> lpad(hex(k), 16, '0')), ''))")
    facts = reps.select("rep", "n", "sig", marks.alias("marks")).join(rare, "rep", "left").withColumn("common", F.col("n") - F.coalesce("n_rare", F.lit(0))).drop("n_rare")
    rest = left.join(facts, "rep")
    # in a small region not all members need be among those whose shingles were counted
    counted = F.col("m") > LARGE
    rest = rest.withColumn("common", F.when(counted, F.col("common")).otherwise(F.col("n"))).withColumn("rare", F.when(counted, F.col("rare")))
    more = verify(cross_pairs(rest, least, share), texts, size, share)
    if not more.isEmpty():
        component = materialise(connected_components(links.union(more), "minhash-b"), "minhash-components").select(F.col("node").alias("rep"), "component")
    by_class = classes.join(component, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "set_key", known.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def set_keys(docs: DataFrame, size: int, name: str) -> DataFrame:
    """docs with the key of each row's set as column `name`."""
    place, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s := shingle_set(t, size)) else None for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.binary())], [*b.schema.names, name])

    return docs.mapInArrow(key, schema)


def _texts(texts: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(rep, text), one row for each rep: of rows that share a doc_id, any with the class's set."""
    if texts.groupBy("rep").count().where("count > 1").isEmpty():
        return texts
    return set_keys(texts, size, "set_key").join(reps.select("rep", "set_key"), ["rep", "set_key"], "left_semi").dropDuplicates(["rep"]).select("rep", "text")


def one_of_each(docs: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each component, with all their columns;
    of rows that share a doc_id and the set, one stays."""
    stay = near_sets(docs, size, share).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("set_key").alias("kept_set")).distinct()
    same_id = docs["doc_id"].cast("long").eqNullSafe(stay["kept_id"])
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(stay, same_id, "left_semi")
    name = free_name(docs, "set_key")
    keyed = set_keys(docs, size, name)
    out = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay["kept_id"]) & keyed[name].eqNullSafe(stay["kept_set"]), "left_semi")
    return out.dropDuplicates(["doc_id", name]).select(*docs.columns)

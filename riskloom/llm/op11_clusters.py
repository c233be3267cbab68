"""Centroid clustering over space-filling-curve zone maps.

Vectors become whole numbers and get a Hilbert key of BITS bits a component, taken between
the component's least and largest value. In the order of the keys they are written in
blocks of BLOCK vectors, each with its box: the least and largest value of every component.
In a round, a block's box bounds its vectors' distances to each centroid from below and
above; only centroids whose lower bound is not above the smallest upper bound are the
block's candidates, and its vectors are compared with these exactly. A task gives a row for
each centroid: count, sums and distances; these meet in partial sums, and one row a
centroid comes to the driver. Equal keys are dealt over several ranges, so that copies of
one vector do not fill one task.

Distances are squared, in 64-bit integers (in doubles where all steps are whole numbers
below 2^53). Of equally near centroids the smaller number is taken. A round that moves no
centroid ends the rounds: further ones would give the same.

Cases: null vectors, vectors of another length and those with a null or non-finite
component are left out; vectors with a null vec_id take part but start no centroid unless
there are too few others; repeated rows count each, and of rows with the same vec_id the
smaller vector starts first; with fewer vectors than centroids each starts one; an empty
table gives no row; further columns are ignored, whatever their names. A component beyond
2^27 in size raises an error, for the squared distances need not fit 64 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
BITS, BLOCK, LARGEST = 4, 128, 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The keys of cells (rows of whole numbers below 2^bits) on a Hilbert curve, as rows of
    bytes: inversions and exchanges from the highest bit down, then a Gray code whose bits
    are interleaved."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = np.uint32((1 << b) - 1)
        for i in range(n):
            inverts = (x[i] >> np.uint32(b)) & np.uint32(1) == 1
            change = np.where(inverts, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverts, low, change)
            if i:
                x[i] ^= change
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint32(b)) & np.uint32(1) == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as whole numbers, written."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    kept = plain.where((F.size("e") == dim) & finite)
    return materialise(kept.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v")), "whole-vectors")


def first_centroids(whole: DataFrame, most: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of their ids: `most` rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.orderBy(F.asc_nulls_last(name), "v").limit(most).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def zone_map(whole: DataFrame, least: np.ndarray, largest: np.ndarray, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(lo, hi, ids, known, vectors), written: blocks in Hilbert order with their boxes."""
    dim = len(least)
    width = (largest - least) // (1 << bits) + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                keys = hilbert_keys((_matrix(part.column(1), dim) - least) // width, bits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in keys], pa.binary())], ["vec_id", "v", "key"])

    def row(ids: np.ndarray, known: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        blobs = [v.min(axis=0).astype("<i4"), v.max(axis=0).astype("<i4"), ids.astype("<i8"), known.astype(np.uint8), v.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blobs], ["lo", "hi", "ids", "known", "vectors"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, bool), np.empty((0, dim), np.int64))
        for b in batches:
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            held = tuple(np.concatenate(pair) for pair in zip(held, (ids, known, _matrix(b.column(1), dim))))
            full = len(held[0]) // block * block
            for k in range(0, full, block):
                yield row(*(x[k : k + block] for x in held))
            held = tuple(x[full:] for x in held)
        if len(held[0]):
            yield row(*held)

    placed = whole.mapInArrow(keyed, "vec_id long, v array<long>, key binary").withColumn("spread", F.xxhash64("vec_id", F.monotonically_increasing_id()))
    ordered = placed.repartitionByRange("key", "spread").sortWithinPartitions("key", "spread").select("vec_id", "v")
    return materialise(ordered.mapInArrow(blocks, "lo binary, hi binary, ids binary, known binary, vectors binary"), "zone-map")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each box and centroid whether it can be nearest to a vector in the box."""
    below, above = lo[:, None] - centroids[None], centroids[None] - hi[:, None]
    nearest = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(below), np.abs(above))
    least, most = (nearest * nearest).sum(axis=2), (farthest * farthest).sum(axis=2)
    return least <= most.min(axis=1)[:, None]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centroid, squared distance) of each vector, exactly."""
    largest = max(int(np.abs(v).max()), int(np.abs(centroids).max()), 1)
    if v.shape[1] * (2 * largest) ** 2 < 1 << 53:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(v)), at].astype(np.int64)


def _assigned(b: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, known, vectors, cluster, distance) of each block of a batch (lo, hi, ids, known, vectors)."""
    dim = centroids.shape[1]
    for k in range(0, b.num_rows, 64):
        part = b.slice(k, 64)
        lo, hi = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<i4").astype(np.int64).reshape(-1, dim) for c in (0, 1))
        for n, can in enumerate(candidates(lo, hi, centroids)):
            some = np.flatnonzero(can)
            v = np.frombuffer(part.column(4)[n].as_py(), "<i4").astype(np.int64).reshape(-1, dim)
            at, distance = nearest(v, centroids[some])
            yield np.frombuffer(part.column(2)[n].as_py(), "<i8"), np.frombuffer(part.column(3)[n].as_py(), np.uint8), v, some[at], distance


def cluster_sums(zones: DataFrame, centroids: np.ndarray) -> list:
    """A row for each centroid that has vectors: cluster, n, inertia and the sum of every component."""
    dim = centroids.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for _, _, v, cluster, distance in _assigned(b, centroids):
                for c in np.unique(cluster):
                    own = cluster == c
                    n[c] += own.sum()
                    inertia[c] += distance[own].sum()
                    sums[c] += v[own].sum(axis=0)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(inertia[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "inertia", "sums"])

    rows = zones.select("lo", "hi", "ids", "known", "vectors").mapInArrow(count, "cluster int, n long, inertia long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)]
    return rows.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *each).collect()


def moved(rows: list, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: means, rounded down; those without vectors stay."""
    out = centroids.copy()
    for r in rows:
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """A row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    whole = whole_vectors(vectors, dim, scale)
    ends = whole.agg(*[f(F.get("v", F.lit(i))).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(dim)]).first()
    if ends["lo0"] is None:
        return vectors.sparkSession.createDataFrame([], schema)
    least, largest = (np.array([ends[f"{n}{i}"] for i in range(dim)], np.int64) for n in ("lo", "hi"))
    if least.min() < -LARGEST or largest.max() > LARGEST:
        raise ValueError("components beyond 2^27: squared distances need not fit 64 bits")
    centroids = first_centroids(whole, k, seed)
    zones = zone_map(whole, least, largest)
    for _ in range(rounds):
        before, centroids = centroids, moved(cluster_sums(zones, centroids), centroids)
        if (before == centroids).all():
            break
    by_cluster = np.zeros(len(centroids), np.int64)
    for r in cluster_sums(zones, centroids):
        by_cluster[r["cluster"]] = r["inertia"]
    inertia = int(by_cluster.sum())
    names = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, known, _, cluster, distance in _assigned(b, centroids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=known == 0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(by_cluster[cluster]), pa.array(np.full(len(ids), inertia)), pa.array(names[cluster], pa.string())],
                    [c.split()[0] for c in schema.split(", ")],
                )

    return zones.select("lo", "hi", "ids", "known", "vectors").mapInArrow(assign, schema)

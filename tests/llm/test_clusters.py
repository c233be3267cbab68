"""Centroid clustering against plain rounds over all pairs of vector and centroid."""

import hashlib
import math
import random
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from riskloom.llm import op11_clusters as op

VECTORS = "vec_id long, embedding array<float>, label int, V string, key long, cluster string"


def brute(rows, k=40, rounds=5, dim=64, scale=256, seed=2):
    """Sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha256), by Python's numbers alone."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            own[j].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    best = assign()
    inertia = defaultdict(int)
    for d, j in best:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, best)], key=str)


def floats(rng, n, dim=64, spread=0.2, centres=12):
    """Vectors around a few centres, as 32-bit floats."""
    middle = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    return [np.array([x + rng.gauss(0, spread) for x in rng.choice(middle)], np.float32).tolist() for _ in range(n)]


def test_hilbert_neighbours_are_one_step_apart():
    for dim, bits in ((2, 5), (3, 3), (5, 2), (4, 1)):
        cells = np.array(list(product(range(1 << bits), repeat=dim)))
        keys = [k.tobytes() for k in op.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(keys)
        along = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_boxes_keep_every_nearest_centroid():
    rng = np.random.default_rng(4)
    for _ in range(50):
        centroids = rng.integers(-300, 300, (20, 6))
        v = rng.integers(-300, 300, 6) + rng.integers(-20, 20, (32, 6))
        can = op.candidates(v.min(axis=0)[None], v.max(axis=0)[None], centroids)[0]
        d = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
        assert can[(d == d.min(axis=1)[:, None]).any(axis=0)].all()


def test_boxes_leave_centroids_out_and_order_makes_them_small():
    """Around clear centres few centroids are candidates in Hilbert order, and more in the order given."""
    v = np.array(floats(random.Random(5), 4000, spread=0.01, centres=16))
    v = np.floor(v * 256).astype(np.int64)
    centroids = v[:: len(v) // 40][:40]
    width = (v.max(axis=0) - v.min(axis=0)) // 16 + 1
    order = np.lexsort(op.hilbert_keys((v - v.min(axis=0)) // width, 4).T[::-1])
    share = []
    for rows in (v[order], v):
        boxes = rows[: len(rows) // 50 * 50].reshape(-1, 50, 64)
        share.append(op.candidates(boxes.min(axis=1), boxes.max(axis=1), centroids).mean())
    assert share[0] < 0.3 < share[1]


@pytest.mark.parametrize("largest", [100, 1 << 27])
def test_distances_are_exact(largest):
    rng = np.random.default_rng(largest)
    v, c = rng.integers(-largest, largest, (50, 64)), rng.integers(-largest, largest, (9, 64))
    at, d = op.nearest(v, c)
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert d.tolist() == [min(r) for r in full] and at.tolist() == [r.index(min(r)) for r in full]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_on_spark(spark):
    rng = random.Random(6)
    good = floats(rng, 400)
    rows = list(enumerate(good))
    rows += [(5, good[9]), (5, good[9]), (None, good[1]), (None, good[2]), (7000, good[3])]
    rows += [(8000 + k, e) for k, e in enumerate([None, [], good[0][:63], good[0] + [0.0], [None, *good[0][1:]], [math.nan, *good[0][1:]], [math.inf, *good[0][1:]], [*good[0][1:], -math.inf]])]
    rows += [(9000 + k, good[11]) for k in range(300)]  # one vector many times
    df = spark.createDataFrame([(i, e, 1, "a", 2, "b") for i, e in rows], VECTORS).repartition(5)
    got = op.clusters(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute(rows)
    few = df.where("vec_id BETWEEN 10 AND 24")
    assert rows_of(op.clusters(few)) == brute([r for r in rows if r[0] is not None and 10 <= r[0] <= 24])
    assert op.clusters(df.limit(0)).count() == 0 and op.clusters(df.where("vec_id BETWEEN 8000 AND 8100")).count() == 0


def test_ties_and_empty_clusters(spark):
    """A grid of whole numbers with equal distances, and copies that leave centroids without vectors."""
    rng = random.Random(7)
    rows = [(k, [float(rng.randint(0, 1)), float(rng.randint(0, 2)), 0.5]) for k in range(120)]
    df = spark.createDataFrame([(i, e, 1, "a", 2, "b") for i, e in rows], VECTORS)
    assert rows_of(op.clusters(df, k=9, rounds=3, dim=3, scale=2, seed=1)) == brute(rows, 9, 3, 3, 2, 1)


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 1, "a", 2, "b")], VECTORS)
    with pytest.raises(ValueError):
        op.clusters(df)


def test_query_over_the_whole_table(spark):
    from riskloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert rows_of(QUERIES["op11_clusters"](spark, sf)) == brute(rows)

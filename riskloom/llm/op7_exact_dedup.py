"""Exact dedup with a minimal perfect hash over digests seen before.

The history is the distinct digests of earlier rows with the locators of their
winners: those of earlier runs, or, for one table, of a random half of its rows. It
is split into shards; each shard gets a minimal perfect hash made of bit levels, and
slots that hold the full digest, the winner's locator (doc_id and length) and the size of
the group. Later rows are sent to the shard of their digest behind the shard's index; a
lookup compares all 32 bytes of the slot, so a stranger that lands in a slot is no member.
Members are repeats: they are summed up by slot, and a slot takes a new winner if its best
challenger is better. Then all rows but the strangers read their winner from the slots;
strangers are in no slot and are grouped among themselves.
Digests with over a thousandth of the earlier rows are dealt to several tasks, each
with its copy of the shard.

Texts are equal when they are equal without the characters 0x20 and 0x09-0x0D. Of
equal texts the longest original (in code points), then the smallest doc_id, stays.

Cases: a null text counts as empty, and all empty texts are one group; very long
texts are digested whole where they lie; a null doc_id loses ties; repeated rows of
one doc_id count in group_size and share the result; rows that share a doc_id but not
the text are judged each by its own text; a digest that a given history repeats counts
once, with the least locator and the sum of its sizes; an empty table gives no rows;
further columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, mix

SHARD_KEYS = 1 << 16
HOT_SHARE = 1000
SPACES = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_points) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text).alias("digest"), F.length(text).cast("long").alias("n_points"))


def digest_of(text):
    return F.unhex(F.sha2(F.translate(text, SPACES, "").cast("binary"), 256))


def bests(rows: DataFrame) -> DataFrame:
    """(digest, best, group_size): the longest, then the least doc_id negated; partial sums come before the shuffle."""
    return rows.groupBy("digest").agg(F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg"))).alias("best"), F.count("*").alias("group_size"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size)."""
    return bests(rows).select("digest", (-F.col("best.neg")).alias("keep_id"), "group_size")


class PerfectHash:
    """Bit levels over distinct keys: a key takes the first level at which it alone
    has its position; its slot is the number of set bits before."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        packed, self.levels, at, before = np.frombuffer(bits, np.uint8), [], 0, 0
        for n in sizes:
            level = np.unpackbits(packed[at : at + (n + 7) // 8], count=n)
            self.levels.append((level, np.cumsum(level, dtype=np.int64) - level + before))
            before += int(level.sum())
            at += (n + 7) // 8

    @staticmethod
    def halves(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = digest.view("<u8")
        return words[:, 1].copy(), words[:, 2] | np.uint64(1)

    @staticmethod
    def place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1 + h2 * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, digest: np.ndarray, gamma: float = 1.5) -> "PerfectHash":
        if len(np.unique(digest, axis=0)) < len(digest):
            raise ValueError("a perfect hash needs distinct keys")
        h1, h2 = cls.halves(digest)
        todo, sizes, bits = np.arange(len(digest)), [], []
        while len(todo):
            size = max(8, int(gamma * len(todo)))
            at = cls.place(h1[todo], h2[todo], len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            todo = todo[~alone[at]]
        return cls(sizes, b"".join(bits))

    def packed(self) -> bytes:
        return b"".join(np.packbits(level).tobytes() for level, _ in self.levels)

    def slots(self, digest: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has it; strangers may get a slot."""
        h1, h2 = self.halves(digest)
        out, open_ = np.full(len(digest), -1, np.int64), np.arange(len(digest))
        for k, (level, rank) in enumerate(self.levels):
            at = self.place(h1[open_], h2[open_], k, self.sizes[k])
            hit = level[at] == 1
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 32)


INDEX = "shard int, sizes array<long>, bits binary, slot_digest binary, slot_keep binary, slot_known binary, slot_points binary, slot_group binary"
_SLOTS = {"slot_keep": "<i8", "slot_known": "u1", "slot_points": "<i8", "slot_group": "<i8"}


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history(digest, keep_id, n_points, group_size) with distinct digests -> one row a shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digest = _matrix(list(pdf["digest"]))
        table = PerfectHash.build(digest)
        order = np.argsort(table.slots(digest))
        slots = {name: [pdf[name].to_numpy()[order].astype(kind).tobytes()] for name, kind in _SLOTS.items()}
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "sizes": [np.array(table.sizes, np.int64)], "bits": [table.packed()], "slot_digest": [digest[order].tobytes()], **slots})

    known = F.col("keep_id").isNotNull()
    rows = history.select("digest", F.coalesce("keep_id", F.lit(0)).alias("slot_keep"), known.cast("int").alias("slot_known"), F.coalesce("n_points", F.lit(0)).alias("slot_points"), F.col("group_size").alias("slot_group"), shard_of(n_shards).alias("shard"))
    return rows.groupBy("shard").applyInPandas(build, INDEX)


def challenge(index: DataFrame, members: DataFrame, winners_stay: bool) -> DataFrame:
    """The index after members(shard, slot, doc_id, n_points): every slot counts its members, and
    its winner gives way to a longer one or one of equal length and smaller doc_id. A row for
    each slot that has members moves, summed up before the shuffle."""
    best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg"))).alias("best")
    per = members.groupBy("shard", "slot").agg(best, F.count("*").alias("n"))
    per = per.select("shard", "slot", F.col("best.n_points").alias("points"), F.coalesce(-F.col("best.neg"), F.lit(0)).alias("id"), F.col("best.neg").isNotNull().cast("int").alias("known"), "n")

    def settle(key: tuple, held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        keep, known, points, group = (np.frombuffer(held[c].iloc[0], kind).copy() for c, kind in _SLOTS.items())
        at, p, i, k = (new[c].to_numpy(np.int64) for c in ("slot", "points", "id", "known"))
        group[at] += new["n"].to_numpy(np.int64)
        if not winners_stay:
            better = (p > points[at]) | ((p == points[at]) & ((k > known[at]) | ((k == known[at]) & (i < keep[at]))))
            at, p, i, k = at[better], p[better], i[better], k[better]
            keep[at], known[at], points[at] = i, k, p
        return held.assign(slot_keep=[keep.tobytes()], slot_known=[known.tobytes()], slot_points=[points.tobytes()], slot_group=[group.tobytes()])

    return index.groupBy("shard").cogroup(per.groupBy("shard")).applyInPandas(settle, INDEX)


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int")


def lookup(rows: DataFrame, index: DataFrame, n_shards: int, hot: DataFrame) -> DataFrame:
    """rows(doc_id, digest, n_points) with shard and slot (-1: no member), and keep_id and
    group_size from the slot; hot(digest, salts) has at most HOT_SHARE + 1 digests, by the
    way it is chosen."""
    placed = rows.join(F.broadcast(hot), "digest", "left").withColumn("shard", shard_of(n_shards))
    placed = placed.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    spread = hot.withColumn("shard", shard_of(n_shards)).groupBy("shard").agg(F.max("salts").alias("salts"))
    copies = index.join(F.broadcast(spread), "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)).cast("int") - 1))).drop("salts")
    both = placed.withColumn("kind", F.lit(1)).unionByName(copies.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    blobs = [c.split()[0] for c in INDEX.split(", ")[1:]]
    both = both.select("kind", "shard", "salt", "doc_id", "digest", "n_points", *blobs).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            kind, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(shard) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(kind)]):
                if kind[lo] == 0:
                    r = b.slice(hi - 1, 1).to_pylist()[0]
                    at, held = shard[lo], (PerfectHash(r["sizes"], r["bits"]), _matrix([r["slot_digest"]]), *(np.frombuffer(r[c], kind_) for c, kind_ in _SLOTS.items() if c != "slot_points"))
                    continue
                part = b.slice(lo, hi - lo)
                digest = _matrix(part.column(4).to_pylist())
                slot, keep, group, blank = np.full(hi - lo, -1, np.int64), np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), np.ones(hi - lo, bool)
                if at == shard[lo]:
                    found = held[0].slots(digest)
                    k = np.flatnonzero(found >= 0)
                    k = k[(held[1][found[k]] == digest[k]).all(axis=1)]
                    slot[k], keep[k], blank[k], group[k] = found[k], held[2][found[k]], held[3][found[k]] == 0, held[4][found[k]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), part.column(4), part.column(5), part.column(1), pa.array(slot), pa.array(keep, mask=blank), pa.array(group)], ["doc_id", "digest", "n_points", "shard", "slot", "keep_id", "group_size"]
                )

    return both.mapInArrow(find, "doc_id long, digest binary, n_points long, shard int, slot long, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    history(digest, keep_id, group_size): winners of earlier runs, which stay winners and
    whose rows count in group_size; without it, a random half of docs is the history of the
    other half."""
    spark = docs.sparkSession
    rows = digests(docs)
    if history is not None:
        earlier, later = None, materialise(rows, "digests")
        known = history.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.lit(0).cast("long").alias("n_points"), F.sum("group_size").alias("group_size"))
        hot, total = later.groupBy("digest").agg(F.count("*").alias("n")), later.count()
    else:
        rows = materialise(rows.withColumn("early", F.rand(7) < 0.5), "digests")  # drawn once, then read
        earlier, later = rows.where("early").drop("early"), rows.where("not early").drop("early")
        known = bests(earlier).select("digest", (-F.col("best.neg")).alias("keep_id"), F.col("best.n_points").alias("n_points"), "group_size")
        hot, total = None, earlier.count()
    known, total = materialise(known, "history"), max(1, total)
    hot = known.select("digest", F.col("group_size").alias("n")) if hot is None else hot
    hot = materialise(hot.where(F.col("n") * HOT_SHARE > total).select("digest", F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("salts")), "hot-digests")
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), known.count() // SHARD_KEYS + 1)
    index = materialise(build_index(known, n_shards), "perfect-hash")
    found = materialise(lookup(later, index, n_shards, hot).drop("keep_id", "group_size"), "found")
    members = found.where("slot >= 0")
    settled = materialise(challenge(index, members, winners_stay=history is not None), "perfect-hash")
    asking = members.select("doc_id", "digest", "n_points")
    asking = asking if earlier is None else earlier.union(asking)
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    strangers = found.where("slot < 0").select("doc_id", "digest", "n_points")
    out = lookup(asking, settled, n_shards, hot).select(columns).union(strangers.join(winners(strangers), "digest").select(columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that share doc_id and
    text (without white space), the longest stays, one of equals."""
    digest, points, place = (free_name(docs, n) for n in ("digest", "points", "place"))
    stay = exact_dedup(docs, history).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn(digest, digest_of(text))
    out = rows.join(stay, rows["doc_id"].cast("long").eqNullSafe(stay["kept_id"]) & (rows[digest] == stay["kept_digest"]), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        order = Window.partitionBy("doc_id", digest).orderBy(F.desc(points))
        out = out.withColumn(points, F.length(text)).withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return out.select(*docs.columns)

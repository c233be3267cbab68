"""Quality by importance resampling.

Two hashed n-gram models are counted: the target's over labelled good documents
and the raw one over all documents. A document's weight is the log ratio of the
two models over its n-grams, and Gumbel top-k over the weights draws k documents
without replacement. k is the number of documents whose weight reaches a cut,
which is chosen on held-out labelled documents.

Words keep their case and marks are words of their own. The target sample is
bounded (`sample` labelled rows, picked by a hash of doc_id); the raw model and
the weights cover all documents and whole texts.

Cases: a null or empty text has weight 0 and the same chance as any text whose
n-grams are neutral; very long texts are weighed whole; labels with null quality are
ignored, and of several labels of one doc_id the worse counts; repeated rows of one
doc_id share their noise, and rows that tie with the k-th key are all drawn; without
labels the models agree and all documents are kept; an empty table keeps nothing;
further columns are ignored, whatever their names.

The weight is a sum over a whole text, so for long texts the noise (1.3 on average)
seldom changes what a plain cut at the same weight would keep; resample() returns
weight and key of every document, from which the difference can be counted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, mix

BUCKETS = 1 << 14
SAMPLE = 20_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")


class _Hash(dict):
    def __missing__(self, w: bytes) -> int:
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


_memo = _Hash()


def ngram_buckets(text: str | None) -> np.ndarray:
    """Buckets of all words and word pairs of a text; a word after itself is one pair, whatever the word."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass")) if text else []
    if len(_memo) > 300_000:
        _memo.clear()
    h = np.array([_memo[w] for w in words], np.uint64)
    pairs = np.where(h[:-1] == h[1:], np.uint64(1), mix(h[:-1] * np.uint64(3) + h[1:]))
    return (np.concatenate([h, pairs]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n) over docs; a task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                total += np.bincount(ngram_buckets(text), minlength=BUCKETS) if text and len(text) > 20_000 else 0
                if text and len(text) <= 20_000:
                    np.add.at(total, ngram_buckets(text), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_model(counts: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """Log probabilities; BUCKETS rows at most come to the driver."""
    n = np.full(BUCKETS, smooth)
    for r in counts.collect():
        n[r["bucket"]] += r["n"]
    return np.log(n / n.sum())


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, log_ratio, n_grams) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                grams = [ngram_buckets(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([float(ratio[g].sum()) for g in grams]), pa.array([len(g) for g in grams], pa.int64())], ["doc_id", "log_ratio", "n_grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, log_ratio double, n_grams long")


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that best separates held-out good from bad documents (mean of the
    two rates), midway in the gap it lies in; no bad documents: below everything."""
    if not len(bad) or not len(good):
        return -np.inf
    values = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    dropped = np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmax(kept + dropped)])


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of keys(code long) with 0 <= code < 2^62, by counts of
    16 bits at a time: at most 65,536 rows a round come to the driver."""
    low, width = 0, 62
    while width > 0:
        step = min(16, width)
        digit = F.shiftright(F.col("code") - F.lit(low), width - step)
        counts = keys.where((F.col("code") >= low) & (F.col("code") - F.lit(low) < F.lit(1 << width))).groupBy(digit.alias("d")).count().collect()
        for r in sorted(counts, key=lambda r: -r["d"]):
            if k <= r["count"]:
                low, width = low + (r["d"] << (width - step)), width - step
                break
            k -= r["count"]
        else:
            return low
    return low


def code_of(key):
    """A double as a non-negative long in the same order, to 2^-20; |key| < 2^41."""
    return (F.rint(F.greatest(F.least(key, F.lit(2.0**40)), F.lit(-(2.0**40))) * F.lit(2.0**20)).cast("long")) + F.lit(1 << 61)


@dataclass
class Resampler:
    """What the passes over the corpus have settled: the log ratio of the models,
    the least code drawn, and every document's weight."""

    ratio: np.ndarray
    least: int
    weights: DataFrame
    seed: int


def gumbel_key(seed: int, weight: str = "log_ratio"):
    """The weight plus Gumbel noise, which a hash of doc_id gives: repeated runs draw alike."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.col(weight) - F.log(-F.log(uniform))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 17) -> Resampler:
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good"))
    picked = picked.groupBy("doc_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    picked = materialise(picked.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0), "quality-sample")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = plain.join(F.broadcast(picked.where("good and not held").select("doc_id")), "doc_id", "left_semi")  # at most `sample` ids
    target_counts = materialise(bucket_counts(target), "quality-target")
    ratio = np.zeros(BUCKETS) if target_counts.isEmpty() else log_model(target_counts) - log_model(bucket_counts(plain))
    weights = materialise(weigh(plain, ratio).withColumn("key", gumbel_key(seed)).withColumn("code", code_of(F.col("key"))), "quality-weights")
    held = weights.join(F.broadcast(picked.where("held")), "doc_id").groupBy("doc_id", "good").agg(F.min("log_ratio").alias("log_ratio")).collect()  # at most `sample` rows
    cut = best_cut(*(np.array([r["log_ratio"] for r in held if r["good"] == side]) for side in (True, False)))
    k = weights.where(F.col("log_ratio") >= F.lit(cut)).count()
    return Resampler(ratio, kth_largest(weights, k) if k else 1 << 62, weights, seed)


def resample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Every document with its weight and decision: doc_id, log_ratio, n_grams, key, kept."""
    fitted = fit(docs, labels, **how)
    return fitted.weights.withColumn("kept", F.col("code") >= F.lit(fitted.least)).drop("code")


def drawn(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with all their columns: each task weighs its rows again, none moves."""
    fitted, name = fit(docs, labels, **how), free_name(docs, "log_ratio")
    ratio, schema = fitted.ratio, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    place = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                w = pa.array([float(ratio[ngram_buckets(t)].sum()) for t in part.column(place).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, w], [*part.schema.names, name])

    return docs.mapInArrow(score, schema).where(code_of(gumbel_key(fitted.seed, name)) >= F.lit(fitted.least)).drop(name)

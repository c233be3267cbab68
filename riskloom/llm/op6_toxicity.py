"""Toxicity by a classifier chain.

Each category has a linear (logistic) model; the models are ordered, and a model
also sees the probabilities of the categories before it. In training these are
out-of-fold predictions, so that a later model learns from probabilities as good
as those it will get; a fold's model chooses its features without the fold's rows.
Features are hashed lower-case words and word beginnings of 4 to 6 letters, present or
not; those that differ most between the classes of a category (chi-square, counted by
Spark) are retained.

Categories are columns of the labels: `poor` (quality is 0) and `toxic`, in this order.
A row that lacks the label of a category is left out of that category's model.

Training uses a bounded sample (`sample` rows with a toxic label, picked by a hash of
doc_id); every document's whole text is scored.

Cases: null or empty texts have no features and get the chain's base rates; very long
texts are read whole; labels with null toxic are ignored, and of several labels of one
doc_id the larger counts; without positive labels a category's probabilities are 0; of
repeated rows of one doc_id the least text is trained on and each is scored; features
that tie are chosen by number; an empty table gives no rows; further columns are
ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 8_000
FEATURES = 1_000
SPACE = 1 << 22
CHAIN = ("poor", "toxic")
FOLDS = 5
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def word_features(word: bytes) -> list[int]:
    """The word and its beginnings of 4 to 6 characters, hashed."""
    text = word.decode("utf-8", "replace")
    return [xxhash.xxh3_64_intdigest(word) % SPACE, *(xxhash.xxh3_64_intdigest(b"^" + text[:n].encode()) % SPACE for n in (4, 5, 6) if len(text) >= n)]


class _Lookup(dict):
    """word -> the retained features it has, as positions."""

    def __init__(self, at: dict[int, int]):
        self.at = at

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        v = self[word] = tuple(self.at[f] for f in word_features(word) if f in self.at)
        return v

    def of(self, text: str | None) -> list[int]:
        """Retained features present."""
        if len(self) > 1_000_000:
            self.clear()
        return sorted({f for w in words_of(text) for f in self[w]})


@dataclass
class Linear:
    """Logistic regression over present features and a few dense columns."""

    w: np.ndarray
    v: np.ndarray
    b: float

    def predict(self, rows: list[list[int]], dense: np.ndarray) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = np.array([f for r in rows for f in r], np.int64)
        s = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.w[flat], len(rows)) + dense @ self.v + self.b
        return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def fit(rows: list[list[int]], dense: np.ndarray, y: np.ndarray, allowed: np.ndarray, rounds: int = 120, rate: float = 0.3, l2: float = 1e-4) -> Linear:
    """Full-batch Adam over the allowed features; the same rows give the same model."""
    sizes = np.array([len(r) for r in rows], np.int64)
    flat, of = np.array([f for r in rows for f in r], np.int64), np.repeat(np.arange(len(rows)), sizes)
    kept = allowed[flat]
    flat, of = flat[kept], of[kept]
    n, d, n_features = len(rows), dense.shape[1], len(allowed)
    if not n or not y.any():
        return Linear(np.zeros(n_features), np.zeros(d), -35.0)
    p = np.zeros(n_features + d + 1)
    p[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, s = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        z = np.bincount(of, p[:n_features][flat], n) + dense @ p[n_features:-1] + p[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        g = np.concatenate([np.bincount(flat, err[of], n_features), dense.T @ err, [err.sum()]])
        g[:-1] += l2 * p[:-1]
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Linear(p[:n_features], p[n_features:-1], p[-1])


@dataclass
class Chain:
    names: tuple[str, ...]
    features: list[int]
    links: list[Linear] = field(default_factory=list)

    def predict(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities, one column a category, each fed to the models after it."""
        out = np.zeros((len(rows), len(self.names)))
        for k, link in enumerate(self.links):
            out[:, k] = link.predict(rows, out[:, :k])
        return out


def train_chain(rows: list[list[int]], targets: dict[str, np.ndarray], features: list[int], fold: np.ndarray, chosen: dict[str, list[np.ndarray]] | None = None) -> Chain:
    """targets: category -> 0, 1 or nan (not labelled) for each row, in chain order; fold: a
    number for each row; chosen: category -> which features the models without fold 0, 1, ...
    may use and, last, the model of all rows (all may use every feature if it is left out)."""
    chain, ahead = Chain(tuple(targets), features), np.zeros((len(rows), 0))
    every = [np.ones(len(features), bool)] * (int(fold.max(initial=0)) + 2)
    for name, y in targets.items():
        allowed, known = (chosen or {}).get(name, every), ~np.isnan(y)
        use = np.flatnonzero(known)
        chain.links.append(fit([rows[i] for i in use], ahead[use], y[use], allowed[-1]))
        out = np.zeros(len(rows))
        for f in range(len(allowed) - 1):
            inn, off = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
            part = fit([rows[i] for i in inn], ahead[inn], y[inn], allowed[f])
            out[off] = part.predict([rows[i] for i in off], ahead[off]) if len(off) else 0
        ahead = np.column_stack([ahead, out])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 29) -> DataFrame:
    """(doc_id, text, poor, toxic, fold) of at most `sample` labelled documents; poor may be null."""
    picked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    picked = picked.agg(F.max((F.col("quality") <= 0).cast("int")).alias("poor"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "poor", "toxic").agg(F.min("text").alias("text"))  # at most `sample` ids
    return materialise(found.select("doc_id", "text", "poor", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int").alias("fold")), "toxic-sample")


def choose_features(rows: DataFrame, names: tuple[str, ...] = CHAIN, n: int = FEATURES) -> dict[str, list[list[int]]]:
    """category -> for each fold left out, and last for none, the n features with the largest
    chi-square: n rows for each come to the driver."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                f = sorted({f for w in set(words_of(row.column(0)[0].as_py())) for f in word_features(w)})
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), *(pa.array([c[0].as_py()] * len(f), c.type) for c in row.columns[1:])], ["f", *row.schema.names[1:]])

    long = rows.select("text", "fold", *names).mapInArrow(present, "f long, fold int, " + ", ".join(f"{c} int" for c in names))
    sums = lambda of: [F.coalesce(F.sum(F.when((F.col("fold") == k) & (F.col(c) == y), 1)), F.lit(0)).alias(f"{c}_{y}_{k}") for c in names for y in (0, 1) for k in range(FOLDS)]
    counts = materialise(long.groupBy("f").agg(*sums(long)), "toxic-features")
    total = rows.agg(*sums(rows)).first()
    out: dict[str, list[list[int]]] = {}
    for c in names:
        for left_out in (*range(FOLDS), None):
            inn = [k for k in range(FOLDS) if k != left_out]
            nb, ng = (max(1, sum(total[f"{c}_{y}_{k}"] for k in inn)) for y in (1, 0))
            a, b = (sum((F.col(f"{c}_{y}_{k}") for k in inn), F.lit(0)).cast("double") for y in (1, 0))
            gap = a * (ng - b) - b * (nb - a)
            chi = gap * gap * float(nb + ng) / ((a + b) * (nb + ng - a - b + 1) * float(nb) * float(ng))
            best = counts.where(a + b >= 3).select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(n).collect()
            out.setdefault(c, []).append([r["f"] for r in best])
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Chain:
    rows = labelled_sample(docs, labels, sample)
    sets = choose_features(rows, CHAIN, n_features)
    features = sorted({f for per_fold in sets.values() for chosen in per_fold for f in chosen})
    at = {f: k for k, f in enumerate(features)}
    chosen = {c: [np.isin(features, s) if s else np.zeros(len(features), bool) for s in per_fold] for c, per_fold in sets.items()}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(at)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([lookup.of(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", *b.schema.names[2:], "f"])

    schema = "doc_id long, " + ", ".join(f"{c} int" for c in CHAIN) + ", fold int, f array<int>"
    got = sorted(rows.select("doc_id", "text", *CHAIN, "fold").mapInArrow(present, schema).collect(), key=lambda r: r["doc_id"])  # at most `sample` rows
    targets = {c: np.array([np.nan if r[c] is None else float(r[c]) for r in got], float) for c in CHAIN}
    whole = train_chain([r["f"] for r in got], targets, features, np.array([r["fold"] for r in got], int), chosen)
    used = np.flatnonzero(np.any([link.w != 0 for link in whole.links], axis=0)) if features else np.arange(0)  # those of the folds' models are done with
    return Chain(whole.names, [features[k] for k in used], [Linear(link.w[used], link.v, link.b) for link in whole.links])


def score(docs: DataFrame, chain: Chain, cut: float = 0.5) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and the decision is_toxic of the last."""
    at = {f: k for k, f in enumerate(chain.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(at)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                p = chain.predict([lookup.of(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= cut)], ["doc_id", *(f"p_{n}" for n in chain.names), "is_toxic"])

    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names) + ", is_toxic boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

"""Ranked lexical search, TAAT and DAAT together.

Every document is split into terms once, where it lies, and becomes part of a segment: an
inverted index of some SEGMENT_WORDS words with its documents, lengths and the postings of
all its terms, one row of a written table. Items then come in blocks of about ITEMS items
or TERMS terms, each broadcast, and every task runs a block over its segments. For an item
the short lists of a segment (up to SHORT of its documents each) are read term at a time
into summed accumulators; these act as one more iterator, bounded by their largest sums,
beside the long lists. The iterators are then read document at a time in windows of
documents: windows whose bounds cannot reach the item's tenth best score so far are
skipped, and in the others only documents of the essential iterators are candidates, which
look up the remaining lists, strongest first, while they can still reach that score. The
tenth best score is carried from segment to segment of a task; at last the tasks' best
rows meet, through groups of tasks first where there are many.

Statistics (documents, terms, document frequencies) cover all documents and are settled
before the search; impacts and sums are 64-bit integers. Bounds only ever drop what is
strictly below the tenth best, so ties are settled by doc_id alone.

Cases: null texts, and texts and items without terms, have no part; a very long text is
split in slices of SLICE bytes and counts whole; documents of equal score rank by doc_id,
those with a null doc_id after all others; repeated rows are documents, or items, of their
own, each ranked; an empty table of either kind gives no row; further columns are ignored,
whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BEST = 10
SEGMENT_WORDS, SEGMENT_DOCS, SLICE = 1 << 20, 1 << 16, 1 << 20
ITEMS, TERMS = 2048, 100_000
SHORT, WINDOW, TASKS = 1 / 32, 128, 256
#: Letters, digits and all beyond ASCII make terms; of letters only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
SEGMENT = "n_docs long, n_words long, doc_ids binary, known binary, lengths binary, terms binary, df binary, docs binary, tf binary, tf_width int"


class _Ids(dict):
    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def slices(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, at most some SLICE bytes of them at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end + 1


class Segment:
    """Collects documents until it is closed into a row."""

    def __init__(self):
        self.ids, self.doc_ids, self.lengths, self.n_words = _Ids(), [], [], 0
        self.open, self.parts = [], []
        self.n_open = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        n, doc = 0, len(self.doc_ids)
        for words in slices(text or ""):
            if words:
                self.open.append((doc, [self.ids[w] for w in words]))
                n, self.n_open = n + len(words), self.n_open + len(words)
                if self.n_open > 1 << 18:
                    self._count()
        if n:
            self.doc_ids.append(doc_id)
            self.lengths.append(n)
            self.n_words += n

    def _count(self) -> None:
        if self.open:
            doc = np.repeat([d for d, _ in self.open], [len(w) for _, w in self.open])
            term = np.concatenate([np.array(w, np.int64) for _, w in self.open])
            self.parts.append(np.unique(term << 17 | doc, return_counts=True))
            self.open, self.n_open = [], 0

    def full(self) -> bool:
        return self.n_words >= SEGMENT_WORDS or len(self.doc_ids) >= SEGMENT_DOCS

    def row(self) -> pa.RecordBatch:
        self._count()
        code, tf = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(code, kind="stable")
        code, tf = code[order], tf[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])  # a long text may come from several counts
        code, tf = code[first], np.add.reduceat(tf, first)
        width = next(w for w in (1, 2, 4, 8) if int(tf.max()) < 1 << (8 * w))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        doc_ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        blobs = [doc_ids, known, np.array(self.lengths, "<i8"), np.frombuffer(b"\n".join(self.ids), np.uint8), np.bincount(code >> 17).astype("<i4"), (code & ((1 << 17) - 1)).astype("<i4"), tf.astype(f"<u{width}")]
        columns = [pa.array([len(known)], pa.int64()), pa.array([self.n_words], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs], pa.array([width], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENT.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """The segments of docs, written."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Segment()
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    now.add(doc_id, text)
                    if now.full():
                        yield now.row()
                        now = Segment()
        if now.n_words:
            yield now.row()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(build, SEGMENT), "lexical-index")


class Best:
    """An item's best documents so far: score, whether doc_id is known, doc_id."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.known, self.doc = np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64)

    def least(self) -> int:
        """The score that a document needs at least."""
        return max(1, int(self.score[-1])) if len(self.score) == self.most else 1

    def offer(self, score: np.ndarray, known: np.ndarray, doc: np.ndarray) -> None:
        score, known, doc = np.concatenate([self.score, score]), np.concatenate([self.known, known]), np.concatenate([self.doc, doc])
        if len(score) > self.most:
            worth = np.flatnonzero(score >= np.partition(score, len(score) - self.most)[len(score) - self.most])
            score, known, doc = score[worth], known[worth], doc[worth]
        order = np.lexsort((doc, 1 - known, -score))[: self.most]
        self.score, self.known, self.doc = score[order], known[order], doc[order]


class Lists:
    """The postings of a segment that a block of items asks for, with their impacts."""

    def __init__(self, row: dict, vocabulary: dict[bytes, int], weight: np.ndarray, n: int, total: int):
        self.known, self.doc_ids = np.frombuffer(row["known"], np.uint8), np.frombuffer(row["doc_ids"], "<i8")
        self.n_docs = len(self.known)
        self.n_windows = -(-self.n_docs // WINDOW)
        df = np.frombuffer(row["df"], "<i4").astype(np.int64)
        ends = np.cumsum(df)
        docs, tf = np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["tf"], f"<u{row['tf_width']}")
        length = np.frombuffer(row["lengths"], "<i8")
        if int(length.max()) * 90 * n < 1 << 62:
            m = 10 + 90 * n * length // total
        else:  # beyond 64 bits: exact in Python's numbers
            m = np.array([10 + 90 * n * int(x) // total for x in length], np.int64)
        self.docs, self.impacts, self._maxima = {}, {}, {}
        for k, term in enumerate(row["terms"].split(b"\n")):
            t = vocabulary.get(term)
            if t is not None:
                at = slice(ends[k] - df[k], ends[k])
                d, f = docs[at], tf[at].astype(np.int64)
                self.docs[t], self.impacts[t] = d, weight[t] * (1_000_000_000 * f // (1000 * f + 8 * m[d]))

    def maxima(self, t: int) -> np.ndarray:
        """The largest impact of a long list in each window."""
        if t not in self._maxima:
            out = np.zeros(self.n_windows, np.int64)
            window = self.docs[t] // WINDOW
            first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
            out[window[first]] = np.maximum.reduceat(self.impacts[t], first)
            self._maxima[t] = out
        return self._maxima[t]


def search_segment(lists: Lists, terms: list[int], best: Best) -> tuple[int, int]:
    """Offers to `best` all documents of the segment that can be among the best for an
    item's terms. Returns how many windows it opened, and of how many."""
    here = [t for t in terms if t in lists.docs]
    if not here:
        return 0, lists.n_windows
    short = [t for t in here if len(lists.docs[t]) <= SHORT * lists.n_docs]
    sums = np.zeros(lists.n_windows * WINDOW, np.int64)
    for t in short:  # term at a time
        sums[lists.docs[t]] += lists.impacts[t]
    # bounds of the iterators by window: the accumulators first, then the long lists
    long_ = sorted(set(here) - set(short), key=lambda t: int(lists.maxima(t).max()))
    bounds = np.stack([sums.reshape(-1, WINDOW).max(axis=1), *[lists.maxima(t) for t in long_]])
    reach, opened, at, step = bounds.sum(axis=0), 0, 0, 4
    todo = np.flatnonzero(reach >= best.least())
    while at < len(todo):  # document at a time, over windows in order
        some = todo[at : at + step]
        at, step = at + step, step * 2
        least = best.least()
        some = some[reach[some] >= least]
        if not len(some):
            continue
        opened += len(some)
        most = bounds[:, some].max(axis=1)
        # iterators that cannot reach the score together name no candidates
        order = np.argsort(most, kind="stable")
        before = np.cumsum(most[order])
        n_idle = int(np.searchsorted(before, least, side="left"))
        idle, essential = order[:n_idle], set(order[n_idle:].tolist())
        wanted = np.zeros(lists.n_windows, bool)
        wanted[some] = True
        named = np.zeros(len(sums), bool)
        if 0 in essential:
            named |= sums > 0
        for k in essential - {0}:
            named[lists.docs[long_[k - 1]]] = True
        doc = np.flatnonzero(named & np.repeat(wanted, WINDOW))
        score = sums[doc]
        for k in (*(essential - {0}), *[k for k in idle[::-1] if k]):
            if k not in essential:  # what is left may add this much at most
                can = score + before[np.flatnonzero(order == k)[0]] >= least
                doc, score = doc[can], score[can]
            own = lists.docs[long_[k - 1]]
            where = np.minimum(np.searchsorted(own, doc), len(own) - 1)
            score = score + np.where(own[where] == doc, lists.impacts[long_[k - 1]][where], 0)
        good = score >= least
        if good.any():
            best.offer(score[good], lists.known[doc[good]], lists.doc_ids[doc[good]])
    return opened, lists.n_windows


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of each row of items, written; item names the row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = F.array_distinct(F.regexp_extract_all(F.translate(F.col("text").cast("string"), upper, upper.lower()), F.lit(TERM), F.lit(0)))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0)
    return materialise(rows.withColumn("item", F.monotonically_increasing_id()), "lexical-items")


def document_frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The documents that hold each term of a block; a row for each of its terms comes to the driver."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        total = np.zeros(len(names), np.int64)
        for b in batches:
            for terms, df in zip(b.column(0), b.column(1)):
                n = np.frombuffer(df.as_py(), "<i4")
                at = [(names[t], k) for k, t in enumerate(terms.as_py().split(b"\n")) if t in names]
                if at:
                    t, k = np.array(at).T
                    total[t] += n[k]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "df").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    shared.destroy()
    return out


def search_block(index: DataFrame, rows: list, n: int, total: int, best: int) -> DataFrame:
    """(item, item_id, task, known, doc_id, score), written: each task's best documents for each of the items."""
    vocabulary: dict[bytes, int] = _Ids()
    asked = [(r["item"], r["item_id"], [vocabulary[t.encode("utf-8", "surrogatepass")] for t in r["terms"]]) for r in rows]
    vocabulary = dict(vocabulary)
    df = document_frequencies(index, vocabulary)
    weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    shared = index.sparkSession.sparkContext.broadcast((asked, vocabulary, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked, vocabulary, weight = shared.value
        found = [Best(best) for _ in asked]
        for b in batches:
            for k in range(b.num_rows):
                lists = Lists(b.slice(k, 1).to_pylist()[0], vocabulary, weight, n, total)
                for (_, _, terms), own in zip(asked, found):
                    search_segment(lists, terms, own)
        size = [len(f.score) for f in found]
        if sum(size):
            item, item_id = (pa.array([x for a, s in zip(asked, size) for x in [a[k]] * s], pa.int64()) for k in (0, 1))
            known, doc, score = (np.concatenate([getattr(f, c) for f in found]) for c in ("known", "doc", "score"))
            task = pa.array([TaskContext.get().partitionId()] * sum(size), pa.int64())
            yield pa.RecordBatch.from_arrays([item, item_id, task, pa.array(doc, mask=known == 0), pa.array(score)], ["item", "item_id", "task", "doc_id", "score"])

    hits = materialise(index.drop("n_docs", "n_words").mapInArrow(search, "item long, item_id long, task long, doc_id long, score long"), "lexical-hits")
    shared.destroy()
    return hits


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `best` documents with a score above 0."""
    index = build_index(docs)
    s = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("total")).first()
    wanted = item_terms(items)
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    n_blocks = max(1, -(-size["n"] // ITEMS), -(-size["terms"] // TERMS))
    hits = None
    for k in range(n_blocks):  # the broadcasts of a block are gone before the next
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k).collect()
        part = search_block(index, rows, s["n"], s["total"], best)
        hits = part if hits is None else hits.union(part)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    if (hits.agg(F.max("task")).first()[0] or 0) >= TASKS:
        hits = hits.withColumn("group", F.floor(F.col("task") / TASKS)).withColumn("rank", place("item", "group")).where(F.col("rank") <= best)
    return hits.withColumn("rank", place("item")).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")

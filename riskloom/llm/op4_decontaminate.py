"""Benchmark decontamination: BM25 over test items with block-max WAND.

An inverted index holds the test items. Every passage of every document (word
windows that overlap by half, so that any item fits into one) is a query of its
distinct words. An item's score is its BM25 sum over the words it shares with the
passage, divided by the score it would have if all its words were there; all items
at or above `threshold` are retrieved. Items lie in blocks with a largest impact
for each word and block; a block whose sum of these stays below the threshold is
skipped, and WAND pivots find the items of the others. Retrieved items are then
verified: `overlap` of the words of its question and of its answer must occur in
the passage, and either that share of the item's word 5-grams or, for items with
altered words, the same share of question and answer in order within a span a
quarter longer than the item.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond
ASCII. The answer is the text after the last line break or, without one, the last
sentence; an item of one sentence is split in half.

Word statistics (in how many items a word stands, their number and mean length) are
counted over all items before the index is split into shards, so a score does not
depend on the shards. Shards hold about SHARD_ITEMS items or SHARD_WORDS words, each
with a scan of the documents of its own; an item is one row and has to fit into a
task. An item is indexed by equal consecutive parts of PART_WORDS words at most (most
items have one), which only retrieve: a part's hit has the whole item scored and
verified on as many words around it as the item may take.

Cases: null or empty texts and items have no words and match nothing; equal items
are each reported; of several passages that hold an item the best one is reported,
the first of equals; very long texts are read whole, a slice of windows at a time;
repeated documents each get their rows; an empty table gives no rows; further
columns are ignored, whatever their names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SHARD_ITEMS, SHARD_WORDS, PART_WORDS = 4096, 400_000, 400
SLICE = 20_000
K1, B = 1.2, 0.75
GRAM = 5
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def grams_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def question_answer(text: str) -> tuple[set[bytes], set[bytes]]:
    question, answer = question_answer_words(text)
    return set(question), set(answer)


def question_answer_words(text: str) -> tuple[list[bytes], list[bytes]]:
    head, cut, tail = text.strip().rpartition("\n")
    if not (cut and words_of(head) and words_of(tail)):
        parts = re.split(r"(?<=[.?!])\s+", text.strip())
        head, tail = " ".join(parts[:-1]), parts[-1]
    if words_of(head) and words_of(tail):
        return words_of(head), words_of(tail)
    w = words_of(text)
    return w[: (len(w) + 1) // 2], w[len(w) // 2 :]


def common_in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    at: dict[bytes, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if u := v & at.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def stands_in_order(question: list[bytes], answer: list[bytes], passage: list[bytes], size: int, overlap: float) -> bool:
    """Whether one span of the passage, a quarter longer than the item, holds the share `overlap` of question and answer in order."""
    step = max(1, size // 8)
    span = size + size // 4 + step
    for k in range(0, max(1, len(passage) - size + step), step):
        part = passage[k : k + span]
        if common_in_order(answer, part) >= overlap * len(answer) and common_in_order(question, part) >= overlap * len(question):
            return True
    return False


def parts_of(words: list[bytes]) -> list[list[bytes]]:
    """The words in the least number of parts of PART_WORDS at most, as equal as can be."""
    n = -(-len(words) // PART_WORDS)
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


@dataclass
class Statistics:
    """Of all items: their number, mean length in words, and in how many of them each word stands."""

    n: int
    mean: float
    df: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[str | None]) -> "Statistics":
        bags = [words for t in texts if (words := words_of(t))]
        return cls(len(bags), sum(map(len, bags)) / max(1, len(bags)), Counter(w for b in bags for w in set(b)))


class Index:
    """Postings with normalised impacts over (item_id, text) rows."""

    def __init__(self, items: list[tuple[int, str]], n_blocks: int = 64, known: Statistics | None = None):
        known = known or Statistics.of([t for _, t in items])
        #: of each part: its item, the item's first part, where the part begins
        self.ids, self.first, self.begins, texts, bags = [], [], [], {}, []
        for item, text in sorted(items, key=lambda r: (len(words_of(r[1])), r[0] is None, r[0] or 0)):
            head, begin = len(bags), 0
            for part in parts_of(words_of(text)):
                texts[head] = text
                self.ids.append(item)
                self.first.append(head)
                self.begins.append(begin)
                bags.append(Counter(part))
                begin += len(part)
        n, df = len(bags), known.df
        self.longest = max([1, *(sum(b.values()) for b in bags)])
        self.term = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]

        def impacts(bag: Counter) -> dict[bytes, float]:
            size = sum(bag.values())
            impact = {w: np.log1p((known.n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / known.mean)) for w, tf in bag.items()}
            whole = sum(impact.values())
            return {w: x / whole for w, x in impact.items()}

        for i, bag in enumerate(bags):
            for w, x in impacts(bag).items():
                postings[self.term[w]].append((i, x))
        self.items = [np.array([p[0] for p in row], np.int32) for row in postings]
        self.impacts = [np.array([p[1] for p in row], np.float32) for row in postings]
        self.block = max(8, -(-n // n_blocks))
        self.n_blocks = -(-n // self.block) if n else 0
        self.block_max = np.zeros((len(self.term), self.n_blocks), np.float32)
        for t, (i, x) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.block_max[t], i // self.block, x)
        #: words of over a tenth of the items only add to every bound at once
        self.common = np.array([len(i) > max(3, 0.1 * n) for i in self.items], bool)
        slack = np.zeros(max(1, n), np.float32)
        for t in np.flatnonzero(self.common):
            slack[self.items[t]] += self.impacts[t]
        self.slack = np.array([slack[k * self.block : (k + 1) * self.block].max() for k in range(self.n_blocks)], np.float32)
        self.largest = self.block_max.max(axis=1) if self.n_blocks else np.zeros(0, np.float32)
        self.checks = {i: (grams_of(words_of(t)), *question_answer(t), min(GRAM, len(words_of(t)))) for i, t in texts.items()}
        self.ordered = {i: question_answer_words(t) for i, t in texts.items()}
        self.size = {i: len(words_of(t)) for i, t in texts.items()}
        #: impacts of the items that have several parts
        self.long = {i: impacts(Counter(words_of(texts[i]))) for i in texts if self.size[i] > PART_WORDS}

    def skips_common(self, threshold: float) -> bool:
        """Whether a passage without rarer words stays below the threshold."""
        return self.slack.max() < threshold - 1e-3

    def blocks_over(self, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(window, block) whose bound reaches the threshold; (window, term) are distinct and
        sorted by window. A slice of windows has its bounds in memory at a time."""
        if not len(window):
            return window, window
        first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
        edges = np.unique(np.r_[0, np.searchsorted(first, np.arange(SLICE, len(window), SLICE)), len(first)])
        begin, windows, blocks = np.r_[first, len(window)], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            bound = np.add.reduceat(self.block_max[term[begin[lo] : begin[hi]]], first[lo:hi] - begin[lo], axis=0) + (self.slack if self.skips_common(threshold) else 0)
            w, b = np.nonzero(bound >= threshold - 1e-5)
            windows.append(window[first[lo:hi]][w]), blocks.append(b)
        return np.concatenate(windows), np.concatenate(blocks)

    def wand(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of a block that reach the threshold for the query terms."""
        lo, hi, cursors = block * self.block, (block + 1) * self.block, []
        for t in terms:
            a, z = np.searchsorted(self.items[t], (lo, hi))
            if a < z:
                cursors.append([int(self.items[t][a]), a, z, self.items[t], self.impacts[t], float(self.block_max[t, block])])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= threshold - 1e-5:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                total = sum(float(c[4][c[1]]) for c in cursors if c[0] == item)
                if total >= threshold - 1e-5:
                    found.append((item, total))
                target = item + 1
            else:
                target = item
            for c in cursors:
                if c[0] < target:
                    c[1] += int(np.searchsorted(c[3][c[1] : c[2]], target))
                    c[0] = int(c[3][c[1]]) if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def search(self, texts: list[str | None], threshold: float, overlap: float) -> list[tuple[int, int, float, float, float, float, int]]:
        """(text number, item's first part, score, gram, question, answer share, passage
        start) of verified matches, the best passage for each text and item."""
        if not self.n_blocks:
            return []
        stride = max(64, self.longest * 5 // 4)
        get, docs, tokens, sizes = self.term.get, [], [], []
        for text in texts:
            words = words_of(text)
            docs.append(words)
            tokens.append(np.array([get(w, -1) for w in words], np.int64))
            sizes.append(-(-len(words) // stride) + 1)
        base = np.concatenate([[0], np.cumsum(sizes)])
        at = np.concatenate([np.arange(len(t)) // stride + b for t, b in zip(tokens, base)])
        flat = np.concatenate(tokens)
        at, flat = at[flat >= 0], flat[flat >= 0]
        # a window is two strides long: each word counts for its own stride's window and for the one before
        width = len(self.term)
        if self.skips_common(threshold):
            rare = ~self.common[flat]
            at, flat = at[rare], flat[rare]
        # windows whose words could not reach the threshold even if each stood in its best item need no look
        most = np.bincount(at, self.largest[flat], int(base[-1]) + 1)
        hopeful = most + np.r_[most[1:], 0.0] + (self.slack.max() if self.skips_common(threshold) else 0) >= threshold - 1e-3
        key = np.concatenate([((at + 1) * width + flat)[hopeful[at]], (at * width + flat)[np.r_[False, hopeful[:-1]][at]]])
        key = np.unique(key)
        best: dict[tuple[int, int], tuple] = {}
        for window, block in zip(*self.blocks_over(key // width, key % width, threshold)):
            window = int(window) - 1
            d = int(np.searchsorted(base, window, side="right")) - 1
            start = (window - int(base[d])) * stride
            words = docs[d][start : start + 2 * stride] if window >= 0 else []
            if not words:  # the stride between two texts; the next text's first words have a window of their own
                continue
            terms = np.unique([t for w in words if (t := get(w, -1)) >= 0]).astype(int)
            for part, score in self.wand(terms, int(block), threshold):
                item, lo, passage = self.first[part], start, words
                if item in self.long:
                    size = self.size[item]
                    lo = max(0, start - self.begins[part] - size // 4)
                    passage = docs[d][lo : start + 2 * stride + size - self.begins[part] + size // 4]
                grams, question, answer, n = self.checks[item]
                there, bag = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}, set(passage)
                if item in self.long:
                    score = sum(x for w, x in self.long[item].items() if w in bag)
                shares = len(grams & there) / max(1, len(grams)), len(question & bag) / max(1, len(question)), len(answer & bag) / max(1, len(answer))
                if score >= threshold - 1e-5 and min(shares[1:]) >= overlap and (shares[0] >= overlap or stands_in_order(*self.ordered[item], passage, self.size[item], overlap)):
                    row = (score, *shares, lo)
                    if (d, item) not in best or row[:4] > best[d, item][:4]:
                        best[d, item] = row
        return [(d, i, *row) for (d, i), row in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, score double, gram_overlap double, question_overlap double, answer_overlap double, passage_start long"


def indexes_of(items: DataFrame) -> Iterator[Index]:
    """The shards' indexes, one after the other, with statistics of all items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                bag = Counter(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(bag), pa.int32()), pa.array(list(bag), pa.binary()), pa.array(list(bag.values()), pa.int64())], ["shard", "word", "n"])

    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
    n = max(1, -(-size["n"] // SHARD_ITEMS), -(-size["c"] // (SHARD_WORDS * 4)))
    plain = materialise(plain.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), "benchmark-items")
    bags = materialise(plain.select("shard", "text").mapInArrow(count, "shard int, word binary, n long"), "benchmark-words")
    frequency = bags.groupBy("word").agg(F.count("*").alias("df"))
    known = materialise(bags.select("shard", "word").distinct().join(frequency, "word"), "benchmark-frequencies")
    total = bags.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()["words"]
    filled = plain.where(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).count()
    for k in range(n):
        rows = plain.where(F.col("shard") == k).select("item_id", "text").collect()  # about SHARD_ITEMS rows or SHARD_WORDS words
        df = {bytes(r["word"]): r["df"] for r in known.where(F.col("shard") == k).select("word", "df").collect()}  # the words of these rows
        yield Index([(r["item_id"], r["text"]) for r in rows], known=Statistics(filled, total / max(1, filled), df))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """A row for each document and item it contains: see SCHEMA."""
    spark, out = docs.sparkSession, None
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for shard in indexes_of(items):
        sent = spark.sparkContext.broadcast(shard)  # within the bounds of a shard

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                for k in range(0, b.num_rows, 200):
                    part = b.slice(k, 200)
                    rows = index.search(part.column(1).to_pylist(), threshold, overlap)
                    if rows:
                        d = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                        cols = [pa.array([index.ids[r[1]] for r in rows], pa.int64()), *(pa.array([float(r[c]) for r in rows]) for c in (2, 3, 4, 5)), pa.array([r[6] for r in rows], pa.int64())]
                        yield pa.RecordBatch.from_arrays([d, *cols], [c.split()[0] for c in SCHEMA.split(", ")])

        found = plain.mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.8) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; no row moves."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    for shard in indexes_of(items):
        sent = spark.sparkContext.broadcast(shard)  # within the bounds of a shard

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(0, b.num_rows, 200):
                    part = b.slice(k, 200)
                    leaks = {r[0] for r in sent.value.search(part.column(place).to_pylist(), threshold, overlap)}
                    yield part.filter(pa.array([i not in leaks for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

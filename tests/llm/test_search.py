"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskloom.llm import op13_lexical_search as op

DOCS = "doc_id long, text string, TERMS string, score long, item long"
ITEMS = "item_id long, text string, rank int, Item string"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in _TERM.findall(text or "")]


def brute(docs, items, best=10):
    """Rows (item_id, rank, doc_id, score), item by item."""
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def corpus(rng, n):
    """Common and rare words in documents of very different lengths, with copies."""
    vocabulary = [f"w{k}" for k in range(400)]
    word = lambda: rng.choice(("the", "of", "AND")) if rng.random() < 0.4 else vocabulary[int(400 * rng.random() ** 3)]
    docs = [(k, rng.choice((" ", "\n", "-_", "\x00")).join(word() for _ in range(rng.choice((1, 5, 60, 300))))) for k in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(n // 3)]  # equal scores
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 30)))) for k in range(40)]
    return docs, items


def local(docs, items, best=10):
    """build, Lists and search_segment without Spark; also how many windows were opened and seen."""
    segments, now = [], op.Segment()
    for d, t in docs:
        now.add(d, t)
        if now.full():
            segments.append(now.row())
            now = op.Segment()
    segments += [now.row()] if now.n_words else []
    rows = [s.to_pylist()[0] for s in segments]
    n, total = sum(r["n_docs"] for r in rows), sum(r["n_words"] for r in rows)
    vocabulary = op._Ids()
    asked = [(i, [vocabulary[t.encode()] for t in dict.fromkeys(terms(text))]) for i, text in items]
    df = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        for t, k in zip(r["terms"].split(b"\n"), np.frombuffer(r["df"], "<i4")):
            if t in vocabulary:
                df[vocabulary[t]] += k
    weight = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    found, windows = [op.Best(best) for _ in asked], np.zeros(2, int)
    for r in rows:
        lists = op.Lists(r, vocabulary, weight, n, total)
        for (_, t), own in zip(asked, found):
            windows += op.search_segment(lists, t, own)
    return sorted([(i, k + 1, int(d) if known else None, int(s)) for (i, _), f in zip(asked, found) for k, (s, known, d) in enumerate(zip(f.score, f.known, f.doc))], key=str), windows


@pytest.mark.parametrize("words, docs, window, short, cut", [(1 << 20, 1 << 16, 128, 1 / 32, 1 << 20), (3000, 1 << 16, 8, 1 / 8, 50), (1 << 20, 37, 4, 0.0, 7), (500, 500, 1, 1.0, 1 << 20)])
def test_segments_windows_and_slices(monkeypatch, words, docs, window, short, cut):
    rng = random.Random(words + docs)
    for name, value in (("SEGMENT_WORDS", words), ("SEGMENT_DOCS", docs), ("WINDOW", window), ("SHORT", short), ("SLICE", cut)):
        monkeypatch.setattr(op, name, value)
    for _ in range(3):
        d, i = corpus(rng, 200)
        for best in (1, 10, 1000):
            assert local(d, i, best)[0] == brute(d, i, best)


def test_windows_are_skipped(monkeypatch):
    """Good documents stand in front: later windows cannot reach them, and stay closed."""
    monkeypatch.setattr(op, "WINDOW", 16)
    rng = random.Random(2)
    docs = [(k, ("alpha beta gamma " if k < 40 else "alpha " if k % 3 else "beta ") + " ".join(f"w{rng.randrange(50)}" for _ in range(10 if k < 40 else 100))) for k in range(2000)]
    items = [(1, "alpha beta gamma")]
    rows, (opened, seen) = local(docs, items)
    assert rows == brute(docs, items) and opened * 4 < seen


def test_lengths_beyond_64_bits():
    row = dict(n_docs=2, n_words=0, doc_ids=np.array([1, 2], "<i8").tobytes(), known=b"\1\1", lengths=np.array([10**12, 5], "<i8").tobytes(), terms=b"a", df=np.array([2], "<i4").tobytes(), docs=np.array([0, 1], "<i4").tobytes(), tf=np.array([7, 1], "<u8").tobytes(), tf_width=8)
    lists = op.Lists(row, {b"a": 0}, np.array([3]), 10**9, 10**13)
    m = [10 + 90 * n * 10**9 // 10**13 for n in (10**12, 5)]
    assert lists.impacts[0].tolist() == [3 * (10**9 * tf // (1000 * tf + 8 * k)) for tf, k in zip((7, 1), m)]


def test_on_spark(spark, monkeypatch):
    rng = random.Random(8)
    docs, items = corpus(rng, 150)
    docs += [(None, docs[3][1]), (None, "only null w1"), (3, docs[3][1]), (900, None), (901, ""), (902, " .,- "), (903, "É é ß w1"), (904, "long " * 300_000 + "w2"), (905, "w3\x1fw3")]
    items += [(100, None), (101, ""), (102, "..."), (103, "É É"), (104, "unheard"), (None, "w1 w2"), (0, "w5 w6 w7"), (105, "w1 " * 3000), (106, docs[3][1])]
    d = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in docs], DOCS).repartition(5)
    i = spark.createDataFrame([(k, t, 1, "y") for k, t in items], ITEMS).repartition(3)
    got = op.ranked(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    expect = brute(docs, items)
    assert sorted(map(tuple, got.collect()), key=str) == expect
    monkeypatch.setattr(op, "ITEMS", 7)  # several blocks
    monkeypatch.setattr(op, "TASKS", 1)  # groups of tasks
    assert sorted(map(tuple, op.ranked(d, i).collect()), key=str) == expect
    assert op.ranked(d.limit(0), i).count() == 0 and op.ranked(d, i.limit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    from riskloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rows = defaultdict(list)
    for r in QUERIES["op13_lexical_search"](spark, sf).collect():
        rows[r.item_id].append(r.rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in rows.values())
    assert sorted(map(tuple, QUERIES["op13_lexical_search"](spark, sf).collect()), key=str) == brute(docs, items)

"""The operators on Spark against brute force."""

import os
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common, op1_packing, op2_minhash, op3_licenses, op4_decontaminate, op5_importance, op6_toxicity, op7_exact_dedup, op8_warc, op9_token_planes, op10_repeats
from riskloom.llm.tokens import Encoder, default_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, salt string, n long, kept string"


def words(rng, n, size=200):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, empty, null, long and tied texts, with columns that could clash."""
    rng = random.Random(11)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c"), (7, "A  b\tc"), (8, words(rng, 20_000))]
    for g in range(6):
        base = words(rng, 120).split()
        for c in range(14):
            w = list(base)
            for _ in range(c % 7):
                w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
            out.append((len(out), (" " if c % 2 else "\n").join(w)))
    out += [(len(out) + k, words(rng, rng.randint(1, 80))) for k in range(60)]
    out += [(300, out[20][1]), (301, out[20][1] + "  "), (302, out[21][1]), (8, out[8][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "s", d, "k") for d, t in texts], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(text):
    return np.append(np.frombuffer(Encoder.of(default_path()).ids(text), "<u4"), np.uint32(2)).astype("<u4")


def test_packing(docs, texts, empty):
    rows = op1_packing.pack(docs, window=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    left = Counter((d, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for d, t in texts)
    seen = Counter()
    for d, parts in by.items():
        own = [t for i, t in texts if i == d]
        for r in parts:
            ids = ids_of(own[0])
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        covered = Counter(k for r in parts for k in range(r.start, r.start + r.length))
        assert covered == Counter({k: len(own) for k in range(len(ids_of(own[0])))})
    del left, seen
    place = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in place:
        assert s * 64 + o == at and o + n <= 64
        at += n
    assert at == sum(len(ids_of(t)) for _, t in texts)
    assert op1_packing.pack(empty).count() == 0


@pytest.mark.parametrize("n, padded", [(3, 4), (4, 4), (5, 64)])
def test_last_sequence_is_padded_but_at_powers_of_two(spark, n, padded):
    one = spark.createDataFrame([(1, " ".join(["cat"] * (n - 1)))], "doc_id long, text string").coalesce(1)
    rows = op1_packing.pack(one, window=64).collect()
    assert rows[0].length == n and rows[0].padded_to == (padded if n & (n - 1) == 0 else 64)


def test_sequences(docs, texts):
    rows = {r.sequence_id: r for r in op1_packing.sequences(docs, window=256).collect()}
    assert sorted(Counter(x for r in rows.values() for x in r.ids[: r.n_tokens]).items()) == sorted(Counter(int(x) for _, t in texts for x in ids_of(t)).items())
    assert all(len(r.ids) == 256 for k, r in rows.items() if k < max(rows))


def sets_of(texts, size):
    out = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        out[d] = frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def components(sets, share):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= share * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("size, share, large", [(3, 85, 64), (5, 80, 64), (3, 85, 2), (3, 60, 3)])
def test_near_dedup(docs, texts, size, share, large, monkeypatch):
    monkeypatch.setattr(op2_minhash, "LARGE", large)
    monkeypatch.setattr(op2_minhash, "RARE", 4 if large < 64 else 32)
    monkeypatch.setattr(op2_minhash, "BLOCK", 8 if large < 64 else 1024)
    sets = sets_of(texts, size)
    expect = components(sets, share)
    rows = op2_minhash.near_dedup(docs, size, share).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expect[r.doc_id], r.doc_id == expect[r.doc_id])


def test_near_dedup_of_nothing_and_of_null_ids(spark, empty):
    assert op2_minhash.near_dedup(empty).count() == 0
    rows = op2_minhash.near_dedup(spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in rows) == [(False, 2, True), (True, None, True), (True, None, True)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in nodes}


def test_licenses(docs, texts, empty):
    rows = op3_licenses.scan_licenses(docs).collect()
    assert sorted((r.doc_id, r.n_words) for r in rows) == sorted((d, len(op3_licenses.words_of(t))) for d, t in texts)
    assert op3_licenses.scan_licenses(empty).count() == 0


def test_licenses_on_tables(spark):
    import re

    rows = {r.doc_id: r for r in op3_licenses.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        at = [(k, p) for p in op3_licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({op3_licenses.BASE[p] for _, p in at}))
        notices = [p for p in op3_licenses.NOTICES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        tags = [op3_licenses.evaluate(line) for line in re.findall(r"(?i)spdx-license-identifier\s*:[ \t]*([^\r\n]*)", d.text or "")]
        labels = {op3_licenses.BASE[p] for _, p in at} | {op3_licenses.NOTICES[p] for p in notices} | {n for names, _ in tags for n in names}
        assert r.labels == ",".join(sorted(labels))
        assert r.score == (1.0 if any(duty for _, duty in tags) else 1 - 0.5 ** (len(at) + len(notices)))


def test_decontamination(spark, empty):
    rng = random.Random(6)
    items = [(k, words(rng, rng.randint(8, 40), 3000) + ". " + words(rng, 8, 3000)) for k in range(30)] + [(30, None), (31, "")]
    rows = [(k, words(rng, rng.randint(0, 500), 3000) + (" " + items[k % 30][1] if k % 4 == 0 else "") + " " + words(rng, 30, 3000)) for k in range(80)] + [(90, None)]
    d = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, score string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = op4_decontaminate.find_leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k % 30) for k in range(0, 80, 4)}
    kept = op4_decontaminate.without_leaks(d, i)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k in range(80) if k % 4} | {90}
    assert op4_decontaminate.find_leaks(empty, i).count() == 0 and op4_decontaminate.find_leaks(d, i.limit(0)).count() == 0
    assert op4_decontaminate.without_leaks(d, i.limit(0)).count() == d.count()


def test_decontamination_in_shards(spark, monkeypatch):
    monkeypatch.setattr(op4_decontaminate, "SHARD_ITEMS", 4)
    rng = random.Random(8)
    items = [(k, words(rng, 20, 3000)) for k in range(20)]
    d = spark.createDataFrame([(k, words(rng, 50, 3000) + " " + items[k][1]) for k in range(20)], "doc_id long, text string")
    i = spark.createDataFrame([*items, (90, None), (91, "?!")], "item_id long, text string")
    got = op4_decontaminate.find_leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(20)}
    monkeypatch.undo()
    assert sorted(op4_decontaminate.find_leaks(d, i).collect()) == sorted(got)  # shards change nothing, scores included


def test_decontamination_of_a_very_long_text(spark, monkeypatch):
    rng = random.Random(18)
    items = [(k, words(rng, 30, 3000)) for k in range(40)]
    long = words(rng, 150_000, 3000).split()
    for k, at in ((3, 10), (7, 70_000), (9, 140_000)):
        long[at:at] = items[k][1].split()
    monkeypatch.setattr(op4_decontaminate, "SLICE", 100)
    d = spark.createDataFrame([(1, " ".join(long)), (1, " ".join(long)), (2, items[5][1])], "doc_id long, text string")
    got = op4_decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 3), (1, 3), (1, 7), (1, 7), (1, 9), (1, 9), (2, 5)]


def test_resampling(spark):
    rng = random.Random(5)
    good = [(k, words(rng, rng.randint(5, 120))) for k in range(300)]
    bad = [(1000 + k, " ".join(f"W{rng.randrange(200)}!!" for _ in range(60))) for k in range(60)]
    d = spark.createDataFrame([(a, b, 1.0, "x") for a, b in good + bad], "doc_id long, text string, log_ratio double, key string")
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 2)] + [(1000 + k, 0) for k in range(0, 60, 2)] + [(5000, 1), (1, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in op5_importance.resample(d, labels).collect()}
    assert {k for k, r in rows.items() if r.kept} == {a for a, _ in good} and len(rows) == 360
    # brute force of the weights
    raw, target = np.ones(op5_importance.BUCKETS), np.ones(op5_importance.BUCKETS)
    for _, t in good + bad:
        np.add.at(raw, op5_importance.ngram_buckets(t), 1)
    held = {r.doc_id: r.h for r in spark.range(6000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(18)), F.lit(4)) == 0).alias("h")).collect()}
    for a, t in good:
        if a % 2 == 0 and not held[a]:
            np.add.at(target, op5_importance.ngram_buckets(t), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert all(abs(rows[a].log_ratio - ratio[op5_importance.ngram_buckets(t)].sum()) < 1e-6 for a, t in good + bad)
    drawn = op5_importance.drawn(d, labels)
    assert drawn.columns == d.columns and {(r.doc_id, r.log_ratio) for r in drawn.collect()} == {(a, 1.0) for a, _ in good}


def test_resampling_of_nothing(spark, empty, docs, texts):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert op5_importance.resample(empty, none).count() == 0
    assert op5_importance.resample(docs, none).where("kept").count() == len(texts)


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.uniform(-1e6, 1e6), 0.5, -2.25]) for _ in range(500)]
    coded = spark.createDataFrame([(v,) for v in values], "v double").select(op5_importance.code_of(F.col("v")).alias("code"))
    codes = sorted((r.code for r in coded.collect()), reverse=True)
    for k in (1, 2, 250, 499, 500):
        assert op5_importance.kth_largest(coded, k) == codes[k - 1]


def brute_chain(texts, quality, toxic, n, spark, queries):
    """The chain with features, folds and predictions recounted in plain Python."""
    ids = sorted(texts)
    folds = {r.id: r.f for r in spark.range(max(ids) + 1).select("id", F.pmod(F.xxhash64("id", F.lit(30)), F.lit(5)).alias("f")).collect()}
    has = {k: {f for w in set(op6_toxicity.words_of(texts[k])) for f in op6_toxicity.word_features(w)} for k in ids}
    answers = [set(f for w in set(op6_toxicity.words_of(t)) for f in op6_toxicity.word_features(w)) for t in queries]
    labels = [{k: None if quality[k] is None else float(quality[k] <= 0) for k in ids}, {k: float(toxic[k]) for k in ids}]
    ahead, asked = {k: [] for k in ids}, [[] for _ in queries]

    def model(y, inn):
        pos, neg = Counter(), Counter()
        for k in inn:
            (pos if y[k] else neg).update(has[k])
        nb, ng = max(1, sum(y[k] == 1 for k in inn)), max(1, sum(y[k] == 0 for k in inn))
        chi = {}
        for f in set(pos) | set(neg):
            a, b = pos[f], neg[f]
            if a + b >= 3:
                gap = float(a * (ng - b) - b * (nb - a))
                chi[f] = gap * gap * float(nb + ng) / (float(a + b) * (nb + ng - a - b + 1) * float(nb) * float(ng))
        best = sorted(sorted(chi, key=lambda f: (-chi[f], f))[:n])
        at = {f: j for j, f in enumerate(best)}
        rows = [sorted(at[f] for f in has[k] if f in at) for k in inn]
        link = op6_toxicity.fit(rows, np.array([ahead[k] for k in inn]).reshape(len(inn), -1), np.array([y[k] for k in inn]), np.ones(len(best), bool))
        return lambda present, before: float(link.predict([sorted(at[f] for f in present if f in at)], np.array([before]).reshape(1, -1))[0])

    for y in labels:
        known = [k for k in ids if y[k] is not None]
        last = model(y, known)
        out = {}
        for f in range(5):
            part = model(y, [k for k in known if folds[k] != f])
            out |= {k: part(has[k], ahead[k]) for k in ids if folds[k] == f}
        asked = [[*before, last(present, before)] for present, before in zip(answers, asked)]
        ahead = {k: [*ahead[k], out[k]] for k in ids}
    return asked


def test_toxicity(spark, empty):
    rng = random.Random(3)
    bad = {"idiot", "scumbag", "moronic"}
    rows = []
    for k in range(700):
        w = words(rng, rng.randint(5, 150)).split()
        if k % 6 == 0:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(sorted(bad)) + rng.choice(["", "s", "ly"]))
        rows.append((k, " ".join(w)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    d = d.union(d.where("doc_id IN (0, 650)"))
    quality = lambda k: None if k % 7 == 0 else int(k % 5 > 0)
    labels = spark.createDataFrame([(k, quality(k), int(k % 6 == 0)) for k in range(500)] + [(2, 1, None)], "doc_id long, quality int, toxic int")
    chain = op6_toxicity.train(d, labels, n_features=200)
    scored = op6_toxicity.score(d, chain).collect()
    got = {r.doc_id: r.is_toxic for r in scored}
    assert len(scored) == 704
    expect = brute_chain({k: t for k, t in rows if k < 500}, {k: quality(k) for k in range(500)}, {k: int(k % 6 == 0) for k in range(500)}, 200, spark, [t for _, t in rows])
    by_text = {r.doc_id: (r.p_poor, r.p_toxic) for r in scored}
    assert all(np.allclose(by_text[k], expect[i], atol=1e-6) for i, (k, _) in enumerate(rows))
    wrong = [k for k in range(500, 700) if got[k] != (k % 6 == 0)]
    assert len(wrong) <= 2 and not got[900] and not got[901]
    assert op6_toxicity.score(empty, chain).count() == 0
    silent = op6_toxicity.train(d, labels.withColumn("toxic", F.lit(0)))
    assert op6_toxicity.score(d, silent).where("is_toxic").count() == 0


def exact(texts):
    groups = defaultdict(list)
    for d, t in texts:
        groups["".join(c for c in t or "" if c not in op7_exact_dedup.SPACES)].append((-len(t or ""), d))
    return {d: (min(g)[1], len(g)) for g in groups.values() for _, d in g}


def test_exact_dedup(docs, texts, empty, monkeypatch):
    monkeypatch.setattr(op7_exact_dedup, "HOT_SHARE", 60)
    expect = exact(texts)
    rows = op7_exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(texts) and all((r.keep_id, r.group_size) == expect[r.doc_id] and r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert op7_exact_dedup.exact_dedup(empty).count() == 0
    kept = op7_exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in expect.values()})


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    rows = [(1, "same text", 1), (2, "same text", 2), (2, "another text", 3), (3, "x y", 4), (3, "x  y", 5), (3, "x y", 6), (4, None, 7), (None, "", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, Digest int").repartition(3)
    assert sorted(r.Digest for r in op7_exact_dedup.distinct_documents(d).collect()) == [1, 3, 5, 7]
    d = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "g h i j k l", 3), (5, "g h i j k l", 4)], "doc_id long, text string, set_key int").repartition(3)
    assert sorted(r.set_key for r in op2_minhash.one_of_each(d).collect()) == [1, 3]


def test_exact_dedup_against_history(spark):
    old = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "ab"), (11, "d"), (12, " d"), (13, "e"), (None, "c")], "doc_id long, text string")
    history = op7_exact_dedup.winners(op7_exact_dedup.digests(old))
    got = {r.doc_id: (r.keep_id, r.kept) for r in op7_exact_dedup.exact_dedup(new, history).collect()}
    assert got == {10: (1, False), 11: (12, False), 12: (12, True), 13: (13, True), None: (2, False)}
    again = history.union(history.selectExpr("digest", "keep_id + 100", "group_size")).union(history.limit(0))
    rows = {r.doc_id: (r.keep_id, r.group_size) for r in op7_exact_dedup.exact_dedup(new, again).collect()}
    assert rows == {10: (1, 3), 11: (12, 2), 12: (12, 2), 13: (13, 1), None: (2, 3)}
    with pytest.raises(ValueError):
        op7_exact_dedup.PerfectHash.build(np.zeros((2, 32), np.uint8))


def test_exact_dedup_reads_its_slots(spark, docs, texts, monkeypatch):
    """Without the lookup, or with slots that name other winners, the result is another."""
    right = op7_exact_dedup.lookup
    spoiled = {
        "all are members": lambda *a: right(*a).withColumn("slot", F.greatest("slot", F.lit(0))),
        "none is": lambda *a: right(*a).withColumn("slot", F.lit(-1).cast("long")),
        "other winners": lambda *a: right(*a).withColumn("keep_id", F.col("keep_id") + 1),
    }
    expect = exact(texts)
    for how in spoiled.values():
        monkeypatch.setattr(op7_exact_dedup, "lookup", how)
        rows = op7_exact_dedup.exact_dedup(docs).collect()
        assert any((r.keep_id, r.group_size) != expect[r.doc_id] for r in rows)


def test_exact_dedup_with_large_ids_beside_nulls(spark):
    rows = [(2**60 + k, f"t{k // 3}") for k in range(60)] + [(None, f"t{k}") for k in range(20)]
    got = op7_exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r.group_size == 4 and (r.keep_id - 2**60) % 3 == 0 for r in got) and sum(r.kept for r in got) == 20


def test_warc(spark, tmp_path):
    rng = random.Random(7)
    bodies = [None, "", "<p>x</p>", "é" * 50] + [words(rng, 30) for _ in range(20)]
    rows = [(k, f"https://h{k % 5}.org/{rng.randrange(9)}", bodies[k % len(bodies)]) for k in range(70)] + [(None, None, "z"), (80, None, "z"), (3, "http://a/", "q"), (2**60 + 1, "http://b/", "big"), (2**60 + 3, "http://c/", "big")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, winner string").repartition(3)
    got = op8_warc.warc_round_trip(pages, str(tmp_path), with_payload=True).collect()
    top = defaultdict(int)
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(top[h or ""], p)
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((p, op8_warc.base32_sha1((h or "").encode())) for p, _, h in rows)
    html = {(p, op8_warc.base32_sha1((h or "").encode())): h or "" for p, _, h in rows}
    for r in got:
        h = html[r.page_id, r.payload_digest]
        refers = top[h] if r.page_id is not None and r.page_id < top[h] else None
        assert (r.refers_to, r.record_type, r.payload_bytes) == (refers, "revisit" if refers is not None else "response", len(h.encode()))
        assert bytes(r.payload) == (b"" if refers is not None else h.encode())
    assert [(r.url_key, r.stamp) for r in got] == sorted((r.url_key, r.stamp) for r in got)
    runs = op8_warc.write_archives(op8_warc.assign(pages), str(tmp_path))
    merged = op8_warc.merge_index(runs).orderBy("rank").collect()
    assert [(r.url_key, r.stamp, r.file, r.offset) for r in merged] == sorted((r.url_key, r.stamp, r.file, r.offset) for r in merged) and len({r.rank for r in merged}) == len(rows)
    backwards = op8_warc.read_archives(op8_warc.merge_index(runs).withColumn("rank", -F.col("rank"))).collect()
    assert [r.page_id for r in backwards] == [r.page_id for r in merged][::-1]  # the merge's ranks decide the order
    assert len([f for f in os.listdir(tmp_path) if f.endswith(".warc.gz")]) >= 1
    assert op8_warc.warc_round_trip(pages.limit(0)).count() == 0
    small = op8_warc.warc_round_trip(pages, min_bytes=10).where("payload_bytes < 10")
    assert small.where("record_type = 'revisit'").count() == 0 and small.count() > 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_planes(docs, texts, empty, tmp_path, bits):
    rows = op9_token_planes.read_files(docs.sparkSession, op9_token_planes.write_files(docs, str(tmp_path), default_path(), block=100, bits=bits), with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(d for d, _ in texts)
    own, at = defaultdict(list), 0
    for d, t in texts:
        own[d].append(ids_of(t).tobytes())
    for r in rows:
        assert r.start == at and bytes(r.ids) in own[r.doc_id] and r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert op9_token_planes.token_planes(empty).count() == 0
    odd = docs.sparkSession.createDataFrame([(None, "x"), (2**60 + 1, "y"), (2**60 + 2, "z")], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in op9_token_planes.token_planes(odd).orderBy("start").collect()] == [None, 2**60 + 1, 2**60 + 2]


def spans_of(texts, n):
    places = defaultdict(set)
    rows = defaultdict(set)
    for d, t in texts:
        w = (t or "").encode().lower().split()
        for k in range(len(w) - n + 1):
            places[tuple(w[k : k + n])].add(d)
            rows[d].add((k, tuple(w[k : k + n])))
    out = set()
    for d, ws in rows.items():
        hit = sorted({k for k, g in ws if len(places[g]) > 1})
        for k in hit:
            if k - 1 not in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                out.add((d, k, end + n))
    return out


@pytest.mark.parametrize("n, depth", [(50, 20), (12, 5), (6, 6)])
def test_repeats(docs, texts, empty, n, depth):
    got = op10_repeats.repeated_spans(docs, n, depth).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == spans_of(texts, n)
    assert all(r.n_words == r.end_word - r.start_word and r.first_doc_id <= r.doc_id for r in got)
    assert op10_repeats.repeated_spans(empty, n, depth).count() == 0


def test_repeats_of_a_passage_over_many_partitions(spark):
    rng, n, depth = random.Random(4), 12, 5
    word = lambda: f"w{rng.randint(0, 200)}"
    passages = [[word() for _ in range(30)] for _ in range(2)]
    texts = [(k // 2, " ".join([word() for _ in range(rng.randint(0, 9))] + passages[k % 7 == 0][rng.choice([0, 0, 3]) :] + [word() for _ in range(rng.randint(0, 9))])) for k in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = op10_repeats.repeated_spans(spark.createDataFrame(texts, "doc_id long, text string"), n, depth).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == spans_of(texts, n)
    least = {}
    for d, t in texts:
        w = t.split()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            least[g] = min(d, least.get(g, d))
    own = {d: [t.split() for e, t in texts if e == d] for d, _ in texts}
    for r in got:
        lows = [min(least[tuple(w[k : k + n])] for k in range(r.start_word, r.end_word - n + 1)) for w in own[r.doc_id] if len(w) >= r.end_word]
        assert min(lows) <= r.first_doc_id <= r.doc_id


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = common.materialise(p.quality(spark, docs, SF), "t")
    kept = {r.doc_id for r in op5_importance.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in quality.collect()} == kept and quality.columns == docs.columns
    text = {r.doc_id: r.text for r in quality.collect()}
    one = common.materialise(p.exact(spark, quality, SF), "t")
    assert {r.doc_id for r in one.collect()} == {k for k, _ in exact(list(text.items())).values()}
    text = {r.doc_id: text[r.doc_id] for r in one.collect()}
    near = common.materialise(p.near(spark, one, SF), "t")
    assert {r.doc_id for r in near.collect()} == set(components(sets_of(list(text.items()), 5), 80).values())
    clean = common.materialise(p.decontaminate(spark, near, SF), "t")
    items = [" ".join(w.decode() for w in op4_decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {r.doc_id: f" {' '.join(w.decode() for w in op4_decontaminate.words_of(text[r.doc_id]))} " for r in near.collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, t in plain.items() if not any(f" {i} " in t for i in items)}
    packed = p.pack(spark, clean, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {r.doc_id: len(ids_of(r.text)) for r in clean.collect()}

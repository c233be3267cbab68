"""The parts of the operators that need no Spark."""

import gzip
import heapq
import io
import random

import numpy as np
import pytest

from riskloom.llm import op2_minhash, op3_licenses, op4_decontaminate, op5_importance, op6_toxicity, op7_exact_dedup, op8_warc, op9_token_planes, op10_repeats
from riskloom.llm.common import WordHash, shingle_hashes, space_words
from riskloom.llm.tokens import Encoder, default_path

TEXTS = ["", "Hello, world!", "don't STOP 'tis 'll 12 3a4 été ÀÉ ßtraße", "naïve ﬁ ½ x²  tabs\tand\r\nlines", "<|endoftext|> a <|startoftext|>", "日本語 テキスト", "é combining", "İstanbul ΣΑΣ", "a" * 500, " nbsp em", "... !!! ,;: ?!"]


def test_encoder_equals_whole_texts():
    enc = Encoder.of(default_path())
    assert enc.plain
    rng = random.Random(3)
    mixed = [" ".join(rng.choice(TEXTS) for _ in range(5)) for _ in range(50)]
    for text in TEXTS + mixed:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text
    assert enc.ids(None) == b""


def test_encoder_keeps_the_separators_that_are_no_white_space():
    enc = Encoder.of(default_path())
    odd = [chr(c) for c in (*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    for text in [x for c in odd for x in (c, f"!{c}!", f"a{c}b", f"x {c} y", f"it{c}'s {c}{c}")] + ["a".join(odd)]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(enc.ids("!\x1c!"), "<u4").tolist() == [0, 216, 256] and np.frombuffer(enc.ids("\x1f"), "<u4").tolist() == [475]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (op9_token_planes.from_planes(op9_token_planes.to_planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file_round_trip(bits):
    rng, out = np.random.default_rng(1), io.BytesIO()
    docs = [(None, np.arange(3, dtype="<u4"))] + [(k, rng.integers(0, 50_000, int(n)).astype("<u4")) for k, n in enumerate([1, 0, 5, 300, 16, 2, 1000])]
    w = op9_token_planes.PlaneWriter(out, block=64, bits=bits)
    for doc, ids in docs:
        w.add(doc, ids.tobytes())
    assert w.close() == sum(len(i) for _, i in docs)
    raw = out.getvalue()
    got = list(op9_token_planes.PlaneReader(io.BytesIO(raw), len(raw)).documents())
    assert [(d, i.tolist()) for d, i in got] == [(d, i.tolist()) for d, i in docs]
    with pytest.raises(ValueError):
        op9_token_planes.PlaneReader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_space_words():
    assert space_words(" A\tb\x0bC\x0cd\re\nÉ f ") == [b"a", b"b", b"c", b"d", b"e", "É f".encode()]
    assert space_words(None) == space_words("") == []


def test_shingles_are_distinct_and_positional():
    h = WordHash().of(space_words("a b c a b d"))
    assert len(set(shingle_hashes(h, 3))) == 4 and len(shingle_hashes(h[:2], 3)) == 1
    assert shingle_hashes(h[:2], 3)[0] != shingle_hashes(h[1:3], 3)[0]


def test_forest_numbers():
    assert op2_minhash.trees_for(0.85) == 19
    n, m = 76, op2_minhash.least_agreeing(76, 0.85)
    rng = np.random.default_rng(0)
    assert 40 < m < 55 and (rng.binomial(n, 0.85, 200_000) < m).mean() < 1e-4


def test_subtrees_are_as_deep_as_needed():
    rng = np.random.default_rng(7)
    path = rng.integers(0, 3, (500, 12)).astype(np.uint8)
    path[100:300, :5] = 1
    path = path[np.lexsort(path.T[::-1])]
    lcp = op2_minhash.prefix_lengths(path)
    assert lcp.tolist() == [0] + [next((k for k in range(12) if a[k] != b[k]), 12) for a, b in zip(path, path[1:])]
    parts = op2_minhash.subtrees(lcp, 0, 500, 16)
    assert [a for a, _ in parts] == [0, *(z for _, z in parts[:-1])] and parts[-1][1] == 500 and max(z - a for a, z in parts) <= 16
    for (a, z), (_, y) in zip(parts, parts[1:]):  # a cut lies where the prefix is no longer than inside the parts
        assert lcp[z] <= min([*lcp[a + 1 : z], *lcp[z + 1 : y], 12])
    same = np.zeros((50, 4), np.uint8)
    assert max(z - a for a, z in op2_minhash.subtrees(op2_minhash.prefix_lengths(same), 0, 50, 16)) == 16


def test_minhash_estimates():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1200, dtype=np.uint64)
    f = op2_minhash.factors(400)
    a, b = op2_minhash.signature(np.sort(pool[:1000]), f), op2_minhash.signature(np.sort(pool[200:]), f)
    assert abs((a == b).mean() - 800 / 1200) < 0.08


def test_licence_words_and_places():
    got = op3_licenses.scan_text("CC-BY. cc by cc_by; ALL RIGHTS reserved GNU general\npublic LICENSE")
    assert got[:4] == (13, 5, 0, 10) and got[4] == "cc-by,gpl,reserved"
    assert op3_licenses.scan_text(None) == (0, 0, None, None, "", "", 0.0, None)
    assert op3_licenses.scan_text("xcc by ccby")[1] == 0


@pytest.mark.parametrize(
    "text, names, duty",
    [
        ("MIT", ["mit"], "permissive"),
        ("MIT OR GPL-3.0-only", ["gpl-3.0-only", "mit"], "permissive"),
        ("MIT AND GPL-3.0-only", ["gpl-3.0-only", "mit"], "copyleft"),
        ("(MIT OR Apache-2.0) AND LGPL-2.1+", ["apache-2.0", "lgpl-2.1+", "mit"], "weak-copyleft"),
        ("MIT OR Apache-2.0 AND GPL-2.0", ["apache-2.0", "gpl-2.0", "mit"], "permissive"),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0"], "weak-copyleft"),
        ("MIT OR", ["mit"], None),
        ("(MIT", ["mit"], None),
        ("MIT and then prose", ["mit"], "permissive"),
        ("MIT and other terms", ["mit"], "permissive"),
        ("see the licence", [], None),
        ("MIT AND Unheard-Of-1.0", ["mit"], None),
        ("Unheard-Of-1.0 OR MIT", ["mit"], None),
        ("GPL-2.0-only WITH MIT", ["gpl-2.0-only", "mit"], None),
        ("(MIT) WITH Classpath-exception-2.0", ["mit"], None),
        ("LicenseRef-Own OR MIT", ["licenseref-own", "mit"], "permissive"),
        ("mit */", ["mit"], "permissive"),
        ("", [], None),
    ],
)
def test_licence_expressions(text, names, duty):
    assert op3_licenses.evaluate(text) == (names, duty)


def test_licence_expressions_against_trees():
    """Random expression trees, evaluated as trees, against their text."""
    rng = random.Random(21)
    ids = sorted(op3_licenses.DUTIES)
    rank = op3_licenses.RANK

    def tree(depth):
        """(text, how tightly it binds, names, rank)"""
        kind = rng.choice(["id", "with", "and", "or"]) if depth else "id"
        if kind in ("id", "with"):
            n = rng.choice(ids)
            r = rank.index(op3_licenses.DUTIES[n])
            if kind == "id":
                return n.upper(), 4, {n}, r
            return f"{n} WITH {rng.choice(sorted(op3_licenses.EXCEPTIONS))}", 3, {n}, 1 if r == 2 else r
        sides, own = [tree(depth - 1), tree(depth - 1)], 2 if kind == "and" else 1
        text = [f"({t})" if b < own or rng.random() < 0.2 else t for t, b, *_ in sides]
        both = [x[3] for x in sides]
        return f" {kind.upper()} ".join(text), own, sides[0][2] | sides[1][2], max(both) if kind == "and" else min(both)

    for _ in range(400):
        text, _, names, r = tree(rng.randint(0, 4))
        assert op3_licenses.evaluate(text) == (sorted(names), rank[r]), text


def test_licence_tag_gives_score_one():
    got = op3_licenses.scan_text("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode")
    assert got[5] == "apache-2.0,mit" and got[6] == 1.0 and got[4] == ""


def test_wand_equals_scoring_all_items():
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(300)] + ["the", "of"] * 30
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40))) + ".") for k in range(150)]
    index = op4_decontaminate.Index(items, n_blocks=10)
    for _ in range(40):
        base = rng.choice(items)[1].split()
        words = base[: rng.randint(1, len(base))] + [rng.choice(vocab) for _ in range(20)]
        terms = np.unique([index.term[w.strip(".").encode()] for w in words if w.strip(".").encode() in index.term]).astype(int)
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.items[t]] += index.impacts[t]
        least, most = ({i for i in range(len(score)) if score[i] >= x} for x in (0.5, 0.49998))
        got = {i for b in range(index.n_blocks) for i, _ in index.wand(terms, b, 0.5)}
        assert least <= got <= most
        bound = index.block_max[terms].sum(axis=0)
        assert all(bound[i // index.block] >= score[i] - 1e-5 for i in range(len(score)))


def test_search_finds_items_wherever_they_stand():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(rng.randint(6, 50))) + ".\n" + " ".join(word() for _ in range(6))) for k in range(60)]
    index = op4_decontaminate.Index(items)
    texts, expect = [None, "", "short"], set()
    for n in range(120):
        noise = [word() for _ in range(rng.randint(0, 400))]
        if n % 3 == 0:
            k = rng.randrange(60)
            noise.insert(rng.randint(0, len(noise)), items[k][1].upper() if n % 2 else items[k][1])
            expect.add((len(texts), k))
        texts.append(" ".join(noise))
    got = {(d, index.ids[i]) for d, i, *_ in index.search(texts, 0.6, 0.8)}
    assert got == expect
    assert op4_decontaminate.Index([]).search(["a b c"], 0.6, 0.8) == []


def test_slices_of_windows_change_nothing(monkeypatch):
    rng = random.Random(12)
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(25))) for k in range(50)]
    index = op4_decontaminate.Index(items)
    texts = [" ".join([*(f"w{rng.randrange(400)}" for _ in range(500)), items[k][1], *(f"w{rng.randrange(400)}" for _ in range(200))]) for k in range(20)]
    whole = index.search(texts, 0.5, 0.5)
    for n in (1, 7, 300):
        monkeypatch.setattr(op4_decontaminate, "SLICE", n)
        assert index.search(texts, 0.5, 0.5) == whole
    assert {(d, index.ids[i]) for d, i, *_ in whole} >= {(k, k) for k in range(20)}


def test_search_with_common_words_only():
    index = op4_decontaminate.Index([(k, "the same words for all items") for k in range(30)])
    assert len(index.search(["x the same words for all items y"], 0.6, 0.8)) == 30


@pytest.mark.parametrize("n", [400, 401, 801, 1300, 2000])
def test_long_items_are_verified_whole(n):
    rng = random.Random(n)
    word = lambda: f"v{rng.randrange(4000)}"
    item = [word() for _ in range(n)]
    index = op4_decontaminate.Index([(7, " ".join(item)), *((k, " ".join(word() for _ in range(30))) for k in range(20, 40))])
    assert max(sum(1 for w in p) for p in op4_decontaminate.parts_of(item)) - min(len(p) for p in op4_decontaminate.parts_of(item)) <= 1
    noise = lambda m: [word() for _ in range(m)]
    texts = [
        " ".join([*noise(300), *item, *noise(700)]), " ".join([*item[:-1], *noise(30), item[-1]]), " ".join(item),
        " ".join([*noise(100), item[-1], *noise(100)]), " ".join([*noise(20), *item[: n // 2], *noise(20)]), " ".join([*noise(20), *item[n // 2 :]]),
    ]
    got = [(d, index.ids[i]) for d, i, *_ in index.search(texts, 0.6, 0.8) if index.ids[i] == 7]
    assert got == [(0, 7), (1, 7), (2, 7)]


def test_items_with_altered_words_are_found():
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [[word() for _ in range(38)] for _ in range(30)]
    index = op4_decontaminate.Index([(k, " ".join(w[:28]) + ".\n" + " ".join(w[28:])) for k, w in enumerate(items)])
    texts = []
    for w in items:
        w = list(w)
        for k in (6, 13, 20, 33):
            w[k] = f"altered{k}"
        texts.append(" ".join([word() for _ in range(60)] + w + [word() for _ in range(200)]))
    texts += [" ".join(rng.sample(w, len(w))) for w in items]  # the same words in another order are no copy
    assert {(d, index.ids[i]) for d, i, *_ in index.search(texts, 0.6, 0.8)} == {(k, k) for k in range(30)}


def test_common_in_order():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([b"x", b"y", b"z", b"w"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert op4_decontaminate.common_in_order(a, b) == best[-1][-1]


def test_best_cut_lies_in_the_gap():
    good, bad = np.array([1.0, 2, 3, -1]), np.array([-10.0, -20, -1.5])
    assert -1.5 < op5_importance.best_cut(good, bad) < -1
    assert op5_importance.best_cut(good, np.array([])) == -np.inf


def test_repeated_word_is_one_pair():
    a, b = op5_importance.ngram_buckets("x x"), op5_importance.ngram_buckets("y y")
    assert a[-1] == b[-1] and len(op5_importance.ngram_buckets(None)) == 0


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 40, 5).tolist())) for _ in range(600)]
    first = np.array([float(0 in r or 1 in r) for r in rows])
    last = np.array([float((0 in r or 1 in r) and 2 not in r) for r in rows])
    chain = op6_toxicity.train_chain(rows, {"first": first, "last": last}, list(range(40)), np.arange(600) % 5)
    p = chain.predict(rows)
    assert ((p[:, 0] > 0.5) == first).mean() > 0.98 and ((p[:, 1] > 0.5) == last).mean() > 0.95
    assert chain.links[1].v[0] > 0
    none = op6_toxicity.train_chain(rows, {"t": np.zeros(600)}, list(range(40)), np.arange(600) % 5)
    assert none.predict(rows).max() < 1e-6


@pytest.mark.parametrize("n", [1, 2, 50, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 256, (n, 32)).astype(np.uint8)
    table = op7_exact_dedup.PerfectHash.build(keys)
    again = op7_exact_dedup.PerfectHash(table.sizes, table.packed())
    assert sorted(again.slots(keys)) == list(range(n))
    assert again.slots(rng.integers(0, 256, (100, 32)).astype(np.uint8)).max() < n


def test_loser_tree_merges_like_heapq():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(op8_warc.LoserTree(runs, key=lambda x: x)) == list(heapq.merge(*runs))


def test_warc_record_round_trip():
    body = "é<p>\r\n\r\nx".encode()
    raw = op8_warc.record(5, "http://a.b/c d", body, op8_warc.base32_sha1(body), None, "20000101000005")
    assert op8_warc.parse(raw)["payload"] == body and b"WARC-Target-URI: http://a.b/cd" in gzip.decompress(raw)
    raw = op8_warc.record(4, None, body, op8_warc.base32_sha1(body), 5, "20000101000004")
    got = op8_warc.parse(raw)
    assert (got["record_type"], got["refers_to"], got["payload_bytes"], got["payload"]) == ("revisit", 5, len(body), b"")


def test_url_keys():
    assert op8_warc.url_key("HTTP://www.Example.com:80/A?b#c") == "com,example)/a?b"
    assert op8_warc.url_key(None) == "" and op8_warc.url_key("//x.y") == "y,x)/"


def test_rolling_hash_does_not_depend_on_place():
    words = np.random.default_rng(0).integers(0, 2**63, 200, dtype=np.uint64)
    whole = op10_repeats.rolling(words, 20)
    assert (op10_repeats.rolling(words[37:90], 20) == whole[37:71]).all() and len(op10_repeats.rolling(words[:19], 20)) == 0


def test_minimisers_are_leftmost_minima():
    grams = np.random.default_rng(0).integers(0, 30, 300).astype(np.uint64)
    for width in (1, 2, 7, 31):
        got = op10_repeats.minimisers(grams, width)
        assert got.tolist() == [s + int(np.argmin(grams[s : s + width])) for s in range(300 - width + 1)]


def test_shared_windows_against_all_pairs():
    rng, n, depth = random.Random(8), 12, 4
    for _ in range(20):
        rows = []
        for run in range(6):
            head = [b"h%d" % run] * depth
            for _ in range(rng.randint(1, 7)):
                left = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, n - depth))]
                right = head + [rng.choice([b"c", b"d"]) for _ in range(rng.randint(0, n - depth))]
                rows.append((run, b"".join(w + b" " for w in right), b"".join(w + b" " for w in left), rng.randint(0, 3), left[::-1] + right, len(left)))
        rows = sorted(set((r[0], r[1], r[2]) for r in rows))
        docs = [sorted(rng.choices(range(4), k=2)) for _ in rows]
        runs, right, left = (list(c) for c in zip(*rows))
        least, ok = op10_repeats.shared_windows(right, left, np.array(runs), np.array([d[0] for d in docs]), np.array([d[1] for d in docs]), n, depth)
        window = lambda k, o: tuple(([*left[k].split()[:o]][::-1] + right[k].split())[:n]) if len(left[k].split()) >= o and len(right[k].split()) >= n - o else None
        for k in range(len(rows)):
            for o in range(n - depth + 1):
                w = window(k, o)
                same = {d for j in range(len(rows)) if w and runs[j] == runs[k] and window(j, o) == w for d in docs[j]}
                assert bool(ok[k, o]) == (len(same) > 1) and (not ok[k, o] or least[k, o] == min(same))


def test_only_windows_within_reach_of_an_edge_go_on():
    rng = random.Random(9)
    for _ in range(50):
        every = sorted(b"h h " + b"".join(rng.choice([b"a ", b"b ", b"ab "]) for _ in range(rng.randint(0, 5))) for _ in range(12))
        begin, end = sorted(rng.sample(range(13), 2))
        inside, outside = every[begin:end], every[:begin] + every[end:]
        reach = op10_repeats.reach_of_edges(inside, begin > 0, end < 12)
        for text, words in zip(inside, reach):
            assert max((op10_repeats.common_words(text, t) for t in outside), default=0) <= words <= text.count(b" ")

"""Token counts by array merging against the vocabulary's library."""

import random

import pytest

from riskloom.llm import op12_token_counts as op

DOCS = "doc_id long, text string, N_TOKENS string, n_bytes long, over_limit string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(op.default_path())
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def mixed(rng, n):
    alphabet = "aab cstz'  \t\n\r\x1c\x85\u00a0\u3000 1٣²é\u0301ß世🙂,.!<|>_"
    return "".join(rng.choice(alphabet) if rng.random() > 0.02 else "<|endoftext|>" for _ in range(n))


def test_every_character(library):
    """Each character of Unicode beside letters, digits, marks and spaces."""
    texts = ["".join(f"a{c}b {c}1{c}!{c}{c} " for c in map(chr, range(k, k + 64)) if not 0xD800 <= ord(c) < 0xE000) for k in range(0, 0x30000, 64)]
    assert op.Merger.of(op.default_path()).counts(texts) == library(texts)


def test_random_texts(library):
    rng = random.Random(3)
    texts = [mixed(rng, rng.randint(0, 200)) for _ in range(4000)] + ["a" * n for n in range(130)] + ["".join(rng.choice("abcde") for _ in range(20_000))]
    texts += [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 12))) for _ in range(300)) for _ in range(50)]
    assert op.Merger.of(op.default_path()).counts(texts) == library(texts)


def test_slices_and_a_small_memo_change_nothing(library, monkeypatch):
    rng = random.Random(4)
    texts = [mixed(rng, n) for n in (0, 5, 400, 3, 900, 2000)]
    monkeypatch.setattr(op, "SLICE", 100)
    monkeypatch.setattr(op, "WORDS", 7)
    monkeypatch.setattr(op, "MEMO", 20)
    assert op.Merger(op.default_path()).counts(texts) == library(texts)


def test_one_place_at_a_time_gives_the_same():
    """Against merging the first place of the lowest pair until none is left."""
    merger, rng = op.Merger.of(op.default_path()), random.Random(5)
    ranks = {int(c): int(r) for c, r in zip(merger.code, merger.rank)}

    def slow(word):
        s = merger.byte_id[list(word)].tolist()
        while True:
            found = [(ranks[a * merger.width + b], k) for k, (a, b) in enumerate(zip(s, s[1:])) if a * merger.width + b in ranks]
            if not found:
                return len(s)
            r, k = min(found)
            s[k : k + 2] = [int(merger.made[r])]

    words = [bytes(rng.choice(b"aaabtheing nsr\xc3\xa9") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    assert merger.surviving(words).tolist() == [slow(w) for w in words]


def test_vocabularies_that_do_not_fit_are_refused(tmp_path):
    import json

    spec = json.load(open(op.default_path()))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            op.Merger(str(path))


def test_documents(spark, library):
    rng = random.Random(6)
    texts = [(1, None), (2, ""), (3, " \n"), (None, "no id"), (4, "a<|endoftext|>b"), (4, "a<|endoftext|>b"), (5, mixed(rng, 50_000)), (6, "x" * 30_000), (7, "tok " * 512), (8, "tok " * 513)]
    df = spark.createDataFrame([(d, t, "z", 7, "y") for d, t in texts], DOCS).repartition(3)
    got = op.token_counts(df)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expect = [(d, len((t or "").encode()), n, n > 512) for (d, t), n in zip(texts, library([t for _, t in texts]))]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expect, key=key)
    assert op.token_counts(df.limit(0)).count() == 0


def test_query_reads_the_whole_table(spark, library):
    from riskloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op12_token_counts"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == dict(zip(texts, library(list(texts.values())))) and len(rows) == len(texts)

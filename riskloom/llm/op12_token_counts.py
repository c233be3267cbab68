"""Token counts by rank-synchronous array merging.

A text is cut at the special strings of the vocabulary, each of which is one token, and
the parts into pre-tokens. Pre-tokens that a worker has not met lately are held together
as one ragged array of byte symbols. In every round each pre-token finds its pair of
lowest rank, all places of that pair are joined at once, and ranks are looked up again
only beside what was joined; a pre-token without a known pair leaves with the number
of its surviving symbols. Joining all places of the lowest pair at once gives what one
merge at a time gives if every pair ranks behind the pairs that made its two symbols,
which is checked when the vocabulary is read.

No row moves between tasks. A worker holds the words of SLICE characters, those still
to be merged and a memo of at most MEMO counts.

Cases: a null or empty text has 0 bytes and 0 tokens; a very long text is read whole, in
slices of its pre-tokens; one endless pre-token is merged like any other; special strings
inside a text are one token each, as the vocabulary's library has it by default; repeated
rows and rows with a null doc_id are counted each; an empty table gives no row; further
columns are ignored, whatever their names."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _byte_letters

LIMIT = 512
SLICE, WORDS, MEMO = 2_000_000, 300_000, 1_000_000
NONE = np.iinfo(np.int32).max
#: Fixed value: the byte-level vocabularies' pre-tokens.
PRE_TOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Merger:
    """A byte-level vocabulary as arrays: pairs in order of their code, with rank and product."""

    _kept: dict[str, "Merger"] = {}

    @classmethod
    def of(cls, path: str) -> "Merger":
        """One for each Python worker and file."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or odd:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: special strings with conditions")
        longest_first = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        vocab: dict[str, int] = model["vocab"]
        self.byte_id = np.array([vocab[c] for _, c in sorted(_byte_letters().items())], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError(f"{path}: a pair ranks before the pairs that make its symbols")
        self.width = len(born)
        code = left * self.width + right
        order = np.argsort(code)
        self.code, self.rank, self.made = code[order], order.astype(np.int32), made
        self.words = regex.compile(PRE_TOKEN)
        self.memo: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], NONE)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word keeps."""
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        # open sequences one behind the other; a sequence's last symbol has no pair
        name = np.flatnonzero(size > 1)
        symbol = symbol[np.repeat(size > 1, size)]
        size = size[name]
        if not len(name):
            return out
        rank = np.append(self.ranks(symbol[:-1], symbol[1:]), NONE).astype(np.int32)
        rank[np.cumsum(size) - 1] = NONE
        while len(name):
            ends = np.cumsum(size)
            lowest = np.minimum.reduceat(rank, ends - size)
            closed = lowest == NONE
            if closed.any():
                out[name[closed]] = size[closed]
                stay = np.repeat(~closed, size)
                symbol, rank, name, size, lowest = symbol[stay], rank[stay], name[~closed], size[~closed], lowest[~closed]
                if not len(name):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # places that overlap are a run of one symbol: every other one, from the left
            first = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            ends = np.cumsum(size)
            size = size - np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(size))
            at -= np.arange(len(at))  # where the joined symbols stand once the others are gone
            symbol, rank = symbol[~gone], rank[~gone]
            last = np.cumsum(size) - 1
            beside = np.zeros(len(symbol), bool)
            beside[at] = beside[at[at > 0] - 1] = True
            beside[last] = False
            beside = np.flatnonzero(beside)
            rank[beside] = self.ranks(symbol[beside], symbol[beside + 1])
            rank[last] = NONE
        return out

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.memo]
        for k in range(0, len(new), WORDS):
            part = new[k : k + WORDS]
            self.memo.update(zip(part, self.surviving([w.encode("utf-8", "surrogatepass") for w in part]).tolist()))

    def parts(self, text: str) -> tuple[list[str], int]:
        """What stands between special strings, and how many of these there are."""
        if self.special is None:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        out, held, n_held = [0] * len(texts), [], 0

        def settle() -> None:
            nonlocal held, n_held
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.learn(set().union(*[w for _, w in held]))
            for k, w in held:
                out[k] += sum(map(self.memo.__getitem__, w))
            held, n_held = [], 0

        for k, text in enumerate(texts):
            if not text:
                continue
            parts, n = self.parts(text)
            out[k] += n
            for part in parts:
                if len(part) <= SLICE:
                    held.append((k, self.words.findall(part)))
                    n_held += len(part)
                    if n_held > SLICE:
                        settle()
                    continue
                found = self.words.finditer(part)
                while some := [m[0] for m in islice(found, WORDS)]:
                    held.append((k, some))
                    settle()
        if held:
            settle()
        return out


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger.of(path)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n = merger.counts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

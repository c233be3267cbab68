"""Token ids by a public tokenizer file, encoded word by word with a memo.

The tokenizer's normaliser and splitter act on single characters and never join
what white space separates, so a text's ids are those of its words in turn; the
tests compare that with encoding whole texts. A tokenizer for which this does
not hold is used with by_word=False."""

from __future__ import annotations

import os
import re

import numpy as np

END_ID = 2
_MEMO_WORDS = 300_000
#: what str.split() cuts at, without U+001C to U+001F, which the tokenizer encodes
_WORDS = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")
_ODD = "\x1c\x1d\x1e\x1f"
#: letters whose lower case and composed form are plain, then marks
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The usual letters for bytes in byte-level vocabularies: visible ones stand for themselves, the others follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    _kept: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def of(cls, path: str, by_word: bool = True) -> "Encoder":
        """One for each Python worker and file."""
        if (path, by_word) not in cls._kept:
            cls._kept[path, by_word] = cls(path, by_word)
        return cls._kept[path, by_word]

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_word = by_word
        self.memo: dict[str, bytes] = {}
        #: plain words can go straight to the model when the file lower-cases, works on bytes and splits letters from marks
        tried = ["Abc,.;:!?", "abc", "ÀÉîöÿßÑàí", "THEre"]
        self.plain = by_word and self._encode(tried) == [[*self._model("abc"), *self._encode([",.;:!?"])[0]], *map(self._model, ("abc", "àéîöÿßñàí", "there"))]

    def _model(self, word: str) -> list[int]:
        spelled = word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])
        return [t.id for t in self.tok.model.tokenize(spelled)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        memo, hard = self.memo, []
        for w in words:
            m = _PLAIN.fullmatch(w) if self.plain else None
            if not m:
                hard.append(w)
                continue
            letters, marks = m[1].lower(), m[2]
            if letters not in memo:
                memo[letters] = np.array(self._model(letters), "<u4").tobytes()
            if marks and marks not in memo:
                memo[marks] = np.array(self._encode([marks])[0], "<u4").tobytes()
            memo[w] = memo[letters] + memo[marks] if marks else memo[letters]
        for k in range(0, len(hard), 4096):
            part = hard[k : k + 4096]
            for w, ids in zip(part, self._encode(part)):
                memo[w] = np.array(ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        """The text's ids without an end id; null counts as empty."""
        if not text:
            return b""
        if not self.by_word:
            return np.array(self._encode([text])[0], "<u4").tobytes()
        words, memo = _WORDS.findall(text) if any(c in text for c in _ODD) else text.split(), self.memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        if new := [w for w in set(words) if w not in memo]:
            self._learn(new)
        return b"".join([memo[w] for w in words])

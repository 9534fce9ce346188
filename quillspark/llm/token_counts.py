"""Token counts by the whole-token shortcut: pre-tokens that are proven to be one token are counted, only the rest merged."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import text_columns

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most merged pre-tokens that a Python worker remembers; beyond it, it starts anew. Results don't depend on it.
REMEMBERED = 1_000_000


def prove_whole(vocab: dict[str, int], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The vocabulary's strings, as text, that are one pre-token and that merging from bytes gives back as one token.

    Strings that aren't valid UTF-8 or that pre-tokenizing would cut are left out; they never meet as whole pre-tokens.
    """
    to_byte = {c: b for b, c in bpe.byte_alphabet().items()}
    cut = regex.compile(PATTERN)
    proven = []
    for token in vocab:
        try:
            text = bytes(to_byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if cut.findall(text) == [text] and bpe.merge(list(token), ranks) == [token]:
            proven.append(text)
    return proven


class Counter(dict):
    """Number of tokens of each pre-token: 1 for the proven ones, found by merging for others when first asked."""

    def __init__(self, proven: list[str], ranks: dict[tuple[str, str], int], added: list[str]) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.ranks = proven, ranks
        self.words = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = added

    def __missing__(self, word: str) -> int:
        n = len(bpe.merge(list(bpe.in_alphabet(word)), self.ranks))
        if len(word) <= 64:
            if len(self) >= len(self.proven) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[word] = n
        return n

    def of(self, text: str) -> int:
        parts, n = [text], 0
        if self.special and any(a in text for a in self.added):
            parts = self.special.split(text)
            n = len(parts) - 1
        return n + sum(sum(map(self.__getitem__, self.words(p))) for p in parts)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    path: a byte-level BPE file of the tokenizers library, read and proven on the driver; its tables, bounded by the
    vocabulary, go to the workers. Added tokens inside a text count as one each, as the library has it. A null text counts
    as empty (0 tokens); rows stay as they are, repeated or not; extra columns are ignored.
    """
    vocab, ranks, added = bpe.load(path)
    shared = docs.sparkSession.sparkContext.broadcast((prove_whole(vocab, ranks), ranks, list(added)))

    def begin():
        if path not in _counters:
            _counters.clear()
            _counters[path] = Counter(*shared.value)
        counter = _counters[path]
        return lambda texts: {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [counter.of(t) for t in texts]}

    return text_columns(docs, begin, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

"""BPE encoding and decoding of words with end marks, sharing work between words with a common prefix."""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm.common import text_columns

#: The pattern of words and the mark of a word's end.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
#: Most words and pieces, and pairs of tokens, that a Python worker remembers; beyond it, it keeps those of its batch, and
#: starts anew with pairs. Results don't depend on it.
REMEMBERED, PAIRS = 800_000, 500_000
#: Longer pieces aren't remembered beyond their batch.
LONG = 64
#: Arrow's split cuts at these, but words hold them: they are no white space in the pattern.
NO_SPACE = "\x1c\x1d\x1e\x1f"
BLANK = pa.scalar(b" ", pa.large_binary())


def normalize(text: str) -> str:
    """NFC, lower case letter by letter (a final sigma is no special case). White space stays: no word holds any."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class PrefixEncoder:
    """Encodes many words at once by a depth-first walk through the trie of their symbols.

    A trie node stands for a prefix; its state is the last token of the prefix's encoding. The encoding of a prefix is that
    token appended to the encoding of what stands before it, so one state per node gives the encodings of all words, and
    prefixes that words share are worked out once. A token may follow another if merging the two tokens' symbols alone
    gives back just these two; of the vocabulary's suffixes of a prefix, exactly one may follow the state it leads back to.

    Which tokens end a prefix depends only on the longest end of it that begins a token. Each node keeps that end, so that the
    next symbol leads to the tokens in question by one lookup.
    """

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int]) -> None:
        self.ranks = ranks
        #: Tokens that merging gives back from their own symbols, by number; no other can stand in an encoding.
        self.tokens = [t for t in vocab if bpe.merge(self.symbols(t), ranks) == [t]]
        self.alone = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = [len(t) - len(END) if t.endswith(END) and len(t) > len(END) else len(t) for t in self.tokens]
        self.begins = {s[:k] for t in self.tokens for s in [t.removesuffix(END)] for k in range(len(s) + 1)}
        self.follows: dict[int, bool] = {}  # by the pair's numbers as one
        self.ends: dict[str, tuple[str, list, list]] = {}  # by the longest end
        self.steps: dict[str, tuple[str, list, list]] = {}  # by the longest end and the symbol after it

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else list(token)

    def may_follow(self, last: int, token: int) -> bool:
        if len(self.follows) > PAIRS:
            self.follows.clear()
        both = [self.tokens[last], self.tokens[token]]
        known = self.follows[last * len(self.tokens) + token] = bpe.merge([*both[0], *self.symbols(both[1])], self.ranks) == both
        return known

    def step(self, seen: str) -> tuple[str, list, list]:
        """The longest end of `seen` that begins a token, and the tokens that end it, longest first, as (symbols, number):
        those without and those with the end mark."""
        if len(self.steps) > PAIRS:
            self.steps.clear()
        end = seen
        while end not in self.begins:
            end = end[1:]
        if end not in self.ends:
            tails = [end[i:] for i in range(len(end))]
            self.ends[end] = (end, *([(len(t), self.alone[t + mark]) for t in tails if t + mark in self.alone] for mark in ("", END)))
        found = self.steps[seen] = self.ends[end]
        return found

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, numbers of its tokens) of distinct words in the byte alphabet, in the order of the walk.

        Sorted words are their trie in depth-first order: the walk comes back to the depth that a word shares with the one
        before it, and goes on from the states kept there. States are worked out when a word first needs them.
        """
        before, states, ends, alone, sizes, n = "", [-1], [""], self.alone, self.sizes, len(self.tokens)
        steps, follows = self.steps.get, self.follows.get
        for word in sorted(words):
            if (token := alone.get(word + END)) is not None:
                yield word, [token]
                continue
            depth = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                depth += 1
            del states[depth + 1 :], ends[depth + 1 :]
            size, end = len(word), ends[-1]
            for at in range(len(states), size + 1):
                seen = end + word[at - 1]
                end, plain, ended = steps(seen) or self.step(seen)
                for length, token in plain if at < size else ended:
                    if length == at:
                        break
                    pair = states[at - length] * n + token
                    if (fits := follows(pair)) is None:
                        fits = self.may_follow(states[at - length], token)
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:at]!r}")
                if at < size:
                    states.append(token)
                    ends.append(end)
            found, at = [token], size - sizes[token]
            while at > 0:
                token = states[at]
                found.append(token)
                at -= sizes[token]
            before = word[:-1]
            found.reverse()
            yield word, found


def joined(offsets: pa.Array, words: pa.Array) -> list[str]:
    """The words of each list, joined by blanks."""
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words), BLANK).cast(pa.large_string()).to_pylist()


class Texts:
    """Encodes and decodes whole texts with the words of a batch encoded together.

    Texts are cut at white space alone; a piece, such as a word and its comma, is cut into words when it is first met.
    """

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], added: dict[str, int], remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        self.added, self.encoder = added, PrefixEncoder(vocab, ranks)
        self.ids, self.tokens = [str(vocab[t]).encode() for t in self.encoder.tokens], [t.encode() for t in self.encoder.tokens]
        self.words = regex.compile(WORDS).findall
        self.words_by_line = regex.compile(WORDS + r"|\n").findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.odd = [*added, *NO_SPACE]
        #: Ids and tokens of pieces and words, in UTF-8.
        self.known = {"": (b"", b"")} | {f"\n{text}": (str(i).encode(), text.encode()) for text, i in added.items()}
        self.always = set(self.known)
        self.long: list[str] = []  # what of it goes after the batch

    def cut(self, text: str) -> list[str]:
        """Words of a text; added tokens stand for themselves."""
        if not self.special or not any(a in text for a in self.added):
            return self.words(normalize(text))
        parts = self.special.split(text)
        return [w for i, p in enumerate(parts) for w in ([f"\n{p}"] if i % 2 else self.words(normalize(p)))]

    def pieces(self, texts: list[str]) -> pa.ListArray:
        """What stands between white space in each text; of a text that can't be cut so, its words."""
        odd = [i for i, t in enumerate(texts) if any(c in t for c in self.odd)]
        plain = [normalize(t) for t in texts]
        for i in odd:
            plain[i] = ""
        cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(plain, pa.large_string())))
        if not odd:
            return cut
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(len(odd))
        return pa.concat_arrays([cut, pa.array([self.cut(texts[i]) for i in odd], cut.type)]).take(pa.array(at))

    def learn(self, new: list[str], pieces: list[str]) -> None:
        """Work out the new ones of a batch's pieces. If too many are known, those of other batches are forgotten first."""
        if len(self.known) + len(new) > self.remembered:
            self.known = {p: self.known[p] for p in self.always.union(self.known.keys() & pieces)}
        known, ids, tokens = self.known, self.ids, self.tokens
        found = self.words_by_line("\n".join(new))
        spelled = {bpe.in_alphabet(w): w for w in set(found) if w not in known and w != "\n"}
        for word, numbers in self.encoder.encode(list(spelled)):
            known[spelled[word]] = b" ".join([ids[i] for i in numbers]), b" ".join([tokens[i] for i in numbers])
        at = 0
        for piece in new:
            first, size = at, 0
            while size < len(piece):
                size += len(found[at])
                at += 1
            if at - first > 1:
                words = [known[w] for w in found[first:at]]
                known[piece] = b" ".join([i for i, _ in words]), b" ".join([t for _, t in words])
            at += 1  # the line break
        self.long = [p for p in {*spelled.values(), *new} if len(p) > LONG]

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, decoded text) of each. Without a decoder of its own, the file's tokens
        are joined by spaces when decoded."""
        if not texts:
            return []
        cut = self.pieces(texts)
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [p for p in distinct if p not in self.known]:
            self.learn(new, distinct)
        found = list(map(self.known.__getitem__, distinct))
        for word in self.long:
            del self.known[word]
        self.long = []
        ids, said = (joined(cut.offsets, pa.array(told, pa.large_binary()).take(words.indices)) for told in zip(*found))
        return [(i.count(" ") + 1 if i else 0, i, s) for i, s in zip(ids, said)]


_texts: dict[tuple[str, int], Texts] = {}


def encode(docs: DataFrame, path: str, ids: bool = True, batch_chars: int = 3_000_000, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ids, the token ids of every whole text.

    path: a word-end BPE file of the tokenizers library, read on the driver; its tables, bounded by the vocabulary, go to
    the workers. A worker handles about batch_chars characters at a time, and forgets words that its batch doesn't need when it
    has more than `remembered`: fewer of both take less memory and more time. A null text counts as empty: no tokens, and the
    hashes of the empty string. Rows stay as they are, repeated or not; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe.load(path))

    def begin():
        if (own := (path, remembered)) not in _texts:
            _texts.clear()
            _texts[own] = Texts(*shared.value, remembered)
        coder = _texts[own]

        def encoded(texts: list[str]) -> dict[str, list]:
            found = coder.encode(texts)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            return {"n_tokens": [n for n, _, _ in found], "ids_sha256": [sha(i) for _, i, _ in found], "decoded_sha256": [sha(d) for _, _, d in found], "ids": [i for _, i, _ in found]}

        return encoded

    out = text_columns(docs, begin, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * ids, slice_chars=batch_chars)
    return out.withColumn("ids", F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))) if ids else out

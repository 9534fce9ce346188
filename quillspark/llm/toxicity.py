"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick in folded texts."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, is_held_out, sampled, text_columns

#: Look-alike letters of other scripts and digits or signs that stand for letters, and what they fold to.
LOOKALIKES = str.maketrans("абвеёзикмнорстухѕіјԁԛԝαβεικνορτυχ", "abbeeznkmhopctyxsijdqwabeiknoptux")
SUBSTITUTES = str.maketrans("01345789@", "oieastbga")
#: Signs that stand for letters only next to a letter; elsewhere they are punctuation.
SIGNS = str.maketrans("$!|+", "silt")
FULLWIDTH = {0xFEE0 + c: chr(c).lower() for c in range(0x21, 0x7F)}
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)])
#: Accented Latin letters to plain ones. Most words are told apart by their accents, so texts keep them, and are looked at
#: without them once more.
ACCENTED = {c: base for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if (base := unicodedata.normalize("NFD", chr(c))[0]) != chr(c)}
FOLDS = LOOKALIKES | SUBSTITUTES | FULLWIDTH | INVISIBLE
_gaps = re.compile(r"[\W_]+")
#: A dollar before a letter or inside a word; the others inside a word alone.
_signs = re.compile(r"\$(?=[^\W_])|(?<=[^\W_])\$+(?=[^\W_])|(?<=[^\W_])[!|+]+(?=[^\W_])")
_marks = re.compile("[\u0300-\u036f]")
_apart = re.compile(r"(?<= )(?:\w ){2,}\w(?= )")


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes to plain letters, words between single spaces; accents stay.

    Three or more single letters in a row are one word, spelled apart.
    """
    plain = text.lower()
    if _marks.search(plain):
        plain = unicodedata.normalize("NFC", plain)
    if _signs.search(plain):
        plain = _signs.sub(lambda m: m[0].translate(SIGNS), plain)
    return _apart.sub(lambda m: m[0].replace(" ", ""), f" {_gaps.sub(' ', plain.translate(FOLDS)).strip()} ")


@dataclass
class Lexicon:
    """weights: folded patterns; one that begins with a space begins a word, one that ends with a space ends it.

    half: evidence at which the score is 0.5. exceptions: phrases in which a lexicon word is harmless.
    """

    weights: dict[str, float]
    half: float = 1.0
    exceptions: tuple[str, ...] = ()

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for p in self.exceptions:
            found.add_word(p := fold(p), (len(p), None))
        if len(found):
            found.make_automaton()
        return found


def evidence(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Summed weights of the words hit, each with its heaviest pattern, but for those in exception phrases; over the
    logarithm of the number of words. Without their accents, words count if a pattern ends them."""
    if not len(automaton):
        return 0.0
    hits: dict[int, float] = {}
    spared = []
    bare = folded if folded.isascii() else folded.translate(ACCENTED)
    for text in (folded, bare) if bare != folded else (folded,):
        for end, (size, w) in automaton.iter(text):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            elif w > hits.get(start, 0) and (text is folded or text[end] == " "):
                hits[start] = w
    total = sum(w for s, w in hits.items() if not any(a <= s < b for a, b in spared))
    return total / math.log2(2 + folded.count(" ")) if total else 0.0


def neighbours(folded: str, automaton: ahocorasick.Automaton) -> set[str]:
    """Each word hit with the one before it and with the one after it."""
    found = set()
    if len(automaton):
        for end, (size, _) in automaton.iter(folded):
            at = end - size + 1
            at += folded[at] == " "
            start, stop = folded.rfind(" ", 0, at) + 1, folded.find(" ", at)
            before = folded.rfind(" ", 0, max(0, start - 1)) + 1
            after = folded.find(" ", stop + 1)
            if start > 1:
                found.add(folded[before:stop])
            if after > 0:
                found.add(folded[start:after])
    return found


def learn(docs: DataFrame, labels: DataFrame, rows: int = 8_000, surprise: float = 12.0, purity: float = 0.8, harmless: int = 2) -> Lexicon:
    """A lexicon from about `rows` labelled documents that are not held out (a bounded sample, chosen by a hash of the id).

    Terms are folded words and beginnings of words, of 4 to 6 letters. They are counted once for each pair of neighbouring
    words, so that copies of a toxic text don't make its harmless words suspect. One enters if a share `purity` of its
    contexts is in toxic documents and that is worth `surprise` nats against the share of all words there. Its weight is
    the log odds ratio. A lexicon word with the word before or after it is an exception if at least `harmless` texts that
    aren't toxic have both and no toxic one has. `half` lies between the labelled texts' evidence where the fewest are told
    wrongly.
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = sampled(told, rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(told), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = [fold(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "folded": folded})

    folded = cut(texts.select("toxic", "text").mapInPandas(words, "toxic int, folded string"))
    totals = {r["toxic"]: r["n"] for r in folded.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    words_ = F.split(F.trim("folded"), " ")
    seen_at = folded.select("toxic", words_.alias("w")).select("toxic", F.explode(F.transform("w", lambda w, i: F.struct(w.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("context")))).alias("x"))
    seen_at = seen_at.select("toxic", "x.word", "x.context").where("length(word) >= 2").groupBy("word", "context").agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    by_word = cut(seen_at.groupBy("word").agg(F.sum("t").alias("t"), F.sum(F.col("t") + F.col("c")).alias("n")))
    starts = F.transform(F.sequence(F.lit(4), F.lit(6)), lambda k: F.concat(F.lit(" "), F.left("word", k)))
    forms = F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.filter(starts, lambda s: F.length(s) <= F.length("word")))
    terms_ = by_word.select(F.explode(forms).alias("term"), "t", "n").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    base = by_word.agg(F.sum("t") / F.sum("n")).first()[0]
    share = F.col("t") / F.col("n")
    nats = F.col("t") * F.log(share / base) + F.when(share < 1, (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    weight = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5)) - math.log(base / (1 - base))
    chosen = terms_.where((F.col("t") >= 3) & (share > purity)).select("term", nats.alias("nats"), weight.alias("weight")).where(F.col("nats") >= surprise)
    weights = {r["term"]: r["weight"] for r in chosen.collect()}  # bounded by the sample
    bare = Lexicon(weights)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = bare.automaton()
        for batch in batches:
            found = [(y, p) for y, t in zip(batch["toxic"], batch["folded"]) for p in neighbours(t, automaton)]
            yield pd.DataFrame(found, columns=["toxic", "phrase"])

    said = folded.mapInPandas(phrases, "toxic int, phrase string").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    spared = tuple(sorted(r["phrase"] for r in said.where((F.col("t") == 0) & (F.col("n") >= harmless)).collect()))
    lexicon = Lexicon(weights, exceptions=spared)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "e": [evidence(t, automaton) for t in batch["folded"]]})

    told = sorted((r["e"], r["toxic"]) for r in folded.mapInPandas(seen, "toxic int, e double").collect())
    wrong = best = sum(1 - y for _, y in told)
    half = told[0][0] / 2
    for i, (e, y) in enumerate(told):
        wrong += 2 * y - 1
        nxt = told[i + 1][0] if i + 1 < len(told) else e * 2 + 1
        if wrong < best and nxt > e:
            best, half = wrong, (e + nxt) / 2
    return Lexicon(weights, max(half, 1e-9), spared)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every whole text: evidence / (evidence + half), 0 where no word is hit.

    Null and empty texts score 0, as every text does where the labels taught nothing. Equal texts score alike; rows stay
    as they are; extra columns are ignored.
    """

    def begin():
        automaton = lexicon.automaton()

        def scored(texts: list[str]) -> dict[str, list]:
            found = [evidence(fold(t), automaton) for t in texts]
            return {"score": [e / (e + lexicon.half) for e in found]}

        return scored

    return text_columns(docs, begin, "score double")

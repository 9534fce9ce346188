"""Language identification: scripts narrow the candidates, per-word scores and a switching penalty label spans."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, is_held_out, trim

#: Ranges of code points of the scripts told apart; letters elsewhere are of script 'other'.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
BITS = 16
BUCKETS = 1 << BITS
#: Characters that are scored together; bounds the memory of a worker, not the length of a text.
SLICE = 1_000_000
#: Rows of a batch that become Python strings at once.
ROWS = 1024
RARE, BARRED = 0.005, 30.0


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or the combining mark, 0 where it is neither; the bit of its script (marks that
    go with all scripts have none); whether it is a letter. Marks belong to words, but count as no letters."""
    plain, bit, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x323B0):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            low = chr(c).lower()
            plain[c], bit[c], letter[c] = ord(low) if len(low) == 1 else c, 1 << len(SCRIPTS), True
        elif kind == "M":
            plain[c] = c
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            bit[a : b + 1] = np.where(plain[a : b + 1] > 0, 1 << i, 0)
    return plain, bit, letter


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts one after another, each followed by a blank; where each text begins."""
    joined = " ".join(texts) + " "
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), starts


def trigrams(c: np.ndarray) -> np.ndarray:
    """Bucket of the three letters that end at each character, with blanks beyond a word's ends; 0 between words."""
    b = np.concatenate((np.zeros(1, np.uint32), c[:-1]))
    a = np.concatenate((np.zeros(2, np.uint32), c[:-2])) if len(c) > 1 else np.zeros_like(c)
    a = np.where(b > 0, a, 0).astype(np.uint32)
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.where((b | c) > 0, (h >> np.uint32(32 - BITS)) | np.uint32(1), 0)


def slices(texts: pd.Series) -> Iterator[list[str]]:
    """The texts in lists of about SLICE characters."""
    cuts = [0, *(np.flatnonzero(np.diff(texts.str.len().cumsum() // SLICE)) + 1).tolist(), len(texts)] if len(texts) else []
    for a, b in zip(cuts, cuts[1:]):
        yield list(texts[a:b])


def letter_counts(texts: pd.Series) -> np.ndarray:
    """How often each bucket of trigrams and, behind them, each script occurs in the texts."""
    plain, bit, _ = letters()
    by = np.zeros(BUCKETS + 32, np.int64)
    for some in slices(texts):
        raw, _ = codes(some)
        by[:BUCKETS] += np.bincount(trigrams(plain[raw]), minlength=BUCKETS)
        scripts = bit[raw]
        by[BUCKETS:] += [np.count_nonzero(scripts & np.uint32(1 << i)) for i in range(32)]
    by[0] = 0
    return by


@dataclass
class Model:
    """languages: learned values, sorted. weights: [bucket, language]. scripts: the bits of each language's scripts."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray

    def label(self, texts: list[str], penalty: float) -> list[list[tuple[int, int, int, int]]]:
        """The spans (start, end, language, letters) of each text, end exclusive, by the best path."""
        plain, bit, letter = letters()
        raw, starts = codes(texts)
        c = plain[raw]
        first = np.flatnonzero((c > 0) & (np.concatenate(([0], c[:-1])) == 0))
        if not len(first):
            return [[] for _ in texts]
        scores = np.add.reduceat(self.weights[trigrams(c)], first, axis=0).astype(np.float64)
        masks = np.bitwise_or.reduceat(bit[raw], first)
        if (seen := np.bitwise_or.reduce(masks)) & ~np.bitwise_and.reduce(self.scripts):
            barred = (masks[:, None] & ~self.scripts[None, :]) != 0
            barred[barred.all(axis=1)] = False  # a script of no language tells nothing
            scores -= BARRED * barred
        del seen
        sizes = np.add.reduceat(letter[raw].astype(np.int64), first)
        at = np.searchsorted(first, starts)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        full = np.flatnonzero(at[1:] > at[:-1])
        lo, hi = at[full], at[full + 1]
        totals = np.add.reduceat(scores, lo, axis=0)
        best = totals.argmax(axis=1)
        sure = self.one_language(scores, lo, hi, best, penalty)
        letters_of = np.add.reduceat(sizes, lo)
        for k, i in enumerate(full):
            if sure[k]:
                out[i] = [(int(first[lo[k]] - starts[i]), len(texts[i]), int(best[k]), int(letters_of[k]))]
            else:
                a, b = lo[k], hi[k]
                path = viterbi(scores[a:b], penalty)
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
                ends = [*(int(first[a + e] - starts[i]) for e in cuts[1:-1]), len(texts[i])]
                out[i] = [(int(first[a + s] - starts[i]), end, int(path[s]), int(sizes[a + s : a + e].sum())) for s, e, end in zip(cuts, cuts[1:], ends)]
        return out

    def one_language(self, scores: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
        """Texts whose best path surely has the one language: in no run of words does another gain more than the penalty.

        (A stretch of m other languages costs m switches at least and gains no more than the sum of m such runs.)
        """
        text = np.repeat(np.arange(len(lo)), hi - lo)
        own = np.take_along_axis(scores, best[text][:, None], axis=1)[:, 0]
        most = np.zeros(len(lo))
        for k in range(len(self.languages)):
            gain = scores[:, k] - own
            total = np.cumsum(gain)
            before = total - gain
            step = (np.abs(total).max() + 1) * 4
            low = np.minimum.accumulate(before - text * step) + text * step
            most = np.maximum(most, np.maximum.reduceat(total - low, lo))
        return most <= penalty


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best sequence of languages for a text's words, where each change costs the penalty."""
    n, k = scores.shape
    back = np.empty((n, k), np.int16)
    v, same = scores[0].copy(), np.arange(k)
    back[0] = same
    for t in range(1, n):
        j = int(v.argmax())
        change = v[j] - penalty
        stay = v >= change
        back[t] = np.where(stay, same, j)
        v = np.where(stay, v, change) + scores[t]
    path = np.empty(n, np.int16)
    path[-1] = v.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def learn(docs: DataFrame, rows: int = 6_000) -> Model:
    """Trigram weights per language from about `rows` documents of each that are not held out and have a lang (a bounded
    sample, chosen by a hash of the id; all of a language with fewer). The model's size is bounded by the number of
    languages."""
    given = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    sizes = cut(given.groupBy("lang").agg(F.count("*").alias("_n")))  # one row per language
    given = given.select("doc_id", "lang", "text").join(sizes, "lang")
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    given = given.where((F.col("_n") <= rows) | (chance < rows / F.col("_n")))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                found[lang] = found.get(lang, 0) + letter_counts(part["text"])
            batch = part = None
            trim()
        for lang, by in found.items():
            kept = np.flatnonzero(by)
            yield pd.DataFrame({"lang": lang, "bucket": kept, "n": by[kept]})

    totals = given.select("lang", "text").mapInPandas(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(totals["lang"].unique())
    counts = np.zeros((BUCKETS + 32, len(languages)))
    for k, lang in enumerate(languages):
        own = totals[totals["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] = own["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    if languages:
        rates = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS))
        weights = rates - rates.max(axis=1, keepdims=True)
    else:
        weights = rates = grams
    weights[0] = 0
    weights[grams.sum(axis=1) == 0] = 0
    used = scripts >= RARE * np.maximum(1, scripts.sum(axis=0))
    bits = np.array([sum(1 << i for i in range(32) if used[i, k]) for k in range(len(languages))], np.uint32)
    return Model(list(languages), weights.astype(np.float32), bits)


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, keep: tuple[str, ...] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """The columns `keep` and lang_pred, score and spans (start, end in code points, lang) of every whole text.

    lang_pred is the language of most letters, the first by name among equals, score its share of them. A text that is
    null or has no letter is `und` with score 0 and no spans, as is every text where no language was learned.
    Rows stay as they are, repeated or not, and kept columns pass through unchanged; others are ignored.
    inside: a kept struct whose field `text` is the text, which then goes to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, len(whole), ROWS)):
            texts = (batch.column(keep.index(inside)).field("text").fill_null("") if inside else batch.column(len(keep))).to_pandas()
            b = 0
            for some in slices(texts):
                a, b = b, b + len(some)
                rows = []
                for spans in m.label(some, penalty) if m.languages else [[]] * (b - a):
                    by: dict[int, int] = {}
                    for _, _, k, n in spans:
                        by[k] = by.get(k, 0) + n
                    top = min(by, key=lambda k: (-by[k], k), default=None) if any(by.values()) else None
                    named = [] if top is None else [{"start": s, "end": e, "lang": m.languages[k]} for s, e, k, _ in spans]
                    rows.append(("und", 0.0, named) if top is None else (m.languages[top], by[top] / sum(by.values()), named))
                own = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], places)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *own], [*keep, "lang_pred", "score", "spans"])
            texts = some = rows = None
            trim()

    texts = docs.select(*keep, *[F.coalesce("text", F.lit("")).alias("_text")][: inside is None])
    told = T.StructType.fromDDL("lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>")
    return texts.mapInArrow(found, T.StructType([*texts.schema.fields[: len(keep)], *told.fields]))

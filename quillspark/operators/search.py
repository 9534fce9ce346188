"""Hybrid search: filtered branches by vectors, words and mentions, fused, without near equals, and scored pair by pair."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import index as I
from quillspark.operators import retrieval as R

#: Hits of a branch, letters of a mention at least.
HITS, LETTERS = 100, 4
#: Passages of a work that are scored pair by pair, and shown of them.
POOL, SHOWN = 96, 8
#: Characters of a passage that a pair scorer sees, pairs that it scores at once.
SEEN, BATCH = 1400, 16


@dataclass
class Corpus:
    """passages: id, text, work, title, author, lang, front (no text of the work) and what selections name. vectors: id, v.
    index: that of the passages. complete: work of the published works."""

    passages: DataFrame
    vectors: DataFrame
    index: I.View
    complete: DataFrame


def if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a hint to broadcast it, if it has so few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def named_works(passages: DataFrame, mentions: list[str]) -> DataFrame:
    """work of all works whose author or title contains a mention, in any case; mentions of under four letters name none."""
    named = F.lit(False)
    for m in mentions:
        if len(m.strip()) >= LETTERS:
            named = named | F.contains(F.lower("author"), F.lit(m.strip().lower())) | F.contains(F.lower("title"), F.lit(m.strip().lower()))
    return passages.where(named).select("work").distinct()


def branches(corpus: Corpus, queries: DataFrame, words: list[str], mentions: list[str], selection: Column) -> DataFrame:
    """branch_no, branch, id, rank of all branches. Each looks at selected passages of works' own texts alone, the keyword
    branch at those of complete works."""
    allowed = corpus.passages.where(selection & ~F.col("front"))
    vectors = corpus.vectors.join(allowed.select("id"), "id", "left_semi")
    near = R.nearest(vectors, queries, HITS).select(F.col("q").alias("branch_no"), F.lit("vector").alias("branch"), "id", "rank")
    n = (queries.agg(F.max("q")).first()[0] or 0) + 1
    score = I.bm25(corpus.index, I.phrases(words), allowed.join(if_small(corpus.complete), "work", "left_semi").select("id"))
    said = R.top(score, [F.desc("score"), "id"], HITS).select(F.lit(n).cast("long").alias("branch_no"), F.lit("keyword").alias("branch"), "id", "rank")
    of_them = allowed.join(named_works(corpus.passages, mentions), "work", "left_semi").select("id")
    named = R.nearest_to_any(corpus.vectors.join(of_them, "id", "left_semi"), queries, HITS)
    named = named.select(F.lit(n + 1).cast("long").alias("branch_no"), F.lit("mention").alias("branch"), "id", "rank")
    return near.unionByName(said).unionByName(named)


def candidates(corpus: Corpus, found: DataFrame, pool: int = 192) -> DataFrame:
    """rank, id, score, work, author, lang, text of the best `pool` of fused branches, without near equals."""
    fused = R.fuse(found).orderBy(F.desc("score"), "first").limit(2 * pool)
    rows = corpus.passages.select("id", "text", "work", "author", "lang").join(F.broadcast(fused), "id")  # 2 * pool rows
    once = R.without_near_equals(rows, [F.desc("score"), "first"])
    return R.top(once, [F.desc("score"), "first"], pool)


def word_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """A pair scorer without a model: the share of a question's words that a passage has."""
    words = re.compile(r"[^\W_]+").findall
    return [len((a := set(words(q.lower()))) & set(words(p.lower()))) / max(1, len(a)) for q, p in pairs]


def reranked(rows: DataFrame, questions: dict[str, str], scorer: Callable[[list[tuple[str, str]]], list[float]] = word_overlap, fallback: str = "sv") -> DataFrame:
    """rows (rank, lang, text, ...) with pair_score, new rank and degraded.

    A passage is scored against the question in its language, or else in the fallback's, or else in any. Pairs go to the
    scorer in batches, cut to what it sees. If the scorer fails on any batch, all rows keep their order and are marked
    degraded; nothing fails.
    """
    any_ = next(iter(questions.values()), "")
    own = rows.drop("pair_score")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(questions.get(lang, questions.get(fallback, any_)), (text or "")[:SEEN]) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist())]
            found, failed = [], False
            for at in range(0, len(pairs), BATCH):
                try:
                    found += [float(x) for x in scorer(pairs[at : at + BATCH])]
                except Exception:  # whatever a model raises, the search goes on
                    found += [float("nan")] * len(pairs[at : at + BATCH])
                    failed = True
            new = [pa.array(found, pa.float64()), pa.array([failed] * len(pairs), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "pair_score", "failed"])

    told = own.mapInArrow(scored, T.StructType([*own.schema.fields, *T.StructType.fromDDL("pair_score double, failed boolean").fields]))
    told = told.withColumn("degraded", F.bool_or("failed").over(Window.partitionBy())).drop("failed")  # a pool of candidates
    order = [F.when(~F.col("degraded"), -F.round("pair_score", 9)), F.col("old")]
    told = R.ranked(told.withColumnRenamed("rank", "old"), order)
    return told.withColumn("pair_score", F.when(~F.col("degraded"), F.col("pair_score"))).drop("old")


def more_from_work(corpus: Corpus, work: str, shown: DataFrame, query: DataFrame, questions: dict[str, str], scorer: Callable[[list[tuple[str, str]]], list[float]] = word_overlap) -> DataFrame:
    """rank, id, text, pair_score, degraded of SHOWN further passages of a work, those that aren't shown (id) yet.

    Of a work with more than POOL of them the nearest to the query vector (q, qv) are scored against the question in their
    language, otherwise all, by id; if the scorer fails, that order stays. An unknown work, or one that is shown whole, has
    none.
    """
    own = corpus.passages.where((F.col("work") == work) & ~F.col("front")).join(shown.select("id"), "id", "left_anti")
    if own.limit(POOL + 1).count() > POOL:
        near = R.nearest(corpus.vectors.join(own.select("id"), "id", "left_semi"), query, POOL).select("id", "rank")
        rows = own.join(F.broadcast(near), "id")  # POOL rows
    else:
        rows = R.ranked(own, ["id"])
    scored = reranked(rows.select("rank", "id", "lang", "text"), questions, scorer)
    return scored.where(F.col("rank") < SHOWN).select("rank", "id", "text", "pair_score", "degraded")


def embedded(texts: DataFrame, role: str = "passage", width: int = 64) -> DataFrame:
    """id, v of (id, text): a unit vector of hashed words, summed with signs; a stand-in for a model with the same contract
    (a role before the text, mean over words, length 1). A text without words has a vector of zeros."""
    words = I.terms_of(F.coalesce("text", F.lit("")))
    told = F.transform(F.when(F.size(words) > 0, F.concat(F.array(F.lit(f"{role}:")), words)).otherwise(F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    at = texts.select("id", told.alias("h"))

    def summed(i: Column) -> Column:
        own = F.filter("h", lambda h: F.pmod(h, F.lit(width)) == i)
        return F.aggregate(own, F.lit(0.0), lambda s, h: s + F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0))

    raw = at.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), summed).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("_n", norm).select("id", F.transform("v", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x)).alias("v"))

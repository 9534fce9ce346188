"""Corpus pipeline over `documents`: quality, language, near duplicates, mixing to target weights, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents, and what each returns is written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import encoding, jaccard_join, language, mixing, quality
from quillspark.llm.common import cut, shared_folder, table
from quillspark.llm.queries import vocabulary

#: A document is rejected below this score.
LEAST_QUALITY, LEAST_LANGUAGE = 0.3, 0.4
#: Characters that a worker encodes at once and words it remembers. Its workers serve all stages, and what they hold stays.
ENCODED, REMEMBERED = 1_000_000, 50_000


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from all labels that aren't held out, scores 0.3 or more.

    A null text scores as an empty one. Rows go by their own score, whatever their doc_id, so that repeated rows and rows
    with null or repeated ids stay or go each by its text. An empty table stays empty.
    """
    rules = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    scored = cut(quality.score(own, rules).select("_row", "score"))  # else the filter moves below the statistics and works them out for each rule
    return scored.where(F.col("score") >= LEAST_QUALITY).select("_row.*")


def filter_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: rejected are those without a letter and those of which no language has 40 % of the letters.

    Each row carries its own score, whatever its doc_id. Null and empty texts have no letter and go; repeated rows stay or
    go together; an empty table stays empty.
    """
    own = docs.select(F.struct(*docs.columns).alias("_row"))
    found = language.identify(own, language.learn(table(spark, sf_dir, "documents")), keep=("_row",), inside="_row")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id of each class of equal or linked texts: nulls last, then the lowest MD5 of the text,
    then the other columns. Unrelated texts with one id all stay. Null texts are equal to empty ones, so that one of all of
    these stays; of repeated rows one stays; an empty table stays empty.
    """
    first = jaccard_join.text_classes(docs).where("key = first_key").select(F.col("key").alias("_key"), *_id_parts())
    own = docs.select(F.struct(*docs.columns).alias("_row"), jaccard_join.text_key().alias("_key"), *_id_parts())
    at = ["_key", "_id", "_none"]
    rows = own.join(first, at, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy("_row")))
    return rows.where("_n = 1").select("_row.*")


def _id_parts() -> list[Column]:
    """doc_id in two columns without nulls."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0, 1 or 2 times, whole.

    The mix takes words by blocks, so that it takes a document t = taken / size times, which is no whole number. The
    document is written floor(t) times, and once more where a hash of its row falls below the rest; so the words written of
    a source are expected to be those that the mix takes of it, and miss its target by about half the root of the sum of
    its documents' squared sizes, seldom by three times as much. Documents without words aren't in the mix.

    What is taken goes back to the rows by two hashes of the whole row; rows that are equal in all columns share it.
    """
    parts = [x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*parts).alias("_whole"), F.xxhash64(F.lit(1), *parts).alias("_again"))
    taken = mixing.mix_sources(docs.select(F.xxhash64(*parts).alias("doc_id"), "text", "source")).where("size > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_whole")).agg(F.sum(F.col("taken") / F.col("size")).alias("t"))
    chance = F.pmod(F.xxhash64(F.lit(29), "_whole"), F.lit(1 << 30)) / float(1 << 30)
    taken = taken.select("_whole", F.floor(F.col("t") + chance).cast("int").alias("times")).where("times > 0")
    rows = own.join(taken, "_whole").dropDuplicates(["_whole", "_again"])  # one shuffle of the rows serves both
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and hashes of what they decode to; no ids for a null or empty text. Rows stay
    as they are, repeated or not; of the columns, only doc_id stays. An empty table gives an empty result."""
    return encoding.encode(docs, vocabulary("word_bpe_49k.json"), batch_chars=ENCODED, remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", filter_quality),
    ("language", filter_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix),
    ("encode", encode),
]
#: No stage but by its learned or sampled parts; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

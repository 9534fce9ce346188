"""Joins by prefix without comparing all with all: names against words that begin with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters by which words and names meet.
BUCKET = 8


def prefix_join(words: DataFrame, names: DataFrame, word: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Rows of words and names, of which the word begins with the name; an empty or null name begins none.

    Different words meet different names first: by equality of the name's first `bucket` letters with as many of the word's,
    with the whole name looked at afterwards where it is longer. A word has a row for each length up to `bucket`, and the
    words of a bucket are those of a vocabulary, however often each of them is said. Then rows join by equality on either
    side, where Spark splits what is frequent. Columns of the two sides must have different names.
    """
    said = words.select(F.col(word).alias("_word")).where("_word <> ''").distinct()
    given = names.select(F.col(name).alias("_name")).where("_name <> ''").distinct()
    starts = said.select("_word", F.explode(F.sequence(F.lit(1), F.least(F.length("_word"), F.lit(bucket)))).alias("_k"))
    starts = starts.select("_word", F.left("_word", F.col("_k")).alias("_start"))
    met = starts.join(given.withColumn("_start", F.left("_name", F.lit(bucket))), "_start").where(F.startswith("_word", F.col("_name"))).select("_word", "_name")
    own = words.join(met, words[word] == met["_word"]).drop("_word")
    return own.join(names, own["_name"] == names[name]).drop("_name")


def mentioned(questions: DataFrame, people: DataFrame, least: int = 4) -> DataFrame:
    """question and person of those whom a question may mean: a word of it begins with a word of the name that has `least`
    letters or more, in any case. questions (question, text), people (person, name); each pair once."""
    asked = questions.select("question", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("_said"))
    parts = F.filter(F.array_distinct(F.split(F.lower("name"), r"\s+")), lambda t: F.length(t) >= least)
    named = people.select("person", F.explode(parts).alias("_part"))
    return prefix_join(asked, named, "_said", "_part").select("question", "person").distinct()

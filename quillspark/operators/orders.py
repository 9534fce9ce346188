"""Orders in which readers look things up: by the letters of a language, in sections, page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Collation by language: Swedish has å, ä and ö behind z. Others go by the common order of letters.
COLLATIONS = {"sv": "sv", "de": "de", "fr": "fr", "en": "en", "it": "it"}


def collated(text: Column, lang: str = "sv", exact: bool = True) -> Column:
    """text as it is sorted and compared in a language; not exact: case and accents don't count, though letters of the
    language's own stay apart."""
    name = COLLATIONS.get(lang, "UNICODE")
    return F.collate(text, name if exact else f"{name}_CI_AI")


def listed(rows: DataFrame, section: str, author: str, year: str, title: str, lang: str = "sv", page: int = 50) -> DataFrame:
    """rows with place (from 1, in their section) and page (from 0): by author, then year, then title.

    Authors are counted first and their places summed over a section's authors; works are numbered within their author. So
    no window holds a section's works, and what a reader pages through is the rows themselves, of which a page is a range.
    Null sections, authors and titles are values of their own, first in order.
    """
    at = [F.col(section), F.col(author)]
    sizes = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    key = [collated(F.col(author), lang).asc_nulls_first(), F.col(author).asc_nulls_first()]
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(section).orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select(F.col(section).alias("_section"), F.col(author).alias("_author"), before.alias("_ahead"))
    own = Window.partitionBy(*at).orderBy(F.col(year).asc_nulls_first(), collated(F.col(title), lang).asc_nulls_first(), F.col(title).asc_nulls_first())
    placed = rows.withColumn("_own", F.row_number().over(own)).join(ahead, F.col(section).eqNullSafe(F.col("_section")) & F.col(author).eqNullSafe(F.col("_author")))
    placed = placed.withColumn("place", F.col("_own") + F.col("_ahead")).drop("_own", "_section", "_author", "_ahead")
    return placed.withColumn("page", F.floor((F.col("place") - 1) / page))


def tallied(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Counts of a column's values in a display order that is given, not by count; values not in it come last, by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("_at", F.when(F.coalesce(place, F.lit(0)) == 0, len(order) + 1).otherwise(place)).orderBy("_at", column).drop("_at")


def archive_filter(rows: DataFrame, models: list[str], words: str) -> DataFrame:
    """Saved searches (model, prompt) of one of the models, all if none is named, whose prompt has the words, in any case and
    with single blanks."""
    said = F.trim(F.regexp_replace(F.lower(F.lit(words)), r"\s+", " "))
    there = F.contains(F.regexp_replace(F.lower("prompt"), r"\s+", " "), said)
    return rows.where((F.col("model").isin(models) if models else F.lit(True)) & there)

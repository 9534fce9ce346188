"""Look-ups by prefix and in a language's order: conversations are questions, words of documents authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import orders as O
from quillspark.operators.prefixes import mentioned, prefix_join
from quillspark.plans.registry import Tables, query

_WORD = r"[\p{L}\p{N}]+"


@query(rf"""WITH q AS (SELECT conv_id AS question, unnest(list_distinct(regexp_extract_all(lower(text), '{_WORD}'))) AS said FROM conversations),
p AS (SELECT item_id AS person, unnest(list_distinct(list_filter(regexp_split_to_array(lower(left(text, 40)), '\s+'), lambda t: length(t) >= 4))) AS part FROM benchmark),
hits AS (SELECT said, part FROM (SELECT DISTINCT said FROM q), (SELECT DISTINCT part FROM p) WHERE starts_with(said, part))
SELECT DISTINCT question, person FROM q JOIN hits USING (said) JOIN p USING (part)""")
def mentioned_names(t: Tables) -> DataFrame:
    """Which names (beginnings of gold passages) the words of all conversations may mean."""
    asked = t.conversations.select(F.col("conv_id").alias("question"), "text")
    return mentioned(asked, t.benchmark.select(F.col("item_id").alias("person"), F.left("text", F.lit(40)).alias("name")))


@query(r"""WITH keys AS (SELECT DISTINCT left(lower(regexp_extract(text, '\p{L}+')), 5) AS key FROM conversations WHERE turn = 0 AND regexp_matches(text, '\p{L}')),
a AS (SELECT doc_id AS work, lower(regexp_extract(text, '\p{L}+')) AS author FROM documents)
SELECT work, author, max(length(key))::INT AS letters FROM a JOIN keys ON starts_with(author, key) AND author <> '' GROUP BY ALL""")
def authors_by_prefix(t: Tables) -> DataFrame:
    """Works whose author's name begins with one of the keys, with the letters of the longest that does."""
    first = F.lower(F.regexp_extract("text", r"\p{L}+", 0))
    keys = t.conversations.where("turn = 0").select(F.left(first, F.lit(5)).alias("key")).where("key <> ''").distinct()
    works = t.documents.select(F.col("doc_id").alias("work"), first.alias("author"))
    return prefix_join(works, keys, "author", "key").groupBy("work", "author").agg(F.max(F.length("key")).alias("letters"))


@query(r"""WITH w AS (SELECT doc_id AS work, lang AS section, nullif(regexp_extract(text, '\p{L}+'), '') AS author, n_chars AS year, source AS title FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY author COLLATE sv NULLS FIRST, author NULLS FIRST, year NULLS FIRST, title COLLATE sv NULLS FIRST, title NULLS FIRST, work) AS place FROM w)
SELECT section, author, year, title, place, (place - 1) // 50 AS page FROM n""")
def listed_works(t: Tables) -> DataFrame:
    """The collection by section, then author as a Swedish reader looks them up, then year and title, in pages."""
    rows = t.documents.select(F.col("lang").alias("section"), F.nullif(F.regexp_extract("text", r"\p{L}+", 0), F.lit("")).alias("author"), F.col("n_chars").alias("year"), F.col("source").alias("title"))
    return O.listed(rows, "section", "author", "year", "title")


@query(r"SELECT conv_id * 1000 + turn AS search FROM conversations WHERE role IN ('user', 'system') AND contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'la le')")
def filtered_archive(t: Tables) -> DataFrame:
    """Saved searches of some models whose prompt holds the words that were typed."""
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("search"), F.col("role").alias("model"), F.col("text").alias("prompt"))
    return O.archive_filter(rows, ["user", "system"], "  La   LE ").select("search")

"""The archive of searches and projects: caches by scope and model, unique names, membership, documents to take away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import prompt_norm, slug, text_hash

#: Characters of a project's name and note at most.
NAME, NOTE = 120, 500


def scope_of(axes: dict[str, Column]) -> Column:
    """Normal form of a filter, from arrays of values by axis: sorted, each once; an axis without values isn't in it."""
    parts = [F.when(F.size(v) > 0, F.concat(F.lit(f"{a}="), F.array_join(F.array_sort(F.array_distinct(v)), "+"))) for a, v in sorted(axes.items())]
    return F.concat_ws(";", *parts)


def exact_hits(saved: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (ask, prompt, scope, model) with search: the newest saved one (search, prompt, scope, model, at) with the same
    normal prompt, scope and model; null where there is none."""
    key = ["_prompt", "scope", "model"]
    newest = saved.withColumn("_prompt", prompt_norm(F.col("prompt"))).groupBy(*key).agg(F.max_by("search", F.struct("at", "search")).alias("search"))
    return asked.withColumn("_prompt", prompt_norm(F.col("prompt"))).join(newest, key, "left").select("ask", "search")


#: Neighbouring order values that are numbered in one window.
BLOCK = 4096


def numbered(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """rows with their number from 1 among those with the same `by`, in the order of a long column. Blocks of order values
    have windows of their own, and one over their counts, so that no window holds all rows of a frequent value."""
    cut = rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    counts = cut.groupBy(by, "_block").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(by).alias("_by"), F.col("_block").alias("_at"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_ahead"))
    inside = cut.withColumn(name, F.row_number().over(Window.partitionBy(by, "_block").orderBy(order)))
    met = inside.join(counts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_at")))
    return met.withColumn(name, F.col(name) + F.col("_ahead")).drop("_block", "_by", "_at", "_ahead")


def with_unique_slugs(rows: DataFrame, taken: DataFrame, title: str, order: str) -> DataFrame:
    """rows with slug, which no other row has and none of those taken (slug).

    The first row of a title, by `order` (long), gets the title's slug unless it is taken. The others get it with a number
    behind it, from 2 on, without the numbers that would give a name that is taken or the first of another title: 'a-b-2' is
    that of 'A b 2', if there is one. Names with different slugs before their number can't be equal.
    """
    named = numbered(rows.withColumn("_slug", F.coalesce(slug(F.col(title)), F.lit(""))), "_slug", order, "_n")
    held = taken.select(F.coalesce("slug", F.lit("")).alias("_name")).distinct()
    own = named.select("_slug").distinct()
    names = held.select("_name").unionByName(own.select(F.col("_slug").alias("_name"))).distinct()
    parsed = names.select(F.regexp_extract("_name", r"^(.*)-([1-9][0-9]{0,8})$", 1).alias("_of"), F.regexp_extract("_name", r"^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("long").alias("_number"))
    barred = parsed.where("_number >= 2").groupBy(F.col("_of").alias("_slug")).agg(F.sort_array(F.collect_set("_number")).alias("_barred"))
    first = own.join(held.select(F.col("_name").alias("_slug"), F.lit(True).alias("_gone")), "_slug", "left").join(barred, "_slug", "left")
    met = named.join(first, "_slug")
    # The k-th number from 2 on that isn't barred: each barred one that is reached moves it on by one.
    k = F.col("_n") - F.when(F.col("_gone"), 0).otherwise(1)
    moved = F.size(F.filter(F.coalesce("_barred", F.array().cast("array<bigint>")), lambda b, j: b - j <= k + 1))
    numbered_ = F.concat("_slug", F.lit("-"), (k + 1 + moved).cast("string"))
    return met.withColumn("slug", F.when(k == 0, F.col("_slug")).otherwise(numbered_)).drop("_slug", "_n", "_gone", "_barred")


def toggled(members: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Members without those asked for that were in, and with those that weren't; asked twice counts once."""
    asked = asked.select(*keys).distinct()
    return members.select(*keys).join(asked, keys, "left_anti").unionByName(asked.join(members.select(*keys), keys, "left_anti"))


def tidy_project(name: Column, note: Column) -> dict[str, Column]:
    return {"name": F.substring(F.trim(name), 1, NAME), "note": F.nullif(F.substring(F.trim(note), 1, NOTE), F.lit(""))}


def published(works: DataFrame, chunks: DataFrame) -> DataFrame:
    """works with chunk_count and complete: whether all that a work needs is there. Works without chunks aren't complete."""
    counts = chunks.groupBy("work").agg(F.count("*").alias("chunk_count"))
    return works.join(counts, "work", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).withColumn("complete", F.col("chunk_count") > 0)


def vector_changes(passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """id and change of passages (id, text) against stored vectors (id, hash of the text): new, changed or gone."""
    now = passages.select("id", text_hash(F.col("text")).alias("_now"))
    both = now.join(vectors.select("id", F.col("hash").alias("_was")), "id", "full")
    change = F.when(F.col("_was").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_was"), "changed")
    return both.withColumn("change", change).where("change is not null").select("id", "change")


def markdown_documents(quotes: DataFrame) -> DataFrame:
    """search, document of (search, question, n, author, title, locator, text): a heading, and each passage as a quotation
    with its reference, in order. One search has few passages."""
    where = F.concat_ws(", ", "author", F.concat(F.lit("*"), F.col("title"), F.lit("*")), "locator")
    quote = F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n— "), where)
    by = quotes.groupBy("search").agg(F.max("question").alias("question"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", quote.alias("q")))), lambda x: x["q"]), "\n\n").alias("body"))
    return by.select("search", F.concat(F.lit("# "), "question", F.lit("\n\n"), "body", F.lit("\n")).alias("document"))


def sections(works: DataFrame, by: Column) -> DataFrame:
    """section, authors: the collection by section, then author, then year and title, nested: author, works (year, title)."""
    one = works.withColumn("section", by).groupBy("section", "author").agg(F.sort_array(F.collect_list(F.struct("year", "title"))).alias("works"))
    return one.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("author", "works"))).alias("authors"))


def gold_verdicts(wanted: DataFrame, found: DataFrame, indexed: DataFrame) -> DataFrame:
    """question, author, verdict of required authors: hit, miss, or not indexed, which no recall may count against."""
    rows = wanted.join(found.select("question", "author").distinct().withColumn("_hit", F.lit(True)), ["question", "author"], "left")
    rows = rows.join(indexed.select("author").distinct().withColumn("_there", F.lit(True)), "author", "left")
    verdict = F.when(F.col("_there").isNull(), "not indexed").when(F.col("_hit"), "hit").otherwise("miss")
    return rows.select("question", "author", verdict.alias("verdict"))


def recall(verdicts: DataFrame) -> DataFrame:
    """question, testable, hits, recall over what could be found; null where nothing could."""
    by = verdicts.groupBy("question").agg(F.count_if(F.col("verdict") != "not indexed").alias("testable"), F.count_if(F.col("verdict") == "hit").alias("hits"))
    return by.withColumn("recall", F.round(F.try_divide("hits", "testable"), 6))


def gold_minimums(asked: DataFrame, found: DataFrame, home: str = "sv") -> DataFrame:
    """question, genres, own, genres_ok, own_ok: whether what was found (question, genre, lang) has as many genres and passages in
    the home language as were asked for (question, min_genres, min_own); null where no minimum is set."""
    by = found.groupBy("question").agg(F.countDistinct("genre").alias("genres"), F.count_if(F.col("lang") == home).alias("own"))
    rows = asked.join(by, "question", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("genres", "own")})
    return rows.select("question", "genres", "own", (F.col("genres") >= F.col("min_genres")).alias("genres_ok"), (F.col("own") >= F.col("min_own")).alias("own_ok"))


def write_documents(documents: DataFrame, path: str, name: Column, content: Column) -> None:
    """Write each document as text to a folder of its own name below path. Names are as file_name() gives them; documents with
    one name stand in one folder, each in its own file; null names and contents are left out."""
    rows = documents.select(name.alias("file"), content.alias("value")).where("file IS NOT NULL AND value IS NOT NULL")
    rows.write.mode("overwrite").option("lineSep", "\n").partitionBy("file").text(path)

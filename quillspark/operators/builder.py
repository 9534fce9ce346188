"""From a catalogue to a manifest: works of the authors that are wanted, each once, with what is added by hand, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import catalog as C
from quillspark.operators.prefixes import prefix_join

#: Fixed value: volumes of a work that are taken where the catalogue has none in one.
VOLUMES = 6


def candidates(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the catalogue (id, authors, title) for each wanted author (grp, author_no, key, cap): one of its primary authors,
    none of them dubious, has a name that begins with the key."""
    named = catalog.withColumn("_by", C.attribution(F.col("authors"))).where("NOT _by.dubious")
    people = named.select("id", "title", F.explode("_by.authors").alias("person"))
    # Keys are met before authors: many authors may have one, and what is grouped is a row of the catalogue, not all its authors.
    met = prefix_join(people, wanted.select(F.col("key").alias("_of")).distinct(), "person", "_of")
    met = met.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("_of", F.col("title").isNull().alias("_none"), "title"))).alias("_met"))
    first = F.filter("_met", lambda x, i: (i == 0) | (x["_of"] != F.get("_met", i - 1)["_of"]))
    own = met.select("id", F.explode(first).alias("_x")).select("id", F.col("_x._of").alias("key"), "_x.title")
    return own.join(wanted.select("grp", "author_no", "key", "cap").distinct(), "key").select("grp", "author_no", "key", "cap", "id", "title")


def chosen(found: DataFrame, denied: str, priority: DataFrame) -> DataFrame:
    """found without titles that are ruled out, volumes of what is there in one, and further editions; of each author the
    first `cap`, prioritised ids (id) before lower ones."""
    rows = found.where(~F.col("title").rlike(denied)).withColumns({"_base": F.lower(C.base_title(F.col("title"))), "_part": C.volume_of(F.col("title")).isNotNull(), "_key": C.title_key(F.col("title"))})
    author = ["grp", "author_no"]
    series = Window.partitionBy(*author, "_base")
    rows = rows.withColumn("_whole", F.max(~F.col("_part")).over(series))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*author, "_base", "_part").orderBy("id")))
    rows = rows.where(F.when(F.col("_whole"), ~F.col("_part") & (F.col("_n") == 1)).otherwise(F.col("_n") <= VOLUMES))
    first = rows.join(priority.select("id", F.lit(0).alias("_first")).distinct(), "id", "left").withColumn("_first", F.coalesce("_first", F.lit(1)))
    order = ["_first", "id"]
    first = first.where("_key <> ''").withColumn("_again", F.row_number().over(Window.partitionBy(*author, "_key").orderBy(*order))).where("_again = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*author).orderBy(*order))).where("place <= cap").select("grp", "author_no", "key", "id", "title", "place")


def manifest(catalog: DataFrame, wanted: DataFrame, extras: DataFrame, denied: str, priority: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The works (id, key, title, origin), and a report (key, report) of what came to nothing.

    A catalogue's row that several authors have chosen goes to the first by group and place in it; caps count before that.
    Extras (id, key, title) come last: one whose row is taken already isn't added, one that the catalogue lacks is reported,
    as are authors without a row and those of whom none is left.
    """
    found = candidates(catalog, wanted)
    own = chosen(found, denied, priority)
    claim = Window.partitionBy("id").orderBy("grp", "author_no")
    works = own.withColumn("_n", F.row_number().over(claim)).where("_n = 1").select("id", "key", "title", F.lit("catalogue").alias("origin"))
    added = extras.dropDuplicates(["id"]).join(works, "id", "left_anti")
    there = added.join(catalog.select("id"), "id", "left_semi").select("id", "key", "title", F.lit("extra").alias("origin"))
    missing = added.join(catalog.select("id"), "id", "left_anti").select("key", F.lit("extra isn't in the catalogue").alias("report"))
    counts = found.groupBy("grp", "author_no").agg(F.count("*").alias("_had"))
    kept = own.groupBy("grp", "author_no").agg(F.count("*").alias("_left"))
    lacking = wanted.join(counts, ["grp", "author_no"], "left").join(kept, ["grp", "author_no"], "left").where("_left IS NULL")
    told = lacking.select("key", F.when(F.col("_had").isNull(), "not in the catalogue").otherwise(F.concat("_had", F.lit(" works, none left"))).alias("report"))
    return works.unionByName(there), told.unionByName(missing)

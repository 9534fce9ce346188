"""State changes as table rewrites, guarded look-ups, set operations and sequence windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import text_hash


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row for each key: the latest of both tables."""
    w = Window.partitionBy(*keys).orderBy(F.desc(newest))
    return old.unionByName(new, allowMissingColumns=True).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones of keys not there yet."""
    return old.unionByName(new.join(old, keys, "left_anti"))


def delete_where_key(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def sync(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of old with the columns of new, and whether any of them changed; nulls compare as values."""
    renamed = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = old.join(renamed.withColumn("_there", F.lit(True)), key, "left")
    there = F.col("_there").isNotNull()
    return joined.withColumn("changed", there & ~same).select(*[F.when(there, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns], "changed")


def guarded(refs: DataFrame, passages: DataFrame) -> DataFrame:
    """refs (id, hash) with the passage's text where it is still there and unchanged; lost: otherwise."""
    # Hashed before it is joined: a text moves only where it is asked for.
    found = refs.join(passages.select("id", "text", text_hash(F.col("text")).alias("_now")), "id", "left")
    intact = F.coalesce(F.col("_now") == F.col("hash"), F.lit(False))
    return found.withColumn("lost", ~intact).withColumn("text", F.when(intact, F.col("text"))).drop("_now")


def carried(rows: DataFrame, value: Column, by: str, order: str, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def runs(rows: DataFrame, flag: Column, by: str, order: str, name: str) -> DataFrame:
    """Length of the run of flagged rows that a flagged row is in; 0 for others."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, "_f").orderBy(order))
    marked = rows.withColumn("_f", flag).withColumn("_i", island)
    return marked.withColumn(name, F.when(F.col("_f"), F.count("*").over(Window.partitionBy(by, "_f", "_i"))).otherwise(0)).drop("_f", "_i")


def capped(rows: DataFrame, by: str, order: list, cap: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)

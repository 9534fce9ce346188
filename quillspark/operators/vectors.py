"""Vectors of passages, kept up to date: only texts whose fingerprint is new are embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import text_hash
from quillspark.sources.versioned import VersionedTable

SCHEMA = "id long, work string, hash string, v array<float>"
#: Texts that a model gets at once.
BATCH = 64
#: What makes a model: called once in each Python worker, however many tasks it runs.
Maker = Callable[[], Callable[[list[str]], list[list[float]]]]
_models: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def model_of(name: str, make: Maker) -> Callable[[list[str]], list[list[float]]]:
    """This worker's model of that name, loaded when first asked for."""
    if name not in _models:
        _models[name] = make()
    return _models[name]


def embedded(texts: DataFrame, name: str, make: Maker) -> DataFrame:
    """id, work, hash, v of (id, work, text); a null text has no vector."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BATCH):
                part = batch.slice(lo, BATCH)
                v = model_of(name, make)(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("work"), part.column("hash"), pa.array(v, pa.list_(pa.float32()))], ["id", "work", "hash", "v"])

    rows = texts.where("text IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("work").cast("string").alias("work"), text_hash(F.col("text")).alias("hash"), "text")
    return rows.mapInArrow(embed, SCHEMA)


class Vectors:
    """The vectors of a folder, as a table with versions."""

    def __init__(self, spark: SparkSession, path: str, name: str, make: Maker) -> None:
        self.table, self.name, self.make = VersionedTable(spark, path, SCHEMA), name, make

    def refresh(self, passages: DataFrame, works: DataFrame) -> int:
        """Bring the vectors of some works (work) in line with their passages (id, work, text); returns the version.

        Unchanged texts keep their vector, changed and new ones are embedded, those of passages that are gone go. Doing it
        again embeds nothing and changes nothing.
        """
        stored = self.table.read()
        names = works.select(F.col("work").cast("string").alias("work")).distinct()
        own = passages.select(F.col("id").cast("long").alias("id"), F.col("work").cast("string").alias("work"), "text").where("text IS NOT NULL")
        now = own.withColumn("_hash", text_hash(F.col("text")))
        held = stored.join(names, "work", "left_semi").select("id", F.col("hash").alias("_hash"))
        fresh = now.join(held, ["id", "_hash"], "left_anti").drop("_hash")
        gone = held.join(now.select("id", "_hash"), ["id", "_hash"], "left_anti").select("id")
        changed = fresh.select("id").unionByName(gone).distinct()
        if not changed.limit(1).count():
            return self.table.version()
        return self.table.replace(embedded(fresh, self.name, self.make), ["id"], keys=changed)

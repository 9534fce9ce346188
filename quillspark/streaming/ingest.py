"""Incremental ingest: works that land are chunked, embedded, indexed and published as one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import index as I
from quillspark.operators import structure
from quillspark.operators.vectors import Maker, Vectors
from quillspark.sources.versioned import VersionedTable

PASSAGES = "id long, work string, lang string, ordinal long, locator string, front boolean, char_start long, char_end long, text string"
LANDED = "work_id long, lang string, text string"
#: Bits of a passage's id that are its ordinal; the others are its work's id.
ORDINAL_BITS = 20


@dataclass(frozen=True)
class Edition:
    """What one commit has published: whole works alone, the same however long it is read."""

    passages: DataFrame
    vectors: DataFrame
    index: I.View


class Library:
    """A folder of works: passages, vectors and the search index. The index's commits name the versions of the other two, so
    that one pointer publishes all three."""

    def __init__(self, spark: SparkSession, path: str, model: str = "hashed words", make: Maker | None = None) -> None:
        self.spark, self.path = spark, path
        self.passages = VersionedTable(spark, f"{path}/passages", PASSAGES)
        self.index = I.Index(spark, f"{path}/index")
        self.vectors = Vectors(spark, f"{path}/vectors", model, make or hashed_words)

    def publish(self, works: DataFrame, stream: str = "", batch: int | None = None, force: bool = False) -> int:
        """Publish works (work_id, lang, text); with force also those that are published already, in place of what there was.

        Of a work that comes twice, the row counts that landed last (`landed`, if there is such a column), then the last by
        text. Null ids are no works. A batch that runs again finds its works published, or its number committed, and changes
        nothing. A work without chunks is published with none.
        """
        order = [F.desc_nulls_last(c) for c in ("landed", "text", "lang") if c in works.columns]
        one = works.where("work_id IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("work_id").orderBy(*order))).where("_n = 1")
        one = one.select(F.col("work_id").cast("long").alias("work_id"), "lang", "text", F.col("work_id").cast("string").alias("work"))
        if not force:
            one = one.join(self.index.view().works().select("work").distinct(), "work", "left_anti")
        names = one.select("work")
        if not names.limit(1).count():
            return self.index.manifests.latest()
        cut = structure.chunks(one.withColumn("language", F.col("lang"))).withColumn("id", F.shiftleft("work_id", ORDINAL_BITS) + F.col("ordinal")).withColumnRenamed("language", "lang")
        first = self.passages.replace(cut.select(*[c.split()[0] for c in PASSAGES.split(", ")]), ["work"], keys=names)
        own = self.passages.read(first).join(names, "work", "left_semi")
        searched = own.where("NOT front")
        second = self.vectors.refresh(searched, names)
        return self.index.add(own.select("id", "work", "text"), stream, batch, works=names, note={"passages": first, "vectors": second})

    def withdraw(self, works: DataFrame) -> int:
        """Take works (work_id) out of what is published."""
        names = works.select(F.col("work_id").cast("string").alias("work")).distinct()
        note = {"passages": self.passages.delete(names, ["work"]), "vectors": self.vectors.table.delete(names, ["work"])}
        return self.index.add(self.spark.createDataFrame([], "id long, work string, text string"), works=names, note=note)

    def edition(self, commit: int | None = None) -> Edition:
        view = self.index.view(commit)
        note = view.commit.get("note", {})
        return Edition(self.passages.read(note.get("passages", 0)), self.vectors.table.read(note.get("vectors", 0)), view)


def hashed_words():
    """A model without weights: signed hashes of words in 64 places, of length 1."""
    import math
    import re
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * 64
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                v[h % 64] += 1 if h & 64 else -1
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out

    return embed


def ingest(library: Library, landing: str, checkpoint: str, force: bool = False, schema: str = LANDED) -> StreamingQuery:
    """Publish all works that landed since the last run, batch by batch; also after a restart none twice."""

    def publish(batch: DataFrame, number: int) -> None:
        library.publish(batch, stream=checkpoint, batch=number, force=force)
        library.index.merge(I.MANY, I.MANY - 1)

    works = library.spark.readStream.schema(schema).parquet(landing).select("*", F.col("_metadata.file_modification_time").alias("landed"))
    return works.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(events: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Counts and cost by time window and type, of a stream or a table; a stream drops what is later than `late`."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("cost"))

"""What the operators of this subpackage share: tables, the held-out split, checkpoints and bounded running totals."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of texts that a worker handles together; a longer text goes alone.
SLICE = 2_000_000
#: Rows of a batch that become Python strings at once.
ROWS = 256
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id, written as text, leaves no remainder by 5. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; one of our own only in local mode, where driver and
    executors are one process, and only where the session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp("-checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Write df as a table to the shared folder and read on from there, so that lost executors lose nothing and plans of
    repeated rounds stay small (a checkpoint() would carry its constraints from round to round). The tables go with that
    folder, or, where their paths are noted in scratch, when release() is told of it.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables that nothing reads any more; what was worked out from them must have been written."""
    for path in scratch:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    scratch.clear()


def text_columns(docs: DataFrame, begin: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, keep: tuple[str, ...] = ("doc_id",), slice_chars: int = SLICE) -> DataFrame:
    """The columns `keep` of docs, and those of `schema` (long, double, string, int or binary) that are worked out of its text.

    begin() is called once a task and gives the function from texts to columns. Kept columns stay in Arrow: pandas would make
    ids next to a null one doubles. A null text counts as empty; texts come in lists of about slice_chars characters.
    """
    told = T.StructType.fromDDL(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = begin()

        def row_part(batch: pa.RecordBatch, first: int, texts: list[str]) -> pa.RecordBatch:
            found = of(texts)
            own = [pa.array(found[f.name], ARROW[f.dataType.simpleString()]) for f in told]
            return pa.RecordBatch.from_arrays([*batch.slice(first, len(texts)).columns[:-1], *own], [*keep, *told.names])

        for batch in batches:
            first, held, size = 0, [], 0
            for lo in range(0, len(batch), ROWS):
                for text in batch.column(len(keep)).slice(lo, ROWS).to_pylist():
                    held.append(text)
                    size += len(text)
                    if size >= slice_chars:
                        yield row_part(batch, first, held)
                        first, held, size = first + len(held), [], 0
            if held:
                yield row_part(batch, first, held)
            held = []
            trim()

    texts = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    return texts.mapInArrow(work, T.StructType([*texts.schema.fields[:-1], *told.fields]))


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers serve one stage after another, and what one has held
    at most would stay with them. Where the system has no such call, nothing happens."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def sampled(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About `rows` rows of df, chosen by a hash of the key, the same at every run; all of them if there are fewer."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < int(rows / n * (1 << 30)))


def running(
    df: DataFrame, keys: list[str], pos: str, values: dict[str, tuple[str, Callable[[Column], Column], int]], top: int, fan: int = 1024
) -> DataFrame:
    """Exclusive running aggregates in the order of `pos`, with no task that needs all rows of a key.

    pos: integers from 0 to top - 1, each once for a key. values: new column -> (input column, aggregate, start).
    The aggregate must be associative and equal to its own merge (sum of counts, bit_xor). Each window sees `fan`
    positions at most: positions are cut into blocks, block totals are accumulated by the same function one level up.
    """
    def before(over) -> list[Column]:
        over = over.orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(f(F.col(c)).over(over), F.lit(start)).alias(out) for out, (c, f, start) in values.items()]

    rest = [c for c in df.columns]
    if top <= fan:
        return df.select(*rest, *before(Window.partitionBy(*keys)))
    blocked = df.withColumn("_block", F.floor(F.col(pos) / fan))
    totals = blocked.groupBy(*keys, "_block").agg(*[f(F.col(c)).alias(f"_{out}") for out, (c, f, _) in values.items()])
    ahead = running(
        totals.withColumnRenamed("_block", "_pos"), keys, "_pos", {f"_{out}_ahead": (f"_{out}", f, start) for out, (_, f, start) in values.items()}, math.ceil(top / fan), fan
    ).select(*keys, F.col("_pos").alias("_block"), *[f"_{out}_ahead" for out in values])
    inside = blocked.select(*rest, "_block", *before(Window.partitionBy(*keys, "_block")))
    joined = inside.join(ahead, [*keys, "_block"], "left")

    def merged(out: str, f: Callable[[Column], Column]) -> Column:
        a, b = F.col(out), F.col(f"_{out}_ahead")
        return (a.bitwiseXOR(b) if f is F.bit_xor else a + b).alias(out)

    return joined.select(*rest, *[merged(out, f) for out, (_, f, _) in values.items()])


def ranges(df: DataFrame, order: list[Column], per: int) -> DataFrame:
    """df with _range, the number of the run of about `per` neighbouring rows, in this order, that each row is in."""
    df = cut(df)
    return cut(df.repartitionByRange(max(1, math.ceil(df.count() / per)), *order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column], name: str, per: int = 50_000) -> DataFrame:
    """df with a column `name`: each row's number in this order, from 0. No window sees more rows than a range has, or than
    there are ranges."""
    placed = ranges(df, order, per)
    counts = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("_range", F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(ahead, "_range").select(*df.columns, (F.col("_inside") + F.col("_ahead")).cast("long").alias(name))


def successors(df: DataFrame, order: list[Column], name: str, per: int = 50_000) -> DataFrame:
    """df with a column `name`: the next row in this order, as a struct of df's columns, of the last row the first one.

    Rows are cut into ranges of about `per`, each with a window of its own; a window over the ranges' first rows, one for
    each `per` rows of df, leads from range to range. An empty table gives an empty result.
    """
    placed = ranges(df, order, per)
    inside = Window.partitionBy("_range").orderBy(*order)
    row = F.struct(*df.columns)
    firsts = cut(placed.withColumn("_n", F.row_number().over(inside)).where("_n = 1").select("_range", row.alias("_first")))
    over = Window.orderBy("_range")
    top = F.first("_first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ahead = firsts.select("_range", F.coalesce(F.lead("_first").over(over), top).alias("_ahead"))
    found = placed.withColumn("_inside", F.lead(row).over(inside)).join(ahead, "_range")
    return found.select(*df.columns, F.coalesce("_inside", "_ahead").alias(name))

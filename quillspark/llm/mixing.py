"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, numbered, running

WORD = r"[^\x20\x09-\x0D]+"
#: Points are integers below 2**POINT_BITS: multiples of the golden ratio's fraction, exact for any number of slots.
POINT_BITS = 52
GOLDEN = round(0.6180339887498949 * 2**POINT_BITS)


def n_words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null and for empty texts."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**52, for slots below 2**52; put together from halves, so that no product overflows."""
    half = 1 << POINT_BITS // 2
    high, low = divmod(GOLDEN, half)
    a, b = F.shiftright(slot, POINT_BITS // 2), slot % half
    return (b * low + (b * high + a * low) % half * half) % (1 << POINT_BITS)


def block_length(size: Column, block: int) -> Column:
    """Words of each block of a source: its size in equal blocks of about `block` words."""
    return F.ceil(size / F.greatest(F.lit(1), F.round(size / block))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: s (its rank by code point from 0, null last), source, source_size and target.

    The weights repeat over the ranked sources. Targets share `share` times all words by weight; none is above `cap` times
    its source's size, what is above goes to the others by weight until none is above. The level of that filling is found
    by repeated sums over the sources, each of which only caps more of them.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    sources = cut(numbered(by_source, [F.col("source").isNull(), F.col("source")], "s").withColumn("w", w))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, room = 0.0, F.col("source_size") * cap
    while total:
        full = room <= F.col("w") * level
        filled, left = sources.agg(F.sum(F.when(full, room).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (share * total - filled) / left if left else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return sources.select("s", "source", "source_size", F.least(room, F.col("w") * level).alias("target"))


def schedule(sources: DataFrame, block: int, cap: int = 2) -> DataFrame:
    """The mix as slots in order: slot, s, block (number of the source's block that the slot takes).

    sources: s, source_size, target. Slot i is the i-th golden-ratio point, mapped through the cumulative shares of the
    sources; its rank among the slots of its source says which block it takes, going round again after the last one, but
    not more than `cap` times. Shares and points meet by cells, of which there are more than sources.
    """
    length = block_length(F.col("source_size"), block)
    rows = sources.where("source_size > 0 and target > 0").select("s", length.alias("length"), F.ceil(F.col("source_size") / length).cast("long").alias("blocks"), (F.col("target") / length).alias("q"))
    rows = cut(rows.withColumn("part", F.greatest(F.lit(1), F.round(F.col("q") * 65536)).cast("long")))
    slots, total, n, last = rows.agg(F.coalesce(F.sum("q"), F.lit(0.0)), F.sum("part"), F.count("*"), F.max("s")).first()
    slots = math.ceil(slots)
    cell_bits = max(10, n.bit_length() + 2)
    cell = lambda p: F.shiftright(p, POINT_BITS - cell_bits)

    def bound(c: Column) -> Column:
        return F.floor(c / F.lit(float(total or 1)) * float(1 << POINT_BITS)).cast("long")

    shares = running(rows, [], "s", {"_before": ("part", F.sum, 0)}, (last or 0) + 1)
    shares = shares.select("s", "length", "blocks", bound(F.col("_before")).alias("lo"), bound(F.col("_before") + F.col("part")).alias("hi")).where("hi > lo")
    shares = shares.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    points = points.withColumn("cell", cell(F.col("u")))
    dealt = points.join(shares, "cell").where("u >= lo and u < hi").select("slot", "s", "blocks", "length")
    ranked = running(dealt.withColumn("_one", F.lit(1)), ["s"], "slot", {"r": ("_one", F.sum, 0)}, max(1, slots))
    return ranked.where(F.col("r") < cap * F.col("blocks")).select("slot", "s", "length", (F.col("r") % F.col("blocks")).alias("block"))


def block_pieces(sizes: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """The documents of each source, shuffled by a seeded hash and cut into its blocks: doc_id, s, start, size, block, words.

    start is the document's place, in words, along the shuffled source. Hash buckets keep each window small, whatever the
    share of the largest source; rows that are equal in id and text (t: a hash of it) are numbered, so that their places in
    the shuffle differ.
    """
    n = sizes.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(1, n) / 256)))
    equal = sizes.where("size > 0").groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("copies"))
    rows = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    h = F.xxhash64(F.lit(seed), "doc_id", "size", "t", "copy")
    placed = rows.join(sources.select("s", F.col("source").alias("_source"), "source_size"), F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.select("doc_id", "size", "s", "source_size", "copy", h.alias("h"), F.pmod(h, F.lit(buckets)).alias("bucket"))
    totals = placed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    ahead = running(totals, ["s"], "bucket", {"ahead": ("words", F.sum, 0)}, buckets).select("s", "bucket", "ahead")
    order = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(order), F.lit(0))
    placed = placed.withColumn("_in", start).join(ahead, ["s", "bucket"]).withColumn("start", F.col("_in") + F.col("ahead"))
    placed = placed.select("doc_id", "size", "s", "start", block_length(F.col("source_size"), block).alias("length"))
    blocks = F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length")))
    cut_up = placed.withColumn("block", F.explode(blocks))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("length")) - F.greatest(F.col("start"), F.col("block") * F.col("length"))
    return cut_up.select("doc_id", "size", "s", "start", "block", words.alias("words"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 128, seed: int = 5) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    docs: doc_id, text, source; other columns are ignored. Texts are read once; from then on only ids and sizes move.
    Null and empty texts have size 0 and taken 0; a null source is a source of its own, ranked last; rows with the same id
    have takes of their own, also where they are equal in all columns; an empty table gives an empty result.
    """
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), F.xxhash64("text").alias("t")))
    sources = source_targets(sizes, weights, share, cap)
    times = schedule(sources, block, int(cap)).groupBy("s", "block").agg(F.count("*").alias("times"))
    taken = block_pieces(sizes, sources, block, seed).join(times, ["s", "block"], "left")
    taken = taken.groupBy("s", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = sizes.where("size = 0").join(sources.select(F.col("source").alias("_source"), "s"), F.col("source").eqNullSafe(F.col("_source")))
    rows = taken.select("doc_id", "size", "s", "taken").unionByName(empty.select("doc_id", "size", "s", F.lit(0).cast("long").alias("taken")))
    return rows.join(sources, "s").select("doc_id", "source", "size", "source_size", "target", "taken")

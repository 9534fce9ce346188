"""Document fingerprints: threshold-scaled sketches of word shingles (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, successors

#: Logarithm of the number of neighbouring ids in a block.
BLOCK_BITS = 8


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """64-bit hashes of all runs of k words, repeats kept; of the whole text where it has fewer words; none for no words."""
    words = F.array_remove(F.split(text, r"\s+"), "")

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    # One-element transform: a name for the words, so that the split runs once.
    return F.get(F.transform(F.array(words), of), F.lit(0))


def sketch(text: Column, scale: int = 4, k: int = 5) -> Column:
    """Sorted distinct shingle hashes among the lowest 1/scale of all 64-bit hashes.

    Sketches of parts merge by union; a document's own size doesn't change which hashes stay, so that containment can be
    estimated between documents of very unequal length.
    """
    lowest = -(1 << 63) + (1 << 64) // scale
    return F.sort_array(F.array_distinct(F.filter(shingle_hashes(text, k), lambda h: h < F.lit(lowest))))


def fingerprint(text: Column, hashes: Column) -> Column:
    """The sketch as a string: a hash of the whole text, a colon, the retained hashes in hexadecimal."""
    return F.concat(F.lower(F.hex(F.xxhash64(text))), F.lit(":"), F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ","))


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents' shingles together."""
    return F.sort_array(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; null where a's sketch is empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard similarity of two documents' shingles.

    Where neither sketch retains a hash, as with texts of a few words: 1 if `same` holds (equal texts), else 0.
    """
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.when(same, 1.0).otherwise(0.0))


def fingerprint_edits(docs: DataFrame, scale: int = 4, k: int = 5, bits: int = BLOCK_BITS) -> DataFrame:
    """Fingerprint each text, its edited text and its successor, and compare them.

    The successor is the row with the next lower doc_id, of the last row the first. The edited text has its last
    floor(n/2) code points replaced by the successor's first as many. Texts move once, dealt by blocks of about
    2**bits neighbouring rows: of so many ids, or of as many more as ids are apart on average. A block's last row gets its successor from a table of block heads. Null ids come last. A block with
    more than four times as many rows (a null or repeated id) is dealt on by id and by the first bits of the text's MD5, and
    rows equal in id and text are counted there: all but one of them succeed one another.
    Null texts count as empty; rows with the same id go by their text's MD5; a table of one row succeeds itself; extra
    columns are ignored.
    """
    zero = F.lit(0).cast("long")
    low, high, rows = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long")), F.count("doc_id")).first()
    wide = min(63, bits + max(0, ((high - low + 1) // rows).bit_length() - 1)) if rows else bits
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({
        "h": F.md5(F.col("text").cast("binary")), "z": F.col("doc_id").isNull(), "g": F.shiftright(F.coalesce("doc_id", zero), wide), "i": zero, "j": zero, "n": zero + 1,
    })
    crowded = cut(base.groupBy("z", "g").agg(F.count("*").alias("m")).where(F.col("m") > 4 << bits))
    dealt_on = crowded.limit(1).count() > 0
    if dealt_on:
        crowd = base.join(crowded, ["z", "g"]).groupBy("z", "g", "m", "doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("n"))
        crowd = crowd.withColumns({"i": F.coalesce("doc_id", zero), "_start": F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), "_bits": F.ceil(F.log2(F.col("m") / (1 << bits))).cast("int")})
        crowd = crowd.withColumn("j", F.expr("shiftright(_start, 32 - _bits)"))
        base = base.join(crowded, ["z", "g"], "left_anti").unionByName(crowd.select(base.columns))
    place, order = ["z", "g", "i", "j"], [F.desc_nulls_last("doc_id"), F.desc("h")]
    window = Window.partitionBy(*place).orderBy(*order)
    heads = base.withColumn("_n", F.row_number().over(window)).where("_n = 1")
    heads = cut(heads.select(F.struct(*place).alias("next_place"), F.col("text").alias("_head"), sketch(F.col("text"), scale, k).alias("_head_sketch")))
    after = successors(heads.select("next_place.*"), [F.asc("z"), F.desc("g"), F.desc("i"), F.desc("j")], "next_place")
    after = after.join(heads, "next_place").select(*place, "_head", "_head_sketch")
    rows = base.withColumn("sketch", sketch(F.col("text"), scale, k))
    rows = rows.withColumn("_in", F.lead("text").over(window)).withColumn("_in_sketch", F.lead("sketch").over(window))
    rows = rows.join(after, place, "left").select(
        "doc_id", "text", "sketch", "n", F.length("text").cast("long").alias("n_chars"), F.coalesce("_in", "_head").alias("next"),
        F.when(F.col("_in").isNull(), F.col("_head_sketch")).otherwise(F.col("_in_sketch")).alias("next_sketch"),
    )
    if dealt_on:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        rows = rows.withColumns({c: F.when(F.col("_copy") < F.col("n"), F.col(own)).otherwise(F.col(c)) for c, own in (("next", "text"), ("next_sketch", "sketch"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - half).cast("int")), F.left("next", half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), scale, k))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text"), F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )

"""Source divergence audit: how far the sources of a language are apart in the terms they use, and which terms stand out.

Each kept term is one wide row with its counts in an array by source. Higher-order functions turn these into shares and emit
the pairs of sources to which the term adds something, and the aggregation sums that on the map side before any row moves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: What bytes become before a text is cut at blanks: of ASCII, letters stay, A-Z as small ones, and all else is a blank.
FOLDED = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Different terms that a worker counts before it hands their counts on.
HELD = 600_000
#: Shares are integers of the unit 1e9, which is the product of these: a division in two steps stays within 64 bits.
STEPS = (100_000, 10_000)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, repeats kept: runs of ASCII letters and of what isn't ASCII, A-Z lower-cased."""
    return text.translate(FOLDED).split()


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / (total + size)), exact for counts up to 9e13 and totals up to 9e14."""
    first, below = (count + 1) * STEPS[0], total + size
    return 1 + div(first, below) * STEPS[1] + div((first % below) * STEPS[1], below)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q). Shares are at most 1e9 + 1, so that squares fit."""
    return div((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents that hold it), counted where the texts are before any row moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> pa.RecordBatch:
            lang, source, term, n, d = [], [], [], [], []
            for (a, b), (times, seen) in groups.items():
                lang += [a] * len(times)
                source += [b] * len(times)
                term += times
                n += times.values()
                d += map(seen.__getitem__, times)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                ["lang", "source", "term", "n", "d"],
            )

        for batch in batches:
            for lo in range(0, len(batch), 64):
                for lang, source, text in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)):
                    times, seen = groups.setdefault((lang, source), (Counter(), Counter()))
                    words = terms(text)
                    times.update(words)
                    seen.update(set(words))
                if sum(len(times) for times, _ in groups.values()) >= HELD:
                    yield told()
                    groups.clear()
        if any(times for times, _ in groups.values()):
            yield told()

    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    found = own.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: each source against each other one of its language, and the terms that stand out.

    A language keeps the terms that are in at least least_docs of its documents. A group's share of a term is smoothed by one
    (`share`). Part `pair`: item is another source of the language, value the sum of `gap` over all kept terms, 0 where none
    are kept. Part `term`: item is a kept term that the group has and of which its share is above the language's, value the
    gap to it, the first `top` alone. Ranks go by value, highest first, then by item.

    All terms that neither of two sources has add the same gap. So a wide row emits, for each source that has the term, its
    gaps to all others, and theirs to it where they lack the term; the number of these says how many terms are left. Sums fit into 64 bits: the sum of squares is at most the square of the sum
    of differences, 2e9 + 2 * size.
    Null texts, langs and sources are empty strings, groups like any other; a document without terms still makes its
    group occur; repeated rows count again; an empty table gives an empty result; other columns are ignored.
    """
    counts = term_counts(docs)
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = cut(named.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")))
    at = langs.select("lang", F.size("sources").alias("_n"), F.posexplode("sources").alias("_i", "source"))
    entries = counts.join(at, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("d").alias("_d"), F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_i", "n"))).alias("_by"))
    dense = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at("_by", i), F.lit(0).cast("long")))
    wide = cut(entries.where(F.col("_d") >= least_docs).select("lang", "term", dense.alias("counts")))

    sums = wide.select("lang", F.posexplode("counts").alias("_i", "n")).groupBy("lang", "_i").agg(F.sum("n").alias("n"), F.count("*").alias("size"))
    sums = sums.groupBy("lang").agg(F.max("size").alias("size"), F.sum("n").alias("whole"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "n"))), lambda x: x["n"]).alias("totals"))
    none = F.lit(0).cast("long")
    audit = langs.join(sums, "lang", "left").select(
        "lang", "sources", F.coalesce("size", none).alias("size"), F.coalesce("whole", none).alias("whole"),
        F.coalesce("totals", F.transform("sources", lambda s: none)).alias("totals"),
    )
    audit = cut(audit)

    rows = wide.join(audit.drop("sources"), "lang").withColumn("shares", F.zip_with("counts", "totals", lambda n, total: share(n, total, F.col("size"))))
    rows = rows.select("lang", "term", "counts", "shares", share(F.aggregate("counts", none, lambda a, n: a + n), F.col("whole"), F.col("size")).alias("q"))
    # Of each row the sources that have the term, each of which meets all sources; the gaps are worked out on flat columns.
    entries = F.filter(F.zip_with(F.sequence(F.lit(0), F.size("counts") - 1), F.arrays_zip("counts", "shares"), lambda i, x: F.struct(i.alias("s"), x["counts"].alias("n"), x["shares"].alias("p"))), lambda e: e["n"] > 0)
    each = rows.select("lang", "counts", "shares", F.explode(entries).alias("e")).select("lang", "counts", "shares", "e.s", "e.p")
    met = each.select("lang", "s", "p", "counts", F.posexplode("shares").alias("t", "q"))
    met = met.select("lang", "s", "t", gap(F.col("p"), F.col("q")).alias("to"), F.when(F.get("counts", F.col("t")) == 0, gap(F.col("q"), F.col("p"))).alias("back"))
    both = cut(met.groupBy("lang", "s", "t").agg(F.sum("to").alias("to"), F.count("*").alias("n"), F.sum("back").alias("back"), F.count("back").alias("m")))
    first = both.select("lang", "s", "t", F.col("to").alias("v"), "n")
    second = both.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), F.col("back").alias("v"), F.col("m").alias("n"))
    added = first.unionByName(second).groupBy("lang", "s", "t").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    pairs = audit.select("lang", "size", "totals", "sources", F.posexplode("sources").alias("s", "source")).select("*", F.posexplode("sources").alias("t", "item")).where("s <> t")
    p, q = (share(none, F.get("totals", F.col(c)), F.col("size")) for c in ("s", "t"))
    pairs = pairs.join(added, ["lang", "s", "t"], "left").withColumn("rest", F.col("size") - F.coalesce("n", none))
    value = F.coalesce("v", none) + F.when(F.col("rest") > 0, F.col("rest") * gap(p, q)).otherwise(none)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    over = rows.select("lang", "term", "q", F.posexplode(F.arrays_zip("counts", "shares")).alias("s", "x")).where((F.col("x.counts") > 0) & (F.col("x.shares") > F.col("q")))
    over = over.join(audit.select("lang", F.posexplode("sources").alias("s", "source")), ["lang", "s"])
    told = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("x.shares"), F.col("q")).alias("value"))

    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = pairs.withColumn("rank", ranked).unionByName(told.withColumn("rank", ranked).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")

"""Connected components by contraction, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """v and label (the lowest vertex of its component) of each vertex in edges (a, b: long).

    Each round names every vertex after the least of itself and its neighbours and rewrites the edges to these names, once
    each, so that stars vanish at once; it ends when no edge is left. A chain whose vertices are spread at random takes about
    as many rounds as the logarithm of its length, one in ascending order as many as it has edges: name vertices by hashes.
    Then the names of the rounds are followed one after another. Nothing is collected but whether edges remain. A round's
    tables go when the next one's are written.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now: list[str] = []  # tables that this round reads
    left = cut(edges.where("a <> b").select(low, high).distinct(), now)
    found = None
    while True:
        ends = left.select(F.col("a").alias("v"), "b").unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("b")))
        names = cut(ends.groupBy("v").agg(F.min("b").alias("_least")).select("v", F.least("v", "_least").alias("name")), now)
        if found is None:
            found = names.select("v", F.col("name").alias("label"))
        else:
            found = found.join(names.select(F.col("v").alias("label"), "name"), "label", "left").select("v", F.coalesce("name", "label").alias("label"))
        if not left.limit(1).count():
            return found
        renamed = left.join(names.select(F.col("v").alias("a"), F.col("name").alias("_a")), "a").join(names.select(F.col("v").alias("b"), F.col("name").alias("_b")), "b")
        left = cut(renamed.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), following := [])
        found = cut(found, following)
        release(edges.sparkSession, now)
        now = following

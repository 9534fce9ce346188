"""Ranked branches, fusion, duplicate removal and diversity caps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import dedupe_key
from quillspark.operators.index import terms_of

#: Query vectors that go along to every task; of more, blocks of so many meet blocks of so many vectors.
BLOCK = 16_384
#: Rows of vectors, and columns of queries, that are multiplied at once; they bound a worker's memory.
ROWS, COLUMNS = 20_000, 256
#: Distances have six digits.
UNIT, FAR = 1_000_000, 1 << 40


def postings(texts: DataFrame) -> DataFrame:
    """term, id, tf of each word of (id, text)."""
    words = texts.select("id", F.explode(terms_of(F.col("text"))).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.size(terms_of(F.col("text"))).cast("long").alias("dl"))


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Nearest:
    """The k nearest vectors of each of some queries among all that were shown: a bounded heap for each query, kept as columns.

    Two of them merge by showing one what the other one holds. Ties go by id.
    """

    def __init__(self, numbers: np.ndarray, wanted: np.ndarray, labels: list[np.ndarray], apart: int, k: int) -> None:
        self.numbers, self.wanted, self.labels, self.apart, self.k = numbers, wanted, labels, apart, k
        self.d = np.full((0, len(numbers)), FAR, np.int64)
        self.ids = np.zeros((0, len(numbers)), np.int64)

    def show(self, ids: np.ndarray, v: np.ndarray, labels: list[np.ndarray]) -> None:
        """Vectors, whose first `apart` labels must differ from a query's, and whose others must be equal to its."""
        order = np.argsort(ids, kind="stable")  # ties then go by place
        ids, v, labels = ids[order], v[order], [x[order] for x in labels]
        held_d, held_ids = [], []
        for lo in range(0, len(self.numbers), COLUMNS):
            at = slice(lo, lo + COLUMNS)
            d = np.rint((1 - v @ self.wanted[at].T) * UNIT).astype(np.int64)
            for i, (mine, theirs) in enumerate(zip(labels, self.labels)):
                d[(mine[:, None] == theirs[None, at]) == (i < self.apart)] = FAR
            best = np.argpartition(d * len(ids) + np.arange(len(ids))[:, None], self.k - 1, axis=0)[: self.k] if len(ids) > self.k else np.tile(np.arange(len(ids))[:, None], (1, d.shape[1]))
            both_d, both_ids = np.vstack((self.d[:, at], np.take_along_axis(d, best, 0))), np.vstack((self.ids[:, at], ids[best]))
            first = np.lexsort((both_ids, both_d), axis=0)[: self.k]
            held_d.append(np.take_along_axis(both_d, first, 0))
            held_ids.append(np.take_along_axis(both_ids, first, 0))
        self.d, self.ids = np.hstack(held_d), np.hstack(held_ids)

    def found(self) -> pa.RecordBatch:
        some = self.d < FAR
        q = np.broadcast_to(self.numbers, self.d.shape)[some]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(self.ids[some], pa.int64()), pa.array(self.d[some] / UNIT, pa.float64())], ["q", "id", "d"])


def _shown(own: Nearest, part: pa.Table | pa.RecordBatch, labels: tuple[str, ...]) -> None:
    for at in range(0, part.num_rows, ROWS):
        piece = part.slice(at, ROWS)
        own.show(piece.column("id").to_numpy(zero_copy_only=False) if isinstance(part, pa.RecordBatch) else piece.column("id").to_numpy(), _vectors(piece.column("v")), [np.array(piece.column(c).to_pylist()) for c in labels])


def _asked(table: pa.Table, labels: tuple[str, ...], apart: int, k: int) -> Nearest:
    return Nearest(np.array(table["q"].to_pylist(), np.int64), _vectors(table["qv"]), [np.array(table[f"q_{c}"].to_pylist()) for c in labels], apart, k)


def nearest(passages: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None, apart: tuple[str, ...] = (), alike: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """q, id, d, rank (from 0) of the k nearest of (id, v) to each of the query vectors (q, qv), by cosine distance.

    Exact, for any number of queries; the filter comes first, null vectors are left out, ties go by id. Columns `apart` of
    both sides must differ, columns `alike` be equal (with q_ before their names on the side of the queries).

    Up to `block` queries go along to every task, which reads its vectors once, as matrix products over batches, and hands on
    k rows for each query. More queries are dealt to blocks, vectors too, and each pair of blocks meets in one task, which
    again hands on k rows for each of its queries.
    """
    both = (*apart, *alike)
    rows = (passages.where(allowed) if allowed is not None else passages).select("id", "v", *both).where("v IS NOT NULL")
    asked = queries.select("q", "qv", *[f"q_{c}" for c in both]).where("qv IS NOT NULL")
    schema = "q long, id long, d double"
    few = asked.limit(block + 1).toArrow()
    if few.num_rows <= block:
        shared = passages.sparkSession.sparkContext.broadcast(few)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _asked(shared.value, both, len(apart), k) if shared.value.num_rows else None
            for batch in batches:
                if own:
                    _shown(own, batch, both)
            if own:
                yield own.found()

        return ranked(rows.mapInArrow(task, schema), ["d", "id"], ["q"], k)
    across, down = math.ceil(asked.count() / block), max(1, math.ceil(rows.count() / (4 * block)))

    def cell(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        own = _asked(theirs, both, len(apart), k) if theirs.num_rows else None
        if own and mine.num_rows:
            _shown(own, mine, both)
            return pa.Table.from_batches([own.found()])
        return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})

    def everywhere(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    grid = rows.withColumn("_down", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("_across", everywhere(across))
    asked = asked.withColumn("_across", F.pmod(F.xxhash64("q"), F.lit(across)).cast("int")).withColumn("_down", everywhere(down))
    met = grid.groupBy("_down", "_across").cogroup(asked.groupBy("_down", "_across")).applyInArrow(cell, schema)
    return ranked(met, ["d", "id"], ["q"], k)


def ranked(rows: DataFrame, order: list, by: list[str] | None = None, k: int | None = None) -> DataFrame:
    """rows with their rank from 0, the first k of each group where k is given. The filter is on row_number() itself, so
    that each partition keeps k rows of a group ahead of the shuffle."""
    found = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))
    return (found if k is None else found.where(F.col("rank") <= k)).withColumn("rank", F.col("rank") - 1)


def top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows with their rank; only these meet in one task."""
    return ranked(rows.orderBy(*order).limit(k), order)


def nearest_to_any(passages: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """id, d, rank of the k passages with the least distance to any of a request's few query vectors.

    A passage among the k best by its least distance is among the k nearest of the query it is nearest to."""
    best = nearest(passages, queries, k).groupBy("id").agg(F.min("d").alias("d"))
    return top(best, ["d", "id"], k)


def fuse(branches: DataFrame, c: int = 60) -> DataFrame:
    """id, score, first, branches of ranked branch rows (branch_no, branch, id, rank from 0) by reciprocal ranks.

    Equal scores keep the order in which the branches first name an id.
    """
    first = F.col("branch_no") * 1_000_000 + F.col("rank")
    fused = branches.groupBy("id").agg(F.round(F.sum(1 / (c + 1 + F.col("rank"))), 9).alias("score"), F.min(first).alias("first"), F.sort_array(F.collect_set("branch")).alias("branches"))
    return fused


def first_of_key(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def without_near_equals(rows: DataFrame, order: list) -> DataFrame:
    return first_of_key(rows, dedupe_key(F.col("text")), order)


def cap_sizes(n: int) -> tuple[int, int]:
    """How many passages of a work and of an author a list of n may hold; halves round up."""
    return max(3, math.floor(n * 3 / 28 + 0.5)), max(4, math.floor(n * 4 / 28 + 0.5))


def diversify(rows: DataFrame, limit: int, work_cap: int, author_cap: int) -> DataFrame:
    """The first `limit` of rows (rank, work, author), those within both caps before the overflow: position from 1.

    The same as a greedy pass, because a work has one author.
    """
    kept = rows.withColumn("_w", F.row_number().over(Window.partitionBy("work").orderBy("rank")) <= work_cap)
    upto = Window.partitionBy("author").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_a", F.sum(F.col("_w").cast("int")).over(upto)).withColumn("overflow", ~(F.col("_w") & (F.col("_a") <= author_cap)))
    return _positions(kept.drop("_w", "_a"), limit)


def _positions(kept: DataFrame, limit: int) -> DataFrame:
    first = kept.orderBy("overflow", "rank").limit(limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy("overflow", "rank")))

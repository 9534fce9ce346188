"""Merkle manifest of a dataset: a digest of each row, of each source and of all, with proofs.

A part of the rows is a sparse forest: its unresolved nodes by tree, level and index. Forests form a commutative monoid.
Their merge unites nodes, and whenever a run of siblings, whose number follows from the tree's number of leaves, is complete,
the run becomes its parent. Blocks of neighbouring leaves become forests, and a tree of rounds merges sixteen forests each
until one is left; a fragment never holds more than the open ends of a stretch of leaves. The rounds are a treeReduce whose
runs, which proofs need, go to the shared folder instead of being lost, and nothing but the root goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, numbered

ARITY = 16
#: The tree whose leaves are the sources' subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, at long, width long, digests array<string>, open boolean"


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Unresolved nodes of a part of the leaves. trees: number of sources."""

    def __init__(self, trees: int) -> None:
        self.trees = trees
        self.open: dict[tuple[int, int, int], dict[int, str]] = {}  # by run: digests by place
        self.widths: dict[tuple[int, int], int] = {}

    def merge(self, nodes: Iterable[tuple[int, int, int, int, str]]) -> list[tuple[int, int, int, int, list[str]]]:
        """Add nodes (tree, level, index, number of nodes on that level, digest); the runs (tree, level, number, width,
        digests) that this completes."""
        left, closed = list(nodes), []
        while left:
            tree, level, at, width, d = left.pop()
            if width == 1 and tree != TOP and self.trees > 1:
                if not level:
                    closed.append((tree, 0, 0, 1, [d]))
                left.append((TOP, 0, tree, self.trees, d))
                continue
            run = self.open.setdefault((tree, level, at // ARITY), {})
            run[at % ARITY] = d
            self.widths[tree, level] = width
            if width > 1 and len(run) == min(ARITY, width - at // ARITY * ARITY):
                digests = [run[i] for i in range(len(run))]
                del self.open[tree, level, at // ARITY]
                closed.append((tree, level, at // ARITY, width, digests))
                left.append((tree, level + 1, at // ARITY, -(-width // ARITY), digest(digests)))
        return closed

    def nodes(self) -> list[tuple[int, int, int, int, str]]:
        return [(tree, level, run * ARITY + i, self.widths[tree, level], d) for (tree, level, run), held in self.open.items() for i, d in sorted(held.items())]


def row_digest(text: Column, names: tuple[str, ...] = FIELDS) -> Column:
    """sha256 of the fields one after another, each `-` if null, else its number of bytes, a colon and its value."""
    parts = [text if c == "text" else F.col(c).cast("string") for c in names]
    told = [F.when(p.isNull(), "-").otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reduce_forest(leaves: DataFrame, trees: int, rows: int, per: int) -> tuple[DataFrame, str]:
    """All completed runs (tree, level, at, width, digests) of leaves (no, tree, at, width, leaf), and the root."""

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(trees)
        closed = forest.merge(zip(frame["tree"], frame["level"], frame["at"], frame["width"], (d[0] for d in frame["digests"])))
        block = int(frame["block"].iloc[0])
        out = [(*x, False, block) for x in closed] + [(*x[:4], [x[4]], True, block) for x in forest.nodes()]
        return pd.DataFrame(out, columns=["tree", "level", "at", "width", "digests", "open", "block"])

    blocks = -(-rows // per)
    found = leaves.select("tree", F.lit(0).alias("level"), "at", "width", F.array("leaf").alias("digests"), F.floor(F.col("no") / per).alias("block"))
    runs = None
    while True:
        found = cut(found.groupBy("block").applyInPandas(merged, NODES + ", block long"))
        closed = found.where("NOT open").drop("open", "block")
        runs = closed if runs is None else runs.unionByName(closed)
        if blocks == 1:
            return runs, found.where("open").first()["digests"][0]
        found = found.where("open").drop("open").withColumn("block", F.floor(F.col("block") / ARITY))
        blocks = -(-blocks // ARITY)


def depth(width: int) -> int:
    """Levels of runs in a tree of so many leaves."""
    n = 0
    while width > 1:
        n, width = n + 1, -(-width // ARITY)
    return n


def step(place: Column, digests: Column) -> Column:
    return F.array(F.struct(place.cast("int").alias("place"), digests.alias("digests")))


def steps_above(runs: DataFrame, trees: int, widest: int, root: str) -> DataFrame:
    """Of each run of leaves (tree, run, digests): steps, from its parent to the root, each a place in a run and its digests;
    and subroot. Parents tell their children, sixteen each, so that no key is hot."""
    none = F.array().cast("array<struct<place: int, digests: array<string>>>")
    over = None
    if trees > 1:
        top = runs.where(F.col("tree") == TOP)
        over = top.where(F.col("level") == depth(trees) - 1).select("at", "digests", none.alias("steps"))
        for level in range(depth(trees) - 2, -1, -1):
            parent = over.select(F.col("at").alias("_up"), F.col("digests").alias("_run"), F.col("steps").alias("_steps"))
            own = top.where(F.col("level") == level).withColumn("_up", F.floor(F.col("at") / ARITY)).join(parent, "_up")
            over = own.select("at", "digests", F.concat(step(F.col("at") % ARITY, F.col("_run")), "_steps").alias("steps"))
        over = cut(over.select(F.col("at").alias("_up"), F.col("digests").alias("_run"), F.col("steps").alias("_steps")))

    def first(found: DataFrame) -> DataFrame:
        """Runs whose parent is a subroot."""
        if over is None:
            return found.select("tree", "at", "digests", none.alias("steps"), F.lit(root).alias("subroot"))
        found = found.withColumn("_up", F.floor(F.col("tree") / ARITY)).join(over, "_up")
        place = (F.col("tree") % ARITY).cast("int")
        return found.select("tree", "at", "digests", F.concat(step(place, F.col("_run")), "_steps").alias("steps"), F.get("_run", place).alias("subroot"))

    below = None
    for level in range(max(1, depth(widest)) - 1, -1, -1):
        own = runs.where((F.col("tree") != TOP) & (F.col("level") == level))
        found = first(own.where(F.col("width") <= ARITY))
        if below is not None:
            parent = below.select("tree", F.col("at").alias("_up"), F.col("digests").alias("_run"), "steps", "subroot")
            rest = own.where(F.col("width") > ARITY).withColumn("_up", F.floor(F.col("at") / ARITY)).join(parent, ["tree", "_up"])
            found = found.unionByName(rest.select("tree", "at", "digests", F.concat(step(F.col("at") % ARITY, F.col("_run")), "steps").alias("steps"), "subroot"))
        below = found
    return below.withColumnRenamed("at", "run")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def up(d: Column, s: Column) -> Column:
        before, after = F.slice(s["digests"], F.lit(1), s["place"]), F.slice(s["digests"], s["place"] + 2, F.lit(ARITY))
        return F.sha2(F.concat(F.array_join(before, ""), d, F.array_join(after, "")).cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def proof(steps: Column) -> Column:
    """Digest of all siblings, from the leaf's to the root's, left to right."""
    others = F.transform(steps, lambda s: F.array_join(F.filter(s["digests"], lambda d, i: i != s["place"]), ""))
    return F.sha2(F.array_join(others, "").cast("binary"), 256)


def manifest(docs: DataFrame, per: int = 16_384) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row, with its source.

    Sources, null first, then bytewise, are the leaves of the top tree; a source's rows are its leaves by doc_id, null first,
    those with equal ids by their leaf. Rows whose crc32 of the id leaves no remainder by 5 are tampered with before their
    root is folded again; a null id isn't. Texts may be null, empty or of any length; repeated rows are leaves of their own;
    extra columns are ignored; an empty table gives an empty result.

    per: leaves of a block, which a task holds at once with the runs that they complete.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    # Texts are read once. What stays of a row are two digests.
    base = docs.select("doc_id", "source", row_digest(F.col("text")).alias("leaf"), F.when(chosen, row_digest(tampered(F.col("text")))).alias("altered"))
    leaves = numbered(base, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")], "no")
    leaves = cut(leaves.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}))
    sources = leaves.groupBy("_null", "_source").agg(F.min("no").alias("_first"), F.count("*").alias("width"))
    sources = cut(numbered(sources, [F.asc("_first")], "tree"))
    trees, rows, widest = sources.agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0)), F.max("width")).first()
    if not trees:
        return docs.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string")
    leaves = leaves.join(sources, ["_null", "_source"]).withColumn("at", F.col("no") - F.col("_first"))
    leaves = cut(leaves.select("doc_id", "source", "leaf", "altered", "no", "tree", "at", "width"))
    runs, root = reduce_forest(leaves, trees, rows, per)
    above = steps_above(runs, trees, widest, root)
    if rows == 1:
        above = leaves.select("tree", F.lit(0).cast("long").alias("run"), F.array("leaf").alias("digests"), F.array().cast("array<struct<place: int, digests: array<string>>>").alias("steps"), F.lit(root).alias("subroot"))
    told = leaves.withColumn("run", F.floor(F.col("at") / ARITY)).join(above, ["tree", "run"])
    told = told.withColumn("steps", F.when(F.col("width") > 1, F.concat(step(F.col("at") % ARITY, F.col("digests")), "steps")).otherwise(F.col("steps")))
    told = told.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof(F.col("steps")).alias("proof_sha256"), fold(F.coalesce("altered", "leaf"), F.col("steps")).alias("folded_root"), "source")
    return told.select(*told.columns[:-1], (F.col("folded_root") == F.col("root")).alias("verified"), "source")

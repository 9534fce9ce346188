"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until the buckets are small."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, release, trim
from quillspark.llm.components import components
from quillspark.llm.shingles import BASE, mixed, shingles, signatures

LOWEST = -(1 << 63)
#: Bytes of text that are hashed together; bounds the memory of a worker, not the length of a text.
SLICE = 1_000_000
#: Bytes of text in a block of texts that are compared in full; bounds the memory of a worker.
BLOCK_BYTES = 4_000_000
#: Signatures by which the text in a component's midst is found; steps in which distances to it are told, rounded up.
SAMPLE, GRID = 64, 10_000
#: Bits of the map by which texts that are no candidates are kept from moving.
FILTER = 1 << 24
#: Runs before the first look at what is connected already.
FIRST_RUNS = 2


def slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, part in batch.groupby(batch["text"].str.len().cumsum() // SLICE, sort=False):
        yield part


def groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Groups of rows with the same key, from batches sorted by it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(batch[key].to_numpy())) + 1), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
    trim()


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the square matrix of links connects, one fewer than members."""
    edges, unseen = [], np.ones(len(near), bool)
    for root in range(len(near)):
        if not unseen[root]:
            continue
        unseen[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(near[i] & unseen):
                unseen[j] = False
                edges.append((i, int(j)))
                stack.append(int(j))
    return edges


class Splitter:
    """Where the sampled tokens of a node send its sets.

    A token is a coordinate of the signature with its value. A node samples each of the `width` coordinates with chance
    1 / (threshold * width), so that a pair at the threshold is expected to stay together in one child.
    """

    def __init__(self, threshold: float, width: int) -> None:
        self.limit = np.uint64(int(2**64 / (threshold * width)) - 1)
        self.coordinates = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(BASE))

    def children(self, nodes: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and the children that each goes to; nodes: the node of each row."""
        rows, at = np.nonzero(mixed(nodes[:, None] ^ self.coordinates[None, :]) < self.limit)
        return rows, mixed(nodes[rows] * np.uint64(BASE) + mixed(self.coordinates[at] ^ sigs[rows, at].astype(np.uint64)))


def together(level: int) -> float:
    """The chance that one run keeps a pair at the threshold in a common node of this level: a node that has both is
    expected to have one child that has both, so that the number of such children is about Poisson of mean 1."""
    chance = 1.0
    for _ in range(level):
        chance = 1 - math.exp(-chance)
    return chance


def runs_for(recall: float, level: int) -> int:
    """Runs after which a share `recall` of the pairs at the threshold has met in a node of this level."""
    return math.ceil(math.log(1 - recall) / math.log(1 - together(level)))


def signature_forest(sigs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect all sets whose signatures agree in `least` coordinates at least, one fewer than members."""
    edges, unseen, stack = [], np.arange(len(sigs)), []
    while len(unseen):
        if stack:
            i = stack.pop()
        else:
            i, unseen = int(unseen[0]), unseen[1:]
        near = (sigs[unseen] == sigs[i]).sum(axis=1) >= least
        found = unseen[near].tolist()
        edges += [(i, j) for j in found]
        stack += found
        unseen = unseen[~near]
    return edges


def _matrix(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), -1)


def representatives(named: DataFrame, k: int, width: int) -> DataFrame:
    """One row per different text with a word: id (64 bits of its MD5), sig, size (characters), at (where it is read: its
    lowest doc_id, or LOWEST where none of its rows has one). A null text counts as empty; a text without words has no row."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                hashes, starts = shingles(list(part["text"]), k)
                sigs = signatures(hashes, starts, width)
                full = np.diff(starts) > 0
                own = part[["id", "at", "none"]][full]
                yield own.assign(size=part["text"].str.len()[full], sig=[s.tobytes() for s in sigs[full]])

    rows = named.select("id", "at", F.col("doc_id").isNull().alias("none"), "text").mapInPandas(signed, "id long, at long, none boolean, size long, sig binary")
    lowest = F.coalesce(F.min(F.when(~F.col("none"), F.col("at"))), F.lit(LOWEST))
    return rows.groupBy("id", "sig").agg(lowest.alias("at"), F.max("size").alias("size"))


class ChosenPaths:
    """Edges (a, b) between texts that met in a small node and whose signatures agree in a share `near` at least.

    A run sends each set down two levels of the tree; nodes of up to `small` sets are compared in full, in larger ones the
    sets near a random leader are tied to it, and those so near it (`leave`) that all their partners are tied, too, leave;
    the rest goes down one level more. What is still large after `levels` levels is compared in full, block against block.
    """

    def __init__(self, reps: DataFrame, threshold: float, width: int, small: int, near: float, levels: int) -> None:
        self.split, self.sigs, self.small, self.levels = Splitter(threshold, width), reps.select("id", "sig"), small, levels
        # d(y, leader) <= d(x, leader) + d(x, y): partners of a set this near are tied, with a tenth for the estimates
        self.near, self.leave = math.ceil(near * width), math.ceil(min(1.0, near + (1 - threshold) + 0.1) * width)

    def run(self, sets: DataFrame, runs: Iterable[int]) -> tuple[DataFrame, DataFrame | None, int]:
        """Edges of these runs over sets (id, sig, label); the ids that went below the second level, and the deepest level.

        Nodes whose sets all have one label, of the component that they are known to belong to, are left out.
        """
        split, small, near, leave = self.split, self.small, self.near, self.leave
        runs, scratch = list(runs), []

        def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sigs, own = _matrix(batch["sig"]), batch[["id", "label"]]
                for run in runs:
                    top = np.full(len(own), mixed(np.array([run + 1], np.uint64) * np.uint64(BASE))[0], np.uint64)
                    rows, nodes = split.children(top, sigs)
                    again, nodes = split.children(nodes, sigs[rows])
                    yield own.iloc[rows[again]].assign(node=nodes.view(np.int64))

        def split_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sigs, own = _matrix(batch["sig"]), batch[["id", "label"]]
                agree = (sigs == _matrix(batch["leader_sig"])).sum(axis=1)
                tied, stays = agree >= near, agree < leave
                yield own[tied].assign(node=batch["leader"][tied], edge=True)
                rows, below = split.children(batch["node"].to_numpy()[stays].view(np.uint64), sigs[stays])
                yield own[stays].iloc[rows].assign(node=below.view(np.int64), edge=False)

        def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in groups(batches, "bucket"):
                ids = part["id"].to_numpy()
                edges = np.array(signature_forest(_matrix(part["sig"]), near), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": ids[edges[:, 0]], "b": ids[edges[:, 1]]})

        paths = cut(sets.select("id", "sig", "label").mapInPandas(roots, "id long, label long, node long"), scratch)
        edges, buckets, crowds, level = None, None, None, 2
        while True:
            nodes = paths.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("label").alias("lo"), F.max("label").alias("hi"))
            nodes = cut(nodes.where("lo <> hi").select("node", "n", "x"), scratch)
            few = nodes.where(F.col("n") <= small).groupBy("n", "x").agg(F.min("node").alias("node"))  # of equal nodes one
            here = paths.join(few.select("node"), "node").select(F.col("node").alias("bucket"), "id")
            buckets = here if buckets is None else buckets.unionByName(here)
            large = nodes.where(F.col("n") > small).select("node", "n")
            if not large.limit(1).count():
                break
            crowd = cut(paths.join(large, "node"), scratch)
            if level == self.levels:
                buckets = buckets.unionByName(_block_pairs(crowd, small))
                break
            level += 1
            crowds = crowd.select("id") if crowds is None else crowds.unionByName(crowd.select("id"))
            leaders = crowd.groupBy("node").agg(F.min_by("id", F.xxhash64("node", "id")).alias("leader"))
            leaders = cut(leaders.join(self.sigs.select(F.col("id").alias("leader"), F.col("sig").alias("leader_sig")), "leader"), scratch)
            rows = crowd.drop("n").join(leaders, "node").join(self.sigs, "id")
            dealt = cut(rows.mapInPandas(split_on, "id long, label long, node long, edge boolean"), scratch)
            tied = dealt.where("edge and id <> node").select(F.col("node").alias("a"), F.col("id").alias("b"))
            edges = tied if edges is None else edges.unionByName(tied)
            paths = dealt.where("not edge").select("id", "label", "node")
        signed = buckets.join(self.sigs, "id").repartition("bucket").sortWithinPartitions("bucket")
        found = signed.mapInPandas(compared, "a long, b long")
        edges = cut(found if edges is None else found.unionByName(edges))
        crowds = None if crowds is None else cut(crowds.distinct())
        release(sets.sparkSession, scratch)
        return edges, crowds, level


def _block_pairs(crowd: DataFrame, small: int) -> DataFrame:
    """Buckets (bucket, id) in which any two sets of a node meet: its blocks of about small / 2 sets, two at a time."""
    blocks = F.ceil(2 * F.col("n") / small)
    dealt = crowd.withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return dealt.where("own <> other").select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "id")


def candidate_components(reps: DataFrame, threshold: float, width: int, recall: float, small: int, near: float, levels: int) -> DataFrame:
    """v and label of all texts that candidate edges connect; see ChosenPaths.

    Runs are repeated until a pair at the threshold has met with a chance of `recall`: for pairs of small nodes as many as
    the second level takes, for sets in nodes that went deeper as many as the deepest of those levels takes. After the
    first runs, only nodes that would connect components are looked at: what is in one component is compared in full
    later anyhow.
    """
    paths = ChosenPaths(reps, threshold, width, small, near, levels)
    done, wanted = min(FIRST_RUNS, runs_for(recall, 2)), runs_for(recall, 2)
    edges, _, _ = paths.run(reps.select("id", "sig", F.col("id").alias("label")), range(done))
    sets = reps.select("id", "sig")
    found = cut(components(edges))
    while done < wanted:
        named = found.select(F.col("v").alias("id"), "label")
        labelled = cut(sets.join(named, "id", "left").select("id", "sig", F.coalesce("label", "id").alias("label")))
        more, crowds, deepest = paths.run(labelled, range(done, wanted))
        edges, done = edges.unionByName(more), wanted
        found = cut(components(edges))
        if crowds is None:
            break
        sets, wanted = cut(sets.join(crowds, "id", "left_semi")), runs_for(recall, deepest)
    return found


def text_classes(
    docs: DataFrame, threshold: float = 0.8, k: int = 5, width: int = 64, recall: float = 0.999, small: int = 4096, block: int = 512, slack: float = 0.2, levels: int = 12
) -> DataFrame:
    """One row per different text: key (its MD5), doc_id (its lowest), class_id, first_key, n_links, n_copies.

    class_id and first_key are the lowest doc_id of the class and the text that has it (nulls last, the lowest MD5 among
    equals). Vertices are texts, so that neither repeated nor null ids join or hide any. The rest as in jaccard_join().
    """
    named = _named(docs)
    reps = cut(representatives(named, k, width))
    near = candidate_components(reps, threshold, width, recall, small, threshold - slack, levels)
    members = cut(near.join(reps.select(F.col("id").alias("v"), "at", "size", "sig"), "v"))
    sizes = cut(members.groupBy("label").agg(_blocks(block).alias("blocks")))
    # Rows without an id all have one place: of those with one text, one is looked at.
    held = named.where("doc_id IS NOT NULL").unionByName(named.where("doc_id IS NULL").dropDuplicates(["id"])).select(F.col("id").alias("v"), "at", "text")
    texts = members.drop("sig").join(sizes, "label").join(_maybe(held, members), ["v", "at"])
    texts = cut(texts.dropDuplicates(["v"]))  # those of candidates alone; all texts are shuffled once for them
    rows = texts.where("blocks = 1").select("v", "text", F.xxhash64("label").alias("pair"), F.lit(0).alias("side"))
    large = sizes.where("blocks > 1").select("label")
    inner = None
    if large.limit(1).count():
        inner, crossing = _large(texts.where("blocks > 1").select("v", "label", "size", "text"), members.join(large, "label"), k, threshold, block)
        rows = rows.unionByName(crossing)
    rows = rows.repartition("pair").sortWithinPartitions("pair")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in groups(batches, "pair"):
            ids, side = part["v"].to_numpy(), part["side"].to_numpy()
            linked = links(list(part["text"]), k, threshold)
            if side.max() > 0:  # two blocks: only what crosses
                linked &= side[:, None] != side[None, :]
            counts = linked.sum(axis=1)
            edges = forest(linked)
            yield pd.DataFrame({"a": ids, "b": ids, "n": counts}).loc[counts > 0]
            if edges:
                i, j = np.array(edges).T
                yield pd.DataFrame({"a": ids[i], "b": ids[j], "n": 0})

    linked = rows.mapInPandas(verified, "a long, b long, n long")
    found = cut(linked if inner is None else linked.unionByName(inner))
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    classes = cut(components(found.where("n = 0").select("a", "b")).select(F.col("v").alias("id"), "label"))
    copies = cut(named.groupBy("key", "id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    firsts = classes.join(copies, "id").groupBy("label").agg(first.alias("first")).select("label", F.col("first.doc_id").alias("class_id"), F.col("first.key").alias("first_key"))
    told = copies.join(classes.join(firsts, "label"), "id", "left").join(counts, "id", "left")
    class_id = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")
    return cut(told.select("key", "doc_id", class_id, F.coalesce("first_key", "key").alias("first_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"))


def _maybe(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows of which v may be a member's, all of those whose v is: the bits of a map of fixed size tell, which is broadcast as
    FILTER / 64 rows at most. So the texts of most others don't move; a map that very many members fill lets all through."""

    def bit(v: Column) -> Column:
        return F.pmod(v, F.lit(FILTER))

    bits = members.select(bit(F.col("v")).alias("b")).groupBy(F.shiftright("b", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("_bits"))
    met = rows.withColumn("_word", F.shiftright(bit(F.col("v")), 6)).join(F.broadcast(bits), "_word")
    return met.where(F.call_function("shiftright", F.col("_bits"), (bit(F.col("v")) % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1).drop("_word", "_bits")


def _blocks(block: int) -> Column:
    """Blocks of about `block` texts, and of BLOCK_BYTES characters at most on average."""
    return F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_BYTES))


def _large(texts: DataFrame, members: DataFrame, k: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """What links texts (v, label, size, text) of components of several blocks: links (a, b, n) that need no comparison, and
    the texts (v, text, pair, side) that are still to be compared, block against block.

    Of each component one text in its midst is the pivot. The Jaccard distance keeps the triangle inequality, so that all
    texts within half the distance of a link from the pivot are linked with each other, and counting them counts their
    links. The others are compared with each other and with these. A crowd of near copies so takes one comparison a text.
    """
    sample = members.withColumn("_n", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("v")))).where(F.col("_n") <= SAMPLE)
    seen = sample.groupBy("label").agg(F.collect_list("sig").alias("seen"))  # SAMPLE signatures each

    def agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = _matrix(batch["sig"])
            yield batch[["v", "label"]].assign(score=[int((_matrix(pd.Series(seen)) == sig).sum()) for sig, seen in zip(own, batch["seen"])])

    scored = members.join(seen, "label").select("v", "label", "sig", "seen").mapInPandas(agreeing, "v long, label long, score long")
    pivots = cut(scored.groupBy("label").agg(F.max_by("v", F.struct("score", "v")).alias("pivot")))
    texts = texts.join(pivots, "label")
    centre = cut(texts.where("v = pivot").select("label", F.col("text").alias("centre")))
    most = math.floor((1 - threshold) / 2 * GRID)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            near = []
            for text, middle in zip(batch["text"], batch["centre"]):
                if known[0] != middle:
                    known = middle, np.unique(shingles([middle], k)[0])
                own = np.unique(shingles([text], k)[0])
                both = len(np.intersect1d(own, known[1], assume_unique=True))
                union = len(own) + len(known[1]) - both
                near.append(math.ceil((union - both) / union * GRID) <= most)
            yield batch[["v", "label", "pivot", "size"]].assign(near=near)

    told = cut(texts.join(centre, "label").select("v", "label", "pivot", "size", "text", "centre").mapInPandas(measured, "v long, label long, pivot long, size long, near boolean"))
    counts = told.groupBy("label").agg(F.count_if("near").alias("_near"))
    inside = told.where("near").join(counts, "label")
    links_ = inside.where("_near > 1").select(F.col("v").alias("a"), F.col("v").alias("b"), (F.col("_near") - 1).alias("n"))
    ties = inside.where("v <> pivot").select(F.col("pivot").alias("a"), F.col("v").alias("b"), F.lit(0).cast("long").alias("n"))
    blocks = cut(told.groupBy("label", "near").agg(_blocks(block).alias("b")).groupBy("label").agg(F.coalesce(F.max(F.when(F.col("near"), F.col("b"))), F.lit(0)).alias("_in"), F.coalesce(F.max(F.when(~F.col("near"), F.col("b"))), F.lit(0)).alias("_out")))
    # Blocks 0 to _out - 1 hold what is outside and meet all blocks; the others meet these alone.
    dealt = told.join(blocks.where("_out > 0"), "label")
    own = F.when(F.col("near"), F.col("_out") + F.pmod(F.xxhash64("v"), F.col("_in"))).otherwise(F.pmod(F.xxhash64("v"), F.col("_out")))
    met = F.when(F.col("near"), F.col("_out")).otherwise(F.col("_out") + F.col("_in"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1)))
    pair = F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    crossing = dealt.select("v", pair.alias("pair"), side.alias("side")).join(texts.select("v", "text"), "v").select("v", "text", "pair", "side")
    return links_.unionByName(ties), crossing


def _named(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", text_key())
    return named.withColumn("id", F.conv(F.substring("key", 1, 16), 16, -10).cast("long")).withColumn("at", F.coalesce("doc_id", F.lit(LOWEST)))


def text_key(text: str = "text") -> Column:
    """MD5 of a text; a null one counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def jaccard_join(docs: DataFrame, **parameters: float) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of each document; parameters: those of text_classes().

    Two texts are linked if their sets of k-word shingles have a Jaccard similarity of `threshold` at least. class_id is
    the lowest doc_id of all texts that links connect (equal texts included), n_links the number of different texts that
    the document's text is linked with, n_copies that of documents with the same text.
    Chosen-path splitting is repeated until a pair at the threshold has met with a chance of `recall`, whatever the depth
    of its nodes (see candidate_components()). Signatures rule out buckets' far pairs (those `slack` below the threshold),
    what stays connected is compared exactly and in full, in blocks of up to about `block` texts against each other, where
    only counts and connecting links leave a task; in components of several blocks, texts near a pivot are linked without
    (see _large()).
    Null texts count as empty; equal texts without words are copies but link to nothing; a null doc_id stays null, and
    class_id is null where no document of a class has an id; different texts with one id are linked, counted and classed
    each on its own (their classes may have the same class_id); extra columns are ignored.
    """
    told = text_classes(docs, **parameters)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key")).join(told.drop("doc_id"), "key").select("doc_id", "class_id", "n_links", "n_copies")


def links(texts: list[str], k: int, threshold: float) -> np.ndarray:
    """Square matrix of which texts are linked, by exact counts of shared shingles; none with itself."""
    m = len(texts)
    hashes, starts = shingles(texts, k)
    owner = np.repeat(np.arange(m), np.diff(starts))
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, bool)
    hashes, owner = hashes[new], owner[new]
    sizes = np.bincount(owner, minlength=m).astype(np.float64)
    first = np.concatenate(([True], hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    owner, at = owner[shared], np.flatnonzero(np.concatenate(([True], np.diff(column[shared]) > 0))) if shared.any() else np.zeros(0, int)
    both = np.zeros((m, m))
    if len(at):
        # Shingles that the same texts share are one column with a weight: 64 random bits a text, summed over its owners.
        told, pick, column, weight = np.unique(np.add.reduceat(mixed((owner + 1).astype(np.uint64) * np.uint64(BASE)), at), return_index=True, return_inverse=True, return_counts=True)
        ends = np.append(at, len(owner))[1:]
        kept = np.isin(np.arange(len(at)), pick)
        owner, column = owner[np.repeat(kept, ends - at)], np.repeat(column, ends - at)[np.repeat(kept, ends - at)]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 2048
        for lo in range(0, len(told), width):
            a, b = np.searchsorted(column, [lo, lo + width])
            has = np.zeros((m, min(width, len(told) - lo)), np.float32)
            has[owner[a:b], column[a:b] - lo] = 1
            both += (has * weight[lo : lo + width].astype(np.float32)) @ has.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = (both >= threshold * union - 1e-9) & (both > 0)
    np.fill_diagonal(linked, False)
    return linked
